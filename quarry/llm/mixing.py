"""Mixing sources to target weights by weighted fair queueing.

The documents of each source are shuffled by a hash of their id. A document's virtual finish time is its source's
cumulative tokens, itself included, divided by the source's weight. The order of finish times interleaves the sources
in proportion to their weights; it is cut where the cumulative tokens of all would exceed the budget.

Neither sum runs over one source or the whole corpus in one task. Each source is cut into slices of the hash, whose
totals give every slice its start, so a window runs within a slice only and a hot source spreads over as many tasks as
its share needs. The global order comes from a range partitioning on the finish time; partition totals give each
partition its start. Token counts and statistics cover all documents.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import _runtime as rt

#: Share of each source in the mixture, by its name; others have OTHER.
WEIGHTS = {"src0": 1.0, "src1": 4.0, "src2": 4.0, "src3": 2.0, "src4": 2.0}
OTHER = 1.0
#: The budget as a share of all tokens.
BUDGET_SHARE = 0.5
SLICES = 4096


def _weight(source: Column, weights: dict[str, float], other: float) -> Column:
    out = F.lit(float(other))
    for name, weight in weights.items():
        out = F.when(source == name, F.lit(float(weight))).otherwise(out)
    return out


def _shuffle_key(doc_id: Column) -> Column:
    """A multiplicative hash of the id in [0, 2^31), which SQL engines compute alike."""
    low = F.pmod(doc_id, F.lit(2147483647))
    return F.pmod(F.pmod(low * F.lit(1103515245) + F.lit(12345), F.lit(2147483647)) * F.lit(48271), F.lit(2147483647))


def tokens_of(text: Column) -> Column:
    """Tokens are runs of characters other than white space."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")), F.lit(0)).cast("long")


def mixture(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    other: float = OTHER,
    budget_share: float = BUDGET_SHARE,
    slices: int = SLICES,
) -> DataFrame:
    """The mixed documents: doc_id, source, tokens, finish (virtual finish time), total (cumulative tokens), place.

    The budget is ``floor(budget_share * tokens of all documents)``; documents up to the first that would exceed it are
    returned. Ties of finish time go by source, then doc_id; ``place`` counts from 1.

    Defined cases: a null source is a source of its own, named ''. A null or empty text has 0 tokens, keeps its place in
    its source's order and is taken if it comes before the cut. Rows with a null id are not mixed. Rows that repeat an
    id are one document, the one with the most tokens, then the least source. Sources of weight 0 or less are left out.
    An empty table gives no rows. Other columns are not read.
    """
    weights = WEIGHTS if weights is None else weights
    sized = (
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            F.coalesce("source", F.lit("")).alias("source"),
            tokens_of(F.col("text")).alias("tokens"),
        )
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg(F.min(F.struct((-F.col("tokens")).alias("less"), "source")).alias("b"))
        .select("doc_id", "b.source", (-F.col("b.less")).alias("tokens"))
        .withColumn("key", _shuffle_key(F.col("doc_id")))
        .withColumn("slice", F.floor(F.col("key") * slices / 2147483647).cast("int"))
    )
    sized = rt.written(sized, "mixing-sizes")
    weighed = sized.withColumn("weight", _weight(F.col("source"), weights, other)).where("weight > 0")
    budget = F.floor(F.lit(budget_share) * F.col("all"))

    totals = weighed.groupBy("source", "slice").agg(F.sum("tokens").alias("slice_tokens"))
    starts = totals.select(
        "source",
        "slice",
        (
            F.sum("slice_tokens").over(
                Window.partitionBy("source").orderBy("slice").rowsBetween(Window.unboundedPreceding, 0)
            )
            - F.col("slice_tokens")
        ).alias("before"),
    )
    within = Window.partitionBy("source", "slice").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    timed = (
        weighed.withColumn("upto", F.sum("tokens").over(within))
        .join(starts, ["source", "slice"])
        .withColumn("finish", (F.col("before") + F.col("upto")).cast("double") / F.col("weight"))
        .select("doc_id", "source", "tokens", "finish")
    )
    ranged = rt.written(
        timed.repartitionByRange("finish", "source", "doc_id").withColumn("part", F.spark_partition_id()), "mixing-timed"
    )
    parts = ranged.groupBy("part").agg(F.sum("tokens").alias("t"), F.count("*").alias("n"))
    upto = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)  # one row for each range partition
    parts = parts.select(
        "part",
        (F.sum("t").over(upto) - F.col("t")).alias("tokens_before"),
        (F.sum("n").over(upto) - F.col("n")).alias("rows_before"),
    )
    grand = sized.agg(F.sum("tokens").alias("all")).select(budget.cast("long").alias("budget"))
    inner = Window.partitionBy("part").orderBy("finish", "source", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.join(parts, "part")
        .crossJoin(F.broadcast(grand))  # one row
        .where("tokens_before <= budget")
        .withColumn("total", F.col("tokens_before") + F.sum("tokens").over(inner))
        .withColumn("place", F.col("rows_before") + F.row_number().over(inner))
        .where("total <= budget")
        .select("doc_id", "source", "tokens", "finish", "total", "place")
    )


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixture(rt.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mixture, in its order.

    Texts that a bitmap of the mixture's ids tells to be out of it are not shuffled. Defined cases: of rows that repeat
    an id the one that was counted stays, of those that tie the first by text, of equal ones any. Null and empty texts
    have no tokens and stay where their place is before the cut; very long ones count whole. Rows with a null id are in
    no mixture and go. An empty table stays empty. Further columns, whatever their names, are passed on.
    """
    key, place, tokens, nth = rt.fresh(docs, "mixed", "place", "tokens", "nth")
    mixed = rt.written(mixture(docs).select(F.col("doc_id").alias(key), F.col("place").alias(place)), "mixing-places")
    may = rt.screen_of(mixed.select(key))
    one = Window.partitionBy(key).orderBy(F.col(tokens).desc(), F.coalesce("source", F.lit("")), "text")
    joined = docs.where(may(F.col("doc_id"))).join(mixed, F.col("doc_id") == F.col(key))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        joined = (
            joined.withColumn(tokens, tokens_of(F.col("text")))
            .withColumn(nth, F.row_number().over(one))
            .where(F.col(nth) == 1)
        )
    return joined.repartitionByRange(place).sortWithinPartitions(place).select(*docs.columns)


def sql(
    weights: dict[str, float] | None = None, other: float = OTHER, budget_share: float = BUDGET_SHARE
) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {float(v)!r}" for k, v in (WEIGHTS if weights is None else weights).items())
    return f"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS source,
                  coalesce(len(regexp_extract_all(text, '[^ \\t\\n\\x0B\\f\\r]+')), 0)::BIGINT AS tokens
           FROM documents WHERE doc_id IS NOT NULL),
e AS (SELECT doc_id, source, tokens FROM
        (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY tokens DESC, source) AS k FROM d) WHERE k = 1),
k AS (SELECT *, ((doc_id % 2147483647) * 1103515245 + 12345) % 2147483647 * 48271 % 2147483647 AS key,
             CASE source {cases} ELSE {float(other)!r} END AS weight FROM e),
f AS (SELECT doc_id, source, tokens,
             (sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING))::DOUBLE / weight::DOUBLE AS finish
      FROM k WHERE weight > 0),
g AS (SELECT *, (sum(tokens) OVER (ORDER BY finish, source, doc_id ROWS UNBOUNDED PRECEDING))::BIGINT AS total,
             row_number() OVER (ORDER BY finish, source, doc_id) AS place FROM f)
SELECT doc_id, source, tokens, finish, total, place FROM g
WHERE total <= (SELECT floor({budget_share!r} * sum(tokens)) FROM e)"""


QUERIES = {"op10_mixing": op10_mixing}
SQL = {"op10_mixing": sql()}
