"""Benchmark decontamination: prefix-filtered set join of benchmark items with item-sized document windows.

A document leaks an item if some window of as many words as the item has holds at least ``threshold`` of the
item's distinct word shingles. Items of fewer words than a shingle have one shingle, of all their words.

Method. The documents' shingles that occur in the benchmark (a bitmap of fixed size screens them while the text is
read once; a join on the hash makes it exact) become a table of hits. Its document frequencies order the shingles of
each item by rarity. A window with ``need = ceil(threshold * m)`` of the item's m shingles must hold one of the
``m - need + 1`` rarest, so only these prefix tokens are joined; documents too short for ``need`` shingles and
matches too near the document's ends for a long enough window are dropped before the exact count over windows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import _runtime as rt
from quarry.llm import _text as tx

SHINGLE = 5
THRESHOLD = 0.8
BITS = 24


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _grams(w: tx.Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of that many words by the position of their first word, told apart from those of other sizes."""
    h, valid = tx.ngram_hashes(w.hashes()[w.codes], w.offsets, size)
    return tx.mix(h + np.uint64(size)), valid


def _bench_shingles(size: int):
    """Rows (item_id, shingle, item_words, size)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rt.chunks(batches):
            w = tx.words(batch.column(1))
            counts, owner = w.counts(), w.owners()
            for n in range(1, size + 1):
                h, valid = _grams(w, n)
                at = np.flatnonzero(valid & ((counts >= size) if n == size else (counts == n))[owner])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner[at])),
                        pa.array(_signed(h[at])),
                        pa.array(counts[owner[at]].astype(np.int32)),
                        pa.array(np.full(len(at), n, np.int32)),
                    ],
                    ["item_id", "shingle", "item_words", "size"],
                )

    return run


def _doc_hits(sizes: list[int], screen):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = np.unpackbits(np.frombuffer(screen.value, np.uint8)).view(bool)
        for batch in rt.chunks(batches):
            w = tx.words(batch.column(1))
            for size in sizes:
                h, valid = _grams(w, size)
                at = np.flatnonzero(valid & bitmap[(h >> np.uint64(64 - BITS)).astype(np.int64)])
                owner = np.searchsorted(w.offsets, at, side="right") - 1
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(owner)),
                        pa.array((at - w.offsets[owner]).astype(np.int32)),
                        pa.array(_signed(h[at])),
                        pa.array(w.counts()[owner].astype(np.int32)),
                    ],
                    ["doc_id", "pos", "shingle", "doc_words"],
                )

    return run


def contaminated(
    docs: DataFrame, benchmark: DataFrame, size: int = SHINGLE, threshold: float = THRESHOLD
) -> DataFrame:
    """Pairs (item_id, doc_id) where the document holds the item, with the best window's figures.

    Columns: item_id, doc_id, matched (distinct shingles of the item in the best window), shingles (of the item),
    containment, start_word (of the first best window).

    Defined cases: rows with a null id or null text match nothing, nor do empty texts. An item of fewer than ``size``
    words matches where all its words stand in order. Very long texts are searched whole. Rows that repeat an id count as
    one text with the positions of each; a pair is returned once, and of windows that tie the first. Further columns of
    either table, whatever their names, are not read. An empty table on either side gives no rows.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").where(
        "item_id IS NOT NULL AND text IS NOT NULL"
    )
    shingles = rt.written(
        items.mapInArrow(_bench_shingles(size), "item_id long, shingle long, item_words int, size int")
        .groupBy("item_id", "shingle", "size")
        .agg(F.max("item_words").alias("item_words"))
        .withColumn("shingles", F.count("*").over(Window.partitionBy("item_id")))
        .withColumn("need", F.ceil(F.lit(threshold) * F.col("shingles") - 1e-9)),
        "decontaminate-items",
    )
    # Bits of a screen of fixed size: at most 2^BITS numbers reach the driver however large the benchmark is.
    set_bits = shingles.select(F.shiftrightunsigned("shingle", 64 - BITS).alias("b")).distinct().toArrow()["b"]
    bitmap = np.zeros(1 << BITS, bool)
    bitmap[set_bits.to_numpy()] = True
    screen = spark.sparkContext.broadcast(np.packbits(bitmap).tobytes())
    sizes = [r["size"] for r in shingles.select("size").distinct().orderBy("size").collect()]  # ``size`` at most

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    hits = rt.written(
        texts.mapInArrow(_doc_hits(sizes, screen), "doc_id long, pos int, shingle long, doc_words int").join(
            shingles.select("shingle").distinct(), "shingle", "left_semi"
        ),
        "decontaminate-hits",
    )

    rarity = hits.groupBy("shingle").agg(F.countDistinct("doc_id").alias("df"))
    ranked = shingles.join(rarity, "shingle").withColumn(
        # Shingles that no document has are the rarest, but cannot match: they count towards the prefix only.
        "rank",
        F.row_number().over(Window.partitionBy("item_id").orderBy("df", "shingle")),
    )
    absent = F.col("shingles") - F.count("*").over(Window.partitionBy("item_id"))
    prefix = (
        ranked.withColumn("absent", absent)
        .where("absent + rank <= shingles - need + 1")
        .select("item_id", "shingle", "item_words", "size", "need", "shingles")
    )
    candidates = (
        hits.join(prefix, "shingle")
        .where("doc_words - size + 1 >= need")
        .withColumn("first", F.greatest(F.lit(0), F.col("pos") - (F.col("item_words") - F.col("size"))))
        .withColumn("last", F.least(F.col("doc_words"), F.col("pos") + F.col("item_words")) - F.col("size"))
        .where("last - first + 1 >= need")
        .select("doc_id", "item_id")
        .distinct()
    )
    found = (
        candidates.join(shingles, "item_id")
        .join(hits.select("doc_id", "shingle", "pos").distinct(), ["doc_id", "shingle"])
        .withColumn("reach", F.col("item_words") - F.col("size"))
        .select("doc_id", "item_id", "shingle", "pos", "reach", "need", "shingles")
    )
    # Every best window can start at a hit. Starts meet the hits of their own and the next stretch of ``reach`` words,
    # so the work stays in proportion to the hits even in long documents.
    stretch = F.floor(F.col("pos") / (F.col("reach") + 1))
    starts = found.select(
        "doc_id", "item_id", F.col("pos").alias("start_word"), F.explode(F.array(stretch, stretch + 1)).alias("stretch")
    ).distinct()
    best = (
        starts.join(found.withColumn("stretch", stretch), ["doc_id", "item_id", "stretch"])
        .where("pos BETWEEN start_word AND start_word + reach")
        .groupBy("doc_id", "item_id", "start_word", "need", "shingles")
        .agg(F.countDistinct("shingle").alias("matched"))
        .where("matched >= need")
        .groupBy("item_id", "doc_id", "shingles")
        .agg(F.max(F.struct("matched", -F.col("start_word"))).alias("b"))
    )
    return best.select(
        "item_id",
        "doc_id",
        F.col("b.matched").alias("matched"),
        F.col("shingles").alias("shingles"),
        (F.col("b.matched") / F.col("shingles")).alias("containment"),
        (-F.col("b.col2")).cast("long").alias("start_word"),
    )


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(
        rt.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    )


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that hold no benchmark item.

    Defined cases: rows with a null id or a null or empty text stay, as they match nothing. Rows that repeat an id count
    as one text, so all of them stay or go; of ties nothing depends. Very long texts are searched whole. An empty table,
    or an empty benchmark, leaves the documents as they are. Further columns, whatever their names, are passed on.
    """
    leaks = contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return rt.without(docs, leaks.select("doc_id").distinct())


def sql(size: int = SHINGLE, threshold: float = THRESHOLD) -> str:
    # Java and DuckDB both give ceil() of a product that may sit a rounding error above a whole number.
    split = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')"
    return f"""
WITH iw AS (SELECT item_id, {split} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
dw AS (SELECT doc_id, {split} AS w FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
ig AS (SELECT DISTINCT item_id, len(w) AS item_words, s, array_to_string(w[i : i + s - 1], ' ') AS g
       FROM (SELECT item_id, w, least({size}, len(w)) AS s, unnest(range(1, len(w) - least({size}, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
im AS (SELECT item_id, count(*) AS shingles FROM ig GROUP BY item_id),
dg AS (SELECT doc_id, i - 1 AS pos, s, array_to_string(w[i : i + s - 1], ' ') AS g
       FROM (SELECT doc_id, w, s, unnest(range(1, len(w) - s + 2)) AS i FROM dw, (SELECT DISTINCT s FROM ig) WHERE len(w) >= s)),
h AS (SELECT ig.item_id, dg.doc_id, dg.pos, ig.g, ig.item_words, s FROM dg JOIN ig USING (s, g)),
win AS (SELECT a.item_id, a.doc_id, a.pos AS start_word, count(DISTINCT b.g) AS matched
        FROM (SELECT DISTINCT item_id, doc_id, pos, item_words, s FROM h) a
        JOIN h b ON a.item_id = b.item_id AND a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + a.item_words - a.s
        GROUP BY 1, 2, 3),
r AS (SELECT win.*, shingles, row_number() OVER (PARTITION BY item_id, doc_id ORDER BY matched DESC, start_word) AS k
      FROM win JOIN im USING (item_id) WHERE matched >= ceil({threshold} * shingles - 1e-9))
SELECT item_id, doc_id, matched::BIGINT AS matched, shingles::BIGINT AS shingles,
       matched::DOUBLE / shingles AS containment, start_word::BIGINT AS start_word
FROM r WHERE k = 1"""


QUERIES = {"op1_decontaminate": op1_decontaminate}
SQL = {"op1_decontaminate": sql()}
