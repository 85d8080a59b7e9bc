"""Exact top-k search of every query over all documents, by MaxScore on shards of postings.

Documents are cut into shards, each holding the postings of the query terms only. Document frequencies and lengths over
all shards give the BM25 weights. Within a shard a query's terms are ordered by the highest score that any posting of
theirs has there. Those whose bounds add up to less than the k-th best score so far are non-essential: a document that
has only such terms cannot come into the result. The essential postings are added up; the others are probed, from the
highest bound on, for the documents that can still reach the k-th best. The k best of each shard are merged by rank.

The k-th best score is raised as a shard's terms are read and goes on from shard to shard of one task. Documents are
dropped only where their bound is below it, so ties are kept, and scores are whole numbers (BM25 times ``UNIT``), so
they don't depend on the order of addition.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from quarry.llm import _runtime as rt
from quarry.llm import _text as tx

TOP = 10
K1 = 1.2
B = 0.75
UNIT = 10_000
SHARD_DOCS = 8192
QUERY_TERMS = 2_000_000  # terms of the queries that are searched in one pass

_POSTINGS = "shard long, docs binary, lengths binary, terms binary, starts binary, places binary, tfs binary, n long, words long"


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (item_id, term, times)."""
    for batch in rt.chunks(batches):
        w = tx.words(batch.column(1))
        h = w.hashes()[w.codes].view(np.int64)
        owner = w.owners()
        order = np.lexsort((h, owner))
        owner, h = owner[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
        starts = np.flatnonzero(new)
        yield pa.RecordBatch.from_arrays(
            [
                batch.column(0).take(pa.array(owner[starts])),
                pa.array(h[starts]),
                pa.array(np.diff(np.append(starts, len(h)))),
            ],
            ["item_id", "term", "times"],
        )


def _shards(wanted):
    """Shards of documents with the postings of the ``wanted`` terms (sorted hashes), by place of the term there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        terms = np.frombuffer(wanted.value, np.uint64)
        number = TaskContext.get().partitionId() << 32
        held: list[tuple[np.ndarray, ...]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, number
            docs, lengths = np.concatenate([x[0] for x in held]), np.concatenate([x[1] for x in held])
            base = np.cumsum([0] + [len(x[0]) for x in held])
            term = np.concatenate([x[2] for x in held])
            place = np.concatenate([x[3] + base[i] for i, x in enumerate(held)])
            tf = np.concatenate([x[4] for x in held])
            order = np.lexsort((place, term))
            term, place, tf = term[order], place[order], tf[order]
            starts = np.flatnonzero(np.concatenate(([True], term[1:] != term[:-1]))) if len(term) else np.zeros(0, np.int64)
            parts = (docs, lengths.astype(np.int64), term[starts], np.append(starts, len(term)), place.astype(np.int32), tf.astype(np.int32))
            row = [number, *(np.ascontiguousarray(x).tobytes() for x in parts), len(docs), int(lengths.sum())]
            held, size, number = [], 0, number + 1
            kinds = [pa.int64()] + [pa.binary()] * 6 + [pa.int64()] * 2
            names = [field.split()[0] for field in _POSTINGS.split(",")]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in rt.chunks(batches):
            w = tx.words(batch.column(1))
            h = w.hashes()
            at = np.minimum(np.searchsorted(terms, h), max(len(terms) - 1, 0))
            hit = terms[at] == h if len(terms) else np.zeros(len(h), bool)
            mine = hit[w.codes]
            width = max(len(terms), 1)
            pairs = np.sort(w.owners()[mine] * width + at[w.codes[mine]])
            starts = np.flatnonzero(np.concatenate(([True], pairs[1:] != pairs[:-1]))) if len(pairs) else np.zeros(0, np.int64)
            tf = np.diff(np.append(starts, len(pairs)))
            held.append((batch.column(0).to_numpy(), w.counts(), pairs[starts] % width, pairs[starts] // width, tf))
            size += batch.num_rows
            if size >= SHARD_DOCS:
                yield flush()
        if held:
            yield flush()

    return run


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for terms, starts in zip(batch.column(0), batch.column(1), strict=True):
            counts = np.diff(np.frombuffer(starts.as_py(), np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.frombuffer(terms.as_py(), np.int64)), pa.array(counts)], ["term", "df"]
            )


def impacts(tf: np.ndarray, length: np.ndarray, idf: float | np.ndarray, mean: float) -> np.ndarray:
    """BM25 of postings in whole units."""
    norm = K1 * (1 - B + B * length / mean)
    return np.floor(UNIT * (idf * (tf * (K1 + 1) / (tf + norm))) + 0.5).astype(np.int64)


def idf_of(df: np.ndarray, n: int) -> np.ndarray:
    return np.log(1 + (n - df + 0.5) / (df + 0.5))


class Shard:
    """Documents with postings (places of documents and their impacts, by term) and each term's highest impact."""

    def __init__(self, docs: np.ndarray, terms: np.ndarray, starts: np.ndarray, places: np.ndarray, values: np.ndarray):
        self.docs, self.starts, self.places, self.values = docs, starts, places, values
        self.bounds = np.maximum.reduceat(values, starts[:-1]) if len(terms) else np.zeros(0, np.int64)
        self.at = {int(t): i for i, t in enumerate(terms.tolist())}
        self.work = np.zeros(len(docs), np.int64)

    def top(self, query: list[tuple[int, int]], k: int, floor: int) -> tuple[np.ndarray, np.ndarray]:
        """(places, scores) of the documents that score at least ``floor`` and may be among the k best."""
        found = [(int(self.bounds[i]) * times, i, times) for term, times in query if (i := self.at.get(term)) is not None]
        found.sort(reverse=True)
        rest = np.cumsum([0] + [bound for bound, _, _ in reversed(found)])[::-1].tolist()  # bounds from here on
        live = np.zeros(0, np.int64)
        scores = np.zeros(0, np.int64)
        work = self.work
        for turn, (_, i, times) in enumerate(found):
            s, e = self.starts[i], self.starts[i + 1]
            places, values = self.places[s:e], self.values[s:e] * times
            if rest[turn] >= floor:  # essential: a document may come in by this term
                work[live] = scores
                fresh = places[work[places] == 0]
                work[places] += values
                live = np.concatenate((live, fresh))
                scores = work[live]
                work[live] = 0
            elif len(live):  # non-essential: only documents that are in are looked up
                if len(live) < len(places) // 16:
                    at = np.minimum(np.searchsorted(places, live), len(places) - 1)
                    scores = scores + np.where(places[at] == live, values[at], 0)
                else:
                    work[places] = values
                    scores = scores + work[live]
                    work[places] = 0
            if len(scores) >= k:
                floor = max(floor, int(np.partition(scores, len(scores) - k)[len(scores) - k]))
            keep = scores + rest[turn + 1] >= floor
            if not keep.all():
                live, scores = live[keep], scores[keep]
        return live, scores


def _search(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, idf, n, mean = shared.value
        floors = dict.fromkeys(queries, 1)
        best: dict[int, list[int]] = {}
        for batch in batches:
            for row in batch.to_pylist():
                docs, lengths = np.frombuffer(row["docs"], np.int64), np.frombuffer(row["lengths"], np.int64)
                terms, starts = np.frombuffer(row["terms"], np.int64), np.frombuffer(row["starts"], np.int64)
                places = np.frombuffer(row["places"], np.int32).astype(np.int64)
                tf = np.frombuffer(row["tfs"], np.int32).astype(np.float64)
                weight = np.repeat(idf[terms], np.diff(starts))
                values = impacts(tf, lengths[places], weight, mean)
                some = values > 0  # a term of nearly all documents may weigh less than half a unit
                starts = np.concatenate(([0], np.cumsum(some)))[starts]
                filled = np.flatnonzero(np.diff(starts))
                shard = Shard(docs, terms[filled], starts[np.append(filled, len(terms))], places[some], values[some])
                out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
                for item, query in queries.items():
                    live, scores = shard.top(query, k, floors[item])
                    if not len(live):
                        continue
                    order = np.lexsort((docs[live], -scores))[:k]
                    live, scores = live[order], scores[order]
                    out.append((np.full(len(live), item), docs[live], scores))
                    have = sorted([*best.get(item, []), *scores.tolist()], reverse=True)[:k]
                    best[item] = have
                    if len(have) == k:
                        floors[item] = max(floors[item], have[-1])
                if out:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], ["item_id", "doc_id", "score"]
                    )

    return run


def search(docs: DataFrame, queries: DataFrame, k: int = TOP) -> DataFrame:
    """For each query its k best documents: item_id, rank, doc_id, score (BM25 in units of 1 / ``UNIT``).

    Every row of ``queries`` (item_id, text) is searched, all its words; a repeated word counts as often. Documents that
    share no word with a query, or score 0, are not in its result. Equal scores are ranked by doc_id.

    Defined cases: rows with a null id are left out on either side; null texts count as empty, and an empty query finds
    nothing, while empty documents count towards the mean length. Rows that repeat a document's id and text are one
    document; with differing texts each is searched, and the best of them is ranked. Query rows that repeat an id are
    one query of all their words. Very long texts are searched whole. Other columns, whatever their names, are not read.
    Empty tables give no rows. Queries of more than ``QUERY_TERMS`` terms in all are searched in several passes.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).where(
        "doc_id IS NOT NULL"
    )
    repeated = texts.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        texts = texts.distinct()
    terms = rt.written(
        queries.select(F.col("item_id").cast("long").alias("item_id"), "text")
        .where("item_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_query_terms, "item_id long, term long, times long")
        .groupBy("item_id", "term")
        .agg(F.sum("times").alias("times")),
        "maxscore-queries",
    )
    # Queries go through the documents in groups by a hash, each of about a size that can be broadcast.
    passes = -(-terms.count() // QUERY_TERMS)
    results = []
    for number in range(passes):
        mine = terms.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == number) if passes > 1 else terms
        results.append(_one_pass(spark, texts, mine.toArrow(), k))
    if not results:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    found = results[0]
    for more in results[1:]:
        found = found.unionByName(more)
    found = found.groupBy("item_id", "doc_id").agg(F.max("score").alias("score"))
    ranked = Window.partitionBy("item_id").orderBy(F.col("score").desc(), "doc_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def _one_pass(spark: SparkSession, texts: DataFrame, table: pa.Table, k: int) -> DataFrame:
    wanted = tx.distinct(table["term"].to_numpy().view(np.uint64))
    shards = rt.written(
        texts.mapInArrow(_shards(spark.sparkContext.broadcast(wanted.tobytes())), _POSTINGS), "maxscore-shards"
    )
    totals = shards.agg(F.sum("n"), F.sum("words")).first()
    n, words = totals[0] or 0, totals[1] or 0
    counts = (
        shards.select("terms", "starts").mapInArrow(_frequencies, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))
    ).toArrow()  # at most the terms of the queries
    df = np.zeros(len(wanted), np.int64)
    df[counts["term"].to_numpy()] = counts["df"].to_numpy()
    places = np.searchsorted(wanted, table["term"].to_numpy().view(np.uint64)).tolist()
    queries: dict[int, list[tuple[int, int]]] = {}
    for item, place, times in zip(table["item_id"].to_pylist(), places, table["times"].to_pylist(), strict=True):
        queries.setdefault(item, []).append((place, times))
    shared = spark.sparkContext.broadcast((queries, idf_of(df, n), n, max(words / max(n, 1), 1e-9)))
    return shards.mapInArrow(_search(shared, k), "item_id long, doc_id long, score long")


def op9_maxscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(rt.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def sql(k: int = TOP) -> str:
    split = r"unnest(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> ''))"
    return f"""
WITH dt AS (SELECT doc_id, {split} AS term FROM documents WHERE doc_id IS NOT NULL),
qt AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, {split} AS term FROM benchmark WHERE item_id IS NOT NULL) GROUP BY 1, 2),
p AS (SELECT term, doc_id, count(*) AS tf FROM dt WHERE term IN (SELECT term FROM qt) GROUP BY 1, 2),
l AS (SELECT doc_id, count(*) AS len FROM dt GROUP BY doc_id),
g AS (SELECT (SELECT count(DISTINCT doc_id) FROM documents) AS n, (SELECT count(*) FROM dt)::DOUBLE / (SELECT count(DISTINCT doc_id) FROM documents) AS mean),
f AS (SELECT term, ln(1 + (n - count(*) + 0.5::DOUBLE) / (count(*) + 0.5::DOUBLE)) AS idf FROM p, g GROUP BY term, n),
s AS (SELECT item_id, doc_id,
             sum(floor({UNIT}::DOUBLE * (idf * (tf::DOUBLE * {K1 + 1}::DOUBLE / (tf::DOUBLE + {K1}::DOUBLE * (1 - {B}::DOUBLE + {B}::DOUBLE * len::DOUBLE / mean)))) + 0.5::DOUBLE)::BIGINT * times)::BIGINT AS score
      FROM qt JOIN p USING (term) JOIN f USING (term) JOIN l USING (doc_id), g GROUP BY 1, 2)
SELECT item_id, rank::INTEGER AS rank, doc_id, score FROM
  (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0) WHERE rank <= {k}"""


QUERIES = {"op9_maxscore": op9_maxscore}
SQL = {"op9_maxscore": sql()}
