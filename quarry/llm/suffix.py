"""Exact passages that documents share, by bucket-pointer refinement of their word suffixes.

A passage counts when some ``MIN_WORDS`` consecutive words of it occur in two documents or more. Suffixes are put into
buckets by their first ``Q`` words and the buckets refined: a bucket is sorted by the bucket identifiers of its
suffixes at a later offset, which splits it into buckets of suffixes that agree in more words, and the refined
identifiers are what the next round sorts by. Three depths, Q, 2 Q and MIN_WORDS, settle which suffixes agree in
MIN_WORDS words. Buckets with suffixes of one text only are done and leave the refinement at once.

Buckets come to tasks sorted, so a task holds an Arrow batch and the rows of one text at a time, however large a bucket
is; the identifier of a refined bucket is a hash of the two that it comes from, so its rows may be anywhere.

Only suffixes that can take part enter it. In every window of ``MIN_WORDS`` words the least hash of its ``SCREEN``-word
grams is selected, which depends on the window's content alone; a window whose selected gram no other text has is in no
shared passage. About one gram in thirteen is shuffled for this, and nothing that repeats is lost. Texts that are equal
throughout are refined once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _runtime as rt
from quarry.llm import _text as tx

MIN_WORDS = 50
Q = 13
SCREEN = 25


def _grams(text: pa.Array, size: int):
    w = tx.words(text)
    h = w.hashes()[w.codes]
    return w, h, *tx.ngram_hashes(h, w.offsets, size)


def _selected(least: int):
    """Rows (rid, anchor, pos, doc_id): selected grams, and for each text a row with pos = -1 - its words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rt.chunks(batches):
            w, _, grams, valid = _grams(batch.column(2), SCREEN)
            at = tx.minimizers(grams, valid, least - SCREEN + 1)
            owner = np.searchsorted(w.offsets, at, side="right") - 1
            n = batch.num_rows
            rid = np.concatenate((batch.column(1).to_numpy()[owner], batch.column(1).to_numpy()))
            anchor = np.concatenate((grams[at].view(np.int64), np.zeros(n, np.int64)))
            pos = np.concatenate((at - w.offsets[owner], -1 - w.counts())).astype(np.int32)
            doc = pa.concat_arrays([pa.nulls(len(at), pa.int64()), batch.column(0)])
            yield pa.RecordBatch.from_arrays(
                [pa.array(rid), pa.array(anchor), pa.array(pos), doc], ["rid", "anchor", "pos", "doc_id"]
            )

    return run


def shared_runs(
    batches: Iterator[pa.RecordBatch], keys: int
) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """Of rows that are sorted by the first ``keys`` columns and then by the next, the owner: those whose keys have two
    owners or more, and the least owner of each. Only rows of the first owner of the last keys seen are held back."""
    held: list[np.ndarray] | None = None
    open_keys, open_least = None, 0  # keys that are known to have two owners, when rows of theirs may follow
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        owner, n = columns[keys], len(columns[0])
        if not n:
            continue
        starts = rt.split_runs(*columns[:keys])
        sizes = np.diff(np.append(starts, n))
        least, most = owner[starts], owner[starts + sizes - 1]
        several = least < most
        if open_keys is not None and all(k[0] == x for k, x in zip(columns, open_keys, strict=False)):
            least, several = least.copy(), several.copy()
            least[0], several[0] = open_least, True
        if several[-1]:
            open_keys, open_least, held = [k[-1] for k in columns[:keys]], least[-1], None
        else:
            open_keys, held = None, [c[starts[-1] :] for c in columns]
        keep = np.repeat(several, sizes)
        yield [c[keep] for c in columns], np.repeat(least, sizes)[keep]


def _shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The selected grams that two texts or more have, of rows (anchor, rid, pos)."""
    for (_, rid, pos), _ in shared_runs(batches, 1):
        yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(pos)], ["rid", "pos"])


def _initial(least: int, q: int):
    """Rows (rid, pos, b, c): suffixes that can take part, with their first bucket and the one q words on."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in rt.chunks(batches):
            rids = batch.column(0).to_pylist()
            fresh = [i for i, rid in enumerate(rids) if rid not in seen and not seen.add(rid)]
            if not fresh:
                continue
            batch = batch.take(pa.array(fresh))
            w, h, grams, valid = _grams(batch.column(1), SCREEN)
            places = batch.column(2)
            flat = places.flatten().to_numpy() + np.repeat(w.offsets[:-1], np.diff(places.offsets.to_numpy()))
            width = least - SCREEN + 1
            lowest = tx.sliding(np.where(valid, np.minimum(grams, tx.NONE - np.uint64(1)), tx.NONE), width, np.minimum)
            total, ends = len(h), np.repeat(w.offsets[1:], w.counts())
            start = (np.arange(total) + least <= ends) & np.isin(lowest, grams[flat])
            need = start.copy()
            need[least - 2 * q :] |= start[: total - (least - 2 * q)]
            at = np.flatnonzero(need)
            first, _ = tx.ngram_hashes(h, w.offsets, q)
            owner = np.searchsorted(w.offsets, at, side="right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(owner)),
                    pa.array((at - w.offsets[owner]).astype(np.int32)),
                    pa.array(first[at].view(np.int64)),
                    pa.array(first[at + q].view(np.int64)),
                ],
                ["rid", "pos", "b", "c"],
            )

    return run


def _refined(owner_column: str):
    """Each bucket b split by c, of rows (b, c, owner, pos); the parts with several owners get new identifiers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (b, c, owner, pos), least in shared_runs(batches, 2):
            name = tx.mix(tx.mix(b.view(np.uint64)) + c.view(np.uint64)).view(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(owner), pa.array(pos), pa.array(name), pa.array(least)], [owner_column, "pos", "b", "least"]
            )

    return run


def _buckets(rows: DataFrame, owner: str) -> DataFrame:
    """Rows (b, c, owner, pos) where each bucket's are together and in order."""
    keys = ("b", "c", owner, "pos")
    return rows.select(*keys).repartition("b", "c").sortWithinPartitions(*keys)


def _later(offset: int):
    """Rows (rep, pos, b, c): suffixes with their refined bucket and the refined one ``offset`` words on.

    A row with pos -1 carries the document that stands for the text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rid, pos, b in rt.whole_runs(batches):
            starts = rt.split_runs(rid)
            text = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(rid))))
            place = (text << 32) + pos
            wanted = place + offset
            found = np.minimum(np.searchsorted(place, wanted), len(place) - 1)
            keep = (pos >= 0) & (place[found] == wanted)
            rep = b[starts][text]
            yield pa.RecordBatch.from_arrays(
                [pa.array(rep[keep]), pa.array(pos[keep]), pa.array(b[keep]), pa.array(b[found[keep]])],
                ["rep", "pos", "b", "c"],
            )

    return run


def _spans(least: int):
    """Rows (rep, start_word, end_word, source) of rows (rep, pos, least)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rep, pos, source in rt.whole_runs(batches):
            new = np.ones(len(rep), bool)
            new[1:] = (rep[1:] != rep[:-1]) | (pos[1:] > pos[:-1] + least)
            starts = np.flatnonzero(new)
            last = np.append(starts[1:], len(rep)) - 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rep[starts]),
                    pa.array(pos[starts].astype(np.int64)),
                    pa.array(pos[last].astype(np.int64) + least),
                    pa.array(np.minimum.reduceat(source, starts)),
                ],
                ["rep", "start_word", "end_word", "source"],
            )

    return run


def repeated_passages(docs: DataFrame, least: int = MIN_WORDS, q: int = Q) -> DataFrame:
    """The maximal stretches of each document that windows of ``least`` words shared with other documents cover.

    Columns: doc_id, start_word, end_word (exclusive), words, source_doc_id (the least doc_id that has one of the
    stretch's windows; where it is doc_id itself, this is the occurrence to keep).

    Defined cases: rows with a null id or null text take no part; empty texts and texts of fewer than ``least`` words
    have no passage, and very long ones are searched whole. Rows that repeat both id and text count once; with differing texts under one id, each is searched,
    and passages that only they share are not reported. Repeats within one document alone are no shared passage. Texts
    are told apart by a 64-bit hash. Of documents that tie as sources the least is given. Columns besides doc_id and text,
    whatever their names, are not read. An empty table gives no rows.
    """
    if not SCREEN < least or not 2 * q <= least <= 4 * q:
        raise ValueError("the depths q, 2 q and least must follow one another")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("rid"), "text").where(
        "doc_id IS NOT NULL AND text IS NOT NULL"
    )
    selected = rt.written(
        texts.select("doc_id", "rid", "text").mapInArrow(
            _selected(least), "rid long, anchor long, pos int, doc_id long"
        ),
        "suffix-selected",
    )
    holders = selected.where("pos < 0").select("rid", "doc_id", (-1 - F.col("pos")).alias("n_words"))
    known = holders.groupBy("rid").agg(
        F.min("doc_id").alias("rep"), F.max("doc_id").alias("other"), F.max("n_words").alias("n_words")
    )
    shared = (
        selected.where("pos >= 0")
        .select("anchor", "rid", "pos")
        .repartition("anchor")
        .sortWithinPartitions("anchor", "rid")
        .mapInArrow(_shared, "rid long, pos int")
        .groupBy("rid")
        .agg(F.collect_set("pos").alias("places"))
    )
    initial = (
        texts.select("rid", "text")
        .join(shared, "rid")
        .select("rid", "text", "places")
        .mapInArrow(_initial(least, q), "rid long, pos int, b long, c long")
    )
    first = rt.written(
        _buckets(initial, "rid").mapInArrow(_refined("rid"), "rid long, pos int, b long, least long").select("rid", "pos", "b"),
        "suffix-refined",
    )
    later = (
        first.unionByName(known.select("rid", F.lit(-1).alias("pos"), F.col("rep").alias("b")))
        .repartition("rid")
        .sortWithinPartitions("rid", "pos")
        .mapInArrow(_later(least - 2 * q), "rep long, pos int, b long, c long")
    )
    second = _buckets(later, "rep").mapInArrow(_refined("rep"), "rep long, pos int, b long, least long").select("rep", "pos", "least")
    spans = rt.written(
        second.repartition("rep")
        .sortWithinPartitions("rep", "pos")
        .mapInArrow(_spans(least), "rep long, start_word long, end_word long, source long"),
        "suffix-spans",
    )
    rt.discard(first)
    # Texts that several documents have are shared throughout.
    copied = known.where("other > rep")
    whole = (
        copied.where(F.col("n_words") >= least)
        .join(spans.groupBy("rep").agg(F.min("source").alias("source")), "rep", "left")
        .select(
            "rid",
            F.lit(0).cast("long").alias("start_word"),
            F.col("n_words").cast("long").alias("end_word"),
            F.least("rep", F.coalesce("source", "rep")).alias("source"),
        )
    )
    single = known.where("other = rep").join(spans, "rep").select("rid", "start_word", "end_word", "source")
    return (
        whole.unionByName(single)
        .join(holders.select("rid", "doc_id").distinct(), "rid")
        .select(
            "doc_id",
            "start_word",
            "end_word",
            (F.col("end_word") - F.col("start_word")).alias("words"),
            F.col("source").alias("source_doc_id"),
        )
    )


def op2_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(rt.documents(spark, sf_dir))


def sql(least: int = MIN_WORDS) -> str:
    return f"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w
            FROM documents WHERE text IS NOT NULL AND doc_id IS NOT NULL),
g AS (SELECT doc_id, i - 1 AS pos, array_to_string(w[i : i + {least - 1}], ' ') AS gram
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - {least} + 2)) AS i FROM dw WHERE len(w) >= {least})),
s AS (SELECT gram, min(doc_id) AS least FROM g GROUP BY gram HAVING count(DISTINCT doc_id) > 1),
p AS (SELECT doc_id, pos, least FROM g JOIN s USING (gram)),
n AS (SELECT *, CASE WHEN pos > {least} + lag(pos, 1, -1000000) OVER (PARTITION BY doc_id ORDER BY pos) THEN 1 ELSE 0 END AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM n)
SELECT doc_id, min(pos)::BIGINT AS start_word, (max(pos) + {least})::BIGINT AS end_word,
       (max(pos) + {least} - min(pos))::BIGINT AS words, min(least) AS source_doc_id
FROM i GROUP BY doc_id, island"""


QUERIES = {"op2_suffix": op2_suffix}
SQL = {"op2_suffix": sql()}
