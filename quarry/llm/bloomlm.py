"""Language-model scores of all documents from n-gram counts in a log-frequency Bloom filter.

The n-grams of the whole corpus are counted: parts of it count what they hold, sort it and send it on by shard,
delta-coded. Each shard keeps all its n-grams, with their counts quantised to levels of a logarithm, exact up to 3. An
n-gram of level q is put into the shard's Bloom filter q times, with the numbers 1 to q, and its level is found by
probing for 1, 2, ... until a probe fails; so an error only ever raises a level. Every document's words are scored by
interpolated probabilities with absolute discounting,

    p(w | u v) = sum over orders k of LAMBDA[k] * max(count(k-gram) - DISCOUNT, 0) / count(its context)
                 + LAMBDA[1] * count(w) / words + LAMBDA[0] / VOCABULARY

from the counts that the levels stand for; orders that a word has no context for are left out and the weights of the
others scaled to 1. As the counts include the document itself, the discount is what tells a passage that occurs once
from one that occurs again.

The filters are broadcast where their size has a small enough bound: an n-gram of n occurrences has n entries at most,
so ``BITS`` for each n-gram position of the corpus, which is known before, can't be exceeded. Beyond ``BROADCAST_BYTES``
the filters stay where they were built and the probes come to them: a part's distinct n-grams are looked up in the
shard's filter, and their levels return to the part, a byte each. The scores are the same. Nothing that grows with the
corpus passes through the driver, and the texts are read twice, however large the corpus is.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _runtime as rt
from quarry.llm import _text as tx

ORDER = 3
BASE = 1.5
LAMBDA = (0.05, 0.15, 0.3, 0.5)
DISCOUNT = 0.75
VOCABULARY = 1 << 20  # of the uniform part, which unseen words have too
BITS = 12  # of the filter for each entry
PROBES = 6
BROADCAST_BYTES = 32 << 20
PART_BYTES = 12 << 20  # of text, counted together
SHARD_GRAMS = 3 << 20  # n-gram positions for each shard
_KEY = np.uint64(16)  # a key is the upper 48 bits of an n-gram's hash


def ngrams(w: tx.Words, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each order the n-gram hashes by the position of their first word, and which are within one text."""
    h = w.hashes()[w.codes]
    out = [(tx.mix(h + np.uint64(1)), np.ones(len(h), bool))]
    for n in range(2, order + 1):
        g, valid = tx.ngram_hashes(h, w.offsets, n)
        out.append((tx.mix(g + np.uint64(n)), valid))
    return out


def counted(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and how often each occurs."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order]
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    if counts is None:
        return keys[starts], np.diff(np.append(starts, len(keys)))
    return keys[starts], np.add.reduceat(counts, starts)


def _planes(values: np.ndarray) -> bytes:
    return values.view(np.uint8).reshape(-1, values.itemsize).T.tobytes()


def pack(keys: np.ndarray, counts: np.ndarray) -> bytes:
    """Sorted 48-bit keys and counts: differences of the upper part and the rest, each byte by byte, so that the zeros
    of small differences and counts lie together for the shuffle's compression."""
    high = (keys >> np.uint64(16)).astype(np.uint32)
    step = np.diff(high, prepend=np.uint32(0)).astype(np.uint32)
    return _planes(step) + (keys & np.uint64(0xFFFF)).astype(np.uint16).tobytes() + _planes(counts.astype(np.uint32))


def unpack(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 10
    flat = np.frombuffer(raw, np.uint8)
    step = np.ascontiguousarray(flat[: 4 * n].reshape(4, n).T).view(np.uint32).ravel()
    low = np.frombuffer(raw, np.uint16, n, 4 * n)
    counts = np.ascontiguousarray(flat[6 * n :].reshape(4, n).T).view(np.uint32).ravel()
    return (np.cumsum(step, dtype=np.uint64) << np.uint64(16)) | low, counts.astype(np.int64)


def shard_of(keys: np.ndarray, shards: int) -> np.ndarray:
    """The shard of each key; in order of keys."""
    return ((keys >> np.uint64(16)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _sorted_keys(texts: pa.Array, order: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each order the keys of all n-gram positions, and which are within one text."""
    for h, valid in ngrams(tx.words(texts), order):
        yield h >> _KEY, valid


def _count(order: int, names: list[int]):
    """Rows (shard, part, kind, grams): counted n-grams of order ``kind`` of each part of the corpus, by shard's name."""
    shards, named = len(names), np.array(names, np.int32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[list[np.ndarray]]] = {}
        for batch in rt.chunks(batches):
            parts = batch.column(2).to_numpy()
            for part in np.unique(parts).tolist():
                mine = held.setdefault(part, [[] for _ in range(order)])
                texts = batch.column(1).filter(pa.array(parts == part))
                for kind, (keys, valid) in enumerate(_sorted_keys(texts, order)):
                    mine[kind].append(keys[valid])
        for part, kinds in held.items():
            for kind in range(order):
                keys, counts = counted(np.concatenate(kinds[kind]))
                kinds[kind] = []
                starts, sizes = _runs(shard_of(keys, shards))
                some = shard_of(keys[starts], shards)
                grams = [pack(keys[a : a + n], counts[a : a + n]) for a, n in zip(starts.tolist(), sizes.tolist(), strict=True)]
                n = len(some)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(named[some]),
                        pa.array(np.full(n, part, np.int32)),
                        pa.array(np.full(n, kind + 1, np.int32)),
                        pa.array(grams, pa.binary()),
                    ],
                    ["shard", "part", "kind", "grams"],
                )

    return run


def _runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def level_of(counts: np.ndarray) -> np.ndarray:
    """The quantised count: 1 for a single occurrence, and one more for each factor of BASE; 0 for none."""
    raised = np.floor(np.log(np.maximum(counts, 1)) / np.log(BASE) + 1e-9)
    return np.where(counts > 0, 1 + raised, 0).astype(np.int64)


def count_of(levels: np.ndarray) -> np.ndarray:
    """The count that a level stands for: the middle of its range."""
    low = np.ceil(BASE ** (levels.astype(float) - 1) - 1e-9)
    high = np.maximum(np.ceil(BASE ** levels.astype(float) - 1e-9) - 1, low)
    return np.where(levels > 0, (low + high) / 2, 0.0)


def _hashed(keys: np.ndarray, level) -> tuple[np.ndarray, np.ndarray]:
    g = tx.mix(keys * np.uint64(0x9E3779B97F4A7C15) + np.asarray(level, np.uint64))
    return g & np.uint64(0xFFFFFFFF), (g >> np.uint64(32)) | np.uint64(1)


def _place(hashed: tuple[np.ndarray, np.ndarray], probe: int, size) -> np.ndarray:
    low, high = hashed
    return ((low + np.uint64(probe) * high & np.uint64(0xFFFFFFFF)) * size >> np.uint64(32)).astype(np.int64)


def build(keys: np.ndarray, levels: np.ndarray) -> tuple[int, np.ndarray]:
    """(size in bits, packed bits) of the filter that has each key with the numbers 1 to its level."""
    repeated = np.repeat(keys, levels)
    number = np.arange(len(repeated)) - np.repeat(np.cumsum(levels) - levels, levels) + 1
    size = max(64, -(-len(repeated) * BITS // 64) * 64)
    bits = np.zeros(size, bool)
    hashed = _hashed(repeated, number)
    for probe in range(PROBES):
        bits[_place(hashed, probe, np.uint64(size))] = True
    return size, np.packbits(bits, bitorder="little")


def probed(keys: np.ndarray, bits: np.ndarray, sizes, starts) -> np.ndarray:
    """The level of each key: how many numbers in a row the filter has with it. Sizes and starts (bits) by key, or one."""
    out = np.zeros(len(keys), np.uint8)
    live = np.arange(len(keys))
    sizes, starts = (np.broadcast_to(np.asarray(x), len(keys)) for x in (sizes, starts))
    for level in range(1, 251):
        low, high = _hashed(keys[live], level)
        for probe in range(PROBES):
            place = _place((low, high), probe, sizes[live]) + starts[live]
            hit = (bits[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
            if not hit.all():
                live, low, high = live[hit], low[hit], high[hit]
        if not len(live):
            break
        out[live] = level
    return out


def _shard_keys(table: pa.Table) -> tuple[list[tuple[int, int, int]], np.ndarray, np.ndarray, np.ndarray]:
    """((part, kind, keys) of each row, all keys in that order, the distinct ones' place of each, levels of the distinct)."""
    rows, keys, counts = [], [], []
    for part, kind, raw in zip(table["part"].to_pylist(), table["kind"].to_pylist(), table["grams"], strict=True):
        k, c = unpack(raw.as_py())
        rows.append((part, kind, len(k)))
        keys.append(k)
        counts.append(c)
    flat, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(flat, kind="stable")
    starts, sizes = _runs(flat[order])
    place = np.empty(len(flat), np.int64)
    place[order] = np.repeat(np.arange(len(starts)), sizes)
    return rows, flat[order][starts], place, level_of(np.add.reduceat(n[order], starts))


def _build(table: pa.Table) -> pa.Table:
    """A shard's filter."""
    _, keys, _, levels = _shard_keys(table)
    size, bits = build(keys, levels)
    return pa.table({"least": pa.array(keys[:1].astype(np.int64)), "size": pa.array([size], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})


def _answer(table: pa.Table) -> pa.Table:
    """A shard's filter built and probed: rows (part, kind, least, levels), each row's n-grams' levels and the shard's least key."""
    rows, keys, place, levels = _shard_keys(table)
    size, bits = build(keys, levels)
    found = probed(keys, bits, np.uint64(size), 0)[place]
    ends = np.cumsum([n for _, _, n in rows]).tolist()
    return pa.table(
        {
            "part": pa.array([part for part, _, _ in rows], pa.int32()),
            "kind": pa.array([kind for _, kind, _ in rows], pa.int32()),
            "least": pa.array(np.full(len(rows), keys[0]).astype(np.int64)),
            "levels": pa.array([found[e - n : e].tobytes() for e, (_, _, n) in zip(ends, rows, strict=True)], pa.binary()),
        }
    )


class Filter:
    """The filters of all shards, one after the other."""

    def __init__(self, count: int, shards: np.ndarray, sizes: np.ndarray, bits: bytes):
        self.sizes = np.zeros(count, np.uint64)
        self.sizes[shards] = sizes
        self.starts = np.cumsum(self.sizes.astype(np.int64)) - self.sizes.astype(np.int64)
        self.bits = bits

    def levels(self, keys: np.ndarray) -> np.ndarray:
        shard = shard_of(keys, len(self.sizes))
        return probed(keys, np.frombuffer(self.bits, np.uint8), self.sizes[shard], self.starts[shard])


def probabilities(levels: list[np.ndarray], offsets: np.ndarray, total: int) -> np.ndarray:
    """The probability of each word from the levels of the n-grams that start at each position."""
    counts = [count_of(q) for q in levels]
    n = len(counts[0])
    depth = np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets))  # words before it in the text
    p = np.full(n, LAMBDA[0] / VOCABULARY) + LAMBDA[1] * counts[0] / max(total, 1)
    mass = np.full(n, LAMBDA[0] + LAMBDA[1])
    for k in range(2, len(levels) + 1):
        back = k - 1
        at = np.flatnonzero(depth >= back)
        whole, context = np.maximum(counts[k - 1][at - back] - DISCOUNT, 0.0), counts[k - 2][at - back]
        p[at] += LAMBDA[k] * np.minimum(1.0, np.where(context > 0, whole / np.maximum(context, 1.0), 0.0))
        mass[at] += LAMBDA[k]
    return p / mass


def _scores(ids: pa.Array, w: tx.Words, levels: list[np.ndarray], total: int) -> pa.Table:
    logs = np.concatenate(([0.0], np.cumsum(np.log(probabilities(levels, w.offsets, total)))))
    words = w.counts()
    mean = (logs[w.offsets[1:]] - logs[w.offsets[:-1]]) / np.maximum(words, 1)
    some = pa.array(words > 0)
    none = pa.scalar(None, pa.float64())
    return pa.table(
        {
            "doc_id": ids,
            "words": pa.array(words),
            "log_probability": pc.if_else(some, pa.array(mean), none),
            "perplexity": pc.if_else(some, pa.array(np.exp(-mean)), none),
        }
    )


def _score_broadcast(order: int, shared, total: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f: Filter = shared.value
        for batch in rt.chunks(batches):
            w = tx.words(batch.column(1))
            levels = []
            for h, valid in ngrams(w, order):
                known = np.zeros(len(h), np.uint8)
                keys = h[valid] >> _KEY
                by = np.argsort(keys, kind="stable")
                starts, sizes = _runs(keys[by])
                mine = np.empty(len(keys), np.uint8)
                mine[by] = np.repeat(f.levels(keys[by][starts]), sizes)
                known[valid] = mine
                levels.append(known)
            yield from _scores(batch.column(0), w, levels, total).to_batches()

    return run


def _score_part(order: int, total: int):
    """A part's texts with the levels of its distinct n-grams, in order of their keys."""

    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        column = texts["text"].combine_chunks()
        w = tx.words(column)
        answers = answers.sort_by([("kind", "ascending"), ("least", "ascending")])
        kinds = answers["kind"].to_numpy()
        levels = []
        for kind, (h, valid) in enumerate(ngrams(w, order), 1):
            raw = answers["levels"].filter(pa.array(kinds == kind))
            flat = np.frombuffer(b"".join(x.as_py() for x in raw), np.uint8)
            keys = h[valid] >> _KEY
            by = np.argsort(keys, kind="stable")
            _, sizes = _runs(keys[by])
            mine = np.empty(len(keys), np.uint8)
            mine[by] = np.repeat(flat, sizes)
            known = np.zeros(len(h), np.uint8)
            known[valid] = mine
            levels.append(known)
        return _scores(texts["doc_id"].combine_chunks(), w, levels, total)

    return run


_SCORES = "doc_id long, words long, log_probability double, perplexity double"


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.chunks(batches):
        text = pc.utf8_lower(pc.fill_null(batch.column(0), ""))
        words = pc.sum(pc.count_substring_regex(text, r"[\p{L}\p{N}]+")).as_py() or 0
        yield pa.RecordBatch.from_arrays([pa.array([words], pa.int64()), pa.array([pc.sum(pc.binary_length(text)).as_py() or 0], pa.int64())], ["words", "bytes"])


def scored(docs: DataFrame, order: int = ORDER, broadcast_bytes: int = BROADCAST_BYTES, part_bytes: int = PART_BYTES) -> DataFrame:
    """Each document's words, the mean log-probability of a word, and the perplexity, under the corpus's own counts.

    Defined cases: a null text counts as empty, and a text without words has no log_probability and no perplexity. A
    null doc_id stays null. Rows that repeat an id or a text are counted and scored each; equal texts have equal scores,
    as there are no ties to break. Texts shorter than the order are scored by the lower orders. A very long text is
    counted and scored whole, in one part. Other columns, whatever their names, are not read. An empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = texts.select("text").mapInArrow(_measured, "words long, bytes long").agg(F.sum("words"), F.sum("bytes")).first()
    total, size = size[0] or 0, size[1] or 0
    shards = max(1, -(-total * order // SHARD_GRAMS))
    parts = max(-(-size // part_bytes), spark.sparkContext.defaultParallelism)
    # The numbers of parts and shards hash to partitions of their own, so that tasks are even.
    number = rt.one_of(rt.even_keys(spark, parts), F.pmod(F.xxhash64("doc_id", "text"), F.lit(parts)))
    placed = texts.withColumn("part", number).repartition(parts, "part")
    counts = placed.mapInArrow(_count(order, rt.even_keys(spark, shards)), "shard int, part int, kind int, grams binary")
    grams = counts.repartition(shards, "shard").groupBy("shard")
    if total * order * BITS // 8 + 8 * shards <= broadcast_bytes:
        rows = grams.applyInArrow(_build, "least long, size long, bits binary").toArrow().sort_by("least")
        places = shard_of(rows["least"].to_numpy().astype(np.uint64), shards)
        held = Filter(shards, places, rows["size"].to_numpy(), b"".join(x.as_py() for x in rows["bits"]))
        return placed.select("doc_id", "text").mapInArrow(_score_broadcast(order, spark.sparkContext.broadcast(held), total), _SCORES)
    answers = grams.applyInArrow(_answer, "part int, kind int, least long, levels binary")
    return placed.groupBy("part").cogroup(answers.groupBy("part")).applyInArrow(_score_part(order, total), _SCORES)


def op5_bloomlm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(rt.documents(spark, sf_dir))


QUERIES = {"op5_bloomlm": op5_bloomlm}
SQL: dict[str, str] = {}
