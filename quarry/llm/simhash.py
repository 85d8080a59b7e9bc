"""SimHash near-duplicate groups by meet-in-the-middle ball hashing.

Each document's words, weighted by their number of up to ``WEIGHT``, give a fingerprint of ``BLOCKS`` x ``BITS`` bits.
Per block every fingerprint emits all variants within ``RADIUS / 2`` flipped bits; two fingerprints within ``RADIUS``
bits in a block meet in a variant. A shuffle on the variants brings them together, equal sets of partners are dropped,
and the rest is verified by the Hamming distance of whole fingerprints. Documents with equal fingerprints are joined
beforehand, so thousands of copies cost what they have in rows. Groups are the connected components.

The ball is complete: of two fingerprints within ``ACCEPT`` = BLOCKS * (RADIUS + 1) - 1 bits, some block differs in
``RADIUS`` bits or fewer, as otherwise they'd differ in more. So every pair within ``ACCEPT`` meets, without a cap, and
the groups are those of all pairs. Unrelated documents differ in 40 bits and more. ``BITS`` should be about the
logarithm of the number of documents or more, or buckets fill with documents that meet by chance.

In a bucket a search from document to document reaches what is within ``ACCEPT``; each one is compared only with those
that none before it has reached, so a bucket of n near copies costs a few times n comparisons, and only one of n
documents that meet by chance n² / 2.
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

BLOCKS = 6
BITS = 32
RADIUS = 2
ACCEPT = BLOCKS * (RADIUS + 1) - 1
WEIGHT = 3
_LONGS = -(-BLOCKS * BITS // 64)
_USED = np.frombuffer(np.packbits(np.arange(64 * _LONGS) < BLOCKS * BITS, bitorder="little").tobytes(), np.uint64)
_SALT = [np.uint64(k * 0xA24BAED4963EE407 & (1 << 64) - 1) for k in range(1, _LONGS + 1)]
_FLIPS = np.array([0] + [1 << b for b in range(BITS)], np.int64)  # the variants within RADIUS / 2 = 1 bit


def fingerprints(text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the texts that have words, and for each the fingerprint as ``_LONGS`` 64-bit numbers."""
    w = tx.words(text)
    n = len(w.offsets) - 1
    # The words of each text up to WEIGHT times, ordered by text.
    pairs = np.sort(w.owners() * max(len(w.vocab), 1) + w.codes)
    if len(pairs) > WEIGHT:
        pairs = pairs[np.concatenate((np.ones(WEIGHT, bool), pairs[WEIGHT:] != pairs[:-WEIGHT]))]
    owner, code = pairs // max(len(w.vocab), 1), pairs % max(len(w.vocab), 1)
    h = w.hashes()
    bits = np.empty((len(h), _LONGS, 64), np.uint8)
    for k, salt in enumerate(_SALT):
        bits[:, k] = np.unpackbits(tx.mix(h ^ salt).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    lanes = bits.reshape(len(h), -1).view(np.uint64)  # eight counters of a byte each in a number
    have = np.flatnonzero(np.bincount(owner, minlength=n))
    if not len(have):
        return have, np.zeros((0, _LONGS), np.uint64)
    starts = np.searchsorted(owner, have)
    sizes = np.diff(np.append(starts, len(owner)))
    # Stretches of at most 255 words of a text, which a byte can count.
    parts = (sizes + 254) // 255
    first = np.concatenate(([0], np.cumsum(parts)[:-1])).astype(np.int64)
    cuts = np.repeat(starts, parts) + 255 * (np.arange(parts.sum()) - np.repeat(first, parts))
    counted = np.empty((len(cuts), lanes.shape[1]), np.uint64)
    for at in range(0, len(cuts), 64):  # so that what is summed stays in cache
        end = cuts[at + 64] if at + 64 < len(cuts) else len(owner)
        counted[at : at + 64] = np.add.reduceat(lanes[code[cuts[at] : end]], cuts[at : at + 64] - cuts[at], axis=0)
    ones = np.add.reduceat(counted.view(np.uint8), first, axis=0, dtype=np.int32)
    return have, np.packbits(2 * ones > sizes[:, None], axis=1, bitorder="little").view(np.uint64) & _USED


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.chunks(batches):
        have, prints = fingerprints(batch.column(1))
        columns = [pa.array(np.ascontiguousarray(prints[:, k]).view(np.int64)) for k in range(_LONGS)]
        yield pa.RecordBatch.from_arrays(
            [batch.column(0).take(pa.array(have)), *columns], ["doc_id", *(f"s{k}" for k in range(_LONGS))]
        )


def blocks_of(prints: np.ndarray) -> list[np.ndarray]:
    """The blocks of fingerprints, as whole numbers."""
    out = []
    for block in range(BLOCKS):
        k, at = divmod(block * BITS, 64)
        part = prints[:, k] >> np.uint64(at)
        if at + BITS > 64:
            part = part | prints[:, k + 1] << np.uint64(64 - at)
        out.append((part & np.uint64((1 << BITS) - 1)).astype(np.int64))
    return out


def _variants(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rt.chunks(batches, rows=2048):
        ids = batch.column(0).to_numpy()
        prints = np.stack([batch.column(1 + k).to_numpy().view(np.uint64) for k in range(_LONGS)], axis=1)
        for block, part in enumerate(blocks_of(prints)):
            keys = (part[:, None] ^ _FLIPS[None, :]) | (block << BITS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, len(_FLIPS)))], ["variant", "rep"])


def runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of the runs of equal neighbours."""
    if not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return starts, np.diff(np.append(starts, len(keys)))


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (bucket, rep, other) of the variants that two or more have, of rows in order of their variant: of two members
    (null, one, the other), of more each one with the bucket's name, which is made of what it holds."""
    seen = np.zeros(0, np.uint64)
    for keys, reps in rt.whole_runs(batches):
        starts, sizes = runs(keys)
        several = sizes > 1
        reps, sizes = reps[np.repeat(several, sizes)], sizes[several]
        if not len(sizes):
            continue
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
        names = tx.mix(np.add.reduceat(tx.mix(reps.view(np.uint64)), starts) + sizes.astype(np.uint64))
        # Equal buckets of this task are sent on once.
        first = np.zeros(len(names), bool)
        first[np.unique(names, return_index=True)[1]] = True
        first &= ~np.isin(names, seen)
        seen = np.concatenate((seen, names[first]))
        two = starts[first & (sizes == 2)]
        more = np.repeat(first & (sizes > 2), sizes)
        rep = np.concatenate((np.minimum(reps[two], reps[two + 1]), reps[more]))
        bucket = pa.concat_arrays([pa.nulls(len(two), pa.int64()), pa.array(np.repeat(names, sizes)[more].view(np.int64))])
        other = pa.concat_arrays([pa.array(np.maximum(reps[two], reps[two + 1])), pa.nulls(int(more.sum()), pa.int64())])
        yield pa.RecordBatch.from_arrays([bucket, pa.array(rep), other], ["bucket", "rep", "other"])


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).sum(axis=-1, dtype=np.int64)


def forest(ids: np.ndarray, prints: np.ndarray, accept: int) -> np.ndarray:
    """A spanning forest, as rows (a, b), of the graph of all pairs within ``accept`` bits.

    Each document is compared with those that none before it has reached, so near copies are compared about once each.
    """
    edges, left = [np.zeros((0, 2), np.int64)], np.arange(len(ids))
    while len(left) > 1:
        reached, left = [left[0]], left[1:]
        while reached and len(left):
            i = reached.pop()
            near = distance(prints[left], prints[i]) <= accept
            if near.any():
                found, left = left[near], left[~near]
                edges.append(np.stack((np.full(len(found), ids[i]), ids[found]), axis=1))
                reached += found.tolist()
    return np.concatenate(edges)


def _verify(accept: int):
    """Edges of each bucket's spanning forest, of rows in order of their bucket. An id that comes with several texts may
    be in a bucket more than once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for buckets, reps, *columns in rt.whole_runs(batches):
            prints = np.stack([c.view(np.uint64) for c in columns], axis=1)
            starts, sizes = runs(buckets)
            twos = starts[sizes == 2]
            near = twos[distance(prints[twos], prints[twos + 1]) <= accept]
            edges = [np.stack((reps[near], reps[near + 1]), axis=1)]
            more = zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True)
            edges += [forest(reps[at : at + n], prints[at : at + n], accept) for at, n in more]
            pairs = np.concatenate(edges).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.ascontiguousarray(pairs[:, 0])), pa.array(np.ascontiguousarray(pairs[:, 1]))], ["a", "b"]
            )

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root): each node of ``edges`` (a, b) but the least of its connected component, with that least node.

    Alternating large and small stars; each round is written to the shared folder.
    """
    now = rt.written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a > b").distinct(), "stars")
    by = Window.partitionBy("a")
    before = None
    while True:
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        large = (
            both.withColumn("m", F.least(F.col("a"), F.min("b").over(by)))
            .where("b > a")
            .select(F.col("b").alias("a"), F.col("m").alias("b"))
            .distinct()
        )
        small = large.withColumn("m", F.min("b").over(by))
        small = (
            small.select("a", F.col("m").alias("b"))
            .unionByName(small.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")))
            .distinct()
        )
        following = rt.written(small, "stars")
        state = following.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        rt.discard(now)
        now = following
        if state == before:
            return now.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state


def near_duplicates(docs: DataFrame, accept: int = ACCEPT) -> DataFrame:
    """The groups of near-duplicate documents that have two members or more.

    Columns: doc_id, group_id (least doc_id of the group), group_size, kept (whether it is the one that stays).

    Defined cases: rows with a null id, a null text or a text without words belong to no group. Very long texts count
    whole. Rows that repeat an id are one document; with differing texts it belongs to the least of their groups. Ties
    between kept documents don't arise, as the least id stays; a bit whose weights tie is 0. Columns besides doc_id and
    text, whatever their names, are not read. An empty table gives no rows. ``accept`` above ``ACCEPT`` is an error, as
    pairs might not meet.
    """
    if accept > ACCEPT:
        raise ValueError(f"pairs within more than {ACCEPT} bits might not meet")
    signed = rt.written(
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
        .where("doc_id IS NOT NULL AND text IS NOT NULL")
        .mapInArrow(_sign, "doc_id long, " + ", ".join(f"s{k} long" for k in range(_LONGS))),
        "simhash-prints",
    )
    prints = [f"s{k}" for k in range(_LONGS)]
    unique = rt.written(signed.groupBy(*prints).agg(F.min("doc_id").alias("rep")).select("rep", *prints), "simhash-unique")
    # One id may come with several texts: the variants then hold it once for each, which only repeats edges.
    met = rt.written(
        unique.mapInArrow(_variants, "variant long, rep long")
        .repartition("variant")
        .sortWithinPartitions("variant")
        .mapInArrow(_meet, "bucket long, rep long, other long"),
        "simhash-met",
    )
    # Most that meet by chance do so two at a time: each such pair is shuffled once by either side. Partitioned by one
    # side, it is freed of repeats and joined to that side's fingerprint where it is.
    pairs = met.where("bucket IS NULL").select(F.col("rep").alias("a"), F.col("other").alias("b")).repartition("a").distinct()
    for t in "ab":
        pairs = pairs.join(unique.select(F.col("rep").alias(t), *(F.col(c).alias(f"{t}_{c}") for c in prints)), t)
    apart = sum((F.bit_count(F.col(f"a_{c}").bitwiseXOR(F.col(f"b_{c}"))) for c in prints), F.lit(0))
    edges = (
        met.where("bucket IS NOT NULL")
        .select("bucket", "rep")
        .distinct()
        .join(unique, "rep")
        .select("bucket", "rep", *prints)
        .repartition("bucket")
        .sortWithinPartitions("bucket", "rep")
        .mapInArrow(_verify(accept), "a long, b long")
        .unionByName(pairs.where(apart <= accept).select("a", "b"))
    )
    roots = components(edges)
    members = (
        signed.join(unique, prints)
        .join(roots, F.col("rep") == F.col("node"), "left")
        .groupBy("doc_id")
        .agg(F.min(F.coalesce("root", "rep")).alias("group_id"))
    )
    members = rt.written(members, "simhash-members")
    sizes = members.groupBy("group_id").agg(F.count("*").alias("group_size")).where("group_size > 1")
    return members.join(sizes, "group_id").select(
        "doc_id", "group_id", "group_size", (F.col("doc_id") == F.col("group_id")).alias("kept")
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(rt.documents(spark, sf_dir))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that are not the kept one of their group.

    Only texts that may have to go are shuffled (``_runtime.without``). Defined cases: of rows that repeat an id the first by text stays, of
    equal ones any. Rows with a null id, and documents without words (null, empty or blank texts), stay; so do ties of
    nothing else, as the least id of a group is the kept one. Very long texts are compared whole. An empty table stays
    empty. Further columns, whatever their names, are passed on.
    """
    key, nth = rt.fresh(docs, "copy", "nth")
    left = rt.without(docs, near_duplicates(docs).where("NOT kept").select("doc_id"))
    repeated = docs.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not repeated.isEmpty():
        again = rt.written(repeated.select(F.col("doc_id").alias(key)), "simhash-repeated")
        one = left.join(again, left["doc_id"] == again[key], "left_semi").withColumn(
            nth, F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
        )
        left = left.join(again, left["doc_id"] == again[key], "left_anti").unionByName(one.where(F.col(nth) == 1).drop(nth))
    return left.select(*docs.columns)


QUERIES = {"op6_simhash": op6_simhash}
SQL: dict[str, str] = {}
