"""Document quality by co-training a text-content and a page-metadata classifier.

The content view has the words of a text and their beginnings, the metadata view its source, language, size and layout
(shares of capitals, digits, symbols; lines; repetition). For each of the two labels, quality and toxicity, a logistic
regression per view is fitted on labelled documents. Then, over some rounds, each view scores all unlabelled documents
of the corpus, and the other view learns from those that its calibrated probability is confident of, along with the
labelled ones. Calibrated views are then combined by a logistic regression on held-out labelled rows, and score all
documents.

Features of all documents are taken from the texts once and kept as a table of numbers, which the rounds and the scoring
read. Only fitting uses samples: at most ``LABELLED`` labelled documents, the least by a hash of their id, and in a round
about ``PSEUDO`` pseudo-labelled ones for each label, view and class, drawn by a hash from all confident ones; weights
give the classes of those the shares that they have among the labelled.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import _runtime as rt
from quarry.llm import _text as tx
from quarry.llm._model import Sparse, fit_dense, fit_logistic, sigmoid

LABELLED = 20_000
PSEUDO = 2_000
FEATURES = 1024  # of the content view, for each label
METADATA = 4096  # places that names of metadata features are hashed to
MIN_DOCUMENTS = 4
LEAST_SCORE = 15.0  # chi-squared
ROUNDS = 3
CONFIDENT = (0.003, 0.97)
REJECT = 0.5
_PREFIXES = (3, 4, 5, 6, 7, 8)
_TARGETS = ("bad", "toxic")
_VIEWS = ("content", "metadata")


class Views(NamedTuple):
    """Features of some texts: (text, 64-bit name) pairs without repeats, ordered by text, for each view."""

    content: tuple[np.ndarray, np.ndarray]
    metadata: tuple[np.ndarray, np.ndarray]


def _word_features(w: tx.Words, wanted: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (word of the vocabulary, feature); of the sorted ``wanted`` their places only, where that is given."""
    length = pc.utf8_length(w.vocab).to_numpy(zero_copy_only=False)
    entries, names = [], []
    for k in (0, *_PREFIXES):
        at = np.arange(len(w.vocab)) if not k else np.flatnonzero(length >= k)
        part = w.vocab.take(pa.array(at)) if k else w.vocab
        h = tx.hash_strings(pc.utf8_slice_codeunits(part, 0, k) if k else part) if len(at) else np.zeros(0, np.uint64)
        h = tx.mix(h + np.uint64(k))
        if wanted is not None:
            place = np.searchsorted(wanted, h)
            hit = np.flatnonzero(wanted[np.minimum(place, len(wanted) - 1)] == h) if len(wanted) else np.zeros(0, int)
            at, h = at[hit], place[hit].astype(np.uint64)
        entries.append(at)
        names.append(h)
    entries, names = np.concatenate(entries), np.concatenate(names)
    order = np.argsort(entries, kind="stable")
    return entries[order], names[order]


def _pairs(rows: np.ndarray, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Without repeats, ordered by row."""
    order = np.lexsort((names, rows))
    rows, names = rows[order], names[order]
    if not len(rows):
        return rows, names
    keep = np.concatenate(([True], (rows[1:] != rows[:-1]) | (names[1:] != names[:-1])))
    return rows[keep], names[keep]


def content_view(w: tx.Words, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    width = max(len(w.vocab), 1)
    pairs = tx.distinct(w.owners() * width + w.codes)
    owner, code = pairs // width, pairs % width
    entries, names = _word_features(w, wanted)
    starts = np.searchsorted(entries, np.arange(width + 1))
    sizes = np.diff(starts)[code]
    keep = sizes > 0
    owner, code, sizes = owner[keep], code[keep], sizes[keep]
    inside = np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    rows, found = np.repeat(owner, sizes), names[np.repeat(starts[code], sizes) + inside]
    if wanted is not None:
        both = tx.distinct(rows * max(len(wanted), 1) + found.astype(np.int64))
        return both // max(len(wanted), 1), (both % max(len(wanted), 1)).astype(np.uint64)
    return _pairs(rows, found)


_SHARES = np.array([0.0, 0.005, 0.01, 0.02, 0.03, 0.05, 0.08, 0.12, 0.2, 0.3, 0.45, 0.65, 0.85])
_SIZES = np.array([1, 20, 60, 150, 400, 1000, 2500, 6000, 15000, 40000, 100000])


def metadata_view(text: pa.Array, source: pa.Array, lang: pa.Array, w: tx.Words) -> tuple[np.ndarray, np.ndarray]:
    text = pc.fill_null(text, "")
    n = len(text)
    chars = pc.utf8_length(text).to_numpy(zero_copy_only=False)
    count = w.counts()
    width = max(len(w.vocab), 1)
    same = np.zeros(len(w.codes), bool)  # a word that repeats the one before
    same[1:] = w.codes[1:] == w.codes[:-1]
    same[w.offsets[:-1][count > 0]] = False
    again = np.bincount(w.owners(), same, minlength=n)
    unique = np.bincount(tx.distinct(w.owners() * width + w.codes) // width, minlength=n)

    def share(pattern: str, whole: np.ndarray) -> np.ndarray:
        found = pc.count_substring_regex(text, pattern).to_numpy(zero_copy_only=False)
        return found / np.maximum(whole, 1)

    numbers = [
        ("chars", np.digitize(chars, _SIZES)),
        ("upper", np.digitize(share(r"\p{Lu}", chars), _SHARES)),
        ("digit", np.digitize(share(r"[0-9]", chars), _SHARES)),
        ("symbol", np.digitize(share(r"[^\p{L}\p{N}\s.,;:?'\"()-]", chars), _SHARES)),
        ("lines", np.digitize(share(r"\n", count), _SHARES)),
        ("word", np.digitize(chars / np.maximum(count, 1), np.arange(2, 16))),
        ("again", np.digitize(again / np.maximum(count, 1), _SHARES)),
        ("repeat", np.digitize(unique / np.maximum(count, 1), _SHARES) * 16 + np.digitize(count, _SIZES)),
    ]
    columns = [tx.hash_strings(pa.array([f"{name}={value}" for value in bins])) for name, bins in numbers]
    for name, values in (("source", source), ("lang", lang)):
        columns.append(tx.hash_strings(pc.binary_join_element_wise(name, pc.fill_null(values, ""), "=")))
    names = np.stack(columns, axis=1) if n else np.zeros((0, 10), np.uint64)
    return np.repeat(np.arange(n), names.shape[1]), tx.mix(names.ravel())


def _count_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(name, n, bad, toxic): of the labelled documents with each content feature, how many have which label. A name comes
    once for each of the small batches: working arrays are some forty times as large as their texts."""
    for batch in rt.chunks(batches, size=1 << 20):
        rows, names = content_view(tx.words(batch.column(1)))
        order = np.argsort(names, kind="stable")
        rows, names = rows[order], names[order]
        starts = np.flatnonzero(np.concatenate(([True], names[1:] != names[:-1]))) if len(names) else np.zeros(0, int)
        marks = [np.ones(batch.num_rows, np.int64)]
        marks += [pc.fill_null(batch.column(c), 0).to_numpy().astype(np.int64) for c in (4, 5)]
        sums = [np.add.reduceat(m[rows], starts) if len(starts) else np.zeros(0, np.int64) for m in marks]
        yield pa.RecordBatch.from_arrays(
            [pa.array(names[starts].view(np.int64)), *(pa.array(s) for s in sums)], ["name", "n", *_TARGETS]
        )


def _choose(counts: pa.Table, totals: dict[str, tuple[float, float]], most: int) -> np.ndarray:
    """The names of the features that tell most about each label by the chi-squared statistic, sorted."""
    names, n = counts["name"].to_numpy().view(np.uint64), counts["n"].to_numpy().astype(float)
    chosen = [np.zeros(0, np.uint64)]
    for target in _TARGETS:
        rows, positive = totals[target]
        if not 0 < positive < rows:
            continue
        have = counts[target].to_numpy().astype(float)
        expected = n * positive / rows
        score = (have - expected) ** 2 / (expected * (1 - positive / rows) * np.maximum(1 - n / rows, 1e-3) + 1e-9)
        best = np.lexsort((names, -score))[:most]
        chosen.append(names[best[score[best] > LEAST_SCORE]])
    return tx.distinct(np.concatenate(chosen))


def _features(wanted):
    """Rows (doc_id, hash, bad, toxic, content, metadata): places of each view's features, and a hash of the document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = np.frombuffer(wanted.value, np.uint64)
        for batch in rt.chunks(batches):
            w = tx.words(batch.column(1))
            views = Views(content_view(w, known), metadata_view(batch.column(1), batch.column(2), batch.column(3), w))
            rows, names = views.metadata
            meta = tx.distinct(rows * METADATA + (names % np.uint64(METADATA)).astype(np.int64))
            lists = []
            for at, places in (views.content, (meta // METADATA, meta % METADATA)):
                offsets = np.concatenate(([0], np.cumsum(np.bincount(at, minlength=batch.num_rows))))
                lists.append(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(places.astype(np.int16))))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(6), batch.column(4), batch.column(5), *lists], ["doc_id", "hash", *_TARGETS, *_VIEWS]
            )

    return run


def _sparse(lists: pa.Array | pa.ChunkedArray, width: int) -> Sparse:
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    if not len(lists):
        return Sparse(np.zeros(0, np.int64), np.zeros(0, np.int32), width)
    return Sparse(np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy(), width)


class Target(NamedTuple):
    """For each view weights and intercept, its calibration, and the combination of the views' log-odds."""

    fits: tuple[tuple[np.ndarray, float], tuple[np.ndarray, float]]
    scale: tuple[np.ndarray, np.ndarray]
    mix: np.ndarray

    def logits(self, views: list[Sparse]) -> list[np.ndarray]:
        return [np.clip(x.dot(w) + b, -12, 12) for x, (w, b) in zip(views, self.fits, strict=True)]

    def confident(self, views: list[Sparse]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each view which documents it is sure to have the label, and not to."""
        p = [sigmoid(z * a + b) for z, (a, b) in zip(self.logits(views), self.scale, strict=True)]
        return [(q >= CONFIDENT[1], q <= CONFIDENT[0]) for q in p]

    def probability(self, views: list[Sparse]) -> np.ndarray:
        return sigmoid(np.column_stack(self.logits(views)) @ self.mix[:-1] + self.mix[-1])


class Model(NamedTuple):
    width: int
    targets: dict[str, Target]

    def views(self, batch: pa.RecordBatch) -> list[Sparse]:
        return [_sparse(batch.column(c), n) for c, n in zip(_VIEWS, (self.width, METADATA), strict=True)]


class Extra(NamedTuple):
    """Pseudo-labelled rows for one view of one target."""

    x: Sparse
    y: np.ndarray


def _fit(x: list[Sparse], y: np.ndarray, held: np.ndarray, extra: list[Extra | None], before: Target | None) -> Target:
    """``y``: 1, 0, or NaN where the document lacks this label. ``held``: rows kept for calibration."""
    known = ~np.isnan(y)
    held = held & known
    fits, scale = [], []
    for v, l2 in enumerate((2e-4, 1e-3)):
        live = known & ~held
        rows, truth, weight = x[v].take(live), y[live], np.ones(int(live.sum()))
        if (more := extra[v]) is not None and len(more.y) and len(truth):
            share = truth.mean()
            rows = Sparse(np.concatenate((rows.sizes, more.x.sizes)), np.concatenate((rows.columns, more.x.columns)), rows.shape[1])
            positive = more.y.mean()
            classes = (share / max(positive, 1e-9), (1 - share) / max(1 - positive, 1e-9))
            weight = np.concatenate((weight, 0.5 * np.where(more.y > 0.5, *classes)))
            truth = np.concatenate((truth, more.y))
        fits.append(fit_logistic(rows, truth, weight, l2, before.fits[v] if before else None))
    z = [np.clip(x[v].dot(w) + b, -12, 12) for v, (w, b) in enumerate(fits)]
    some = held.any()
    for v in range(2):
        scale.append(fit_dense(z[v][held][:, None], y[held]) if some else np.array([1.0, 0.0]))
    mix = fit_dense(np.column_stack(z)[held], y[held]) if some else np.array([1.0, 0.0, 0.0])
    return Target(tuple(fits), tuple(scale), mix)


#: A group of pseudo-labels: the view that gives them, and the class.
_GROUPS = [(t, v, c) for t in range(2) for v in range(2) for c in (1, 0)]


def _sure(model, shares):
    """Without ``shares`` how many unlabelled documents each view is confident of, as (group, n); with them those drawn by
    their hash, as (group, doc_id, places), with the features that the other view has of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            views = m.views(batch)
            hashes = batch.column("hash").to_numpy().view(np.uint64).astype(np.float64) / 2.0**64
            found = []
            for g, (t, v, c) in enumerate(_GROUPS):
                sure = m.targets[_TARGETS[t]].confident(views)[v][1 - c] & batch.column(_TARGETS[t]).is_null().to_numpy(zero_copy_only=False)
                found.append(np.flatnonzero(sure & (hashes < shares[g]) if shares else sure))
            if not shares:
                yield pa.RecordBatch.from_arrays([pa.array(range(len(_GROUPS)), pa.int32()), pa.array([len(f) for f in found], pa.int64())], ["g", "n"])
                continue
            for g, at in enumerate(found):
                places = batch.column(_VIEWS[1 - _GROUPS[g][1]]).take(pa.array(at))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), g, np.int32)), batch.column("doc_id").take(pa.array(at)), places], ["g", "doc_id", "places"])

    return run


def _exchange(spark: SparkSession, table: DataFrame, model: Model, pseudo: int) -> dict[str, list[Extra | None]]:
    """For each target and view the documents that the other view is confident of."""
    shared = spark.sparkContext.broadcast(model)
    counts = {r["g"]: r["n"] for r in table.mapInArrow(_sure(shared, None), "g int, n long").groupBy("g").agg(F.sum("n").alias("n")).collect()}
    shares = [min(1.0, pseudo / max(counts.get(g, 0), 1)) for g in range(len(_GROUPS))]
    drawn = table.mapInArrow(_sure(shared, shares), "g int, doc_id long, places array<short>").toArrow().sort_by([("g", "ascending"), ("doc_id", "ascending")])
    extra: dict[str, list[Extra | None]] = {t: [None, None] for t in _TARGETS}
    groups = drawn["g"].to_numpy()
    for t, target in enumerate(_TARGETS):
        for v in range(2):
            mine = np.isin(groups, [g for g, (a, b, _) in enumerate(_GROUPS) if (a, b) == (t, 1 - v)])
            lists = drawn["places"].filter(pa.array(mine))
            y = np.array([_GROUPS[g][2] for g in groups[mine].tolist()], float)
            extra[target][v] = Extra(_sparse(lists, (model.width, METADATA)[v]), y)
    shared.unpersist()
    return extra


def fit(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, pseudo: int = PSEUDO, rounds: int = ROUNDS) -> tuple[Model, DataFrame]:
    """The model, and the table of all documents' features."""
    spark = docs.sparkSession
    marks = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality", "toxic")
        .where("doc_id IS NOT NULL")
        .groupBy("doc_id")
        .agg((1 - F.min("quality")).cast("int").alias("bad"), F.max("toxic").cast("int").alias("toxic"))
        .where("bad IS NOT NULL OR toxic IS NOT NULL")
    )
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "source", "lang")
    taken = marks.join(texts.select("doc_id").distinct(), "doc_id", "left_semi").orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled)
    # At most ``labelled`` rows, so broadcasting them is bounded by a parameter.
    taken = F.broadcast(rt.written(taken, "cotraining-labels"))
    sample = texts.join(taken, "doc_id").select("doc_id", "text", "source", "lang", *_TARGETS)
    totals = taken.agg(*(f(t).alias(f"{t}_{n}") for t in _TARGETS for n, f in (("rows", F.count), ("sum", F.sum)))).first()
    counts = (
        sample.mapInArrow(_count_features, "name long, n long, bad long, toxic long")
        .groupBy("name")
        .agg(*(F.sum(c).alias(c) for c in ("n", *_TARGETS)))
        .where(F.col("n") >= MIN_DOCUMENTS)
        .toArrow()
    )
    wanted = _choose(counts, {t: (totals[f"{t}_rows"] or 0, totals[f"{t}_sum"] or 0) for t in _TARGETS}, FEATURES)
    del counts
    table = rt.written(
        texts.join(taken, "doc_id", "left")
        .select("doc_id", "text", "source", "lang", *_TARGETS, F.xxhash64(F.lit(7), "doc_id", "text").alias("hash"))
        .mapInArrow(
            _features(spark.sparkContext.broadcast(wanted.tobytes())),
            "doc_id long, hash long, bad int, toxic int, content array<short>, metadata array<short>",
        ),
        "cotraining-features",
    )
    own = table.where("bad IS NOT NULL OR toxic IS NOT NULL").toArrow().sort_by([("doc_id", "ascending"), ("hash", "ascending")])
    width = max(len(wanted), 1)
    x = [_sparse(own[c], n) for c, n in zip(_VIEWS, (width, METADATA), strict=True)]
    truth = {t: own[t].to_numpy().astype(float) if len(own) else np.zeros(0) for t in _TARGETS}
    held = tx.mix(own["doc_id"].to_numpy().astype(np.int64).view(np.uint64)) % np.uint64(4) == 0
    del own
    targets = {t: _fit(x, y, held, [None, None], None) for t, y in truth.items()}
    for _ in range(rounds if len(held) and held.any() else 0):
        extra = _exchange(spark, table, Model(width, targets), pseudo)
        targets = {t: _fit(x, y, held, extra[t], targets[t]) for t, y in truth.items()}
    return Model(width, targets), table


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Model = model.value
        for batch in batches:
            views = m.views(batch)
            bad, toxic = (m.targets[t].probability(views) for t in _TARGETS)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array(1 - bad),
                    pa.array(toxic),
                    pa.array((1 - bad) * (1 - toxic)),
                    pa.array((bad < REJECT) & (toxic < REJECT)),
                ],
                ["doc_id", "quality", "toxic", "score", "kept"],
            )

    return run


def scored(docs: DataFrame, labels: DataFrame, **fitting) -> DataFrame:
    """All documents with the probabilities of quality and toxicity, their combined score and whether to keep them.

    Defined cases: a null text counts as empty, and an empty one is scored by its metadata; very long ones are read whole;
    null source or language is a category of its own. A null doc_id stays null in the result. Rows that repeat an id are
    scored each, and documents that tie in all features have equal scores. Documents with several label rows have the
    worst of them; null labels and labels of no document are ignored. Without labels, or with one class only, the view
    scores are constant at the classes' share, at even odds without any label, and as REJECT needs a probability of 0.5
    or more, ``kept`` follows from that. Other columns of either table, whatever their names, are not read. An empty table
    gives no rows.
    """
    model, table = fit(docs, labels, **fitting)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return table.select("doc_id", *_VIEWS).mapInArrow(_score(shared), "doc_id long, quality double, toxic double, score double, kept boolean")


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(rt.documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without those that the classifier rejects.

    Defined cases: rows with a null id stay. Where rows that repeat an id are scored differently, all of them go if one is
    rejected. Null and empty texts are judged by their metadata, very long ones whole, ties alike. Without labels all stay
    or go at even odds, as ``scored`` says. An empty table stays empty. Further columns, whatever their names, are passed on.
    """
    rejected = scored(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("NOT kept AND doc_id IS NOT NULL")
    return rt.without(docs, rejected.select("doc_id").distinct())


QUERIES = {"op4_cotraining": op4_cotraining}
SQL: dict[str, str] = {}
