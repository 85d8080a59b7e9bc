"""Documents to postings: (field, term, doc_id, tf), and the statistics of terms.

Words are counted in Arrow batches, by document. A document has one row, so its counts are whole and needn't be shuffled;
only where a table has several rows of one id are they added up. Segments hold postings packed: a row for each term of a
batch, with the lists of its documents and counts, as rows of single postings would take several times as long to sort,
write and merge.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.functions.analysis import REGISTRY, Analyzer, Registry
from quarry.sources.schema import IndexSchema

_SEPARATOR = r"[^\p{L}\p{N}]+"
_SLICE = 32 << 20  # bytes of text whose words are counted together
_BLOCK = 1 << 16  # postings of a term up to which rows are joined when they are merged


def tokens(docs: DataFrame, schema: IndexSchema, registry: Registry = REGISTRY) -> DataFrame:
    """(doc_id, field, term), a row for each token. Null values, and fields that documents lack, give none."""
    schema.check(docs)
    parts = []
    for f in schema.fields:
        if f.name not in docs.columns:
            continue
        analyzer = registry.get(f.analyzer)
        repeated = isinstance(docs.schema[f.name].dataType, T.ArrayType)
        values = F.filter(F.col(f.name), lambda v: v.isNotNull()) if repeated else F.col(f.name)
        found = analyzer.tokens_of_values(values) if repeated else analyzer.tokens(values)
        parts.append(docs.select("doc_id", F.lit(f.name).alias("field"), F.explode(found).alias("term")))
    if not parts:
        return docs.sparkSession.createDataFrame([], "doc_id long, field string, term string")
    return reduce(DataFrame.unionByName, parts)


def _source(docs: DataFrame, name: str, analyzer: Analyzer) -> Column:
    """What is counted: texts after the char filters where the rest can be done by distinct word, or lists of tokens."""
    repeated = isinstance(docs.schema[name].dataType, T.ArrayType)
    values = F.filter(F.col(name), lambda v: v.isNotNull()) if repeated else F.col(name)
    if analyzer.wordwise() is not None:
        return analyzer.filtered(values, repeated)
    return analyzer.tokens_of_values(values) if repeated else analyzer.tokens(values)


def _words(column: pa.Array, steps: list | None) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """The row of each token, its place in a vocabulary, and that."""
    lists = column if steps is None else pc.split_pattern_regex(column, _SEPARATOR)
    row = np.repeat(np.arange(len(lists)), pc.fill_null(pc.list_value_length(lists), 0).to_numpy())
    flat = lists.flatten()
    if flat.null_count:
        row, flat = row[flat.is_valid().to_numpy(zero_copy_only=False)], flat.drop_null()
    coded = flat.dictionary_encode()
    code, vocabulary = coded.indices.to_numpy(), coded.dictionary
    if steps is not None:
        blank = pc.index(vocabulary, "").as_py()
        kept = np.where(np.arange(len(vocabulary)) == blank, -1, np.arange(len(vocabulary)))
        if steps:
            out = [w or None for w in vocabulary.to_pylist()]
            for step in steps:
                out = [None if w is None else step(w) for w in out]
            coded = pa.array(out, pa.string()).dictionary_encode()
            kept, vocabulary = pc.fill_null(coded.indices, -1).to_numpy(), coded.dictionary
        code = kept[code]
        row, code = row[code >= 0], code[code >= 0]
    return row, code, vocabulary


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        step = max(1, int(batch.num_rows * _SLICE / max(batch.nbytes, 1)))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def _starts(*keys: np.ndarray) -> np.ndarray:
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _sizes(starts: np.ndarray, end: int) -> pa.Array:
    return pa.array(np.diff(np.append(starts, end)).astype(np.int32))


def _lists(starts: np.ndarray, values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.append(starts, len(values)).astype(np.int32)), values)


def _count(steps: list | None):
    """(term, doc_id, tf) from rows (doc_id, text or tokens)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, code, vocabulary = _words(batch.column(1), steps)
            keys = np.sort(row * max(1, len(vocabulary)) + code)
            starts = _starts(keys)
            row, code = np.divmod(keys[starts], max(1, len(vocabulary)))
            cells = [vocabulary.take(pa.array(code)), batch.column(0).take(pa.array(row)), pa.array(np.diff(np.append(starts, len(keys))))]
            yield pa.RecordBatch.from_arrays(cells, ["term", "doc_id", "tf"])

    return run


def _pack(steps: list | None):
    """(part, term, n, doc_id, tf), the last two being lists of n, from rows (doc_id, text or tokens, part)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            row, code, vocabulary = _words(batch.column(1), steps)
            n, part = batch.num_rows, batch.column(2).to_numpy().astype(np.int64)
            keys = np.sort((part[row] * max(1, len(vocabulary)) + code) * n + row)
            starts = _starts(keys)
            of, row = np.divmod(keys[starts], n)
            tf = pa.array(np.diff(np.append(starts, len(keys))))
            first = _starts(of)
            part, code = np.divmod(of[first], max(1, len(vocabulary)))
            cells = [pa.array(part.astype(np.int32)), vocabulary.take(pa.array(code)), _sizes(first, len(of)), _lists(first, batch.column(0).take(pa.array(row))), _lists(first, tf)]
            yield pa.RecordBatch.from_arrays(cells, ["part", "term", "n", "doc_id", "tf"])

    return run


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (part, field, term, n, doc_id, tf) that are sorted by the first three, those of one term joined up to ``_BLOCK``
    postings."""
    for batch in batches:
        if not batch.num_rows:
            continue
        part, fields, terms, n, ids, tfs = batch.columns
        sizes = n.to_numpy().astype(np.int64)
        same = pc.and_(pc.equal(terms[1:], terms[:-1]), pc.equal(fields[1:], fields[:-1])).to_numpy(zero_copy_only=False)
        same &= part.to_numpy()[1:] == part.to_numpy()[:-1]
        whole = np.cumsum(np.concatenate(([True], ~same)))
        total = np.cumsum(sizes)
        first = _starts(whole)
        block = (total - np.repeat((total - sizes)[first], np.diff(np.append(first, len(whole))))) // _BLOCK
        rows = _starts(whole, block)
        places = (total - sizes)[rows]
        cells = [c.take(pa.array(rows)) for c in (part, fields, terms)] + [_sizes(places, int(total[-1]))] + [_lists(places, x.flatten()) for x in (ids, tfs)]
        yield pa.RecordBatch.from_arrays(cells, batch.schema.names)


def _by_field(docs: DataFrame, schema: IndexSchema, registry: Registry) -> Iterator[tuple[str, Column, list | None]]:
    schema.check(docs)
    for f in schema.fields:
        if f.name in docs.columns:
            analyzer = registry.get(f.analyzer)
            yield f.name, _source(docs, f.name, analyzer), analyzer.wordwise()


def _repeats(docs: DataFrame) -> bool:
    """Whether several rows have one id; nothing but the ids is read."""
    return (docs.groupBy("doc_id").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0) > 1


def counts(docs: DataFrame, schema: IndexSchema, registry: Registry = REGISTRY) -> DataFrame:
    """(field, term, doc_id, tf): how often each row of ``docs`` has each term, by field."""
    kind = docs.schema["doc_id"].dataType
    shape = T.StructType([T.StructField("term", T.StringType()), T.StructField("doc_id", kind), T.StructField("tf", T.LongType())])
    parts = [
        docs.select("doc_id", source.alias("source")).mapInArrow(_count(steps), shape).select(F.lit(name).alias("field"), "term", "doc_id", "tf")
        for name, source, steps in _by_field(docs, schema, registry)
    ]
    if not parts:
        return docs.sparkSession.createDataFrame([], "field string, term string, doc_id long, tf long")
    return reduce(DataFrame.unionByName, parts)


def postings(docs: DataFrame, schema: IndexSchema, registry: Registry = REGISTRY) -> DataFrame:
    """How often each document has each term, by field."""
    found = counts(docs, schema, registry)
    return found.groupBy("field", "term", "doc_id").agg(F.sum("tf").alias("tf")) if _repeats(docs) else found


_PACKED = "part int, field string, term string, n int, doc_id array<long>, tf array<long>"


def packed(docs: DataFrame, schema: IndexSchema, registry: Registry = REGISTRY, part: Column | None = None) -> DataFrame:
    """The postings of documents whose ids are whole numbers, with a row for each term of a batch: how many documents, and
    lists of them and their counts. ``part``, an int from 0 on, divides the documents; rows of each part stand by themselves."""
    part = F.lit(0) if part is None else part
    if _repeats(docs):
        of = [r[0] for r in docs.select(part).distinct().collect()]
        found = [postings(docs.where(part == p), schema, registry).withColumn("part", F.lit(p)) for p in of]
        singles = reduce(DataFrame.unionByName, found).select("part", "field", "term", F.lit(1).alias("n"), F.array("doc_id").alias("doc_id"), F.array("tf").alias("tf"))
        return joined(singles.repartition("field", "term"))
    parts = [
        docs.select("doc_id", source.alias("source"), part.alias("part"))
        .mapInArrow(_pack(steps), "part int, term string, n int, doc_id array<long>, tf array<long>")
        .select("part", F.lit(name).alias("field"), "term", "n", "doc_id", "tf")
        for name, source, steps in _by_field(docs, schema, registry)
    ]
    return reduce(DataFrame.unionByName, parts) if parts else docs.sparkSession.createDataFrame([], _PACKED)


def joined(rows: DataFrame) -> DataFrame:
    """Packed postings with those of a term that are in one task joined."""
    return rows.select("part", "field", "term", "n", "doc_id", "tf").sortWithinPartitions("part", "field", "term").mapInArrow(_join, _PACKED)


def unpacked(rows: DataFrame) -> DataFrame:
    """A row for each posting. Filters on the other columns reach what is read."""
    rows = rows.drop("n")
    others = [c for c in rows.columns if c not in ("doc_id", "tf")]
    single = rows.select(*others, "tf", F.posexplode("doc_id").alias("place", "id"))
    return single.select(*(F.col("id").alias(c) if c == "doc_id" else F.get("tf", F.col("place")).alias(c) if c == "tf" else c for c in rows.columns))


def term_stats(postings: DataFrame) -> DataFrame:
    """(field, term, df): the term dictionary, with the documents that have each term."""
    return postings.groupBy("field", "term").agg(F.count("*").alias("df"))


def sum_stats(parts: DataFrame, *by: str) -> DataFrame:
    """The dictionary of several segments from theirs; ``by`` keeps some apart."""
    return parts.groupBy(*by, "field", "term").agg(F.sum("df").alias("df"))


def packed_stats(rows: DataFrame, *by: str) -> DataFrame:
    """The dictionary of packed postings."""
    return sum_stats(rows.select(*by, "field", "term", F.col("n").cast("long").alias("df")), *by)
