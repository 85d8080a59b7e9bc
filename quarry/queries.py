"""The registered queries of the search engine, and the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import analysis as A
from quarry.functions.scoring import idf
from quarry.functions.stem_sql import stems
from quarry.operators import docsets
from quarry.operators.collectors import Both, Count, TopScore, top_per_group
from quarry.plans.query import All, Boolean, Empty, Occur, Query, Term, intersection, multi_terms, must_should, union
from quarry.sources import postings as P
from quarry.shared import shared_dir, spread
from quarry.sources.index import Index, Reader, Writer
from quarry.sources.merge_policy import SizeTieredPolicy, no_merge
from quarry.sources.schema import IndexSchema

_TEXT = IndexSchema.of("text")
_WIDE = IndexSchema.of("text", "lang", "source")
Run = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(_docs(spark, sf_dir))


_BUILT: dict[tuple, Index] = {}


def _reader(spark: SparkSession, sf_dir: str, schema: IndexSchema = _TEXT) -> Reader:
    """A reader of an index of all documents in the shared folder, built by the first query of a session that asks for it."""
    docs = _docs(spark, sf_dir)
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, sf_dir, changed, schema)
    if key not in _BUILT or not _BUILT[key].storage.versions():
        index = _new_index(spark, schema)
        writer = index.writer(no_merge)
        writer.add(docs)
        writer.commit()
        _BUILT[key] = index
    return _BUILT[key].reader()


def _new_index(spark: SparkSession, schema: IndexSchema = _TEXT) -> Index:
    return Index.create(spark, f"{shared_dir(spark)}/quarry-index/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}", schema)


def t(text: str, field: str = "text") -> Term:
    return Term(field, text)


def _scored(query: Query | str, schema: IndexSchema = _TEXT) -> Run:
    return lambda spark, sf_dir: _reader(spark, sf_dir, schema).scored(query)


def _counted(query: Query | str) -> Run:
    return lambda spark, sf_dir: Count().plan(_reader(spark, sf_dir).scored(query))


# SQL pieces.
_SPLIT = r"unnest(list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> ''))"
_TOKENS = f"SELECT doc_id, 'text' AS field, {_SPLIT.format('text')} AS term FROM documents"
_TOKENS_WIDE = " UNION ALL ".join(
    f"SELECT doc_id, '{f}' AS field, {_SPLIT.format(f)} AS term FROM documents" for f in _WIDE.names
)


def _with(tokens: str = _TOKENS) -> str:
    return f"""WITH tok AS ({tokens}),
p AS (SELECT field, term, doc_id, count(*) AS tf FROM tok GROUP BY 1, 2, 3),
n AS (SELECT count(*) AS n FROM documents),
st AS (SELECT field, term, count(*) AS df FROM p GROUP BY 1, 2),
s AS (SELECT field, term, doc_id, tf * (1.0::DOUBLE + ln(n::DOUBLE / (1 + df))) AS score FROM p JOIN st USING (field, term), n)"""


def _leaf_sql(wanted: list[tuple[str, str]]) -> str:
    """l(doc_id, s0, s1, ...): a column for each leaf."""
    columns = ", ".join(f"max(CASE WHEN field = '{f}' AND term = '{x}' THEN score END) AS s{i}" for i, (f, x) in enumerate(wanted))
    picks = " OR ".join(f"(field = '{f}' AND term = '{x}')" for f, x in wanted)
    return f", l AS (SELECT doc_id, {columns} FROM s WHERE {picks} GROUP BY doc_id)"


def _tree_sql(expression: str, *wanted: str, fields: str = "text") -> str:
    return _with() + _leaf_sql([(fields, x) for x in wanted]) + f" SELECT doc_id, {expression} AS score FROM l WHERE {expression} IS NOT NULL"


def _or_sql(*columns: str) -> str:
    total = " + ".join(f"coalesce({c}, 0.0::DOUBLE)" for c in columns)
    return f"(CASE WHEN coalesce({', '.join(columns)}) IS NOT NULL THEN {total} END)"


# Queries that are more than one expression.


def lower_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", A.lower_case(F.col("text")).alias("lowered"))


def simple_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.postings(_texts(spark, sf_dir), _TEXT).select("doc_id", "term", F.col("tf").alias("tokens"))


def markup_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumnRenamed("page_id", "doc_id")
    return P.postings(pages, IndexSchema.of("url", "html"))


def stop_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    analyzers = A.Registry({"stop": A.DEFAULT.with_token_filter(A.stop_word_filter)})
    return P.postings(_texts(spark, sf_dir), IndexSchema.of(text="stop"), analyzers).select("doc_id", "term", F.col("tf").alias("tokens"))


def stem_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = P.counts(_texts(spark, sf_dir), _TEXT).groupBy(F.col("term").alias("word")).agg(F.sum("tf").alias("n"))
    return words.select("word", "n", A.stemming_filter(F.array("word"))[0].alias("stem"))


def english_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.postings(_texts(spark, sf_dir), IndexSchema.of(text="en_stem"))


def term_freq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.postings(_texts(spark, sf_dir), _WIDE)


def term_dict(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.term_stats(P.postings(_texts(spark, sf_dir), _WIDE))


def term_enumeration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir, _WIDE).terms("source")


def doc_freq_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _reader(spark, sf_dir).term_stats.where(F.col("term").isin("the", "und", "license", "absentword"))
    wanted = spark.createDataFrame([("the",), ("und",), ("license",), ("absentword",)], "term string")
    return wanted.join(stats, "term", "left").select("term", F.coalesce("df", F.lit(0)).alias("df"))


def index_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reader(spark, sf_dir).n_docs


def idf_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return r.term_stats.crossJoin(F.broadcast(r.n_docs)).select("term", "df", idf(F.col("n"), F.col("df")).alias("idf"))


def multi_value_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    docs = turns.groupBy(F.col("conv_id").alias("doc_id")).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x["text"]).alias("text")
    )
    return P.postings(docs, _TEXT)


def must_should_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return docsets.must_should(r.scored(t("und")), r.scored(t("license")))


def union_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return docsets.union(r.scored(t("les")), r.scored(t("und")))


def intersection_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _reader(spark, sf_dir)
    return docsets.intersection(r.scored(t("the")), r.scored(t("license")))


def top_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TopScore(10).plan(_reader(spark, sf_dir).scored("text:the OR text:and"))


def top_score_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TopScore(10, 25).plan(_reader(spark, sf_dir).scored("text:the OR text:and"))


def best_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best documents of each source."""
    scored = _reader(spark, sf_dir).scored("text:the OR text:and")
    joined = scored.join(_docs(spark, sf_dir).select("doc_id", "source"), "doc_id")
    best = top_per_group(joined, ["source"], [F.col("score").desc(), F.col("doc_id").desc()], 3)
    return best.select("source", "doc_id", "score")


def count_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Count().plan(_reader(spark, sf_dir).scored("text:the AND text:license"))


def tuple_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Both(TopScore(10), Count()).plan(_reader(spark, sf_dir).scored("text:les OR text:license"))


def _segmented(spark: SparkSession, sf_dir: str, k: int = 4) -> tuple[Index, Writer]:
    index = _new_index(spark)
    writer = index.writer(no_merge)
    writer.add_divided(_docs(spark, sf_dir), k, F.coalesce(F.pmod("doc_id", F.lit(k)), F.lit(0)).cast("int"))
    writer.commit()
    return index, writer


_SEGMENT_QUERY = "(text:license AND text:the) OR text:und"


def segment_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segmented(spark, sf_dir)[0].reader().scored(_SEGMENT_QUERY)


def merged_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, writer = _segmented(spark, sf_dir)
    writer.merge([s.id for s in index.meta().segments])
    return index.reader().scored(_SEGMENT_QUERY)


def doc_address(spark: SparkSession, sf_dir: str) -> DataFrame:
    index, _ = _segmented(spark, sf_dir)
    reader = index.reader()
    return reader.addresses().withColumn("slice", F.col("doc_id") % 4).select("doc_id", "slice", "seg_doc_id")


def merge_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the policy wants merged, of an index in ten segments: how many of them and their documents."""
    index, _ = _segmented(spark, sf_dir, 10)
    sizes = {s.id: s.num_docs for s in index.meta().segments}
    rows = [(len(ids), sum(sizes[i] for i in ids)) for ids in SizeTieredPolicy()(list(index.meta().segments))]
    return spark.createDataFrame(rows, "segments long, num_docs long")


def gc_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents of segments that are garbage: two of four are merged while a reader has them, and then it is closed.
    A fifth that is staged is none."""
    index, writer = _segmented(spark, sf_dir)
    reader = index.reader()
    segments = {s.id for s in reader.meta.segments if s.opstamp in (1, 2)}
    writer.merge(sorted(segments))
    writer.add(_docs(spark, sf_dir).where("doc_id % 4 = 3"))
    reader.close()
    return index.data.get("docs", index.garbage()).select("doc_id")


_OR_LU = _or_sql("s0", "s1")
_ADDRESS_SQL = "SELECT doc_id, doc_id % 4 AS slice, row_number() OVER (PARTITION BY doc_id % 4 ORDER BY doc_id) - 1 AS seg_doc_id FROM documents"
_TOP = _tree_sql(_OR_LU, "the", "and")
_SEGMENT_SQL = _tree_sql(_or_sql("(s0 + s1)", "s2"), "license", "the", "und")
_GROUPED = "SELECT doc_id, term, count(*)::BIGINT AS tokens FROM tok GROUP BY 1, 2"

QUERIES: dict[str, tuple[Run, str | None]] = {
    "lower_filter": (lower_filter, "SELECT doc_id, lower(text) AS lowered FROM documents"),
    "simple_tokens": (simple_tokens, f"WITH tok AS ({_TOKENS}) {_GROUPED}"),
    "markup_tokens": (
        markup_tokens,
        "WITH tok AS ("
        + " UNION ALL ".join(f"SELECT page_id AS doc_id, '{f}' AS field, {_SPLIT.format(f)} AS term FROM pages" for f in ("url", "html"))
        + ") SELECT field, term, doc_id, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2, 3",
    ),
    "stop_tokens": (
        stop_tokens,
        f"WITH tok AS (SELECT * FROM ({_TOKENS}) WHERE term NOT IN ({', '.join(repr(w) for w in A.STOP_WORDS)})) {_GROUPED}",
    ),
    "stem_tokens": (
        stem_tokens,
        f"WITH tok AS ({_TOKENS}), {stems('tok')}, n AS (SELECT term, count(*)::BIGINT AS n FROM tok GROUP BY term) "
        "SELECT term AS word, n, stem FROM n JOIN stemmed USING (term)",
    ),
    "english_tokens": (
        english_tokens,
        f"WITH tok AS ({_TOKENS}), {stems('tok')} SELECT field, stem AS term, doc_id, count(*)::BIGINT AS tf FROM tok JOIN stemmed USING (term) "
        f"WHERE stem NOT IN ({', '.join(repr(w) for w in A.STOP_WORDS)}) GROUP BY 1, 2, 3",
    ),
    "term_freq": (term_freq, f"WITH tok AS ({_TOKENS_WIDE}) SELECT field, term, doc_id, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2, 3"),
    "term_dict": (term_dict, f"WITH tok AS ({_TOKENS_WIDE}) SELECT field, term, count(DISTINCT doc_id)::BIGINT AS df FROM tok GROUP BY 1, 2"),
    "term_enumeration": (
        term_enumeration,
        f"WITH tok AS ({_TOKENS_WIDE}) SELECT term, count(DISTINCT doc_id)::BIGINT AS df FROM tok WHERE field = 'source' GROUP BY 1",
    ),
    "doc_freq_lookup": (
        doc_freq_lookup,
        f"WITH tok AS ({_TOKENS}), w(term) AS (VALUES ('the'), ('und'), ('license'), ('absentword')) "
        "SELECT w.term, count(DISTINCT doc_id)::BIGINT AS df FROM w LEFT JOIN tok USING (term) GROUP BY 1",
    ),
    "index_stats": (index_stats, "SELECT count(*)::BIGINT AS n FROM documents"),
    "idf_table": (idf_table, _with() + " SELECT term, df::BIGINT AS df, 1.0::DOUBLE + ln(n::DOUBLE / (1 + df)) AS idf FROM st, n"),
    "multi_value_field": (
        multi_value_field,
        "WITH d AS (SELECT conv_id AS doc_id, string_agg(text, ' ' ORDER BY turn) AS text FROM conversations GROUP BY 1), "
        f"tok AS (SELECT doc_id, 'text' AS field, {_SPLIT.format('text')} AS term FROM d) "
        "SELECT field, term, doc_id, count(*)::BIGINT AS tf FROM tok GROUP BY 1, 2, 3",
    ),
    "term_query": (_scored(t("license")), _tree_sql("s0", "license")),
    "term_query_field2": (
        _scored(t("en", "lang"), _WIDE),
        _with(_TOKENS_WIDE) + _leaf_sql([("lang", "en")]) + " SELECT doc_id, s0 AS score FROM l",
    ),
    "multi_terms": (_scored(multi_terms(t("les"), t("und"))), _tree_sql(_OR_LU, "les", "und")),
    "or_query": (_scored("text:les OR text:und"), _tree_sql(_OR_LU, "les", "und")),
    "implicit_or": (_scored("text:les text:license"), _tree_sql(_OR_LU, "les", "license")),
    "and_query": (_scored(intersection(t("the"), t("license"))), _tree_sql("(s0 + s1)", "the", "license")),
    "nested_bool": (_scored("(text:license AND text:the) OR text:und"), _SEGMENT_SQL),
    "nested_api": (
        _scored(union(intersection(t("license"), t("the")), intersection(t("und"), union(t("der"), t("die"))))),
        _tree_sql(_or_sql("(s0 + s1)", f"(s2 + {_or_sql('s3', 's4')})"), "license", "the", "und", "der", "die"),
    ),
    "left_assoc": (_scored("text:les OR text:the AND text:license"), _tree_sql(f"({_or_sql('s0', 's1')} + s2)", "les", "the", "license")),
    "must_should": (
        _scored(must_should([t("the")], [t("license")])),
        _tree_sql("(s0 + coalesce(s1, 0.0::DOUBLE))", "the", "license"),
    ),
    "must_should_sets": (must_should_sets, _tree_sql("(s0 + coalesce(s1, 0.0::DOUBLE))", "und", "license")),
    "union_sets": (union_sets, _tree_sql(_OR_LU, "les", "und")),
    "intersection_sets": (intersection_sets, _tree_sql("(s0 + s1)", "the", "license")),
    "all_query": (_scored(All()), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents"),
    "empty_string_query": (_scored(""), "SELECT doc_id, 1.0::DOUBLE AS score FROM documents"),
    "all_in_boolean": (
        _scored(Boolean(((Occur.MUST, All()), (Occur.SHOULD, t("license"))))),
        _with() + _leaf_sql([("text", "license")]) + " SELECT doc_id, 1.0::DOUBLE + coalesce(s0, 0.0::DOUBLE) AS score FROM documents LEFT JOIN l USING (doc_id)",
    ),
    "empty_query": (_counted(Empty()), "SELECT 0::BIGINT AS hits"),
    "unknown_field": (_counted("nofield:the"), "SELECT 0::BIGINT AS hits"),
    "absent_term": (_counted("text:absentword"), "SELECT 0::BIGINT AS hits"),
    "bare_term_multi_field": (
        _scored("en", _WIDE),
        _with(_TOKENS_WIDE)
        + _leaf_sql([(f, "en") for f in _WIDE.names])
        + f" SELECT doc_id, {_or_sql('s0', 's1', 's2')} AS score FROM l",
    ),
    "repeated_term": (_scored("text:license text:license"), _tree_sql("(s0 + s0)", "license")),
    "top_score": (top_score, f"SELECT * FROM ({_TOP}) ORDER BY score DESC, doc_id DESC LIMIT 10"),
    "top_score_offset": (top_score_offset, f"SELECT * FROM ({_TOP}) ORDER BY score DESC, doc_id DESC LIMIT 10 OFFSET 25"),
    "best_by_source": (
        best_by_source,
        f"SELECT source, doc_id, score FROM (SELECT source, doc_id, score, row_number() OVER (PARTITION BY source ORDER BY score DESC, doc_id DESC) AS k "
        f"FROM ({_TOP}) JOIN documents USING (doc_id)) WHERE k <= 3",
    ),
    "count_hits": (count_hits, f"SELECT count(*)::BIGINT AS hits FROM ({_tree_sql('(s0 + s1)', 'the', 'license')})"),
    "tuple_hits": (
        tuple_hits,
        f"SELECT *, (count(*) OVER ())::BIGINT AS hits FROM ({_tree_sql(_OR_LU, 'les', 'license')}) ORDER BY score DESC, doc_id DESC LIMIT 10",
    ),
    "segment_search": (segment_search, _SEGMENT_SQL),
    "merged_search": (merged_search, _SEGMENT_SQL),
    "doc_address": (doc_address, _ADDRESS_SQL),
    "merge_candidates": (
        merge_candidates,
        "SELECT count(*)::BIGINT AS segments, sum(n)::BIGINT AS num_docs FROM (SELECT doc_id % 10 AS s, count(*) AS n FROM documents GROUP BY 1) "
        "WHERE n < 10000000 GROUP BY greatest(n, 10000) HAVING count(*) >= 8",
    ),
    "gc_candidates": (gc_candidates, "SELECT doc_id FROM documents WHERE doc_id % 4 < 2"),
}


#: Logarithms of two engines may differ in the last digit; registered queries are compared to so many places.
_DIGITS = 9
_INEXACT = ("score", "idf")


def _rounded(run: Run) -> Run:
    def rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = run(spark, sf_dir)
        return df.withColumns({c: F.round(c, _DIGITS) for c in _INEXACT if c in df.columns})

    return rounded


def queries() -> dict[str, Run]:
    return {name: _rounded(run) for name, (run, _) in QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    out = {}
    for name, (_, sql) in QUERIES.items():
        if sql:
            column = _COLUMNS.get(name, "score" if "AS score" in sql else None)
            out[name] = f"SELECT * REPLACE (round({column}, {_DIGITS}) AS {column}) FROM ({sql})" if column else sql
    return out


#: Queries with the score in an inner part of their SQL only.
_COLUMNS = {"idf_table": "idf", "count_hits": None}


__all__ = ["QUERIES", "oracle_sql", "queries"]
