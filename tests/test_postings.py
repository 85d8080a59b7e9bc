from collections import Counter

import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis as A
from quarry.sources import index as I
from quarry.sources import postings as P
from quarry.sources.index import Index
from quarry.sources.merge_policy import no_merge
from quarry.sources.schema import IndexSchema

TEXTS = ["Running runs, the run: RUNNING!", "the  THE of skies", "", None, "één Ärger ärger x1 2²", "word " * 50]


def _rows(df):
    return Counter((r.field, r.term, r.doc_id, r.tf) for r in df.collect())


def _by_tokens(docs, schema, registry=A.REGISTRY):
    return P.tokens(docs, schema, registry).groupBy("field", "term", "doc_id").agg(F.count("*").alias("tf"))


@pytest.mark.parametrize("ids", [range(6), [1, 1, 2, 3, 3, 1], [None, None, 5, 5, -1, None]])
def test_postings_equal_grouped_tokens(spark, ids):
    """With ids that occur once, several times or are missing; texts and lists of them; clashing names of fields."""
    rows = [(i, x, [x, None, x], x) for i, x in zip(ids, TEXTS, strict=True)]
    docs = spark.createDataFrame(rows, "doc_id long, part string, source array<string>, other string").repartition(3)
    registered = A.Registry({"default": A.DEFAULT, "stop": A.DEFAULT.with_token_filter(A.stop_word_filter), "odd": A.Analyzer(lambda text: F.split(text, " "))})
    for schema, registry in ((IndexSchema.of("part", source="en_stem"), A.REGISTRY), (IndexSchema.of(source="stop", part="odd", missing="default"), registered)):
        got = _rows(P.postings(docs, schema, registry))
        assert got and got == _rows(_by_tokens(docs, schema, registry))
        packed = P.packed(docs, schema, registry, F.coalesce(F.pmod("doc_id", F.lit(2)), F.lit(0)).cast("int"))
        assert _rows(P.unpacked(packed)) == got
        assert {(r.field, r.term): r.df for r in P.packed_stats(packed).collect()} == {k: n for k, n in Counter((f, t) for f, t, _, _ in got.elements()).items()}


def test_postings_of_documents_are_not_shuffled(spark, tmp_path):
    """Each document's counts are whole in its row."""
    spark.createDataFrame([(i, "a b a") for i in range(20)], "doc_id long, text string").write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    found = P.postings(docs, IndexSchema.of(text="en_stem"))
    assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
    assert found.count() == 20  # "a" is a stop word


@pytest.mark.parametrize("joined", [0, 10_000])
@pytest.mark.parametrize("files", [True, False])
def test_divided_documents_and_merge(spark, tmp_path, monkeypatch, joined, files):
    """Several segments of one pass hold what they would by themselves, an empty one too; merged they give the same hits."""
    monkeypatch.setattr(I, "_JOINED", joined)
    schema = IndexSchema.of("text", "lang")
    index = Index.create(spark, f"file://{tmp_path}/ix", schema) if files else Index.in_memory(spark, schema)
    docs = spark.createDataFrame([(i, f"a w{i % 3} w{i % 3}", "en" if i % 2 else None) for i in range(30)], "doc_id long, text string, lang string")
    w = index.writer(no_merge)
    added = w.add_divided(docs, 4, (F.col("doc_id") % 3).cast("int"))
    assert [a.opstamp for a in added] == [1, 2, 3, 4] and [a.segment.num_docs for a in added] == [10, 10, 10, 0]
    w.commit()
    assert len(index.meta().segments) == 3 and index.storage.staged() == set()
    for a in added[:3]:
        assert {(r.term, r.tf) for r in index.data.get("postings", [a.segment.id]).where("field = 'text' AND term <> 'a'").collect()} == {(f"w{added.index(a)}", 2)}
    before = sorted(map(tuple, index.reader().scored("text:w1 OR lang:en").collect()))
    stats = sorted(map(tuple, index.reader().term_stats.collect()))
    w.merge([s.id for s in index.meta().segments])
    assert sorted(map(tuple, index.reader().scored("text:w1 OR lang:en").collect())) == before
    assert sorted(map(tuple, index.reader().term_stats.collect())) == stats == [("lang", "en", 15), ("text", "a", 30), *(("text", f"w{i}", 10) for i in range(3))]
    if files and joined:
        assert index.data.packed([index.meta().segments[0].id]).count() == 5  # a row for each term


def test_an_earlier_format_is_not_read(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/ix", IndexSchema.of("text"))
    old = index.storage.load() | {"version": 1, "format": 1}
    index.storage.publish(old)
    with pytest.raises(ValueError):
        index.meta()
