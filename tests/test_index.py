import gc
import io
import json
import math
import re
import threading
from dataclasses import dataclass

import pytest
from pyspark.sql import functions as F

from quarry import cli, logs
from quarry.operators.collectors import Both, Count, TopScore, top_per_group
from quarry.plans.query import Query, Term, union
from quarry.sources.index import Index
from quarry.sources.merge_policy import Segment, SizeTieredPolicy, no_merge
from quarry.sources.schema import IndexSchema, SchemaError
from quarry.sources.storage import MemoryFiles, Storage
from quarry.streaming.ingest import index_stream

SCHEMA = IndexSchema.of("title", "description")
IDIOMS = [
    (0, "Down To The Wire", "A situation that is not decided before the last minute."),
    (1, "Eat My Hat", "Confidence in an outcome."),
    (2, "When the Rubber Hits the Road", "When something is about to begin, get serious."),
]


@pytest.fixture(params=["files", "memory"])
def index(request, spark, tmp_path):
    return Index.create(spark, f"file://{tmp_path}/ix", SCHEMA) if request.param == "files" else Index.in_memory(spark, SCHEMA)


def frame(spark, rows, names="doc_id long, title string, description string"):
    return spark.createDataFrame(rows, names)


def test_first_documents(spark, index):
    w = index.writer()
    first = w.add(frame(spark, [(0, "test title", None)]))
    second = w.add(frame(spark, [(1, "abc", None)]))
    assert (first.opstamp, second.opstamp) == (1, 2)
    reader = index.reader()
    assert reader.search(Term("title", "test"), TopScore(1)) == []
    assert w.commit() == 3
    assert reader.search(Term("title", "test"), TopScore(1)) == []
    (hit,) = reader.reload().search("title:test", TopScore(1))
    assert hit == (0, pytest.approx(1 + math.log(2 / 2)))
    assert reader.doc_freq("title", "test") == 1 and reader.doc_freq("title", "none") == 0


def test_closed_writer_discards(spark, index):
    w = index.writer()
    w.add(frame(spark, [(0, "x", "y")]))
    w.close()
    assert index.garbage() == [] and index.reader().search("title:x") == []
    with pytest.raises(RuntimeError):
        w.commit()


def test_idioms(spark):
    index = Index.in_memory(spark, IndexSchema.of(phrase="en_stem", description="en_stem"))
    w = index.writer()
    w.add(frame(spark, IDIOMS, "doc_id long, phrase string, description string"))
    w.commit()
    hits, count = index.reader().search("phrase:hat OR description:serious", Both(TopScore(10), Count()))
    assert count == 2
    assert hits == [(2, pytest.approx(1.4054651, abs=1e-6)), (1, pytest.approx(1.4054651, abs=1e-6))]


def test_merges_leave_results(spark, index):
    w = index.writer(no_merge)
    for i in range(4):
        w.add(frame(spark, [(2 * i, "a b", "c"), (2 * i + 1, "b" * (i % 2), "a a")]))
    w.commit()
    query = union(Term("title", "b"), Term("description", "a"))
    before = sorted(index.reader().search(query, TopScore(100)))
    ids = [s.id for s in index.meta().segments]
    with pytest.raises(ValueError):
        w.merge([*ids, "unknown"])
    with pytest.raises(ValueError):
        w.merge([ids[0], ids[0]])
    w.merge(ids)
    assert len(index.meta().segments) == 1 and index.meta().num_docs == 8
    assert sorted(index.reader().search(query, TopScore(100))) == before
    assert index.garbage() == [] and not index.data.present() & set(ids)  # gone with the merge
    assert sorted(index.reader().search(query, TopScore(100))) == before
    assert sorted(r.seg_doc_id for r in index.reader().addresses().collect()) == list(range(8))


def test_vacuum_leaves_what_is_staged(spark, index):
    """Add, commit, add, vacuum, commit: by this handle or another, what was staged is there."""
    w = index.writer(no_merge)
    w.add(frame(spark, [(0, "a", "b")]))
    w.commit()
    w.add(frame(spark, [(1, "a", "b")]))
    assert index.garbage() == [] and index.vacuum() == []
    if not isinstance(index.storage, MemoryFiles):
        assert Index.open(spark, index.storage.root).vacuum() == []
    w.commit()
    assert sorted(d for d, _ in index.reader().search("title:a")) == [0, 1]
    w.add(frame(spark, [(2, "a", "b")]))
    (dead,) = index.storage.staged()  # as a writer leaves it that dies
    assert index.vacuum() == [] and index.vacuum(abandoned=True) == [dead] and index.storage.staged() == set()
    with pytest.raises(RuntimeError):
        w.commit()
    assert sorted(d for d, _ in index.reader().search("title:a")) == [0, 1]


def test_open_readers_keep_their_segments(spark, index):
    w = index.writer(no_merge)
    for i in range(2):
        w.add(frame(spark, [(i, "a", "b")]))
    w.commit()
    reader = index.reader()
    ids = reader.segment_ids
    w.merge(ids)
    assert set(ids) <= index.data.present() and len(reader.search("title:a")) == 2
    reader.close()
    assert index.vacuum() == sorted(ids) and len(index.reader().search("title:a")) == 2
    with pytest.raises(RuntimeError):
        reader.search("title:a")


def test_failed_merges_are_logged(spark, index, monkeypatch, caplog):
    w = index.writer(SizeTieredPolicy(min_segments=2))
    w.add(frame(spark, [(0, "a", "b")]))
    w.commit()
    w.add(frame(spark, [(1, "a", "b")]))
    monkeypatch.setattr(w, "merge", lambda ids: 1 / 0)
    with caplog.at_level("ERROR", "quarry"):
        w.commit()
    assert "a merge failed" in caplog.text and len(index.reader().search("title:a")) == 2


def test_staged_segments_are_merged(spark, index):
    w = index.writer(SizeTieredPolicy(min_segments=3))
    for i in range(3):
        w.add(frame(spark, [(i, "a", "b")]))
    w.commit()
    assert len(index.meta().segments) == 1 == len(index.data.present()) and index.meta().num_docs == 3
    assert index.meta().version == 1 and index.storage.staged() == set()


def test_single_documents_are_bundled(spark, index, monkeypatch):
    monkeypatch.setattr("quarry.sources.index.BUNDLE_DOCS", 3)
    w = index.writer(no_merge)
    for i in range(7):
        w.add_document(doc_id=i, title=["a", "b"] if i == 5 else "a", description=None)
    assert len(w.staged) == 2
    w.commit()
    assert sorted(s.num_docs for s in index.meta().segments) == [1, 3, 3] and index.reader().doc_freq("title", "a") == 7
    monkeypatch.setattr("quarry.sources.index.BUNDLE_SIZE", 10)
    w.add_document(title="eleven char", description="x")
    assert len(w.staged) == 1
    w.add_document(title="x")
    with pytest.raises(SchemaError):
        w.add_document(doc_id=1, title="y")


def test_nothing_stays_cached(spark):
    count = lambda: spark.sparkContext._jsc.sc().getPersistentRDDs().size()
    before = count()
    index = Index.in_memory(spark, SCHEMA)
    w = index.writer(no_merge)
    w.add(frame(spark, [("a", "b")], "title string, description string"))
    w.commit()
    assert len(index.reader().search("title:a")) == 1 and count() == before + 3
    index.close()
    assert count() == before
    again = Index.in_memory(spark, SCHEMA)
    again.writer(no_merge).add(frame(spark, [(0, "a", "b")]))
    assert count() == before + 3
    del again
    gc.collect()
    assert count() == before


def test_one_publisher_wins(spark, tmp_path):
    files, won = Storage(spark, f"file://{tmp_path}/ix"), []

    def publish(i: int) -> None:
        try:
            files.write_new("v1.json", str(i))
            won.append(i)
        except FileExistsError:
            pass

    threads = [threading.Thread(target=publish, args=(i,)) for i in range(12)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(won) == 1 and files.read("v1.json") == str(won[0]) and files.list() == ["v1.json"]


def test_a_query_is_analyzed_in_one_job(spark, index):
    w = index.writer(no_merge)
    w.add(frame(spark, [(0, "a b c", "d e f")]))
    w.commit()
    reader = index.reader()
    group = f"parse-{index.storage.key}"
    spark.sparkContext.setJobGroup(group, "")
    try:
        reader.parser().parse("title:a OR (title:b AND description:d) title:c description:e unknown:x")
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup(group)) == 1
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


@dataclass(frozen=True)
class Without(Query):
    """A query of the user's own: documents of one term that lack another."""

    has: Term
    lacks: Term

    @property
    def terms(self):
        return [(t.field, t.text) for t in (self.has, self.lacks)]

    def column(self, scores):
        has, lacks = (scores[leaf] for leaf in self.terms)
        return F.when(lacks.isNull(), has)


def test_custom_query(spark, index):
    w = index.writer(no_merge)
    w.add(frame(spark, [(0, "a b", None), (1, "a", None), (2, "b", None)]))
    w.commit()
    query = Without(Term("title", "a"), Term("title", "b"))
    assert [d for d, _ in index.reader().search(query)] == [1]
    assert [d for d, _ in index.reader().search(union(query, Term("title", "b")), TopScore(5))] == [2, 1, 0]


def test_policy_merges_at_eight(spark):
    policy = SizeTieredPolicy()
    seven = [Segment(f"s{i}", 10 + i) for i in range(7)]
    assert policy(seven) == []
    assert [sorted(x) for x in policy([*seven, Segment("s7", 10_000)])] == [[f"s{i}" for i in range(8)]]
    assert policy([Segment(f"x{i}", 20_000 + i) for i in range(9)]) == []
    assert policy([Segment(f"x{i}", 10_000_000) for i in range(9)]) == []
    index = Index.in_memory(spark, SCHEMA)
    w = index.writer(SizeTieredPolicy(min_segments=3))
    for i in range(3):
        w.add(frame(spark, [(i, "a", "b")]))
    w.commit()
    assert len(index.meta().segments) == 1 and index.meta().num_docs == 3


def test_empty_segments_are_dropped(spark, index):
    w = index.writer()
    w.add(frame(spark, []))
    w.commit()
    assert index.meta().segments == () and index.reader().search("", Count()) == 0


def test_documents_without_tokens_count(spark, index):
    w = index.writer()
    w.add(frame(spark, [(0, "a", None), (1, "", ""), (2, None, None)]))
    w.commit()
    r = index.reader()
    assert r.search("", Count()) == 3
    assert r.search("title:a") == [(0, pytest.approx(1 + math.log(3 / 2)))]


def test_ids_are_given(spark, index):
    w = index.writer()
    w.add(frame(spark, [("a", "b"), ("c", "d")], "title string, description string"))
    w.add(frame(spark, [("a", "b")], "title string, description string"))
    w.commit()
    assert index.reader().docs.distinct().count() == 3


def test_collectors(spark):
    scored = spark.createDataFrame([(i, float(s)) for i, s in enumerate([1, 3, 2, 3, 1])], "doc_id long, score double")
    assert TopScore(3).result(scored) == [(3, 3.0), (1, 3.0), (2, 2.0)]
    assert TopScore(2, 1).result(scored) == [(1, 3.0), (2, 2.0)]
    assert TopScore(5, 9).result(scored) == [] and TopScore(0).result(scored) == []
    with pytest.raises(ValueError):
        TopScore(-1)
    assert Both(TopScore(1), Both(Count(), TopScore(1, 1))).result(scored) == ([(3, 3.0)], (5, [(1, 3.0)]))
    assert [r.hits for r in Both(TopScore(2), Count()).plan(scored).collect()] == [5, 5]
    with pytest.raises(TypeError):
        Both(Count(), Count()).plan(scored)
    best = top_per_group(scored.withColumn("g", scored.doc_id % 2), ["g"], [scored.score.desc(), scored.doc_id.desc()], 1)
    assert sorted((r.g, r.doc_id) for r in best.collect()) == [(0, 2), (1, 3)]


def test_open(spark, tmp_path):
    path = f"file://{tmp_path}/ix"
    with pytest.raises(FileNotFoundError):
        Index.open(spark, path)
    Index.open_or_create(spark, path, SCHEMA)
    assert Index.open_or_create(spark, path, IndexSchema.of("other")).schema == SCHEMA
    with pytest.raises(FileExistsError):
        Index.create(spark, path, SCHEMA)


def test_schema():
    with pytest.raises(SchemaError):
        IndexSchema.of("a", "a")
    with pytest.raises(SchemaError):
        IndexSchema.from_json([{"name": "a", "type": "number", "analyzer": "default"}])
    assert IndexSchema.from_json(SCHEMA.to_json()) == SCHEMA
    assert SCHEMA.field("none") is None and SCHEMA.by_id(1).name == "description"
    assert SCHEMA.struct()["title"].metadata == {"analyzer": "default"}


def test_schema_check(spark, index):
    with pytest.raises(SchemaError):
        index.writer().add(frame(spark, [(1, 2)], "doc_id long, title int"))
    with pytest.raises(SchemaError):
        index.writer().add(frame(spark, [("x", "y")], "doc_id string, title string"))


def test_storage(spark, tmp_path):
    for files in (Storage(spark, f"file://{tmp_path}"), MemoryFiles()):
        files.write_new("test", "abc")
        assert files.read("test") == "abc" and files.exists("test")
        with pytest.raises(FileExistsError):
            files.write_new("test", "x")
        files.delete("test")
        files.delete("test")
        assert not files.exists("test") and files.list() == []
        with pytest.raises(FileNotFoundError):
            files.read("test")


def test_pushdown(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)
    w = index.writer()
    w.add(frame(spark, [(0, "a", "b"), (1, "b", "a")]))
    w.commit()
    plan = index.reader().scored("title:a OR description:b")._jdf.queryExecution().executedPlan().toString()
    scans = [line for line in plan.splitlines() if "FileScan" in line and "/postings/" in line and "tf#" in line]
    assert len(scans) == 1
    filters = scans[0].partition("PartitionFilters: [")[2].partition("], PushedFilters: [")
    assert re.search(r"field#\d+ = title", filters[0]) and re.search(r"field#\d+ = description", filters[0])
    pushed = filters[2].partition("], ReadSchema")[0]
    assert "EqualTo(term,a)" in pushed and "EqualTo(term,b)" in pushed


def test_stream(spark, tmp_path):
    source = tmp_path / "in"
    frame(spark, [(0, "a", "b")]).write.parquet(str(source))
    index = Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)
    stream = spark.readStream.schema("doc_id long, title string, description string").parquet(str(source))
    index_stream(stream, index, "feed", str(tmp_path / "cp")).awaitTermination(60)
    frame(spark, [(1, "a", "b")]).write.mode("append").parquet(str(source))
    index_stream(stream, index, "feed", str(tmp_path / "cp")).awaitTermination(60)
    assert index.reader().search("title:a", Count()) == 2
    assert index.meta().streams == {"feed": 1}


def test_cli(spark, tmp_path):
    index = Index.create(spark, f"file://{tmp_path}/ix", SCHEMA)
    w = index.writer()
    w.add(frame(spark, [(7, "a", "b")]))
    w.commit()
    out = io.StringIO()
    assert cli.main(["search", "title:a", "-p", f"file://{tmp_path}/ix", "-l", "3"], spark, out) == 0
    assert out.getvalue().splitlines()[0] == "7\t0.306853"
    with pytest.raises(SystemExit):
        cli.main(["search"])


def test_logs(tmp_path):
    path = tmp_path / "log"
    logs.configure({logs.LEVEL: "info", logs.JSON: "1", logs.FILE: str(path)}).info("hello")
    assert json.loads(path.read_text())["message"] == "hello"
    assert not logs.configure({}).isEnabledFor(50)
