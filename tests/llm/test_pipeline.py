"""The pipeline's stages: each decision is the operator's, over all that the stage before kept."""

import duckdb
import pytest

import __spark_entry__ as entry
import corpus_pipeline
from quarry.llm import catalog, cotraining, decontaminate, mixing, rans, simhash

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """What goes into each stage and what comes out of the last, in turn."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    out, at = [docs], tmp_path_factory.mktemp("stages")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, out[-1], DATA).write.parquet(f"{at}/{name}")
        out.append(spark.read.parquet(f"{at}/{name}"))
    return out


def _ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_columns(kept):
    for df in kept[:-1]:
        assert df.columns == kept[0].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "token_ids"]


def test_rows_are_unchanged(kept):
    whole = {r.doc_id: r for r in kept[0].collect()}
    for df in kept[1:-1]:
        assert all(whole[r.doc_id] == r for r in df.collect())


def test_quality(spark, kept):
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    scored = cotraining.scored(kept[0], labels).where("kept")
    assert _ids(kept[1]) == _ids(scored) and len(_ids(kept[1])) > 150


def test_near_duplicates(kept):
    group = {r.doc_id: r.group_id for r in simhash.near_duplicates(kept[1]).collect()}
    assert _ids(kept[2]) == sorted(i for i in _ids(kept[1]) if group.get(i, i) == i)


def test_decontamination(spark, kept):
    con = duckdb.connect()
    con.register("documents", kept[2].toArrow())
    con.register("benchmark", spark.read.parquet(f"{DATA}/benchmark.parquet").toArrow())
    leaks = {r[0] for r in con.sql(f"SELECT DISTINCT doc_id FROM ({decontaminate.sql()})").fetchall()}
    assert _ids(kept[3]) == sorted(set(_ids(kept[2])) - leaks)


def test_mixing(kept):
    con = duckdb.connect()
    con.register("documents", kept[3].toArrow())
    order = [r[0] for r in con.sql(f"SELECT doc_id FROM ({mixing.sql()}) ORDER BY place").fetchall()]
    assert _ids(kept[4]) == sorted(order)


def test_token_ids(spark, kept):
    encoder = rans.encoder(rans.TOKENIZER)
    texts = {r.doc_id: r.text for r in kept[4].collect()}
    parts = {}
    for r in rans.decoded(kept[5]).collect():
        parts.setdefault(r.doc_id, []).append((r.doc_offset, r.ids))
    assert {k: encoder.decode([i for _, p in sorted(v) for i in p]) for k, v in parts.items()} == texts


def test_run(spark, kept):
    """run() gives the same corpus as the stages one by one."""
    ids = lambda blocks: sorted(r.doc_id for r in rans.decoded(blocks).select("doc_id").collect())
    assert ids(corpus_pipeline.run(spark, DATA)) == ids(kept[5])


def test_empty_table(spark, tmp_path):
    for table in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{table}.parquet").limit(0).write.parquet(f"{tmp_path}/{table}.parquet")
    assert [r.block_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()] == [-1]


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names and set(catalog.queries()) < names
    assert {n.split("_")[0] for n in catalog.queries()} == {f"op{k}" for k in range(1, 11)}
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
