"""Nulls, empty and very long texts, ties and repeated rows, empty tables, and columns with clashing names."""

import pytest
from pyspark.sql import functions as F

from quarry.llm import bloomlm, chains, cotraining, decontaminate, maxscore, mixing, pii, rans, simhash, suffix

BENCHMARK = "item_id long, text string"
LABELS = "doc_id long, quality int, toxic int"
PASSAGE = " ".join(f"w{i}x{i * 7 % 31}" for i in range(70))
#: A name of every column that an operator makes for itself.
CLASHING = (
    "shingle pos item_id rank df b variant bucket rep root node s0 rid anchor seed start stretch first last need key "
    "slice weight finish total place part tokens leaks copy rejected mixed nth _nth count item_words doc_words rid words n"
).split()


def _benchmark(spark, rows=((1, PASSAGE), (2, None), (None, PASSAGE), (3, ""), (4, "too short"))):
    return spark.createDataFrame(list(rows), BENCHMARK)


def _labels(spark, rows=((1, 1, 0), (2, 0, 1), (3, None, None), (None, 1, 1), (99, 0, 0), (1, 1, 0))):
    return spark.createDataFrame(list(rows), LABELS)


OPERATORS = {
    "decontaminate": lambda s, d: decontaminate.contaminated(d, _benchmark(s)),
    "suffix": lambda s, d: suffix.repeated_passages(d),
    "chains": lambda s, d: chains.fuzzy_passages(d),
    "cotraining": lambda s, d: cotraining.scored(d, _labels(s)),
    "bloomlm": lambda s, d: bloomlm.scored(d),
    "simhash": lambda s, d: simhash.near_duplicates(d),
    "pii": lambda s, d: pii.personal_data(d),
    "rans": lambda s, d: rans.encoded(d),
    "maxscore": lambda s, d: maxscore.search(d, _benchmark(s)),
    "mixing": lambda s, d: mixing.mixture(d),
}
LONG = " ".join(f"long{i % 977}a{i % 1009}" for i in range(120_000))
ROWS = [
    (1, PASSAGE),
    (1, PASSAGE),  # a repeated row
    (2, PASSAGE.upper()),
    (3, None),
    (4, ""),
    (5, " \n\t "),
    (6, LONG),
    (None, PASSAGE),
    (None, None),
    (7, "mail ana@example.com now", None, None),
    (8, "!!! ??? ..."),
    (9, "e" * 300_000),
]


@pytest.fixture(scope="module")
def odd(documents):
    df = documents(ROWS)
    for name in CLASHING:
        df = df.withColumn(name, F.lit("other"))
    return df


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(spark, documents, name):
    got = OPERATORS[name](spark, documents([])).collect()
    if name == "rans":  # the frequency table alone
        assert [(r.block_id, r.n_tokens, bytes(r.states)) for r in got] == [(-1, 0, b"")]
    else:
        assert got == []


@pytest.mark.parametrize("name", ["decontaminate", "maxscore"])
def test_empty_benchmark(spark, documents, name):
    run = {"decontaminate": decontaminate.contaminated, "maxscore": maxscore.search}[name]
    assert run(documents([(1, PASSAGE)]), _benchmark(spark, ())).collect() == []


def test_no_labels(spark, documents):
    got = cotraining.scored(documents([(1, PASSAGE), (2, "")]), _labels(spark, ())).collect()
    assert {(r.doc_id, round(r.quality, 3), round(r.toxic, 3)) for r in got} == {(1, 0.5, 0.5), (2, 0.5, 0.5)}


def test_decontaminate(spark, odd):
    got = OPERATORS["decontaminate"](spark, odd).collect()
    assert sorted((r.item_id, r.doc_id, r.matched, r.containment, r.start_word) for r in got) == [(1, 1, 66, 1.0, 0), (1, 2, 66, 1.0, 0)]


def test_suffix(spark, odd):
    got = OPERATORS["suffix"](spark, odd).collect()
    assert sorted(map(tuple, got)) == [(1, 0, 70, 70, 1), (2, 0, 70, 70, 1)]


def test_chains(spark, odd):
    got = OPERATORS["chains"](spark, odd).collect()
    ((a, b),) = {tuple(sorted((r.doc_id, r.partner_doc_id))) for r in got}
    assert (a, b) == (1, 2) and all((r.start_word, r.end_word, r.identity) == (0, 70, 1.0) for r in got)


def test_cotraining(spark, odd):
    got = OPERATORS["cotraining"](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    assert all(0 <= r.quality <= 1 and 0 <= r.toxic <= 1 and r.kept is not None for r in got)


def test_bloomlm(spark, odd):
    got = OPERATORS["bloomlm"](spark, odd).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(str(r[0]) for r in ROWS)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    for k in (3, 4, 5, 8):
        assert (by_id[k].words, by_id[k].log_probability, by_id[k].perplexity) == (0, None, None)
    assert by_id[6].words == 120_000 and by_id[9].words == 1


def test_simhash(spark, odd):
    got = OPERATORS["simhash"](spark, odd).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 2, True), (2, 1, 2, False)]


def test_pii(spark, odd):
    got = OPERATORS["pii"](spark, odd).collect()
    assert {(r.doc_id, r.start, r.end, r.kind) for r in got} == {(7, 5, 20, "email")}


def test_rans(spark, odd):
    texts = {}
    for r in rans.decoded(OPERATORS["rans"](spark, odd)).collect():
        texts.setdefault(r.doc_id, []).append((r.doc_offset, r.ids))
    encoder = rans.encoder(rans.TOKENIZER)
    for doc_id in (3, 4, 6, 7, 8, 9):
        ids = [i for _, part in sorted(texts[doc_id]) for i in part]
        assert encoder.decode(ids) == (next(r[1] for r in ROWS if r[0] == doc_id) or "")
    assert len(texts[1]) == 2 and len(texts[None]) == 2


def test_maxscore(spark, odd):
    got = OPERATORS["maxscore"](spark, odd).collect()
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [(1, 1, 1), (1, 2, 2)]
    assert got[0].score == got[1].score > 0


def test_mixing(spark, odd):
    got = OPERATORS["mixing"](spark, odd).collect()
    ids = [r.doc_id for r in got]
    assert None not in ids and len(ids) == len(set(ids))
    whole = sorted(mixing.mixture(odd, budget_share=1.0).collect(), key=lambda r: r.place)
    assert sorted(r.doc_id for r in whole) == list(range(1, 10))
    assert {r.doc_id: r.source for r in whole}[7] == ""
    assert [r.place for r in whole] == list(range(1, 10)) and {r.doc_id: r.tokens for r in whole}[3] == 0


@pytest.mark.parametrize("table", ["benchmark", "labels"])
def test_extra_columns_beside(spark, documents, table):
    """Columns of the second table with the names that an operator makes for itself."""
    docs = documents([(1, PASSAGE), (2, "other text here")])
    other = _benchmark(spark) if table == "benchmark" else _labels(spark)
    wide = other
    for name in [c for c in CLASHING if c not in other.columns]:
        wide = wide.withColumn(name, F.lit("other"))
    runs = [decontaminate.contaminated, maxscore.search] if table == "benchmark" else [cotraining.scored]
    for run in runs:
        assert sorted(map(tuple, run(docs, wide).collect())) == sorted(map(tuple, run(docs, other).collect()))


STAGES = {"quality": cotraining, "near_duplicates": simhash, "decontamination": decontaminate, "mixing": mixing, "token_ids": rans}
#: Which ids each stage keeps of ROWS by itself; None where its decision depends on a fit.
KEPT = {
    "quality": None,
    "near_duplicates": ["1", "3", "4", "5", "6", "7", "8", "9", "None", "None"],
    "decontamination": ["3", "4", "5", "6", "7", "8", "9", "None", "None"],
    "mixing": None,
}


@pytest.fixture(scope="module")
def beside(spark, tmp_path_factory):
    """A folder with the tables that stages read."""
    at = tmp_path_factory.mktemp("beside")
    _benchmark(spark).write.parquet(f"{at}/benchmark.parquet")
    _labels(spark).write.parquet(f"{at}/labels.parquet")
    return str(at)


@pytest.mark.parametrize("name", list(STAGES)[:-1])
def test_stages(spark, beside, odd, name):
    """Columns are passed on as they are, rows are whole, and those that go are the operator's."""
    kept = STAGES[name].stage(spark, odd, beside)
    assert kept.columns == odd.columns
    rows, whole = kept.collect(), set(map(tuple, odd.collect()))
    assert all(tuple(r) in whole for r in rows)
    ids = sorted(str(r.doc_id) for r in rows)
    if KEPT[name] is not None:
        assert ids == KEPT[name]
    if name == "quality":
        rejected = {r.doc_id for r in cotraining.scored(odd, _labels(spark)).collect() if not r.kept and r.doc_id is not None}
        assert ids == sorted(str(r[0]) for r in ROWS if r[0] not in rejected)
    if name == "mixing":
        assert ids == sorted(str(r.doc_id) for r in mixing.mixture(odd).collect())


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_an_empty_table(spark, beside, odd, name):
    got = STAGES[name].stage(spark, odd.limit(0), beside)
    assert [r.block_id for r in got.collect()] == [-1] if name == "token_ids" else got.isEmpty() and got.columns == odd.columns


def test_the_chain_on_odd_rows(spark, beside, odd, tmp_path):
    """Each stage on what the one before kept; at the end the texts come back from the blocks."""
    docs = odd
    for name, operator in list(STAGES.items())[:-1]:
        before = {(r.doc_id, r.text) for r in docs.collect()}
        operator.stage(spark, docs, beside).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        assert docs.columns == odd.columns and {(r.doc_id, r.text) for r in docs.collect()} <= before
    encoder, parts = rans.encoder(rans.TOKENIZER), {}
    for r in rans.decoded(rans.stage(spark, docs, beside)).collect():
        parts.setdefault(r.doc_id, []).append((r.doc_offset, r.ids))
    texts = {k: encoder.decode([i for _, p in sorted(v) for i in p]) for k, v in parts.items()}
    assert texts == {r.doc_id: r.text or "" for r in docs.collect()}


def test_without(spark, documents):
    """Ids that a bitmap can't tell apart are, by the join."""
    from quarry.llm import _runtime as rt

    docs = documents([(i, "t") for i in range(500)] + [(None, "t")])
    drop = spark.range(0, 500, 3).toDF("x")
    assert sorted(str(r.doc_id) for r in rt.without(docs, drop).collect()) == sorted([*(str(i) for i in range(500) if i % 3), "None"])
    assert rt.without(docs, drop.limit(0)).count() == 501
