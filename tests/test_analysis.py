import random

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.functions import analysis as A
from quarry.functions import stemmer as S
from quarry.functions.stem_sql import stems
from quarry.functions.stemmer import stem

STEM_SAMPLE = {
    "consign": "consign", "consigned": "consign", "consisting": "consist", "consistency": "consist", "knightly": "knight",
    "knocked": "knock", "happy": "happi", "relational": "relat", "hopping": "hop", "hoping": "hope", "skies": "sky",
    "generously": "generous", "sensational": "sensat", "kings": "king",
}


def test_simple_tokenizer(spark):
    cases = {
        "Don't a_b": ["don", "t", "a", "b"],
        "É①Ⅷ½": ["é①ⅷ½"],
        "éx": ["e", "x"],
        "": [],
        "... !": [],
        None: None,
    }
    df = spark.createDataFrame([(i, t) for i, t in enumerate(cases)], "id int, text string")
    got = {r.id: r.tokens for r in df.select("id", A.DEFAULT.tokens(F.col("text")).alias("tokens")).collect()}
    assert [got[i] for i in range(len(cases))] == list(cases.values())


def test_stop_words_keep_repetitions(spark):
    analyzer = A.DEFAULT.with_token_filter(A.stop_word_filter)
    assert analyzer.terms(spark, "a x and x be have i in of that the to y") == ["x", "x", "y"]


def test_english_stems_before_stop_words(spark):
    assert A.ENGLISH.terms(spark, "Having hopes, the king's beings") == ["having", "hope", "king", "s"]
    # "toes" is no stop word, but a stem that is one goes.
    assert A.ENGLISH.terms(spark, "Eat My Hat") == ["eat", "my", "hat"]
    assert A.ENGLISH.terms(spark, "the hats running") == ["hat", "run"]


def test_multi_values_are_appended(spark):
    df = spark.createDataFrame([(["One two", "two"],)], "v array<string>")
    assert df.select(A.DEFAULT.tokens_of_values(F.col("v")).alias("t")).first().t == ["one", "two", "two"]


def test_registry():
    r = A.Registry()
    assert r.get("default") is A.DEFAULT
    with pytest.raises(KeyError):
        r.get("en_stem")
    r.register("x", A.ENGLISH)
    for name, analyzer in (("x", A.ENGLISH), ("y", None)):
        with pytest.raises(ValueError):
            r.register(name, analyzer)


@pytest.mark.parametrize(("word", "expected"), [
    *STEM_SAMPLE.items(), ("caresses", "caress"), ("ties", "tie"), ("cries", "cri"), ("gas", "gas"), ("gaps", "gap"),
    ("kiwis", "kiwi"), ("agreed", "agre"), ("luxuriated", "luxuri"), ("fly", "fli"), ("say", "say"), ("by", "by"),
    ("triplicate", "triplic"), ("adjustment", "adjust"), ("decision", "decis"), ("probate", "probat"), ("rate", "rate"),
    ("controll", "control"), ("roll", "roll"), ("communism", "communism"), ("inning", "inning"), ("knives", "knive"),
    ("kneeling", "kneel"), ("consolatory", "consolatori"), ("conspiracies", "conspiraci"), ("under", "under"),
])
def test_stem(word, expected):
    assert stem(word) == expected


def test_stem_as_sql():
    """The SQL that registered queries are held against, on words with every ending, and with y, accents and doubles."""
    rng = random.Random(0)
    endings = [x for x, _ in (*S._STEP2, *S._STEP3)] + list(S._STEP4) + "s es ies ied sses us ss ed edly eed eedly ing ingly y ly e l ll".split()
    roots = ["".join(rng.choices("abdegilnorstuyyéñ5", k=rng.randint(0, 6))) for _ in range(4000)]
    known = [*S._SPECIAL, *S._KEPT_AFTER_1A, *S.STOP_WORDS, "general", "communal", "arsenal", "yyy", "ayyb", "by", "say", *STEM_SAMPLE]
    words = sorted({r + rng.choice(endings) + rng.choice(["", "", rng.choice(endings)]) for r in roots} | set(known))
    con = duckdb.connect()
    con.register("words", pa.table({"term": words}))
    got = dict(con.sql(f"WITH {stems('words')} SELECT term, stem FROM stemmed").fetchall())
    assert got == {w: stem(w) for w in words}


def test_stems_of_arrays(spark):
    df = spark.createDataFrame([(0, ["kings", "kings", "hoping"]), (1, None), (2, []), (3, ["skies"])], "i int, w array<string>")
    got = {r.i: r.s for r in df.coalesce(1).select("i", A.stemming_filter(F.col("w")).alias("s")).collect()}
    assert got == {0: ["king", "king", "hope"], 1: None, 2: [], 3: ["sky"]}


def test_stop_words_are_stemmed_on_request():
    assert (stem("having"), stem("having", True)) == ("having", "have")
