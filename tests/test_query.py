import random

import pytest

from quarry.plans.compile import WIDE, compile_query, leaves, simplify
from quarry.plans.query import (
    All, Boolean, Empty, Occur, Parser, QueryParseError, Term, intersection, must_should, union,
)
from quarry.sources.index import Index
from quarry.sources.merge_policy import no_merge
from quarry.sources.schema import IndexSchema

A, B, C = (Term("f1", x) for x in "abc")


def parser(**options):
    def analyze(field, text):
        return text.lower().replace("-", " ").split() if field in ("f1", "f2") else None

    return Parser(["f1"], analyze, **options)


@pytest.mark.parametrize(("text", "expected"), [
    ("", All()),
    ("   ", All()),
    ("f1:a", A),
    ("f1:a f1:b", union(A, B)),
    ("f1:a OR f1:b AND f1:c", intersection(union(A, B), C)),
    ("f1:a or (f1:b and f1:c)", union(A, intersection(B, C))),
    ("a", A),
    ("AND", Term("f1", "AND")),
    ("f1:A-b", union(A, B)),
    ("f1:x:y", Term("f1", "x:y")),
    ("nofield:x", Empty()),
    ("f1:", Empty()),
    ("(f1:a)", A),
    ("http://x f1:a", union(Empty(), A)),
])
def test_parse(text, expected):
    assert parser().parse(text) == expected


@pytest.mark.parametrize("text", ["(", "(a", "a)", "()", "a ()", "a AND", "a OR", "a AND )", ")", "((a)"])
def test_parse_errors(text):
    with pytest.raises(QueryParseError):
        parser().parse(text)


def test_bare_terms():
    assert parser().parse("Go") == Term("f1", "Go")
    assert parser(analyze_bare=True).parse("Go") == Term("f1", "go")
    assert Parser(["f1", "f2"], lambda f, t: [t]).parse("x") == union(Term("f1", "x"), Term("f2", "x"))


def test_simplify():
    assert simplify(intersection(A, Empty())) == Empty()
    assert simplify(union(A, Empty())) == A
    assert simplify(Boolean(())) == Empty()
    assert leaves(union(A, B, A)) == [("f1", "a"), ("f1", "b")]


# Random trees against a plain evaluator.


def evaluate(query, scores, ids):
    """{doc: score}"""
    if isinstance(query, All):
        return dict.fromkeys(ids, 1.0)
    if isinstance(query, Empty):
        return {}
    if isinstance(query, Term):
        return scores.get((query.field, query.text), {})
    must = [evaluate(q, scores, ids) for o, q in query.clauses if o is Occur.MUST]
    should = [evaluate(q, scores, ids) for o, q in query.clauses if o is Occur.SHOULD]
    found = set.intersection(*map(set, must)) if must else set().union(*should)
    return {d: sum(p.get(d, 0.0) for p in [*must, *should]) for d in found}


def tree(rng, depth=0):
    kind = rng.random()
    if depth > 2 or kind < 0.4:
        return Term(rng.choice(["f1", "f2"]), rng.choice("abcdez"))
    if kind < 0.47:
        return All()
    if kind < 0.52:
        return Empty()
    n = rng.randint(0, 3)
    if kind < 0.7:
        return Boolean(tuple((rng.choice(list(Occur)), tree(rng, depth + 1)) for _ in range(n)))
    return (union if kind < 0.85 else intersection)(*(tree(rng, depth + 1) for _ in range(n)))


@pytest.fixture(scope="module")
def small(spark):
    import math

    rng = random.Random(3)
    rows = [(i, " ".join(rng.choices("abcde", k=rng.randint(0, 6))), " ".join(rng.choices("abc", k=rng.randint(0, 3)))) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, f1 string, f2 string")
    index = Index.in_memory(spark, IndexSchema.of("f1", "f2"))
    writer = index.writer(no_merge)
    for part in (0, 1):
        writer.add(docs.where(docs.doc_id % 2 == part))
    writer.commit()
    reader = index.reader()
    scores = {}
    for place, field in ((1, "f1"), (2, "f2")):
        for term in "abcde":
            tfs = {r[0]: r[place].split().count(term) for r in rows if term in r[place].split()}
            scores[field, term] = {d: tf * (1 + math.log(len(rows) / (1 + len(tfs)))) for d, tf in tfs.items()}
    yield [reader.postings, reader.term_stats, reader.n_docs, reader.docs], scores, [r[0] for r in rows]
    index.close()


@pytest.mark.parametrize("seed", range(25))
def test_random_trees(small, seed):
    held, scores, ids = small
    query = tree(random.Random(seed))
    got = {r.doc_id: r.score for r in compile_query(query, *held).collect()}
    expected = evaluate(query, scores, ids)
    assert got.keys() == expected.keys()
    assert all(abs(got[d] - expected[d]) < 1e-9 for d in got)


def test_wide_disjunction(small):
    held, scores, ids = small
    query = union(*(Term("f1", x) for x in "abcde"), A, *(Term("f1", f"no{i}") for i in range(WIDE)))
    got = {r.doc_id: r.score for r in compile_query(query, *held).collect()}
    expected = evaluate(query, scores, ids)
    assert got.keys() == expected.keys() and all(abs(got[d] - expected[d]) < 1e-9 for d in got)


def test_child_that_does_not_match_adds_nothing(small):
    held, scores, ids = small
    query = must_should([A], [intersection(B, C)])
    got = {r.doc_id for r in compile_query(query, *held).collect()}
    assert got == set(scores["f1", "a"])
