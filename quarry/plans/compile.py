"""Queries to one DataFrame plan that scores documents.

One scan of the postings, filtered to the query's terms by literals (which reach the Parquet scan as partition and data
filters), then one aggregation by document with a conditional maximum per term. The tree becomes one column in which
null means that a document doesn't match:

    term            the term's score
    all MUST        l + r, null if any is
    all SHOULD      null if all are, else the sum of those that aren't
    MUST + SHOULD   must + coalesce(should, 0)
    All             1.0; then every document is joined, as those without any term must appear
    Empty           null
"""

from __future__ import annotations

from collections import Counter
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.scoring import tf_idf
from quarry.plans.query import All, Boolean, Empty, Occur, Query, Term

#: A disjunction of more terms is summed by document instead of getting a column for each term.
WIDE = 64
Leaf = tuple[str, str]


def leaves(query: Query) -> list[Leaf]:
    """The terms of the tree, without repeats, in order."""
    found: dict[Leaf, None] = {}

    def visit(node: Query) -> None:
        if isinstance(node, Term):
            found[(node.field, node.text)] = None
        elif isinstance(node, Boolean):
            for _, child in node.clauses:
                visit(child)
        else:
            found.update(dict.fromkeys(getattr(node, "terms", ())))

    visit(query)
    return list(found)


def simplify(query: Query) -> Query:
    """Booleans of one clause give way to it; what can't match becomes Empty."""
    if not isinstance(query, Boolean):
        return query
    clauses = [(occur, simplify(q)) for occur, q in query.clauses]
    if any(occur is Occur.MUST and isinstance(q, Empty) for occur, q in clauses):
        return Empty()
    clauses = [(occur, q) for occur, q in clauses if not isinstance(q, Empty)]
    if not clauses:
        return Empty()
    return clauses[0][1] if len(clauses) == 1 else Boolean(tuple(clauses))


def has_all(query: Query) -> bool:
    return isinstance(query, All) or isinstance(query, Boolean) and any(has_all(q) for _, q in query.clauses)


def _sum_must(parts: list[Column]) -> Column:
    return reduce(lambda l, r: l + r, parts)


def _sum_should(parts: list[Column]) -> Column:
    if len(parts) == 1:
        return parts[0]
    total = reduce(lambda l, r: l + r, [F.coalesce(p, F.lit(0.0)) for p in parts])
    return F.when(~reduce(and_, [p.isNull() for p in parts]), total)


def score_column(query: Query, scores: dict[Leaf, Column]) -> Column:
    if isinstance(query, Term):
        return scores[(query.field, query.text)]
    if isinstance(query, All):
        return F.lit(1.0)
    if isinstance(query, Empty):
        return F.lit(None).cast("double")
    if isinstance(query, Boolean):
        must = [score_column(q, scores) for occur, q in query.clauses if occur is Occur.MUST]
        should = [score_column(q, scores) for occur, q in query.clauses if occur is Occur.SHOULD]
        if not must:
            return _sum_should(should) if should else F.lit(None).cast("double")
        return _sum_must(must) + F.coalesce(_sum_should(should), F.lit(0.0)) if should else _sum_must(must)
    return query.column(scores)  # a query of the user's own


def leaf_filter(wanted: list[Leaf]) -> Column:
    """field = f AND term IN (...), for each field, with literals."""
    by_field: dict[str, list[str]] = {}
    for field, text in wanted:
        by_field.setdefault(field, []).append(text)
    return reduce(or_, [(F.col("field") == f) & F.col("term").isin(ts) for f, ts in by_field.items()])


def _only_terms(query: Query) -> Counter[Leaf] | None:
    """How often each term occurs, in a tree of nothing but SHOULD clauses and terms."""
    if isinstance(query, Term):
        return Counter([(query.field, query.text)])
    if not isinstance(query, Boolean) or any(occur is Occur.MUST for occur, _ in query.clauses):
        return None
    parts = [_only_terms(q) for _, q in query.clauses]
    return None if any(p is None for p in parts) else sum(parts, Counter())


def compile_query(query: Query, postings: DataFrame, stats: DataFrame, n_docs: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, score) of the documents that match.

    ``stats`` is (field, term, df), ``n_docs`` one row with ``n``, ``docs`` all doc_ids, those without terms included.
    """
    query = simplify(query)
    wanted = leaves(query)
    if not wanted:
        rows = docs if has_all(query) else docs.where(F.lit(False))
        return rows.select("doc_id", score_column(query, {}).alias("score")).where("score IS NOT NULL")
    # As many rows as the query has terms.
    weights = F.broadcast(stats.where(leaf_filter(wanted)).crossJoin(F.broadcast(n_docs)))
    hits = (
        postings.where(leaf_filter(wanted))
        .select("field", "term", "doc_id", "tf")
        .join(weights, ["field", "term"])
        .withColumn("score", tf_idf(F.col("tf"), F.col("n"), F.col("df")))
    )
    times = _only_terms(query)
    if times is not None and len(wanted) > WIDE:
        often = F.lit(1)
        for (field, text), n in times.items():
            if n > 1:
                often = F.when((F.col("field") == field) & (F.col("term") == text), n).otherwise(often)
        return hits.groupBy("doc_id").agg(F.sum(often * F.col("score")).alias("score"))
    parts = [
        F.max(F.when((F.col("field") == field) & (F.col("term") == text), F.col("score"))).alias(f"s{i}")
        for i, (field, text) in enumerate(wanted)
    ]
    by_doc = hits.groupBy("doc_id").agg(*parts)
    if has_all(query):
        by_doc = docs.select("doc_id").join(by_doc, "doc_id", "left")
    scores = {leaf: F.col(f"s{i}") for i, leaf in enumerate(wanted)}
    return by_doc.select("doc_id", score_column(query, scores).alias("score")).where("score IS NOT NULL")
