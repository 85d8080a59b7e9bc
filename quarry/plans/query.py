"""Queries: a tree of terms and boolean clauses, built by calls or parsed from the query language."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from enum import Enum


class Occur(Enum):
    SHOULD = "should"
    MUST = "must"


class Query:
    """Any node. ``plans.compile`` has a rule for each kind; other kinds may define ``column(leaves)``."""

    def __and__(self, other: Query) -> Query:
        return intersection(self, other)

    def __or__(self, other: Query) -> Query:
        return union(self, other)


@dataclass(frozen=True)
class All(Query):
    """Every document, with score 1."""


@dataclass(frozen=True)
class Empty(Query):
    """No document."""


@dataclass(frozen=True)
class Term(Query):
    """Documents that have the term in the field, by TF-IDF."""

    field: str
    text: str


@dataclass(frozen=True)
class Boolean(Query):
    """All MUST clauses have to match; SHOULD clauses add to the score, and one has to match where none is MUST."""

    clauses: tuple[tuple[Occur, Query], ...]


def union(*queries: Query) -> Query:
    return queries[0] if len(queries) == 1 else Boolean(tuple((Occur.SHOULD, q) for q in queries)) if queries else Empty()


def intersection(*queries: Query) -> Query:
    return queries[0] if len(queries) == 1 else Boolean(tuple((Occur.MUST, q) for q in queries)) if queries else Empty()


def multi_terms(*terms: Term) -> Query:
    return union(*terms)


def must_should(must: list[Query], should: list[Query]) -> Query:
    return Boolean((*((Occur.MUST, q) for q in must), *((Occur.SHOULD, q) for q in should)))


class QueryParseError(ValueError):
    """A query that the language doesn't allow."""


Analyze = Callable[[str, str], list[str] | None]


class Parser:
    """``field:text``, bare terms, AND, OR and parentheses. Neighbours without an operator are joined by OR.

    Operators have no precedence and apply from left to right. The text after the first colon goes through the field's
    analyzer; a bare term is looked up as it is in each default field, or analyzed where ``analyze_bare`` is set. A
    field that the schema lacks matches nothing. An empty query matches everything.
    """

    def __init__(
        self,
        default_fields: list[str],
        analyze: Analyze,
        analyze_bare: bool = False,
        prepare: Callable[[list[tuple[str, str]]], None] | None = None,
    ):
        """``prepare`` gets all fields and texts that a query will have analyzed, before the first of them is."""
        self.default_fields, self.analyze, self.analyze_bare, self.prepare = default_fields, analyze, analyze_bare, prepare

    def parse(self, text: str) -> Query:
        self._tokens = self.split(text)
        self._at = 0
        if not self._tokens:
            return All()
        if self.prepare and (pairs := [pair for token in self._tokens for pair in self._analyzed(token)]):
            self.prepare(pairs)
        query = self._expression()
        if self._at < len(self._tokens):
            raise QueryParseError(f"unparsed tokens: {' '.join(self._tokens[self._at:])}")
        return query

    @staticmethod
    def split(text: str) -> list[str]:
        """Only the space separates; parentheses are tokens of their own."""
        return [t for t in text.replace("(", " ( ").replace(")", " ) ").split(" ") if t]

    def _peek(self) -> str | None:
        return self._tokens[self._at] if self._at < len(self._tokens) else None

    def _expression(self) -> Query:
        left = self._primary()
        while (token := self._peek()) is not None and token != ")":
            word = token.lower()
            if word in ("and", "or"):
                self._at += 1
            right = self._primary()
            left = intersection(left, right) if word == "and" else union(left, right)
        return left

    def _primary(self) -> Query:
        token = self._peek()
        if token is None:
            raise QueryParseError("a term is missing at the end")
        if token == ")":
            raise QueryParseError("a term is missing before a closing parenthesis")
        self._at += 1
        if token == "(":
            inner = self._expression()
            if self._peek() != ")":
                raise QueryParseError("no closing parenthesis")
            self._at += 1
            return inner
        return self._leaf(token)

    def _analyzed(self, token: str) -> list[tuple[str, str]]:
        field, colon, text = token.partition(":")
        if colon:
            return [(field, text)]
        bare = self.analyze_bare and token not in ("(", ")") and token.lower() not in ("and", "or")
        return [(f, token) for f in self.default_fields] if bare else []

    def _leaf(self, token: str) -> Query:
        field, colon, text = token.partition(":")
        if colon:
            terms = self.analyze(field, text)
            return union(*(Term(field, t) for t in terms or []))
        if not self.analyze_bare:
            return union(*(Term(f, token) for f in self.default_fields))
        return union(*(Term(f, t) for f in self.default_fields for t in self.analyze(f, token) or []))
