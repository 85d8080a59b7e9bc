"""Collectors: what becomes of a query's scored documents."""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


class Collector(Protocol):
    """Aggregates (doc_id, score); ``plan`` is lazy, ``result`` runs it. Spark merges the partitions' parts."""

    def plan(self, scored: DataFrame) -> DataFrame: ...

    def result(self, scored: DataFrame) -> Any: ...


def _checked(limit: int, offset: int) -> None:
    if limit < 0 or offset < 0:
        raise ValueError("limit and offset can't be negative")


@dataclass(frozen=True)
class TopScore:
    """The best documents by score, then by the higher doc_id, after ``offset`` of them."""

    limit: int = 10
    offset: int = 0

    def __post_init__(self) -> None:
        _checked(self.limit, self.offset)

    def plan(self, scored: DataFrame) -> DataFrame:
        hits = scored.orderBy(F.desc("score"), F.desc("doc_id"))
        return (hits.offset(self.offset) if self.offset else hits).limit(self.limit)

    def result(self, scored: DataFrame) -> list[tuple[int, float]]:
        return [(row["doc_id"], row["score"]) for row in self.plan(scored).collect()]


@dataclass(frozen=True)
class Count:
    """How many documents match."""

    def plan(self, scored: DataFrame) -> DataFrame:
        return scored.agg(F.count("*").alias("hits"))

    def result(self, scored: DataFrame) -> int:
        return self.plan(scored).first()["hits"]


@dataclass(frozen=True)
class Both:
    """Two collectors over one evaluation of the query; they may be pairs themselves."""

    left: Collector
    right: Collector

    def plan(self, scored: DataFrame) -> DataFrame:
        """Of a top-score and a count, the hits with the count beside each."""
        tops = [c for c in (self.left, self.right) if isinstance(c, TopScore)]
        if len(tops) != 1 or not any(isinstance(c, Count) for c in (self.left, self.right)):
            raise TypeError("only a top-score and a count make one table; use result() for other pairs")
        # A count by broadcast rather than a window over all hits, which would bring them into one task.
        return tops[0].plan(scored).crossJoin(F.broadcast(Count().plan(scored)))

    def result(self, scored: DataFrame) -> tuple[Any, Any]:
        kept = scored.persist()
        try:
            return self.left.result(kept), self.right.result(kept)
        finally:
            kept.unpersist()


def top_per_group(rows: DataFrame, groups: list[str], order: list, k: int) -> DataFrame:
    """The k best rows of each group; Spark's window group limit prunes within partitions first."""
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*groups).orderBy(*order)))
    return ranked.where(F.col("rank") <= k)
