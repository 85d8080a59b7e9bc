"""Which segments to merge after a commit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Segment:
    """A committed or staged part of an index; immutable."""

    id: str
    num_docs: int
    opstamp: int = 0


MergePolicy = Callable[[list[Segment]], list[list[str]]]


def no_merge(segments: list[Segment]) -> list[list[str]]:
    return []


@dataclass(frozen=True)
class SizeTieredPolicy:
    """Merges segments on a level once there are ``min_segments`` of them.

    Segments of ``max_docs`` or more stay as they are. Segments of up to ``min_docs`` documents are on one level; above
    it a level is one exact size.
    """

    min_segments: int = 8
    min_docs: int = 10_000
    max_docs: int = 10_000_000

    def __call__(self, segments: list[Segment]) -> list[list[str]]:
        levels: dict[int, list[str]] = {}
        for s in sorted(segments, key=lambda s: -s.num_docs):
            if s.num_docs < self.max_docs:
                levels.setdefault(max(s.num_docs, self.min_docs), []).append(s.id)
        return [ids for ids in levels.values() if len(ids) >= self.min_segments]

    def plan(self, segments: DataFrame) -> DataFrame:
        """The same over a table (segment, num_docs): a row (level, segments) for each merge."""
        return (
            segments.where(F.col("num_docs") < self.max_docs)
            .groupBy(F.greatest("num_docs", F.lit(self.min_docs)).alias("level"))
            .agg(F.count("*").alias("segments"))
            .where(F.col("segments") >= self.min_segments)
        )
