"""Set operations on scored documents (doc_id, score), for results that don't come from one query."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def union(*parts: DataFrame) -> DataFrame:
    """Documents of any part, scores added."""
    return reduce(DataFrame.unionByName, parts).groupBy("doc_id").agg(F.sum("score").alias("score"))


def intersection(*parts: DataFrame) -> DataFrame:
    """Documents of all parts, scores added."""
    named = [p.select("doc_id", F.col("score").alias(f"s{i}")) for i, p in enumerate(parts)]
    both = reduce(lambda l, r: l.join(r, "doc_id"), named)
    return both.select("doc_id", reduce(lambda l, r: l + r, [F.col(f"s{i}") for i in range(len(parts))]).alias("score"))


def must_should(must: DataFrame, should: DataFrame) -> DataFrame:
    """Documents of ``must``, with what ``should`` adds to their scores."""
    extra = should.select("doc_id", F.col("score").alias("extra"))
    return must.join(extra, "doc_id", "left").select(
        "doc_id", (F.col("score") + F.coalesce("extra", F.lit(0.0))).alias("score")
    )
