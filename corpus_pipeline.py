"""A training corpus from the documents, in five stages that each call one operator of ``quarry.llm``.

Each function takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next one's docs. All
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quarry.llm import _runtime as rt
from quarry.llm import cotraining, decontaminate, mixing, rans, simhash

STAGES = [
    ("quality", cotraining.stage),
    ("near_duplicates", simhash.stage),
    ("decontamination", decontaminate.stage),
    ("mixing", mixing.stage),
    ("token_ids", rans.stage),
]

#: Co-training can't be written in SQL; the tests hold the stages against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The token blocks of the corpus: each stage works on the table that the one before wrote.

    Defined cases are those of the stages: rows with a null id pass quality, near duplicates and decontamination and go in
    mixing; null and empty texts are judged by their metadata and become documents of no tokens; very long texts are read
    whole; of rows that repeat an id one is left after near duplicates; of ties the least id stays; an empty table gives
    the frequency table's row alone; further columns, whatever their names, are passed on up to the last stage.
    """
    docs = rt.documents(spark, sf_dir)
    for name, stage in STAGES[:-1]:
        before, docs = docs, rt.written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        rt.discard(before)
    blocks = STAGES[-1][1](spark, docs, sf_dir)
    rt.discard(docs)  # the blocks come from a table of their own
    return blocks
