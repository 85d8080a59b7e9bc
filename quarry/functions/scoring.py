"""TF-IDF as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def idf(n_docs: Column, doc_freq: Column) -> Column:
    """1 + ln(N / (1 + df)); above 0 for every term that occurs."""
    return F.lit(1.0) + F.log(n_docs.cast("double") / (F.lit(1) + doc_freq))


def tf_idf(tf: Column, n_docs: Column, doc_freq: Column) -> Column:
    return tf * idf(n_docs, doc_freq)
