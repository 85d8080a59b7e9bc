"""Session helpers of the training-data operators: shared folder, written tables, Arrow batches."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.shared import shared_dir


SMALL = 256 << 20


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents. A small one in fewer files than there are cores, which as few tasks would read, is spread
    over all; larger ones have tasks enough, and their texts are not shuffled for this."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cores = spark.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < SMALL and len(docs.inputFiles()) < cores else docs


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table in the shared folder and read again: short lineage, safe from lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    again = spark.read.schema(df.schema).parquet(path)
    again._quarry_path = path
    return again


def discard(df: DataFrame) -> None:
    """Delete the table behind a result of ``written`` once nothing reads it any more."""
    if path := getattr(df, "_quarry_path", None):
        _delete(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete all tables that this application wrote here. Results that were not written elsewhere by then are lost."""
    _delete(spark, f"{shared_dir(spark)}/quarry/{spark.sparkContext.applicationId}")


def _delete(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


SEGMENT = 1 << 16
SCREEN_BITS = 1 << 27


def screen_of(ids: DataFrame) -> Callable[[Column], Column]:
    """A test of whether a whole number may be among those in the column of ``ids``: surely not, where it says no.

    A bitmap of hashes, made by segments in tasks; 16 bits a number, but ``SCREEN_BITS`` (16 MB) at most, however many
    there are. Beyond that more and more pass that are not among them.
    """
    from quarry.llm import _text as tx

    spark = ids.sparkSession
    bits = min(SCREEN_BITS, max(SEGMENT, 1 << (16 * ids.count()).bit_length()))
    shift = np.uint64(64 - bits.bit_length() + 1)

    def places(numbers: pa.Array) -> np.ndarray:
        return (tx.mix(numbers.to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) >> shift).astype(np.int64)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = places(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array(at // SEGMENT), pa.array(at % SEGMENT)], ["segment", "bit"])

    def filled(table: pa.Table) -> pa.Table:
        own = np.zeros(SEGMENT, bool)
        own[table["bit"].to_numpy()] = True
        return pa.table({"segment": table["segment"][:1], "bits": pa.array([np.packbits(own).tobytes()], pa.binary())})

    parts = (
        ids.toDF("id").where("id IS NOT NULL").mapInArrow(hashed, "segment long, bit long").distinct()
        .groupBy("segment").applyInArrow(filled, "segment long, bits binary").toArrow()
    )
    whole = np.zeros((bits // SEGMENT, SEGMENT // 8), np.uint8)
    for segment, raw in zip(parts["segment"].to_pylist(), parts["bits"], strict=True):
        whole[segment] = np.frombuffer(raw.as_py(), np.uint8)
    shared = spark.sparkContext.broadcast(whole.tobytes())

    @F.arrow_udf("boolean")
    def may(numbers: pa.Array) -> pa.Array:
        bitmap = np.frombuffer(shared.value, np.uint8)
        some = numbers.is_valid().to_numpy(zero_copy_only=False)
        at = places(numbers.fill_null(0))
        return pa.array((bitmap[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & some)

    return lambda number: may(number.cast("long"))


def without(docs: DataFrame, drop: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is not in the one column of ``drop``; rows with a null id stay.

    Most rows are told by a bitmap and stay where they are; only those that may have to go are shuffled.
    """
    drop = written(drop, "drop")
    key, sure = fresh(docs, "drop_id", "sure")
    may = screen_of(drop)
    marked = docs.withColumn(sure, may(F.col("doc_id")))
    gone = drop.toDF(key)
    unsure = marked.where(F.col(sure)).join(gone, F.col("doc_id") == F.col(key), "left_anti")
    return marked.where(~F.col(sure)).unionByName(unsure).select(*docs.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores before them where columns of ``df`` have them already."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def even_keys(spark: SparkSession, n: int) -> list[int]:
    """n whole numbers of which the i-th, as an int, hashes to the i-th of n shuffle partitions."""
    place = F.pmod(F.hash(F.col("id").cast("int")), F.lit(n)).cast("int")
    reach, found = 32 * n + 256, {}
    while len(found) < n:
        rows = spark.range(reach).groupBy(place.alias("place")).agg(F.min("id").alias("key")).collect()  # n rows
        found, reach = {r["place"]: r["key"] for r in rows}, 4 * reach
    return [found[i] for i in range(n)]


def one_of(keys: list[int], place: Column) -> Column:
    """The key at a place."""
    return F.from_json(F.lit(str(keys)), "array<int>")[place.cast("int")]


def chunks(batches: Iterator[pa.RecordBatch], rows: int = 4096, size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, by row count and bytes, so that working arrays stay in cache."""
    for batch in batches:
        step = max(1, min(rows, int(batch.num_rows * size / max(batch.nbytes, 1)) or 1))
        for at in range(0, batch.num_rows, step):
            yield batch.slice(at, step)


def split_runs(*keys: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal neighbours by all keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.zeros(len(keys[0]), bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def whole_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
    """The columns of rows that are sorted by the first, in pieces that don't cut runs of it: a text's rows at most are
    held back."""
    held: list[np.ndarray] | None = None
    for batch in batches:
        columns = [c.to_numpy() for c in batch.columns]
        if held is not None:
            columns = [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
        if len(columns[0]):
            last = split_runs(columns[0])[-1]
            held = [c[last:] for c in columns]
            if last:
                yield [c[:last] for c in columns]
    if held is not None:
        yield held
