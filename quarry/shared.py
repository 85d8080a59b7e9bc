"""The folder that all executors share, and small tables over all cores."""

from __future__ import annotations

import atexit
import tempfile

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}
_SMALL = 4 << 30  # bytes of input that are spread over all cores where it is in fewer files, which few tasks may read


def shared_dir(spark: SparkSession) -> str:
    """From ``spark.checkpoint.dir``. Only where that is unset and Spark runs in one local process (tests) is a temporary
    folder made; on a cluster an unset folder is an error, since a machine-local one would be lost with its machine."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        own = tempfile.TemporaryDirectory(prefix="quarry-")
        atexit.register(own.cleanup)
        _OWN[app] = f"file://{own.name}"
    return _OWN[app]


def spread(docs: DataFrame) -> DataFrame:
    """Small inputs over all cores; those in many files, and larger ones, have tasks enough, and would be shuffled for nothing."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.repartition(cores) if size < _SMALL and len(docs.inputFiles()) < cores else docs
