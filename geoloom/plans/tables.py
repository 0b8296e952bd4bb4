"""Materialised intermediate tables, in the folder that all executors share."""

from __future__ import annotations

import atexit
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

_made: dict[str, SparkSession] = {}
atexit.register(lambda: _clear())


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir, the context's checkpoint folder, or where neither is set a folder in the warehouse, which
    driver and executors share too."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        kept = spark.sparkContext._jsc.sc().getCheckpointDir()
        path = kept.get() if kept.isDefined() else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return path


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path below the shared folder; what is there goes when Python ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _made[path] = spark
    return path


def _clear(keep: frozenset[str] = frozenset()) -> None:
    for path in [p for p in _made if p not in keep]:
        spark = _made.pop(path)
        try:
            context = spark.sparkContext
            at = context._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(context._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session has ended before
            return


@contextmanager
def passing():
    """What is settled inside goes at the end, so its results must be written or collected by then."""
    before = frozenset(_made)
    try:
        yield
    finally:
        _clear(before)


def settled(df: DataFrame) -> DataFrame:
    """df as it is now, written once and cut off from its lineage."""
    path = scratch_path(df.sparkSession, "settled")
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
