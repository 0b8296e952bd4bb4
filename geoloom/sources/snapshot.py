"""Snapshots of the engine's tables: one Parquet folder each, read back with the schema that is asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def snapshot_write(tables: dict[str, DataFrame], path: str) -> None:
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def snapshot_read(spark: SparkSession, path: str, schemas: dict) -> dict[str, DataFrame]:
    """A missing or unreadable table fails when it is read; nothing is preprocessed again."""
    return {name: spark.read.schema(schema).parquet(f"{path}/{name}") for name, schema in schemas.items()}
