"""Parquet readers with a column contract, and the readout sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql import types as T

from .. import schema


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Projected Parquet read: missing columns fail, only the named ones are scanned."""
    df = spark.read.parquet(path)
    return schema.assert_columns(df, columns, path).select(*columns)


def read_event_index(spark: SparkSession, path: str) -> DataFrame:
    """Sample-event index with its required columns and a naive timestamp."""
    df = spark.read.parquet(path)
    schema.assert_columns(df, schema.EVENT_REQUIRED, path)
    return df.withColumn("target_timestamp", F.col("target_timestamp").cast("timestamp_ntz"))


def write_table(df: DataFrame, path: str, contract: T.StructType | None = None,
                partition_by: list[str] | None = None, sort_by: list[str] | None = None) -> None:
    """Parquet sink. ``contract`` is checked before any work starts."""
    if contract is not None:
        schema.assert_schema(df, contract, path)
    if sort_by:
        df = df.sortWithinPartitions(*(partition_by or []), *sort_by)
    writer = df.write.mode("overwrite")
    if partition_by:
        # A unit re-run replaces its own partitions and leaves the others.
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by)
    writer.parquet(path)


def export_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def export_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)
