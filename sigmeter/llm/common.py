"""Small helpers that every operator of this subpackage shares."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..sources.tables import table

__all__ = ["crc_bucket", "documents", "fold_ascii", "located", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents")


def fold_ascii(text: Column) -> Column:
    """A-Z to lower case and nothing else. Pure ASCII takes the byte-wise path of ``lower``."""
    ascii_only = F.length(text) == F.octet_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def crc_bucket(doc_id: Column, n: int) -> Column:
    """crc32 of the id written as text, modulo ``n``."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(n))


def located(docs: DataFrame, keep: list[Column]) -> DataFrame:
    """``keep`` plus a content locator (``src_file``, ``src_row``) of each row of a file-backed frame."""
    meta = docs.metadataColumn("_metadata")
    return docs.select(meta.getField("file_path").alias("src_file"), meta.getField("row_index").alias("src_row"), *keep)
