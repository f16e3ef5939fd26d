"""Raw minute text files: one file per ticker, optional header, optional byte-order mark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from .. import schema

# Fixed formats of the raw files.
HEADER = "Date"
STAMP_FORMAT = "MM/dd/yyyy HH:mm"
BOM = "﻿"


# The ticker is the file's base name up to the first '_' or '.'.
TICKER_IN_PATH = r"([^/_.]+)[^/]*$"


def read_minute_files(spark: SparkSession, glob: str, ticker_in_path: str = TICKER_IN_PATH) -> DataFrame:
    """All files in one scan, the ticker taken from the path.

    The first line of a file is a header only if it says so: such lines must equal the
    contract, and any value that does not parse fails the job (ANSI casts).
    """
    raw = (spark.read.schema(schema.RAW_MINUTE).option("header", False)
           .option("mode", "FAILFAST").csv(glob)
           .withColumn("_file", F.col("_metadata.file_path")))
    raw = raw.withColumn("Date", F.regexp_replace(F.trim("Date"), f"^{BOM}", ""))
    names = schema.RAW_MINUTE.fieldNames()
    is_header = F.col("Date") == F.lit(HEADER)
    wrong = is_header & ~F.concat_ws(",", *[F.trim(c) for c in names]).eqNullSafe(",".join(names))
    checked = F.when(wrong, F.raise_error(F.lit("raw minute header differs from contract"))
                     .cast("boolean")).otherwise(is_header)
    body = raw.filter(~checked)
    stamp = F.to_timestamp_ntz(F.concat_ws(" ", F.trim("Date"), F.trim("Time")),
                               F.lit(STAMP_FORMAT))
    return body.select(
        F.regexp_extract("_file", ticker_in_path, 1).alias("ticker"),
        stamp.alias("timestamp"),
        *[F.trim(c).cast("double").alias(c.lower()) for c in names[2:]],
    )
