"""Frozen decision records: nested JSON read by dotted path."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _json_path(dotted: str) -> str:
    return "$" + "".join(f"['{k}']" for k in dotted.split("."))


def resolve(record: Column, dotted: str) -> Column:
    """The field as text; a null that is recorded stays null, and a missing key ends the job.

    ``record`` is a VARIANT, see ``parse_json``.
    """
    found = F.variant_get(record, _json_path(dotted), "variant")
    lost = F.raise_error(F.lit(f"record field {dotted!r} not found"))
    return F.when(found.isNull(), lost.cast("string")).otherwise(F.variant_get(record, _json_path(dotted), "string"))


def record_fields(records: DataFrame, keys: list[str], text: str, paths: list[str]) -> DataFrame:
    """(keys, path, value, status) for every record and path, in one pass over the records.

    ``status`` is ``resolved``, ``recorded_null`` (the key is there and holds null), ``missing`` (a key of the
    path is absent, or something on the way is not a mapping), or ``no_record`` (the text is null or not JSON). Values are text.
    """
    v = records.select(*keys, F.try_parse_json(text).alias("_v"))

    def entry(path: str) -> Column:
        found = F.variant_get("_v", _json_path(path), "variant")
        status = (F.when(F.col("_v").isNull(), "no_record").when(found.isNull(), "missing")
                  .when(F.is_variant_null(found), "recorded_null").otherwise("resolved"))
        return F.struct(F.lit(path).alias("path"), F.variant_get("_v", _json_path(path), "string").alias("value"), status.alias("status"))

    return v.select(*keys, F.explode(F.array(*map(entry, paths))).alias("_f")).select(*keys, "_f.*")
