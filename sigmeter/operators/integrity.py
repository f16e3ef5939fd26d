"""File inventories, run inventories, order-free table fingerprints and recorded digests."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..schema import ContractError
from ..sources.file_ranges import file_digests


def file_inventory(spark: SparkSession, pattern: str, sequential: bool = False) -> DataFrame:
    """One row per file: base name, bytes and digest, hashed by ranges where the file is read (see ``file_digests``)."""
    return file_digests(spark, pattern, sequential)


def verify_manifest(found: DataFrame, manifest: DataFrame) -> DataFrame:
    m = manifest.select("relative_path", F.col("bytes").alias("expected_bytes"),
                        F.col("sha256").alias("expected_sha256"))
    status = (F.when(F.col("sha256").isNull(), "missing_file")
              .when(F.col("expected_sha256").isNull(), "not_in_manifest")
              .when(F.col("bytes") != F.col("expected_bytes"), "size_mismatch")
              .when(F.col("sha256") != F.col("expected_sha256"), "hash_mismatch").otherwise("ok"))
    return found.join(m, "relative_path", "full_outer").withColumn("status", status)


def completeness(verified: DataFrame) -> DataFrame:
    return verified.agg(F.count("*").alias("n_files"), F.count_if(F.col("status") == "ok").alias("n_ok"),
                        (F.count_if(F.col("status") != "ok") == 0).alias("complete"))


def require_inventory(verified: DataFrame, strict: bool = True) -> DataFrame:
    """Strict: every file listed and equal. Lenient: what is listed and present must be equal."""
    bad = F.col("status") != "ok"
    if not strict:
        bad = F.col("status").isin("size_mismatch", "hash_mismatch")
    n = verified.filter(bad).limit(1).count()
    if n:
        raise ContractError("inventory does not match its manifest")
    return verified


def run_inventory(runs: DataFrame, artifacts: DataFrame, key: str) -> DataFrame:
    """One row per (run, artifact); a run without artifacts keeps a pending row."""
    j = runs.join(artifacts.withColumn("_hit", F.lit(True)), key, "left")
    status = (F.when(F.col("_hit").isNull(), "pending")
              .when(F.col("sha256").isNull(), "missing_in_inventory").otherwise("recorded"))
    return j.withColumn("status", status).withColumn(
        "artifact", F.coalesce("artifact", F.lit("pending"))).drop("_hit")


def id_sum(column: str) -> Column:
    """Order-free aggregate: sum of 52-bit key hashes, exact in decimal at any row count."""
    h = F.conv(F.substring(F.sha2(F.col(column), 256), 1, 13), 16, 10).cast("decimal(20,0)")
    return F.sum(h)


def fingerprint(df: DataFrame, group: list[str], key: Column) -> DataFrame:
    """Order-free identity of a table: count, sum and xor of key hashes. Partial-aggregates."""
    hexed = F.sha2(key, 256)
    lo = F.conv(F.substring(hexed, 1, 13), 16, 10)
    hi = F.conv(F.substring(hexed, 14, 13), 16, 10)
    return df.groupBy(*group).agg(F.count("*").alias("n_ids"), F.sum(lo.cast("decimal(20,0)")).alias("hash_sum"),
                                  F.bit_xor(hi.cast("long")).alias("hash_xor"))


def ordered_sha256(df: DataFrame, group: list[str], order: list[str], text: Column) -> DataFrame:
    """Order-stable sha256 of a group's ids, chained block -> day -> group.

    A (ticker, trading_day) block is bounded by the bar grid; a day has one digest per ticker
    and a group one per day, so no list ever grows with the rows of a group.
    """
    def chain(entries: Column) -> Column:
        return F.sha2(F.array_join(F.transform(F.sort_array(entries), lambda s: s["_t"]), "\n"), 256)

    item = F.struct(*order, text.alias("_t"))
    blocks = df.groupBy(*group, "ticker", "trading_day").agg(
        chain(F.collect_list(item)).alias("_t"), F.count("*").alias("_n"))
    days = blocks.groupBy(*group, "trading_day").agg(
        chain(F.collect_list(F.struct("ticker", "_t"))).alias("_t"), F.sum("_n").alias("_n"))
    return days.groupBy(*group).agg(
        chain(F.collect_list(F.struct("trading_day", "_t"))).alias("ids_sha256"), F.sum("_n").alias("n_ids"))


CHUNK_BYTES = 1 << 20


def _chunks(n_group: int, chunk_bytes: int):
    """Texts of consecutive rows of a group, each with its newline, in chunks numbered by partition and place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, at, held, rows, size = TaskContext.get().partitionId(), 0, None, [], 0, 0

        def out() -> pa.RecordBatch:
            values = [*at, part, seq, rows, b"".join(held)]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=pa.schema(fields))

        for batch in batches:
            fields = [*[pa.field(f.name, f.type) for f in list(batch.schema)[:n_group]], pa.field("part", pa.int64()),
                      pa.field("seq", pa.int64()), pa.field("n_ids", pa.int64()), pa.field("chunk", pa.binary())]
            columns = [c.to_pylist() for c in batch.columns]
            for row in zip(*columns):
                key = row[:n_group]
                if held and (key != at or size >= chunk_bytes):
                    yield out()
                    held, rows, size, seq = [], 0, 0, seq + 1
                at = key
                held.append(row[n_group].encode() + b"\n")
                rows, size = rows + 1, size + len(held[-1])
        if held:
            yield out()

    return run


def _digests(n_group: int):
    """One sha256 state at a time over chunks sorted by group; the newline after the last id is not hashed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, rows = None, None, 0

        def out() -> pa.RecordBatch:
            values = [*at, state.hexdigest(), rows]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, fields)], schema=pa.schema(fields))

        for batch in batches:
            fields = [*[pa.field(f.name, f.type) for f in list(batch.schema)[:n_group]], pa.field("ids_sha256", pa.string()), pa.field("n_ids", pa.int64())]
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if state is not None and row[:n_group] != at:
                    yield out()
                    state = None
                if state is None:
                    at, state, rows = row[:n_group], hashlib.sha256(), 0
                else:
                    state.update(b"\n")
                state.update(row[-1][:-1])
                rows += row[-2]
        if state is not None:
            yield out()

    return run


def recorded_sha256(df: DataFrame, group: list[str], order: list[str], text: Column, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Per group, plain sha256 of its texts in order, joined by newlines: the form that ledgers record.

    The rows are sorted by range over all tasks, where a large group takes many, and become chunks of about
    ``chunk_bytes``. sha256 is sequential, so one task streams a group's chunks through one hash state; its
    memory is a chunk. A null text counts as empty. An empty table gives no groups.
    """
    kinds = dict(df.dtypes)
    head = ", ".join(f"`{c}` {kinds[c]}" for c in group)
    rows = df.select(*group, F.coalesce(text, F.lit("")).alias("_text"), F.struct(*order).alias("_at"))
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, *group, "_at", "_text").sortWithinPartitions(*group, "_at", "_text").select(*group, "_text")
    chunks = rows.mapInArrow(_chunks(len(group), chunk_bytes), f"{head}, part long, seq long, n_ids long, chunk binary")
    chunks = chunks.repartition(*group).sortWithinPartitions(*group, "part", "seq").select(*group, "n_ids", "chunk")
    return chunks.mapInArrow(_digests(len(group)), f"{head}, ids_sha256 string, n_ids long")
