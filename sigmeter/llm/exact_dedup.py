"""Exact dedup as a stateful stream.

A stream of arrivals (digest, id, content locator) meets keyed state in RocksDB that never
expires. The state of a digest is the locator of the row that stays and the number of rows seen,
so its size follows the number of different texts, not their length, and a later run over new
files continues from the same checkpoint. Rows that hit an occupied digest are checked byte for
byte against the other texts of that digest before they count as equal.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.utils import AnalysisException

from ..session import materialise, scratch_path
from .common import documents, fold_ascii, located

STORE_CONF = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    # Without this every partition's store reserves several MB of disk, however little it holds.
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",
}
LOCATOR = ["src_file", "src_row"]


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def arrivals(docs: DataFrame, digest=sha256_hex) -> DataFrame:
    """One slim row per document: digest of the folded text, id and content locator."""
    norm = fold_ascii(F.coalesce(F.col("text"), F.lit("")))
    return located(docs, [F.col("doc_id"), digest(norm).alias("digest")])


def keyed_state(stream: DataFrame) -> DataFrame:
    """Stream of arrivals -> state per digest: the row that stays (largest id, then locator) and the count."""
    return stream.groupBy("digest").agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("n"))


def run_state(spark: SparkSession, source: str, checkpoint: str, bytes_per_trigger: int = 2 << 30) -> DataFrame:
    """Take every arrival file that the checkpoint has not seen into the state, and read the state.

    A second call with the same checkpoint takes only new files. Nothing is kept on a machine's own
    disk but RocksDB's working copy; each micro-batch commits to ``checkpoint``, so a lost executor
    costs the batch in hand.
    """
    before = {k: spark.conf.get(k, None) for k in STORE_CONF}
    for k, v in STORE_CONF.items():
        spark.conf.set(k, v)
    try:
        stream = (spark.readStream.schema(spark.read.parquet(source).schema)
                  .option("maxBytesPerTrigger", bytes_per_trigger).parquet(source))
        (keyed_state(stream).writeStream.format("noop").outputMode("update").trigger(availableNow=True)
         .option("checkpointLocation", checkpoint).start().awaitTermination())
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    state = spark.read.format("statestore").load(checkpoint)
    return state.select(F.col("key.digest").alias("digest"), *(F.col(f"value.{c}").alias(c) for c in state.schema["value"].dataType.names))


def label(docs: DataFrame, digest=sha256_hex, bytes_per_trigger: int = 2 << 30) -> DataFrame:
    """Each row's locator, doc_id, digest, keep_id, group_size and kept.

    * Null text counts as empty; empty texts form one group.
    * Of equal texts the largest doc_id stays; a null id loses to any other. Rows that repeat both
      text and id are all counted, and the one with the last locator stays.
    * An empty table gives no rows. Columns other than doc_id and text are not read.
    * Texts that share a digest but not their bytes are told apart: their groups are formed again on
      the text itself.
    """
    spark = docs.sparkSession
    path = scratch_path(spark, "arrivals")
    arrivals(docs, digest).write.parquet(path)
    seen = spark.read.parquet(path)
    if seen.isEmpty():
        groups = keyed_state(seen)
    else:
        state = run_state(spark, path, scratch_path(spark, "dedup-state"), bytes_per_trigger)
        groups = state.toDF("digest", *state.columns[1:])
        groups = materialise(groups.select("digest", F.col(groups.columns[1]).alias("keep"), F.col(groups.columns[2]).alias("n")), "dedup-groups")
    out = seen.join(groups, "digest").select(
        *LOCATOR, "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"),
        (F.col("src_file").eqNullSafe(F.col("keep.src_file")) & F.col("src_row").eqNullSafe(F.col("keep.src_row"))).alias("kept"))
    clash = clashes(docs, groups, digest)
    if clash.isEmpty():
        return out
    split = regroup(docs, clash, digest)
    return out.join(clash, "digest", "left_anti").unionByName(split)


def hits(docs: DataFrame, groups: DataFrame, digest) -> DataFrame:
    """Full texts of the rows whose digest is occupied by more than one row."""
    occupied = groups.filter("n > 1").select(F.xxhash64("digest").alias("short")).distinct()
    texts = docs.select(fold_ascii(F.coalesce(F.col("text"), F.lit(""))).alias("norm"))
    texts = texts.select(digest(F.col("norm")).alias("digest"), "norm").withColumn("short", F.xxhash64("digest"))
    return texts.join(occupied, "short", "left_semi")


def clashes(docs: DataFrame, groups: DataFrame, digest) -> DataFrame:
    """Digests under which full bytes differ. Equal texts fold to one row per task before they move."""
    per = hits(docs, groups, digest).groupBy("digest").agg(F.min("norm").alias("low"), F.max("norm").alias("high"))
    return materialise(per.filter(F.col("low") != F.col("high")).select("digest"), "dedup-clashes")


def regroup(docs: DataFrame, clash: DataFrame, digest) -> DataFrame:
    """The same labels for clashing digests, grouped on the text."""
    norm = fold_ascii(F.coalesce(F.col("text"), F.lit("")))
    rows = located(docs, [F.col("doc_id"), digest(norm).alias("digest"), norm.alias("norm")]).join(clash, "digest", "left_semi")
    sizes = rows.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", *LOCATOR)).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    return rows.join(sizes, ["digest", "norm"]).select(
        *LOCATOR, "doc_id", "digest", F.col("keep.doc_id").alias("keep_id"), "group_size",
        (F.struct(*LOCATOR) == F.struct("keep.src_file", "keep.src_row")).alias("kept"))


def file_backed(docs: DataFrame) -> DataFrame:
    """The frame itself where its rows have a locator, else a written copy."""
    try:
        located(docs, [])
        return docs
    except AnalysisException:
        return materialise(docs, "dedup-docs")


def dedup(docs: DataFrame) -> DataFrame:
    """The rows that stay, with all their columns."""
    docs = file_backed(docs)
    kept = label(docs).filter("kept").select(*(F.col(c).alias(f"_kept_{c}") for c in LOCATOR))
    meta = docs.metadataColumn("_metadata")
    on = (meta.getField("file_path") == F.col("_kept_src_file")) & (meta.getField("row_index") == F.col("_kept_src_row"))
    return docs.join(kept, on, "left_semi")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return label(file_backed(documents(spark, sf_dir))).select(
        "doc_id", "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP1_SQL = """
WITH n AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY t)
SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.t) AS text_sha256
FROM n JOIN g ON n.t = g.t
"""
