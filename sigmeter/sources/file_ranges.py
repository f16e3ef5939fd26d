"""Digests of files of any size, read by byte ranges where the executors are.

``FileRanges`` is a Python data source: one partition per range (tree digests) or per file (sequential digests),
read in small blocks, so no file has to fit into a task. A tree digest is the sha256 of the range digests in order; a
plain sha256 needs one reader per file and is for manifests that record it.
"""

from __future__ import annotations

import fnmatch
import hashlib
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..session import ship_package

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
SCHEMA = "relative_path string, bytes long, range_index int, digest string"


def listed(pattern: str) -> list[tuple[str, str, int]]:
    """(uri of the folder, file name, bytes) of a folder's files that match the last part of ``pattern``, by name."""
    folder, _, name = pattern.rpartition("/")
    store, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
    found = [f for f in store.get_file_info(pafs.FileSelector(path, allow_not_found=True)) if f.is_file and fnmatch.fnmatchcase(f.base_name, name)]
    return sorted((folder, f.base_name, f.size) for f in found)


class Range(InputPartition):
    def __init__(self, folder: str, name: str, size: int, index: int, start: int, end: int):
        super().__init__((folder, name, size, index, start, end))


class RangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.pattern, self.step = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[Range]:
        out = []
        for folder, name, size in listed(self.pattern):
            step = self.step or max(size, 1)
            out += [Range(folder, name, size, i, a, min(a + step, size)) for i, a in enumerate(range(0, max(size, 1), step))]
        return out

    def read(self, partition: Range) -> Iterator[tuple]:
        if partition is None:  # no file matches
            return
        folder, name, size, index, start, end = partition.value
        store, path = pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)
        state, left = hashlib.sha256(), end - start
        with store.open_input_file(f"{path}/{name}") as f:
            f.seek(start)
            while left > 0:
                block = f.read(min(BLOCK_BYTES, left))
                if not block:
                    raise OSError(f"{name} ended {left} bytes early")
                state.update(block)
                left -= len(block)
        yield name, size, index, state.hexdigest()


class FileRanges(DataSource):
    """Options: path (folder/pattern), rangebytes (0: one range per file)."""

    @classmethod
    def name(cls) -> str:
        return "file_ranges"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> RangeReader:
        return RangeReader(dict(self.options))


def file_digests(spark: SparkSession, pattern: str, sequential: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(relative_path, bytes, sha256): tree digests, or the plain sha256 of every file where ``sequential``."""
    ship_package(spark)
    spark.dataSource.register(FileRanges)
    rows = spark.read.format("file_ranges").option("rangebytes", 0 if sequential else range_bytes).load(pattern)
    if sequential:
        return rows.select("relative_path", "bytes", F.col("digest").alias("sha256"))
    # One short text per range of a file: 16,000 of them for a terabyte.
    tree = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("range_index", "digest"))), lambda r: r["digest"]), ""), 256)
    return rows.groupBy("relative_path").agg(F.max("bytes").alias("bytes"), tree.alias("sha256"))
