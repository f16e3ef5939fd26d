"""File digests by ranges, against hashlib and with damaged files."""

from __future__ import annotations

import hashlib
import os

import pytest

from sigmeter.operators import integrity as Q
from sigmeter.schema import ContractError
from sigmeter.sources.file_ranges import file_digests


def folder(tmp_path):
    for i, size in enumerate((0, 1, 1000, 5000)):
        (tmp_path / f"f{i}.bin").write_bytes(os.urandom(size))
    (tmp_path / "other.txt").write_text("not listed")
    return f"{tmp_path}/*.bin"


def test_digests_equal_hashlib(spark, tmp_path):
    pattern = folder(tmp_path)
    plain = {r.relative_path: r for r in file_digests(spark, pattern, sequential=True).collect()}
    tree = {r.relative_path: r for r in file_digests(spark, pattern, range_bytes=700).collect()}
    assert set(plain) == set(tree) == {f"f{i}.bin" for i in range(4)}
    for name, row in plain.items():
        data = (tmp_path / name).read_bytes()
        parts = "".join(hashlib.sha256(data[a:a + 700]).hexdigest() for a in range(0, max(len(data), 1), 700))
        assert row.bytes == tree[name].bytes == len(data) and row.sha256 == hashlib.sha256(data).hexdigest()
        assert tree[name].sha256 == hashlib.sha256(parts.encode()).hexdigest()
    assert file_digests(spark, f"{tmp_path}/*.none").count() == 0


def test_planted_faults_are_found(spark, tmp_path):
    pattern = folder(tmp_path)
    manifest = spark.createDataFrame(file_digests(spark, pattern, range_bytes=700).collect())
    assert Q.completeness(Q.verify_manifest(file_digests(spark, pattern, range_bytes=700), manifest)).first().complete
    os.truncate(tmp_path / "f3.bin", 4999)
    data = bytearray((tmp_path / "f2.bin").read_bytes())
    data[999] ^= 1
    (tmp_path / "f2.bin").write_bytes(data)
    (tmp_path / "f1.bin").rename(tmp_path / "f9.bin")
    got = Q.verify_manifest(file_digests(spark, pattern, range_bytes=700), manifest)
    assert {r.relative_path: r.status for r in got.collect()} == {"f0.bin": "ok", "f1.bin": "missing_file", "f2.bin": "hash_mismatch", "f3.bin": "size_mismatch", "f9.bin": "not_in_manifest"}
    with pytest.raises(ContractError):
        Q.require_inventory(got)


def test_a_file_above_two_gigabytes(spark, tmp_path):
    size = (2 << 30) + 12345
    with open(tmp_path / "large.bin", "wb") as f:
        f.truncate(size)
    row = file_digests(spark, f"{tmp_path}/*.bin").first()
    step, zero = 64 << 20, hashlib.sha256(bytes(64 << 20)).hexdigest()
    want = hashlib.sha256((zero * (size // step) + hashlib.sha256(bytes(size % step)).hexdigest()).encode()).hexdigest()
    assert row.bytes == size and row.sha256 == want
