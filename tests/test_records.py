"""Keyed record files: checksums, lookups that read their frames alone, broken frames, several writes."""

import glob

import pytest
from pyspark.sql import functions as F

from tessera.sources import records


def test_checksum_by_the_published_vectors():
    assert records.crc32c(b"123456789") == 0xE3069283 and records.crc32c(bytes(32)) == 0x8A9136AA and records.crc32c(b"\xff" * 32) == 0x62A8AB43 and records.crc32c(b"") == 0


@pytest.fixture
def folder(spark, tmp_path):
    records.register(spark)
    d = spark.range(400).select(F.concat(F.lit("k"), "id").alias("key"), F.encode(F.concat(F.lit("v"), F.col("id") * 7), "UTF-8").alias("value"))
    d.repartition(3).write.format("keyed_records").option("splitBytes", "500").mode("append").save(f"{tmp_path}/r")
    return f"{tmp_path}/r"


def read(spark, folder, *where):
    d = spark.read.format("keyed_records").load(folder)
    for w in where:
        d = d.filter(w)
    return sorted(((r.key, None if r.value is None else bytes(r.value)) for r in d.collect()), key=repr)


def test_scan_and_lookup(spark, folder):
    assert read(spark, folder) == sorted(((f"k{i}", f"v{7 * i}".encode()) for i in range(400)), key=repr)
    assert read(spark, folder, "key = 'k7'") == [("k7", b"v49")] and read(spark, folder, "key = 'none'") == []
    assert read(spark, folder, "key IN ('k1', 'k399', 'x')") == [("k1", b"v7"), ("k399", b"v2793")]
    assert read(spark, folder, "key = 'k7'", "value IS NULL") == [] and read(spark, folder, "key = 'k1'", "key = 'k2'") == []


def test_broken_frames(spark, folder):
    """A value that fails its checksum is null; a lookup of another key doesn't pass by the broken frames."""
    for path in glob.glob(f"{folder}/*.records"):
        raw = bytearray(open(path, "rb").read())
        at = raw.find(records.frame("k7", b"v49"))
        if at >= 0:
            raw[at + 12 + 4 + 2] ^= 1
            open(path, "wb").write(raw)
    assert read(spark, folder, "key = 'k7'") == [("k7", None)]
    got = read(spark, folder)
    assert len(got) == 400 and got.count((None, None)) == 1
    for path in glob.glob(f"{folder}/*.records"):
        raw = bytearray(open(path, "rb").read())
        keep = raw.find(records.frame("k9", b"v63"))
        size = len(records.frame("k9", b"v63"))
        spoiled = bytearray(b"\0" * len(raw))
        if keep >= 0:
            spoiled[keep : keep + size] = raw[keep : keep + size]
        open(path, "wb").write(spoiled)
    assert read(spark, folder, "key = 'k9'") == [("k9", b"v63")]


def test_appends_overwrites_and_leftovers(spark, folder):
    one = spark.createDataFrame([("k7", bytearray(b"again"))], "key string, value binary")
    one.write.format("keyed_records").mode("append").save(folder)
    assert read(spark, folder, "key = 'k7'") == [("k7", b"again"), ("k7", b"v49")]
    open(f"{folder}/part-left.records", "wb").write(records.frame("lost", b"x"))
    assert read(spark, folder, "key = 'lost'") == []
    one.write.format("keyed_records").mode("overwrite").save(folder)
    assert read(spark, folder) == [("k7", b"again")]
