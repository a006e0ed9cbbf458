"""Batch operators, file formats and streams on small hand-made tables."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import batch
from tessera.sources import files, sinks
from tessera.streaming import jobs


@pytest.fixture
def df(spark):
    return spark.createDataFrame([(1, "x", 2.0), (2, None, 3.0), (3, 'a "q"\tb', None)], "id long, Text string, A double")


def test_columns(df):
    assert batch.select(df, ["A", "none", "id"]).columns == ["A", "id"]
    popped, rest = batch.pop(df, ["A", "none"], "id")
    assert popped.columns == ["id", "A"] and rest.columns == ["id", "Text"]
    assert batch.rename(df, ["A"], ["b"]).columns == ["id", "Text", "b"]
    with pytest.raises(ValueError):
        batch.rename(df, ["A"], [])
    assert batch.fold_case(df).columns == ["id", "text", "A"]


def test_rows_and_nested(spark, df):
    at = spark.createDataFrame([(3, 0), (1, 1), (3, 2)], "id long, pos int")
    assert [r.id for r in batch.index_select(df, at, "id").orderBy("pos").collect()] == [3, 1, 3]
    nested = df.select(F.struct("id", F.struct("A").alias("in")).alias("s"), "Text")
    assert batch.flatten(nested).columns == ["s/id", "s/in/A", "Text"]
    row = spark.sql("SELECT map('a', 1, 'b', 2) AS x, map('b', 3, 'c', 4) AS y").select(batch.merge_maps(F.col("x"), F.col("y")).alias("m")).first()
    assert row.m == {"a": 1, "b": 3, "c": 4}


def test_scans_over_steps(spark):
    r, v, m = [1.0, 0.5, 2.0, 9.0], [0.2, 0.1, 0.4, 7.0], [1, 1, 1, 0]
    out = spark.createDataFrame([(r, v, m)], "r array<double>, v array<double>, m array<int>").select(batch.advantages(F.col("r"), F.col("v"), F.col("m"), 0.9, 0.8).alias("a"), batch.discounted(F.col("r"), F.col("m"), 0.5).alias("d")).first()
    want, nxt, gae = [], 0.0, 0.0
    for a, b, k in zip(r[::-1], v[::-1], m[::-1], strict=True):
        if k:
            gae, nxt = a + 0.9 * nxt - b + 0.9 * 0.8 * gae, b
        want.insert(0, gae)
    assert out.a == pytest.approx(want)
    assert out.d == pytest.approx([1.75, 1.5, 2.0, 9.0])


@pytest.mark.parametrize("fmt", ["csv", "tsv", "jsonl", "parquet"])
def test_round_trip(spark, df, tmp_path, fmt):
    path = f"{tmp_path}/t.{fmt}"
    files.dump(df, path, per_file=2)
    assert sorted(map(tuple, files.load(spark, path, schema="id long, Text string, A double").collect())) == sorted(map(tuple, df.collect()))
    with pytest.raises(ValueError):
        files.load(spark, "t.pkl")


def test_tolerant_jsonl(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"id": 1}\n\nnot json\n{"id": 2}\n')
    good, bad = files.tolerant_jsonl(spark, str(tmp_path), "id long")
    assert sorted(r.id for r in good.collect()) == [1, 2] and [r.value for r in bad.collect()] == ["not json"]


def test_streams(spark, tmp_path):
    src = f"{tmp_path}/in"
    part = lambda rows: spark.createDataFrame(rows, "k long, at string, v double").withColumn("at", F.col("at").cast("timestamp")).write.mode("append").parquet(src)
    part([(1, "2024-01-01 00:00:00", 1.0), (1, "2024-01-01 00:01:00", 2.0), (2, "2024-01-01 00:02:00", 3.0)])
    stream = lambda: spark.readStream.schema("k long, at timestamp, v double").parquet(src)

    def run():
        assert jobs.write_all(jobs.first_of_each(stream(), "k", "at"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(60)
        return sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect())

    assert run() == [1, 2]
    part([(2, "2024-01-01 00:03:00", 4.0), (3, "2024-01-01 00:04:00", 5.0)])
    assert run() == [1, 2, 3]
    q = jobs.meters(stream(), "k", "v").writeStream.format("memory").queryName("meters").outputMode("complete").trigger(availableNow=True).start()
    assert q.awaitTermination(60)
    assert sorted(map(tuple, spark.table("meters").collect())) == [(1, 3.0, 2, 1.5), (2, 7.0, 2, 3.5), (3, 5.0, 1, 5.0)]


def test_pending(spark):
    wanted, results = spark.range(4).toDF("k"), spark.createDataFrame([(0, "ok"), (1, "FAIL"), (1, "ok"), (2, "FAIL")], "k long, out string")
    assert sorted(r.k for r in jobs.pending(wanted, results, "k", "out = 'FAIL'").collect()) == [2, 3]


def test_numbers_as_python_writes_them(spark):
    """Sums of ten million and more aren't written as 1.0E7."""
    v = [10177450.0, 1e7, -1e7, 123456789.25, 9999999.0, 0.1, 1e15, 1234567890123456.0, 1e16, 1.5e22, 1e100, 0.001, 0.00012345678901234567, -0.0001, 1e-5, 2.5e-7, 1e-300, 0.0, -0.0, float("inf"), float("-inf"), float("nan"), 1 / 3]
    d = spark.createDataFrame([(k, x) for k, x in enumerate(v)], "k int, v double")
    assert [r.s for r in d.select("k", sinks.number_text(F.col("v")).alias("s")).orderBy("k").collect()] == [repr(x) for x in v]
    assert spark.range(1).select(sinks.number_text(F.lit(None).cast("double"))).first()[0] is None


def test_first_of_each_takes_late_rows(spark, tmp_path):
    """Files far apart in time and out of order: a watermark of 1,000 days would leave out the second and third."""
    for k, at in enumerate(("2024-01-01", "2001-01-01", "2010-01-01")):
        spark.createDataFrame([(k, at), (9, at)], "k long, at string").coalesce(1).withColumn("at", F.col("at").cast("timestamp")).write.parquet(f"{tmp_path}/in/{k}")
    for k in range(3):
        s = spark.readStream.schema("k long, at timestamp").option("maxFilesPerTrigger", "1").option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        assert jobs.write_all(jobs.first_of_each(s, "k"), f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination(100)
    assert sorted(r.k for r in spark.read.parquet(f"{tmp_path}/out").collect()) == [0, 1, 2, 9]
