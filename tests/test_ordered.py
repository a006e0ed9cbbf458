"""Positions, running sums and quantiles over ranges against plain Python: ties, nulls, one hot key, empty tables."""

import random

import numpy as np
import pytest

from tessera.operators import arrange, ordered, partition


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    return [(i, r.choice(["hot"] * 8 + ["a", None]), r.choice([None, r.randint(0, 9), r.randint(0, 1000)])) for i in range(3000)]


@pytest.fixture(scope="module")
def df(spark, rows):
    return spark.createDataFrame(rows, "id long, k string, v long")


def order(row):
    return (row[2] is not None, row[2] or 0, row[0])


def test_positions(df, rows):
    got = {r.id: (r.pos, r.n) for r in ordered.numbered(df, ["v", "id"], total="n", parts=7).collect()}
    assert got == {r[0]: (k, 3000) for k, r in enumerate(sorted(rows, key=order))}


def test_positions_and_sums_within_keys(df, rows):
    got = {r.id: r.pos for r in ordered.numbered_within(df, ["k"], ["v", "id"], parts=7).collect()}
    sums = {r.id: (r.s, r.n) for r in ordered.running(df.selectExpr("*", "1 AS one", "coalesce(v, 0) AS w"), ["k"], ["v", "id"], {"s": "w", "n": "one"}, parts=7).collect()}
    for key in ("hot", "a", None):
        total = 0
        for n, r in enumerate(sorted((r for r in rows if r[1] == key), key=order)):
            total += r[2] or 0
            assert got[r[0]] == n and sums[r[0]] == (total, n + 1)


def test_quantiles_are_exact(spark, df, rows):
    at = {"lo": 0.0, "q1": 0.1, "half": 0.5, "q9": 0.9, "hi": 1.0}
    got = {r.k: r for r in ordered.quantiles(df, ["k"], "v", at).collect()}
    for key in ("hot", "a", None):
        v = [r[2] for r in rows if r[1] == key and r[2] is not None]
        assert [got[key][n] for n in at] == pytest.approx([float(np.quantile(v, q)) for q in at.values()])
    whole = ordered.quantiles(df, [], "v", {"m": 0.5}).collect()
    assert [r.m for r in whole] == [float(np.median([r[2] for r in rows if r[2] is not None]))]
    assert ordered.quantiles(spark.createDataFrame([("x", None)], "k string, v long"), ["k"], "v", at).collect() == []


def test_empty_and_single(spark):
    none = spark.createDataFrame([], "id long, k string")
    assert ordered.numbered(none, ["id"]).collect() == ordered.numbered_within(none, ["k"], ["id"]).collect() == []
    one = spark.createDataFrame([(5, "x")], "id long, k string")
    assert [(r.copy, r.a, r.b) for r in arrange.repeated(one, ["id"], 2, "a", "b").orderBy("copy").collect()] == [(0, 0, 0), (1, 1, 1)]


def test_schedule_and_fraction(df, rows):
    out = partition.schedule(df, "id", 2).collect()
    for e in (0, 1):
        assert sorted(r.pos for r in out if r.epoch == e) == list(range(1, 3001))
    assert [r.id for r in sorted(out, key=lambda r: r.pos) if r.epoch == 0] != [r.id for r in sorted(out, key=lambda r: r.pos) if r.epoch == 1]
    part = partition.fraction(df, "k", "id", 0.25).collect()
    for key in ("hot", "a", None):
        assert sum(r.k == key for r in part) == int(sum(r[1] == key for r in rows) * 0.25)
