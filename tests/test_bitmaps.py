"""Components against flood fill, distances against all pairs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import bitmaps


def flood(m):
    out, n = np.zeros(m.shape, int), 0
    for y, x in zip(*np.nonzero(m), strict=True):
        if out[y, x]:
            continue
        n += 1
        stack = [(y, x)]
        while stack:
            a, b = stack.pop()
            if 0 <= a < m.shape[0] and 0 <= b < m.shape[1] and m[a, b] and not out[a, b]:
                out[a, b] = n
                stack += [(a + 1, b), (a - 1, b), (a, b + 1), (a, b - 1)]
    return out


@pytest.mark.parametrize("seed", range(40))
def test_components_and_distances(seed):
    r = np.random.default_rng(seed)
    m = (r.random((r.integers(1, 14), r.integers(1, 14))) < r.choice([0.3, 0.55, 0.8, 1.0])).astype(int)
    assert (bitmaps.components(m) == flood(m)).all()
    zeros = np.argwhere(m == 0)
    if len(zeros):
        want = [[min((y - a) ** 2 + (x - b) ** 2 for a, b in zeros) for x in range(m.shape[1])] for y in range(m.shape[0])]
        assert (bitmaps.distances(m) == np.array(want)).all()
    else:
        assert (bitmaps.distances(m) >= max(m.shape) ** 2).all()


def test_spirals_hang_together():
    m = np.ones((41, 41), int)
    m[1::4, :-1] = 0
    m[3::4, 1:] = 0
    assert bitmaps.components(m).max() == 1 and bitmaps.components(m.T).max() == 1


def test_columns(spark):
    d = spark.createDataFrame([(1, [1, 0, 1, 1, 0, 0]), (2, [0] * 6), (3, None), (4, [1] * 6)], "id int, m array<int>")
    got = {r.id: r for r in d.select("id", bitmaps.component_sizes(F.col("m"), F.lit(3)).alias("s"), bitmaps.several_components(F.col("m"), F.lit(3)).alias("k"), bitmaps.point_prompt(F.col("m"), F.lit(3), F.col("id")).alias("p")).collect()}
    assert got[1].s == [2, 1] and got[1].k and got[2].s == [] and not got[2].k and got[3].s is None and got[4].s == [6]
    assert tuple(got[1].p) == (0, 0) and tuple(got[2].p) == (0, 0)
