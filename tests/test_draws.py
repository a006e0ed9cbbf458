"""Bootstrap on NumPy's own stream, and balanced pairs among classes, against plain computations."""

import random
from collections import Counter
from itertools import combinations

import numpy as np
import pytest

from tessera.operators import audit, partition

#: Published means of sixteen groups, in order of their names.
MEANS = [0.0, 0.9619041908074887, 0.9670942279693997, 0.4824878420740531, 0.2838709831232977, 0.34258971753680206, 0.5448227006038244, 0.31781242856391484, 0.39691070303923925, 0.37022877747947097, 0.5096902846092398, 0.3398074673683853, 0.20036292289160534, 0.4510967229497965, 0.37045086192612364, 0.3240417308311697]


@pytest.mark.parametrize("n,draws", [(16, 3000), (6, 9000), (7, 1), (1, 5)])
def test_places_are_those_of_the_generator(spark, n, draws):
    got = {(r.draw, r.j): r.place for r in audit.numpy_draws(spark, n, draws, 20260916).collect()}
    want = np.random.default_rng(20260916).integers(0, n, size=(draws, n))
    assert got == {(b, j): int(x) for (b, j), x in np.ndenumerate(want)}


def test_numbers_that_are_passed_over(monkeypatch):
    """With so many places that half of the numbers would favour some, blocks still follow on one another."""
    n = (1 << 31) + 1
    got = np.concatenate([audit._accepted(5, n, k) for k in range(3)])
    assert (got[:20_000] == np.random.default_rng(5).integers(0, n, size=20_000)).all() and len(got) < 2.2 * audit.BLOCK * 2


def test_published_interval(spark):
    d = spark.createDataFrame([(f"g{k:02d}", m) for k, m in enumerate(MEANS)], "g string, v double")
    r = audit.numpy_bootstrap(d, ["g"], "v").first()
    assert (round(r.estimate, 6), round(r.lower, 6), round(r.upper, 6)) == (0.428948, 0.320991, 0.555574)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_pairs_among_all_rows(spark, seed):
    r = random.Random(seed)
    rows = [(s, i, r.choice("abc"), r.choice("xy"), r.randint(0, 3)) for i, s in enumerate(r.choices("pqrst", k=120))]
    d = spark.createDataFrame(rows, "s string, id int, action string, difficulty string, distractors int")
    a, b, want = Counter(), Counter(), []
    for s in "pqrst":
        def cost(p):
            x, y = p
            na, nb = a + Counter((x[2], y[2])), b + Counter((x[3], y[3]))
            va, vb = [na[k] for k in "abc"], [nb[k] for k in "xy"]
            spread = lambda v: (max(v) - min(v), sum((x - sum(v) / len(v)) ** 2 for x in v))
            return (*spread(va), x[2] == y[2], *spread(vb), x[3] == y[3], -abs(x[4] - y[4]), x[1], y[1])

        pair = min(combinations(sorted((x for x in rows if x[0] == s), key=lambda x: x[1]), 2), key=cost)
        a.update(x[2] for x in pair)
        b.update(x[3] for x in pair)
        want += [(s, x[1]) for x in pair]
    assert partition.balanced_pairs(d, ["s"], "id", "action", "difficulty", "distractors", list("abc"), list("xy")) == want
    with pytest.raises(ValueError):
        partition.balanced_pairs(d.limit(1), ["s"], "id", "action", "difficulty", "distractors", list("abc"), list("xy"))
