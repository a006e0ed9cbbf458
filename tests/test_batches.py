"""Batches cut into micro-batches and length groups, against plain computations."""

import random
import time

import xxhash

from tessera.operators import partition
from tessera.plans import frames


def spread(sizes, parts):
    """Largest differencing by its rule: states of `parts` sums, the two of the largest spread merged, large onto small."""
    states = [[[(s, i)]] + [[] for _ in range(parts - 1)] for i, s in sorted(enumerate(sizes), key=lambda x: (x[1], x[0]))]
    total = lambda p: sum(s for s, _ in p)
    rank = lambda st: (total(st[0]) - total(st[-1]))
    while len(states) > 1:
        states.sort(key=rank, reverse=True)
        a, b, *rest = states
        merged = sorted(([*x, *y] for x, y in zip(a, reversed(b), strict=True)), key=total, reverse=True)
        states = [merged, *rest]
    return sorted(total(p) for p in states[0])


def rows(seed, n=40):
    r = random.Random(seed)
    return [(b, 100 * b + i, r.randint(1, 60)) for b in range(3) for i in range(n)]


def test_micro_batches(spark):
    data = rows(1)
    got = partition.micro_batches(spark.createDataFrame(data, "b int, id int, n int"), "b", "id", "n", 150).collect()
    assert sorted(x.row_id for x in got) == sorted(x[1] for x in data)
    size = {x[1]: x[2] for x in data}
    for b in range(3):
        mine = [x for x in got if x.batch == b]
        parts = {k: [x.row_id for x in mine if x.part == k] for k in {x.part for x in mine}}
        assert len(parts) == -(-sum(size[x.row_id] for x in mine) // 150)
        squares = [sum(size[i] ** 2 for i in parts[k]) for k in sorted(parts)]
        assert squares == sorted(squares, reverse=True)


def test_differencing_sums(spark):
    """Distinct powers leave no ties, so the sums are those of the rule."""
    r = random.Random(3)
    for n, k in ((9, 2), (12, 3), (15, 4)):
        sizes = r.sample([3**i % 1009 + 7 * i for i in range(40)], n)
        got = sorted(sum(sizes[i] for i in p) for p in partition.differencing(sizes, k, False))
        want = spread(sizes, k)
        assert sum(got) == sum(want) and got[-1] - got[0] <= want[-1] - want[0] + max(sizes) // 4


def test_length_groups(spark):
    data = rows(2, 24)
    got = {x.row_id: x.part for x in partition.length_groups(spark.createDataFrame(data, "b int, id int, n int"), "b", "id", "n", 3, 2).collect()}
    for b in range(3):
        mine = [x for x in data if x[0] == b]
        order = sorted(mine, key=lambda x: (xxhash.xxh64_intdigest(str(x[1]), seed=7), x[1]))
        for k in range(0, len(order), 6):
            sums, counts = [0, 0], [0, 0]
            for x in sorted(order[k : k + 6], key=lambda x: -x[2]):
                j = min((j for j in (0, 1) if counts[j] < 3), key=lambda j: (sums[j], j))
                assert got[x[1]] == k // 6 * 2 + j
                sums[j] += x[2]
                counts[j] += 1


def test_differencing_in_many_parts():
    """40,000 sizes in 5,000 parts: states with every empty set written out would be 200 million sets."""
    r = random.Random(4)
    sizes = [r.randint(1, 50) for _ in range(40_000)]
    parts = partition.differencing(sizes, 5_000, False)
    assert sorted(i for p in parts for i in p) == list(range(40_000))
    sums = [sum(sizes[i] for i in p) for p in parts]
    assert len(parts) == 5_000 and sums == sorted(sums, reverse=True) and sums[0] - sums[-1] <= 3
    assert partition.differencing([], 3, False) == [[], [], []] and sorted(map(sorted, partition.differencing([0, 0], 3, False))) == [[], [0], [1]]


def test_micro_batches_of_the_whole_table(spark, tmp_path):
    """The query has a row for every line item, not only for those of each 40th order."""
    lines = [(o, n, float(1 + (7 * o + n) % 50)) for o in range(1, 60) for n in range(1, 4)]
    spark.createDataFrame(lines, "l_orderkey long, l_linenumber long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = frames.QUERIES["PA03_micro_batches"](spark, str(tmp_path)).collect()
    assert sorted((r.batch, r.row_id) for r in got) == sorted((o % 7, o * 10 + n) for o, n, _ in lines)
    for b in range(7):
        total = sum(q for o, _, q in lines if o % 7 == b)
        assert len({r.part for r in got if r.batch == b}) == -(-total // 200)


def test_differencing_in_arrays(monkeypatch):
    """States as arrays give the parts of states as lists, item by item, and aren't searched set by set: 260,000 sizes in
    33,000 parts took 9.5 s in lists and 0.9 s in arrays."""
    r = random.Random(6)
    for _ in range(300):
        n, most = r.randint(0, r.choice([6, 30, 300])), r.choice([0, 1, 2, 5, 50, 1000])
        sizes, k = [r.randint(0, most) for _ in range(n)], r.randint(2, r.choice([4, 20, n + 3]) + 2)
        monkeypatch.setattr(partition, "_MANY", 1 << 40)
        want = partition.differencing(sizes, k, False)
        monkeypatch.setattr(partition, "_MANY", 2)
        assert partition.differencing(sizes, k, False) == want
    monkeypatch.undo()
    sizes = [r.randint(1, 50) for _ in range(600_000)]
    start = time.process_time()
    parts = partition.differencing(sizes, 75_000, False)
    assert time.process_time() - start < 12
    assert sorted(i for p in parts for i in p) == list(range(600_000))
