"""Near joins against all pairs: nothing lost at any threshold, and far fewer candidates than a bucket's square."""

import random

import pytest

from tessera.operators import relate


@pytest.mark.parametrize("most", [0.01, 0.05, 0.2])
def test_thumbnails_equal_all_pairs(spark, most):
    """Means are concentrated: every thumbnail is a shuffle of one set of pixels, so the mean tells nothing apart."""
    r = random.Random(2)
    base = [255.0 * i / 31 for i in range(32)]
    rows = []
    for i in range(160):
        p = base[:]
        r.shuffle(p)
        rows.append((i, "ab"[i % 2], p))
        rows.append((1000 + i, "ab"[(i + 1) % 2], [min(255.0, x + r.choice([0, 2, 12])) for x in p]))
    d = spark.createDataFrame(rows, "id int, split string, px array<double>")
    gap = lambda x, y: sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 32 / 255
    want = {(a, b) for a, s, p in rows for b, u, q in rows if a < b and s != u and gap(p, q) <= most}
    got = relate.near_thumbnails(d, "id", "split", "px", most).collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want)
    counts = [relate.thumbnail_candidates(d, "id", "split", "px", most, n).count() for n in (1, 4)]
    assert counts[0] > 10_000 and (most > 0.01 or counts[1] * 10 < counts[0])


@pytest.mark.parametrize("bits", [0, 1, 4, 9])
def test_images_equal_all_pairs(spark, bits):
    r = random.Random(bits)
    rows = []
    for i in range(120):
        code, h, e, m, f = r.getrandbits(64), [r.random() for _ in range(3)], [r.random() for _ in range(4)], [r.random() for _ in range(4)], r.random()
        for k in range(3):
            turned = code
            for _ in range(r.choice([0, 0, bits, bits + 1]) if k else 0):
                turned ^= 1 << r.randrange(64)
            signed = turned - (1 << 64) if turned >> 63 else turned
            step = r.choice([0.0, 0.0, 0.004]) * (k > 0)
            rows.append((10 * i + k, "ab"[k % 2], 1.0 + i % 3 / 5 + r.choice([0, 0.004, 0.03]), signed, [x + step for x in h], [x + step for x in e], [x + step * 4 for x in m], f + step / 3))
    rows.append((5000, "a", 1.0, 0, [0.0] * 3, [0.0] * 4, [0.0] * 4, 0.0))
    d = spark.createDataFrame(rows, "sample_id int, split string, aspect double, dhash long, histogram array<double>, edge array<double>, mask array<double>, foreground double")
    gap = lambda x, y: sum(abs(a - b) for a, b in zip(x, y, strict=True))
    want = set()
    for x in rows:
        for y in rows:
            if x[0] < y[0] and x[1] != y[1] and round(x[2] * 20) == round(y[2] * 20) and abs(x[2] - y[2]) <= 0.02 and ((x[3] ^ y[3]) & (2**64 - 1)).bit_count() <= bits:
                if gap(x[4], y[4]) / 3 <= 0.08 and gap(x[5], y[5]) / 4 <= 0.025 and gap(x[6], y[6]) / 4 <= 0.01 and abs(x[7] - y[7]) <= 0.002:
                    want.add((x[0], y[0]))
    got = relate.near_images(d, bits=bits).collect()
    assert {(x.a, x.b) for x in got} == want and len(got) == len(want) and want
    assert relate.image_candidates(d, bits=bits).count() < 20 * len(rows)


@pytest.mark.parametrize("block", [7, 1024])
def test_thumbnails_in_blocks(spark, block):
    """Rows of one cell are cut into blocks, each pair of which is one group; keys may be texts, sizes may differ."""
    r = random.Random(5)
    rows = [(f"k{i:03d}", r.choice(["a", "b", "c", None]), [float(r.randint(0, 9)) for _ in range(r.choice([4, 5]))]) for i in range(120)]
    rows += [("none", "a", None), ("gap", "a", [1.0, None, 2.0, 3.0]), (None, "b", [1.0] * 4)]
    d = spark.createDataFrame(rows, "id string, split string, px array<double>")
    full = [x for x in rows if x[0] and x[1] and x[2] and None not in x[2]]
    gap = lambda x, y: sum(abs(a - b) for a, b in zip(x, y, strict=True)) / len(x) / 255
    want = {(a, b): round(gap(p, q), 8) for a, s, p in full for b, u, q in full if a < b and s != u and len(p) == len(q) and gap(p, q) <= 0.008}
    pairs = relate.near_thumbnails(d, "id", "split", "px", 0.008, block=block)
    got = pairs.collect()
    assert len(got) == len(want) > 200 and {(x.a, x.b): x.distance for x in got} == pytest.approx(want)
    nearest = sorted((v, *k) for k, v in want.items())[:9]
    told = relate.reported(pairs, 9).collect()
    assert [(x.a, x.b) for x in told] == [x[1:] for x in nearest] and {(x.n_pairs, x.truncated) for x in told} == {(len(want), True)}
    assert relate.reported(pairs.filter("distance < 0"), 9).count() == 0
