"""Average precision and caption scores against plain Python, by the published rules."""

import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import captions, detect

RANGES = {"all": (0.0, 1e10), "small": (0.0, 30.0), "medium": (30.0, 34.0), "large": (34.0, 1e10)}
MOST = (1, 3, 6)


def scene(seed):
    r = random.Random(seed)
    truth, found = [], []
    for image in range(12):
        for k in range(r.randint(0, 5)):
            m = [int(r.random() < r.choice([0.4, 0.5, 0.6])) for _ in range(64)]
            truth.append((image, k % 2, k, m, r.random() < 0.2))
            for n in range(r.randint(0, 2)):
                found.append((image, k % 2, 10 * k + n, r.randint(0, 6) / 6, [x ^ (r.random() < 0.08 * n) for x in m]))
        for k in range(r.randint(0, 4)):
            found.append((image, k % 2, 100 + k, r.randint(0, 6) / 6, [int(r.random() < 0.5) for _ in range(64)]))
    return truth, [(a, b, c, d, [int(x) for x in e]) for a, b, c, d, e in found]


def by_the_rule(truth, found, category, span, threshold):
    """(ap, recalls) of one class, range and threshold, a detection after another."""
    lo, hi = RANGES[span]
    rows, n_truth = [], 0
    for image in sorted({x[0] for x in truth} | {x[0] for x in found}):
        g = [(m, crowd, crowd or not lo <= sum(m) <= hi) for i, c, _, m, crowd in sorted(truth, key=lambda x: x[2]) if (i, c) == (image, category)]
        g.sort(key=lambda x: x[2])
        n_truth += sum(not x[2] for x in g)
        d = sorted(((-s, det, m) for i, c, det, s, m in found if (i, c) == (image, category)), key=lambda x: x[:2])[: MOST[-1]]
        taken = set()
        for rank, (s, _, m) in enumerate(d):
            best, pick = min(threshold, 1 - 1e-10), None
            for j, (gm, crowd, ignored) in enumerate(g):
                if j in taken and not crowd:
                    continue
                if pick is not None and not g[pick][2] and ignored:
                    break
                inter = sum(x & y for x, y in zip(m, gm))
                over = sum(m) if crowd else sum(m) + sum(gm) - inter
                iou = inter / over if over else 0.0
                if iou >= best:
                    best, pick = iou, j
            ignored = g[pick][2] if pick is not None else not lo <= sum(m) <= hi
            if pick is not None:
                taken.add(pick)
            rows.append((s, image, rank, pick is not None, ignored))
    if not n_truth:
        return None
    rows.sort(key=lambda x: x[0])
    counts = [(x[3], x[2]) for x in rows if not x[4]]
    tp = np.cumsum([x[0] for x in counts])
    precision = list(tp / (np.arange(len(tp)) + 1 + np.spacing(1)))
    for i in range(len(precision) - 1, 0, -1):
        precision[i - 1] = max(precision[i - 1], precision[i])
    at = np.searchsorted(tp / n_truth, np.linspace(0, 1, 101), side="left")
    return np.mean([precision[i] if i < len(precision) else 0.0 for i in at]), [sum(a and b < m for a, b in counts) / n_truth for m in MOST]


@pytest.mark.parametrize("seed", [1, 2])
def test_average_precision(spark, seed):
    truth, found = scene(seed)
    t = spark.createDataFrame(truth, "image int, category int, gt int, mask array<int>, crowd boolean")
    f = spark.createDataFrame(found, "image int, category int, det int, score double, mask array<int>")
    ap = detect.average_precision(f, t, ranges=RANGES, most=MOST)
    got = {(r.category, r.area, round(r.threshold, 2)): (r.ap, [r.recall_1, r.recall_3, r.recall_6]) for r in ap.collect()}
    want = {(c, a, round(t, 2)): by_the_rule(truth, found, c, a, t) for c in (0, 1) for a in RANGES for t in detect.THRESHOLDS}
    want = {k: v for k, v in want.items() if v}
    assert set(got) == set(want)
    for k, (a, r) in want.items():
        assert got[k][0] == pytest.approx(a) and got[k][1] == pytest.approx(r), k
    s = {r.metric: r.value for r in detect.summary(ap, RANGES, MOST).collect()}
    assert s["AP"] == pytest.approx(np.mean([v[0] for k, v in want.items() if k[1] == "all"])) and s["AP50"] == pytest.approx(np.mean([v[0] for k, v in want.items() if k[1:] == ("all", 0.5)]))
    assert s["AR_large"] == pytest.approx(np.mean([v[1][2] for k, v in want.items() if k[1] == "large"])) and len(s) == 12


def test_average_precision_of_nothing(spark):
    t = spark.createDataFrame([], "image int, category int, gt int, mask array<int>, crowd boolean")
    f = spark.createDataFrame([], "image int, category int, det int, score double, mask array<int>")
    assert {r.value for r in detect.summary(detect.average_precision(f, t)).collect()} == {-1.0}


def test_cells_are_those_of_the_sorted_search(spark):
    recalls = [a / b for b in range(1, 60) for a in range(b + 1)]
    got = spark.createDataFrame([(x,) for x in recalls], "r double").select(detect._cell(F.col("r")).alias("c")).collect()
    cells = np.arange(101) * 0.01
    assert [x.c for x in got] == [int(np.searchsorted(cells, r, side="right")) - 1 for r in recalls]


CAPTIONS = [
    (1, "a red bolt on a table", ["a red bolt on the table", "the red bolt"]),
    (2, "a a a a", ["a b a", "c"]),
    (3, "", ["a red bolt"]),
    (4, "the small ring of steel", ["the small ring of steel"]),
    (5, "x", ["y z", "a red bolt on the wall of a house"]),
]


def grams(words, n):
    return Counter(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def test_caption_scores(spark):
    split = [(i, h.split(), [r.split() for r in refs]) for i, h, refs in CAPTIONS]
    df = spark.createDataFrame(split, "id int, hypothesis array<string>, references array<array<string>>")
    test, ref = sum(len(h) for _, h, _ in split), sum(min((abs(len(r) - len(h)), len(r)) for r in refs)[1] for _, h, refs in split)
    product, want = 1.0, []
    for n in range(1, 5):
        right = sum(min(c, max(grams(r, n)[g] for r in refs)) for _, h, refs in split for g, c in grams(h, n).items())
        product *= (right + 1e-15) / (sum(max(0, len(h) - n + 1) for _, h, _ in split) + 1e-9)
        ratio = (test + 1e-15) / (ref + 1e-9)
        want.append(product ** (1 / n) * (math.exp(1 - 1 / ratio) if ratio < 1 else 1))
    assert [r.bleu for r in captions.bleu(df).orderBy("n").collect()] == pytest.approx(want)

    def lcs(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        return t[-1][-1]

    rouge = {}
    for i, h, refs in split:
        p, r = max(lcs(h, x) / len(h) if h else 0 for x in refs), max(lcs(h, x) / len(x) for x in refs)
        rouge[i] = (1 + 1.2**2) * p * r / (r + 1.2**2 * p) if p and r else 0.0
    assert {r.id: r.rouge_l for r in captions.rouge_l(df).collect()} == pytest.approx(rouge)

    frequency = Counter(g for _, _, refs in split for g in {x for r in refs for n in range(1, 5) for x in grams(r, n)})
    weigh = lambda words, n: {g: c * (math.log(len(split)) - math.log(max(1, frequency[g]))) for g, c in grams(words, n).items()}
    norm = lambda v: math.sqrt(sum(x * x for x in v.values()))
    cider = {}
    for i, h, refs in split:
        total = 0
        for r in refs:
            gap = max(0, len(h) - 1) - max(0, len(r) - 1)
            for n in range(1, 5):
                a, b = weigh(h, n), weigh(r, n)
                dot = sum(min(a[g], b[g]) * b[g] for g in a if g in b)
                total += (dot / (norm(a) * norm(b)) if norm(a) and norm(b) else dot) * math.exp(-(gap**2) / 72) / 4
        cider[i] = total / len(refs) * 10
    assert {r.id: r.cider for r in captions.cider(df).collect()} == pytest.approx(cider)


def test_captions_are_counted_in_their_rows(spark, monkeypatch):
    """No shuffle of n-grams to count them; rare and frequent n-grams, looked up apart, give one score."""
    d = spark.createDataFrame([(1, ["a", "a", "b"], [["a", "b"], ["a", "a", "a"]]), (2, [], [["b", "c"]]), (3, ["c"], [[]]), (4, ["b", "c"], [["b", "c"]])], "id int, hypothesis array<string>, references array<array<string>>")
    g = captions.counted(d)
    assert "Exchange" not in g._jdf.queryExecution().executedPlan().toString()
    assert sorted((r.gram, r.h, r.r) for r in g.filter("id = 1 and n = 1").collect()) == [(["a"], 2, [1, 3]), (["b"], 1, [1, 0])]
    scores = []
    for often in (0.5, 2, 1000):
        monkeypatch.setattr(captions, "OFTEN", often)
        scores.append({r.id: round(r.cider, 9) for r in captions.cider(d).collect()})
    assert scores[0] == scores[1] == scores[2] and set(scores[0]) == {1, 2, 3, 4} and scores[0][2] == scores[0][3] == 0 < scores[0][4]
