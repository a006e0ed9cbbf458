"""Functions and operators against plain Python renderings of their rules, and hand-computed cases."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.functions import answers, masks, similar, tagged
from tessera.operators import arrange, audit, batch, partition, relate


def one(spark, column, **values):
    return spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items())).select(column).first()[0]


@pytest.mark.parametrize(("text", "want"), [("Yes, it is", "Yes"), ("no!", "No"), ("yes and no", "Unknown"), ("the one", "Unknown")])
def test_yes_or_no(spark, text, want):
    assert one(spark, answers.yes_or_no(F.col("t")), t=text) == want


@pytest.mark.parametrize(("target", "told", "want"), [("100", "105", True), ("100", "95", True), ("100", "105.1", False), ("50%", "0.52", True), ("0", "0", True), ("0", "0.0", False), ("A", "a", True), ("n/a", "5", False)])
def test_relaxed_includes_its_boundary(spark, target, told, want):
    assert one(spark, answers.relaxed(F.col("t"), F.col("p")), t=target, p=told) is want


@pytest.mark.parametrize(("text", "want"), [("The answer is C.", "C"), ("A or C", None), ("(D)", "D"), ("Z", "Z"), ("Cannot determine the answer", "Z"), ("nothing", None)])
def test_option_knows_all_letters(spark, text, want):
    assert one(spark, answers.option(F.col("t"), F.array(*(F.lit(x) for x in "ABCD"))), t=text) == want


@pytest.mark.parametrize(("text", "want"), [("Its  a dog.", "its dog"), ("two cats, the isnt", "2 cats isn't"), ("3.5", "3.5"), ("a/b", "b"), ("1,5 [x]", "15 x")])
def test_answer_text(spark, text, want):
    assert one(spark, answers.answer_text(F.col("t")), t=text) == want


def test_agreement(spark):
    a = F.array(*(F.lit(x) for x in ["x", "x", "x", "x", "y", "z"]))
    assert one(spark, answers.agreement(F.lit("x"), a)) == pytest.approx(1.0)
    assert one(spark, answers.agreement(F.lit("y"), a)) == pytest.approx(5 / 18)


@pytest.mark.parametrize(("a", "b", "want"), [("\\frac{1}{2}", "0.5", True), ("3/4", "0.75", True), ("x", " X ", True), ("1/0", "1", False), ("-\\dfrac{3}{2}", "-1.5", True)])
def test_math_equal(spark, a, b, want):
    assert one(spark, answers.math_equal(F.col("a"), F.col("b")), a=a, b=b) is want


M = "<|mt_start|><|mt_{:04d}|><|mt_{:04d}|><|mt_end|>"


def test_mask_rewards(spark):
    s, g = M.format(1, 2) + M.format(3, 4), M.format(1, 9) + M.format(3, 4)
    assert one(spark, tagged.mask_accuracy(F.col("s"), F.col("g")), s=s, g=g) == pytest.approx((0.4 + 1) / 2)
    assert one(spark, tagged.mask_accuracy(F.col("s"), F.col("g")), s="", g="") == 1.0
    assert one(spark, tagged.unrepeated(F.col("s")), s=M.format(1, 2) * 4) == 0.0 and one(spark, tagged.unrepeated(F.col("s")), s=M.format(1, 2) * 3) == 1.0
    assert one(spark, tagged.repaired_masks(F.col("s")), s="<|mt_start|><|mt_0001|>") == M.format(1, 9999)
    graph = '{"subject": {"mask_2d": "%s", "label": "a"}, "predicate": "on", "object": {"mask_2d": "%s", "label": "b"}}'
    x, y = graph % (M.format(1, 2), M.format(3, 4)), graph % (M.format(1, 5), M.format(3, 4))
    assert one(spark, tagged.triplet_accuracy(F.col("s"), F.col("g")), s=x, g=y) == pytest.approx(0.5 + 0.25 * 0.4 + 0.25)
    assert one(spark, tagged.unrepeated_triplets(F.col("s")), s=x * 3) == 0.0


def test_best_ngram():
    assert similar.best_ngram("the red cat sat", "red cat")[:2] == ("red cat", 1.0)
    assert similar.best_ngram("the red dog", "red cat")[4] == pytest.approx(0.5) and similar.best_ngram("x y", "red cat")[1] == 0.0


def test_assignment_is_best():
    r = np.random.default_rng(1)
    for n, k in itertools.product(range(1, 5), range(1, 5)):
        for _ in range(20):
            m = r.random((n, k)).round(1)
            best = max(sum(m[i, j] for i, j in zip(rows, cols, strict=True)) for rows in itertools.combinations(range(n), min(n, k)) for cols in itertools.permutations(range(k), min(n, k)))
            got = masks.assignment(m)
            assert len(got) == min(n, k) and len({i for i, _ in got}) == len({j for _, j in got}) == len(got)
            assert sum(m[p] for p in got) == pytest.approx(best)


def test_matching():
    m = np.array([[0.9, 0.8], [0.85, 0.1]])
    assert masks.greedy(m) == [(0, 0), (1, 1)] and masks.assignment(m) == [(0, 1), (1, 0)]
    assert masks.admissible(m, np.array([[0.1, 0.9], [0.9, 0.9]]), 0.5, 0.5) == []  # the largest isn't admissible: it ends
    assert masks.admissible(m, np.ones((2, 2)), 0.5, 0.5) == [(0, 0)]


def test_boundary():
    m = np.zeros((6, 6), bool)
    m[2:4, 2:4] = True
    assert masks.boundary_f(m, m) == 1.0 and masks.boundary_f(m, np.zeros_like(m)) == 0.0 and masks.boundary_f(np.zeros_like(m), np.zeros_like(m)) == 1.0
    assert masks.boundary(m).sum() == 8 and masks.dilated(m, 1).sum() == 12


def test_run_lengths_round_trip(spark):
    r = random.Random(3)
    rows = [(i, [r.randint(0, 1) for _ in range(12)]) for i in range(20)] + [(20, [0] * 12), (21, [1] * 12)]
    d = spark.createDataFrame(rows, "i long, m array<int>")
    h, w = F.lit(3), F.lit(4)
    back = d.select("m", masks.decoded(masks.encoded(F.col("m"), h, w), h, w).alias("b")).collect()
    assert all(x.m == x.b for x in back)


def test_tiling(spark):
    def want(w, h, size=448, most=6):
        ratios = sorted({(i, j) for i in range(1, most + 1) for j in range(1, most + 1) if i * j <= most}, key=lambda x: (x[0] * x[1], x))
        best, diff = (1, 1), float("inf")
        for i, j in ratios:
            d = abs(w / h - i / j)
            if d < diff or d == diff and w * h > 0.5 * size * size * i * j:
                best, diff = (i, j), d
        return best

    rows = [(w, h) for w in (100, 448, 900, 1800) for h in (100, 300, 448, 1400)]
    got = spark.createDataFrame(rows, "w int, h int").select("w", "h", masks.tiling(F.col("w"), F.col("h")).alias("t")).collect()
    assert all((x.t.columns, x.t.rows) == want(x.w, x.h) for x in got)


def test_differencing():
    """The classic case, and equal parts; sums are those of merging the two widest states each time."""
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in p) for p in partition.differencing([8, 7, 6, 5, 4], 2, False))
    assert sums == [14, 16]
    r = random.Random(5)
    for _ in range(30):
        s = [r.randint(1, 50) for _ in range(12)]
        for equal in (True, False):
            parts = partition.differencing(s, 3, equal)
            assert sorted(i for p in parts for i in p) == list(range(12)) and (not equal or {len(p) for p in parts} == {4})
    with pytest.raises(ValueError):
        partition.differencing([1, 2, 3], 2, True)


def test_least_filled_keeps_the_order():
    s, k = [5, 1, 9, 2, 2, 7], 3
    sums, want = [0] * k, [[] for _ in range(k)]
    for i, x in enumerate(s):
        j = sums.index(min(sums))
        want[j].append(i)
        sums[j] += x
    assert partition.least_filled(s, k, False) == want
    assert {len(p) for p in partition.least_filled(s, k, True)} == {2}


def test_numbered_is_stable(spark):
    d = spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k"), F.when(F.col("id") % 10 == 0, None).otherwise(F.col("id") % 3).alias("g"))
    got = arrange.numbered(d, ["g", "k"], "pos").collect()
    want = sorted(((x.g is not None, x.g or 0, x.k) for x in got))
    assert [(x.g is not None, x.g or 0, x.k) for x in sorted(got, key=lambda x: x.pos)] == want and sorted(x.pos for x in got) == list(range(1000))
    assert arrange.numbered(d.limit(0), ["g", "k"]).count() == 0


def test_strict_operators_fail_on_gaps(spark):
    a, b = spark.range(4).toDF("k"), spark.range(3).selectExpr("id AS k", "id AS v")
    with pytest.raises(Exception, match="unknown key"):
        relate.strict(a, b, "k", ["v"]).collect()
    with pytest.raises(Exception, match="no row for"):
        batch.subset(b, a, "k", "all", 0).collect()
    with pytest.raises(Exception, match="equal chunks"):
        arrange.chunked(a, ["k"], 3).collect()
    two = spark.createDataFrame([(1, 1, 5), (1, 2, 6), (2, 1, 7)], "k long, v int, x int")
    with pytest.raises(Exception, match="missing or repeated"):
        relate.variants(two, "k", "v", "x", [1, 2]).collect()


def test_near_images(spark):
    rows = [(i, "ab"[i % 2], 1.0 + 0.01 * (i % 3), i * 37 % 16, [0.1 * (i % 4)] * 3, [0.1] * 2, [0.2] * 2, 0.3) for i in range(30)]
    names = "sample_id long, split string, aspect double, dhash long, histogram array<double>, edge array<double>, mask array<double>, foreground double"
    got = {(x.a, x.b) for x in relate.near_images(spark.createDataFrame(rows, names), bits=1, histogram=0.11).collect()}
    want = {(x[0], y[0]) for x, y in itertools.combinations(rows, 2) if x[1] != y[1] and round(x[2] * 20) == round(y[2] * 20) and abs(x[2] - y[2]) <= 0.02 and (x[3] ^ y[3]).bit_count() <= 1 and sum(abs(p - q) for p, q in zip(x[4], y[4], strict=True)) / 3 <= 0.11}
    assert got == want and got


def test_violations(spark):
    rules = audit.record_rules(["n"], {"k": ["a"]}, {"n": "^x"}, ["v"], ["p"])
    d = spark.createDataFrame([("x1", "a", 1, "i/j"), (" ", "b", -1, "../j"), (None, None, None, "/j")], "n string, k string, v int, p string")
    got = [x[0] for x in d.select(audit.violations(rules)).collect()]
    assert got[0] == [] and got[1] == ["n: missing", "k: unknown value", "n: malformed", "v: negative", "p: unsafe path"] and len(got[2]) == 5


def test_agreement_is_worked_out_once(spark):
    """Texts are processed once each, not once a pair of answers; the mean is that of the rule."""
    rows = [(k, "a", ["a"] * k + ["b"] * (10 - k)) for k in range(11)] + [(11, "a", ["a", None, "b"]), (12, "c", ["a"]), (13, "a", None)]
    d = spark.createDataFrame(rows, "id int, p string, a array<string>")
    out = d.select("id", answers.agreement(F.upper("p"), F.transform("a", F.upper)).alias("s"))
    assert out._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 2
    for r in out.collect():
        p, a = rows[r.id][1:]
        want = a and sum(min(1.0, sum(y == p for n, y in enumerate(a) if n != m) / 3) for m in range(len(a))) / len(a)
        assert r.s == want or abs(r.s - want) < 1e-12


def test_answer_texts(spark):
    a = ["The  Cat, one", None, "the cat one", "The  Cat, one", ""]
    d = spark.createDataFrame([(a,), (None,), ([],)], "a array<string>")
    assert [r.s for r in d.select(answers.answer_texts(F.col("a")).alias("s")).collect()] == [r.s for r in d.select(F.transform("a", answers.answer_text).alias("s")).collect()]


def test_schema_parses_a_record_once(spark):
    types = {f"f{k}": ("string", "integer", "number")[k % 3] for k in range(12)}
    d = spark.createDataFrame([("{}",)], "j string").select(audit.schema_violations(F.upper("j"), types, list(types), {"a": types}))
    assert d._jdf.queryExecution().optimizedPlan().toString().count("upper(") == 1
    plain = spark.createDataFrame([('{"f0": 1, "f1": 2.5, "f2": 7, "x": 1}',), ("[1]",), (None,)], "j string")
    got = [r.v for r in plain.select(audit.schema_violations(F.col("j"), types, ["f0", "f3"], {}).alias("v")).collect()]
    assert got == [["f3: missing", "x: unknown", "f0: not string", "f1: not integer"], ["not an object"], ["not an object"]]
