"""Average precision of scored masks (or of any overlaps) over thresholds, size ranges and detections per image.

Matching is done per image and class, detections by falling score. Precision and recall run over a global score order: the
running counts come from ranges of it, and interpolated precision at a recall is the largest precision of all places with
that recall or more, so the envelope is a maximum per recall cell and a step over 101 cells, not a pass over the rows.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import masks
from .ordered import running

#: Overlap thresholds, size ranges in pixels (ends included), detections per image, recall cells.
THRESHOLDS = tuple(float(x) for x in np.linspace(0.5, 0.95, 10))
RANGES = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
MOST = (1, 10, 100)
CELLS = 101
FALSE, TRUE, IGNORED = 0, 1, 2


def match(overlap: np.ndarray, sizes: np.ndarray, ignored: np.ndarray, crowd: np.ndarray, thresholds: np.ndarray, ranges: np.ndarray) -> np.ndarray:
    """[detection][range][threshold]: FALSE, TRUE or IGNORED, of detections by falling score.

    overlap: detections x truths; sizes: of detections; ignored: ranges x truths; crowd: truths that may be matched again.
    A detection takes the largest overlap that reaches the threshold among truths that are free, the last of equals, and an
    ignored truth only where no other will do. One that takes an ignored truth, or none while its size is out of range,
    doesn't count."""
    n, k = overlap.shape
    out = np.empty((n, len(ranges), len(thresholds)), np.int8)
    taken = np.zeros((len(ranges), len(thresholds), k), bool)
    least = np.minimum(thresholds, 1 - 1e-10)[None, :, None]
    outside = (sizes[:, None] < ranges[:, 0]) | (sizes[:, None] > ranges[:, 1])
    last = lambda x: k - 1 - x[..., ::-1].argmax(-1)
    for d in range(n):
        if not k:
            out[d] = np.where(outside[d], IGNORED, FALSE)[:, None]
            continue
        free = (~taken | crowd) & (overlap[d] >= least)
        counted = np.where(free & ~ignored[:, None, :], overlap[d], -1.0)
        spare = np.where(free & ignored[:, None, :], overlap[d], -1.0)
        some, other = counted.max(-1) >= 0, spare.max(-1) >= 0
        out[d] = np.where(some, TRUE, np.where(other | outside[d][:, None], IGNORED, FALSE))
        r, t = np.nonzero(some | other)
        taken[r, t, np.where(some, last(counted), last(spare))[r, t]] = True
    return out


def matches(found: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS, ranges: Mapping[str, tuple[float, float]] = RANGES, most: int = MOST[-1]) -> DataFrame:
    """(category, image, rank, score, codes): detections (image, category, det, score, mask), `most` an image and class by
    falling score (ties by det), with codes of match(), range by range and threshold by threshold. truth: (image, category,
    gt, mask, crowd). The overlap with a crowd is the share of the detection that lies in it."""
    w = Window.partitionBy("image", "category").orderBy(F.col("score").desc(), "det")
    top = found.withColumn("rank", F.row_number().over(w) - 1).filter(F.col("rank") < most)
    key = ["image", "category"]
    d = top.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("rank", "score", "mask"))).alias("d"))
    g = truth.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("gt", "mask", F.coalesce("crowd", F.lit(False)).alias("crowd")))).alias("g"))
    levels, spans = np.array(thresholds), np.array(list(ranges.values()))

    @F.pandas_udf("array<array<int>>")
    def codes(dm: pd.Series, gm: pd.Series, gc: pd.Series) -> pd.Series:
        def one(a, b, crowd):
            crowd = np.array([] if crowd is None else list(crowd), bool)
            x = np.array([np.asarray(m) for m in a], float)
            y = np.array([np.asarray(m) for m in b], float) if len(crowd) else np.zeros((0, x.shape[1]))
            inter, dx, dy = x @ y.T, x.sum(1), y.sum(1)
            over = np.where(crowd, dx[:, None], dx[:, None] + dy - inter)
            overlap = np.divide(inter, over, out=np.zeros_like(inter), where=over > 0)
            ignored = crowd | (dy < spans[:, :1]) | (dy > spans[:, 1:])
            return match(overlap, dx, ignored, crowd, levels, spans).reshape(len(x), -1).tolist()

        return pd.Series([one(a, b, c) for a, b, c in zip(dm, gm, gc, strict=True)])

    part = lambda c, f: F.transform(c, lambda s: s[f])
    j = d.join(g, key, "left").withColumn("codes", codes(part("d", "mask"), part("g", "mask"), part("g", "crowd")))
    return j.select(*key, F.explode(F.arrays_zip(part("d", "rank").alias("rank"), part("d", "score").alias("score"), "codes")).alias("z")).select("category", "image", "z.rank", "z.score", "z.codes")


def wanted(truth: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES) -> DataFrame:
    """(category, area, truths): truths of each class and size range that count; a crowd never does."""
    size = masks.area(F.col("mask"))
    spans = F.array(*(F.struct(F.lit(n).alias("area"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, (a, b) in ranges.items()))
    each = truth.select("category", size.alias("size"), F.coalesce("crowd", F.lit(False)).alias("crowd"), F.explode(spans).alias("s"))
    return each.groupBy("category", F.col("s.area").alias("area")).agg(F.count(F.when(~F.col("crowd") & F.col("size").between(F.col("s.a"), F.col("s.b")), 1)).alias("truths"))


def _cell(recall: Column) -> Column:
    """The last recall cell that a recall reaches; cells are at multiples of 0.01 as doubles."""
    near = F.least(F.floor(recall * (CELLS - 1)) + 1, F.lit(CELLS - 1))
    at = lambda k: (near - k) * 0.01 <= recall
    return F.when(at(0), near).when(at(1), near - 1).otherwise(near - 2).cast("int")


def average_precision(found: DataFrame, truth: DataFrame, thresholds: Sequence[float] = THRESHOLDS, ranges: Mapping[str, tuple[float, float]] = RANGES, most: Sequence[int] = MOST) -> DataFrame:
    """(category, area, threshold, truths, ap, recall_N...) for every class, range and threshold with truths that count: mean
    of the interpolated precision at 101 recalls, and the recall with N detections an image."""
    names, n = list(ranges), len(thresholds)
    rows = matches(found, truth, thresholds, ranges, most[-1]).select("category", "image", "rank", "score", F.posexplode("codes").alias("k", "code")).filter(F.col("code") != IGNORED)
    rows = rows.withColumns({"area": F.element_at(F.array(*map(F.lit, names)), F.floor(F.col("k") / n).cast("int") + 1), "threshold": F.col("k") % n, "_down": -F.col("score"), "_one": F.lit(1)})
    key = ["category", "area", "threshold"]
    run = running(rows, key, ["_down", "image", "rank"], {"_tp": "code", "_n": "_one"})
    counts = wanted(truth, ranges).filter("truths > 0")
    run = run.join(counts, ["category", "area"]).withColumn("_cell", _cell(F.col("_tp") / F.col("truths")))
    hit = F.col("code") == TRUE
    cells = run.groupBy(*key, "_cell").agg(F.max(F.col("_tp") / (F.col("_n") + F.lit(float(np.spacing(1))))).alias("p"), *(F.count(F.when(hit & (F.col("rank") < m), 1)).alias(f"_hit_{m}") for m in most))
    curve = cells.groupBy(*key).agg(F.collect_list(F.struct("_cell", "p")).alias("c"), *(F.sum(f"_hit_{m}").alias(f"_hit_{m}") for m in most))
    reach = lambda r: F.coalesce(F.array_max(F.transform(F.filter("c", lambda s: s["_cell"] >= r), lambda s: s["p"])), F.lit(0.0))
    ap = F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(CELLS - 1)), reach), F.lit(0.0), lambda a, b: a + b) / CELLS
    every = counts.withColumn("threshold", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    j = every.join(curve.select(*key, ap.alias("ap"), *(f"_hit_{m}" for m in most)), key, "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return j.select("category", "area", F.element_at(F.array(*map(F.lit, thresholds)), F.col("threshold") + 1).alias("threshold"), "truths", F.coalesce("ap", F.lit(0.0)).alias("ap"), *((zero(F.col(f"_hit_{m}")) / F.col("truths")).alias(f"recall_{m}") for m in most))


def summary(ap: DataFrame, ranges: Mapping[str, tuple[float, float]] = RANGES, most: Sequence[int] = MOST) -> DataFrame:
    """(metric, value) of average_precision(): AP over all thresholds, at 0.5 and 0.75, by range, and AR by detections an image
    and by range; -1 where no truth counts."""
    first, *rest = ranges
    all_of = F.col("area") == first
    near = lambda x: F.abs(F.col("threshold") - x) < 1e-6
    last = f"recall_{most[-1]}"
    lines = {"AP": (all_of, "ap"), "AP50": (all_of & near(0.5), "ap"), "AP75": (all_of & near(0.75), "ap"), **{f"AP_{r}": (F.col("area") == r, "ap") for r in rest}}
    lines |= {f"AR_{m}": (all_of, f"recall_{m}") for m in most} | {f"AR_{r}": (F.col("area") == r, last) for r in rest}
    wide = ap.agg(*(F.coalesce(F.avg(F.when(c, F.col(v))), F.lit(-1.0)).alias(k) for k, (c, v) in lines.items()))
    return wide.select(F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), F.col(k).alias("value")) for k in lines))).alias("s")).select("s.*")
