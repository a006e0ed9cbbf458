"""Accuracy reports, metric summaries and cross-tables over columns that the caller names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import ordered


def share(hit: str | Column) -> Column:
    """Sum of hits over rows, as a double."""
    hit = F.col(hit) if isinstance(hit, str) else hit
    return F.sum(hit.cast("double")) / F.count("*")


def by_sets(df: DataFrame, sets: Sequence[Sequence[str]], *aggregates: Column) -> DataFrame:
    """The aggregates of several groupings in one pass; a column that a grouping lacks is null there."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets([[F.col(c) for c in s] for s in sets], *(F.col(c) for c in cols)).agg(*aggregates)


def accuracy(df: DataFrame, hit: str, sets: Sequence[Sequence[str]]) -> DataFrame:
    return by_sets(df, sets, F.count("*").alias("n"), F.sum(hit).cast("long").alias("hits"), share(hit).alias("acc"))


def wide_accuracy(df: DataFrame, hit: str, split: str, columns: Sequence[str]) -> DataFrame:
    """A row per split, Overall and a column per value of the columns. Values become columns, so they must be few: the
    caller's categories."""
    d = df.select(split, hit, F.explode(F.array(F.lit("Overall"), *(F.col(c).cast("string") for c in columns))).alias("_v"))
    return d.groupBy(split).pivot("_v").agg(share(hit))


def mean_of_means(df: DataFrame, by: Sequence[str], category: str, hit: str, whole: str | None = None, every: str = "ALL") -> DataFrame:
    """Unweighted mean of the categories' accuracies; whole: a column of by that also has a row over all its values."""
    sets = [[*by, category], *([[c for c in by if c != whole] + [category]] if whole else [])]
    c = by_sets(df, sets, share(hit).alias("acc"))
    keys = [F.coalesce(F.col(k), F.lit(every)).alias(k) if k == whole else F.col(k) for k in by]
    return c.select(*keys, "acc").groupBy(*by).agg(F.avg("acc").alias("acc"), F.count("*").alias("n_categories"))


def paired(df: DataFrame, category: str, image: str, hit: str) -> DataFrame:
    """acc: share of hits, acc_plus: share of images whose rows all hit, both times 100."""
    p = df.groupBy(category, image).agg(F.sum(F.col(hit).cast("long")).alias("r"), F.count("*").alias("n"), F.min(F.col(hit).cast("int")).alias("every"))
    return p.groupBy(category).agg((F.sum("r") * 100.0 / F.sum("n")).alias("acc"), (F.avg("every") * 100.0).alias("acc_plus"))


def all_right(df: DataFrame, keys: Sequence[str], by: str, hit: str) -> DataFrame:
    """a_acc: share of hits; f_acc: share of key groups with hits only; over all and by a column of keys."""
    g = df.groupBy(*keys).agg(F.sum(F.col(hit).cast("long")).alias("h"), F.count("*").alias("n"), F.min(F.col(hit).cast("int")).alias("ok"))
    return by_sets(g, [[], [by]], (F.sum("h") / F.sum("n")).alias("a_acc"), (F.sum("ok") / F.count("*")).alias("f_acc"))


def precision_recall(df: DataFrame, labels: Column, truth: str, predicted: str) -> DataFrame:
    """prec, rec, f1 of 0/1 columns per label (an array: rows count for each), and over all such rows; 0 where undefined."""
    e = df.select(F.explode(labels).alias("cat"), F.col(truth).cast("long").alias("t"), F.col(predicted).cast("long").alias("p"))
    s = by_sets(e, [[], ["cat"]], F.sum(F.col("t") * F.col("p")).alias("tp"), F.sum("p").alias("pp"), F.sum("t").alias("gp"))
    r = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    return s.select("cat", r(F.col("tp"), F.col("pp")).alias("prec"), r(F.col("tp"), F.col("gp")).alias("rec"), r(2 * F.col("tp"), F.col("pp") + F.col("gp")).alias("f1"))


def by_labels(df: DataFrame, labels: Column, hit: str) -> DataFrame:
    """tot, hit, rate per label (an array per row) and Overall."""
    e = df.select(F.explode(F.concat(F.array(F.lit("Overall")), labels)).alias("label"), hit)
    return e.groupBy("label").agg(F.count("*").alias("tot"), F.sum(hit).cast("long").alias("hit"), share(hit).alias("rate"))


def cycles(df: DataFrame, cycle: str, category: str, hit: str) -> DataFrame:
    """Mean accuracy per category over all cycles; a cycle without the category counts as 0."""
    c = df.groupBy(cycle, category).agg(share(hit).alias("acc"))
    return c.groupBy(category).agg(F.sum("acc").alias("_t")).crossJoin(F.broadcast(df.agg(F.countDistinct(cycle).alias("_k")))).select(category, (F.col("_t") / F.col("_k")).alias("average"))


def ratio_of_means(df: DataFrame, by: str, score: Column, reference: Column) -> DataFrame:
    return by_sets(df, [[], [by]], (F.avg(score) / F.avg(reference) * 100).alias("ratio"))


def clipped(df: DataFrame, by: str, value: Column, low: float, high: float, valid: Column) -> DataFrame:
    """Sum clipped to [low, high], rows, and valid rows."""
    return df.groupBy(by).agg(F.sum(F.least(F.greatest(value, F.lit(low)), F.lit(high))).alias("total"), F.count("*").alias("n_all"), F.count(F.when(valid, 1)).alias("n_valid"))


def summary(df: DataFrame, by: Sequence[str], iou: str, inter: str, total: str, pred: str, truth: str) -> DataFrame:
    """n, mean and median overlap (null unless every row has one), micro IoU and Dice of the pixel sums (null for none)."""
    full = F.count(iou) == F.count("*")
    sums = df.groupBy(*by).agg(
        F.count("*").alias("n"), full.alias("_full"), F.when(full, F.avg(iou)).alias("mean_iou"),
        F.try_divide(F.sum(inter).cast("double"), F.sum(total)).alias("micro_iou"), F.try_divide(2.0 * F.sum(inter), F.sum(pred) + F.sum(truth)).alias("micro_dice"),
    )
    d = with_quantiles(sums, df, by, iou, {"median_iou": 0.5})
    return d.select(*by, "n", "mean_iou", F.when(F.col("_full"), F.col("median_iou")).alias("median_iou"), "micro_iou", "micro_dice")


def with_quantiles(groups: DataFrame, df: DataFrame, by: Sequence[str], value: str, at: dict[str, float]) -> DataFrame:
    """groups (a row per key of by) with exact quantiles of df's values as columns."""
    q = ordered.quantiles(df, by, value, at).select(*(F.col(c).alias(f"_q{k}") for k, c in enumerate(by)), *at)
    cond = F.lit(True)
    for k, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_q{k}"))
    return groups.join(q, cond, "left").drop(*(f"_q{k}" for k in range(len(by))))


def flags(df: DataFrame, by: Sequence[str], flagged: dict[str, Column], worst: str) -> DataFrame:
    """Count and rate of each flag, and the worst value."""
    each = [x for k, c in flagged.items() for x in (F.count(F.when(c, 1)).alias(k), (F.count(F.when(c, 1)) / F.count("*")).alias(f"{k}_rate"))]
    return df.groupBy(*by).agg(*each, F.min(worst).alias("worst"))


def group_macro(df: DataFrame, by: Sequence[str], value: str, places: int = 9) -> DataFrame:
    """macro: mean of the groups' means; worst: the group of the least mean, the first by name of equals."""
    g = df.groupBy(*by).agg(F.round(F.avg(value), places).alias("m"))
    return g.agg(F.avg("m").alias("macro"), F.min(F.struct("m", F.concat_ws("/", *by).alias("name"))).alias("_w")).select("macro", F.col("_w.name").alias("worst"))


def localisation(df: DataFrame, labels: Column, iou: str, least: float = 0.5) -> DataFrame:
    """lq: share over `least`; sq: mean of those (0 without any); miou; per label (an array) and overall."""
    e = df.select(F.explode(F.concat(F.array(F.lit("overall")), labels)).alias("label"), F.col(iou).alias("_v"))
    over = F.col("_v") > least
    return e.groupBy("label").agg((F.count(F.when(over, 1)) / F.count("*")).alias("lq"), F.coalesce(F.avg(F.when(over, F.col("_v"))), F.lit(0.0)).alias("sq"), F.avg("_v").alias("miou"))


def overlap_meters(df: DataFrame, by: Sequence[str], inter: str, total: str) -> DataFrame:
    """ciou: sum of intersections over sum of unions; giou: mean of the rows' smoothed overlaps, 1 more where a union is 0."""
    i, u = F.col(inter), F.col(total)
    return df.groupBy(*by).agg((F.sum(i) / (F.sum(u) + 1e-10)).alias("ciou"), F.avg(i / (u + 1e-5) + F.when(u == 0, 1.0).otherwise(0.0)).alias("giou"))


def no_target(df: DataFrame, pred: str, truth: str, inter: str) -> DataFrame:
    """Rows without a target (truth of 0 pixels) are right when nothing is predicted. n_acc and t_acc: shares of right rows
    without and with a target; giou: such rows count 1 or 0, others their overlap; ciou: intersections over unions, where a
    right row without a target adds nothing."""
    p, g, i = (F.col(c).cast("double") for c in (pred, truth, inter))
    none, empty = g == 0, p == 0
    u = p + g - i
    return df.agg(
        F.try_divide(F.count(F.when(none & empty, 1)), F.count(F.when(none, 1))).alias("n_acc"), F.try_divide(F.count(F.when(~none & ~empty, 1)), F.count(F.when(~none, 1))).alias("t_acc"),
        F.avg(F.when(none, empty.cast("double")).otherwise(i / (u + 1e-8))).alias("giou"), F.try_divide(F.sum(i), F.sum(u)).alias("ciou"),
    )


def best_of_key(df: DataFrame, key: str, value: str, least: float = 0.5) -> DataFrame:
    """ap50: share of keys whose best value reaches `least`; mean_best."""
    b = df.groupBy(key).agg(F.max(value).alias("b"))
    return b.agg(F.avg((F.col("b") >= least).cast("double")).alias("ap50"), F.avg("b").alias("mean_best"))


def type_means(df: DataFrame, unit: str, kind: str, value: str, places: int = 2) -> DataFrame:
    """Mean of the types' means of the units' means, times 100 and rounded in between."""
    e = df.groupBy(unit).agg(F.max(kind).alias("k"), F.round(F.avg(value) * 100, places).alias("v"))
    return e.groupBy("k").agg(F.avg("v").alias("v")).agg(F.avg("v").alias("overall"))


def crosstab(df: DataFrame, a: str, b: str) -> DataFrame:
    """n of each pair of values, zeros written out. Pairs of the distinct values are crossed, which must be few."""
    n = df.groupBy(F.col(a).alias("_a"), F.col(b).alias("_b")).agg(F.count("*").alias("_n"))
    full = df.select(a).distinct().crossJoin(df.select(b).distinct())
    return full.join(n, F.col(a).eqNullSafe(F.col("_a")) & F.col(b).eqNullSafe(F.col("_b")), "left").select(a, b, F.coalesce("_n", F.lit(0)).alias("n"))


def quantiles(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """lo, hi, mean, q25, median, q75 of each group's values; the quantiles are exact."""
    d = df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"))
    return with_quantiles(d, df, by, value, {"q25": 0.25, "median": 0.5, "q75": 0.75}).select(*by, "lo", "hi", "mean", "q25", "median", "q75")


def transitions(df: DataFrame, key: str, variant: str, value: str, baseline, other) -> DataFrame:
    """Against the baseline variant, over keys that have both: gained (0 before, some now), lost, delta of the sums."""
    p = df.groupBy(key).agg(*(F.max(F.when(F.col(variant) == v, F.col(value))).alias(n) for v, n in ((baseline, "a"), (other, "b")))).filter("a is not null and b is not null")
    return p.agg(F.count(F.when((F.col("a") == 0) & (F.col("b") > 0), 1)).alias("gained"), F.count(F.when((F.col("a") > 0) & (F.col("b") == 0), 1)).alias("lost"), F.sum(F.col("b") - F.col("a")).cast("long").alias("delta"))


def winners(df: DataFrame, key: str, variant: str, value: str) -> DataFrame:
    """(winner, n): keys whose largest value one variant alone has, null for ties. One pass over the keys' rows."""
    w = df.groupBy(key).agg(F.array_agg(F.struct(value, variant)).alias("_r")).withColumn("_top", F.array_max(F.transform("_r", lambda s: s[value])))
    best = F.filter("_r", lambda s: s[value] == F.col("_top"))
    return w.select(F.when(F.size(best) == 1, F.get(best, 0)[variant]).alias("winner")).groupBy("winner").agg(F.count("*").alias("n"))


def gains(df: DataFrame, by: Sequence[str], variant: str, value: str, before, after, places: int = 9) -> DataFrame:
    """Groups whose mean rose, fell or stayed from one variant to another, the largest gain and loss and their groups (the
    first by name of equals)."""
    mean = lambda v: F.round(F.avg(F.when(F.col(variant) == v, F.col(value))), places)
    g = df.groupBy(*by).agg(mean(before).alias("a"), mean(after).alias("b")).withColumns({"d": F.round(F.col("b") - F.col("a"), places), "name": F.concat_ws("/", *by)})
    count = lambda c: F.count(F.when(c, 1))
    return g.agg(count(F.col("d") > 0).alias("improved"), count(F.col("d") < 0).alias("declined"), count(F.col("d") == 0).alias("tied"), F.min(F.struct((-F.col("d")).alias("d"), "name")).alias("_g"), F.min(F.struct("d", "name")).alias("_l")).select("improved", "declined", "tied", (-F.col("_g.d")).alias("max_gain"), F.col("_g.name").alias("best"), F.col("_l.d").alias("max_loss"), F.col("_l.name").alias("worst"))


def imbalance(df: DataFrame, part: Column, size: str) -> DataFrame:
    c = df.groupBy(part.alias("_p")).agg(F.sum(size).alias("s"))
    return c.agg(F.min("s").cast("long").alias("lo"), F.max("s").cast("long").alias("hi"), (F.max("s") - F.min("s")).cast("long").alias("gap"))


def lengths(df: DataFrame, value: str) -> DataFrame:
    """mean, most, least and the share of rows at the most (those that were cut off). Lengths are counted first, so that
    the table is read once."""
    c = df.groupBy(value).agg(F.count("*").alias("_n"))
    return c.agg((F.sum(F.col(value) * F.col("_n")) / F.sum("_n")).alias("mean"), F.max(value).alias("most"), F.min(value).alias("least"), (F.max_by("_n", value) / F.sum("_n")).alias("clip_ratio"))


def spread_of(df: DataFrame, by: Sequence[str], value: str, returned: str) -> DataFrame:
    """lo, hi, mean of a value, and the explained variance 1 - var(returned - value) / (var(returned) + 1e-5)."""
    return df.groupBy(*by).agg(F.min(value).alias("lo"), F.max(value).alias("hi"), F.avg(value).alias("mean"), (1 - F.var_samp(F.col(returned) - F.col(value)) / (F.var_samp(returned) + 1e-5)).alias("explained"))


def failures(df: DataFrame, text: str, message: str) -> DataFrame:
    bad = F.count(F.when(F.col(text).contains(message), 1))
    return df.agg(F.count("*").alias("n"), bad.alias("failed"), (bad / F.count("*")).alias("rate"))


def labelled_rows(df: DataFrame, *rows: tuple[str, Column]) -> DataFrame:
    """One row of named aggregates: LaTeX and submission lines are made of it."""
    return df.agg(*(c.alias(n) for n, c in rows))


def latex(*values: Column, places: int = 1) -> Column:
    """A row of a LaTeX table."""
    return F.concat(F.concat_ws(" & ", *(F.format_string(f"%.{places}f", v.cast("double")) for v in values)), F.lit(" \\\\"))


def capabilities(df: DataFrame, names: Sequence[str], category: str, score: str) -> DataFrame:
    """(part, category, tot, acc): of each capability, those rows whose category holds its name (a row counts for several),
    and of each whole combination, commas as underscores; both with Overall; acc is the mean score times 100."""
    has = F.filter(F.array(*(F.lit(n) for n in names)), lambda n: F.contains(F.col(category), n))
    lines = F.concat(F.transform(has, lambda n: F.struct(F.lit("capability").alias("part"), n.alias("category"))), F.array(*(F.struct(F.lit(p).alias("part"), x.alias("category")) for p, x in (("combination", F.replace(F.col(category), F.lit(","), F.lit("_"))), ("capability", F.lit("Overall")), ("combination", F.lit("Overall"))))))
    e = df.select(F.explode(lines).alias("l"), score)
    return e.groupBy("l.part", "l.category").agg(F.count("*").alias("tot"), (F.avg(score) * 100).alias("acc"))


def rated_dimensions(df: DataFrame, dimensions: str, score: str, groups: dict[str, Sequence[str]]) -> DataFrame:
    """(level, dim, all, valid): mean scores, negative ones as 0 (all) or left out (valid), of every dimension that a row names
    (fine) and of every group that one of its dimensions is in (coarse)."""
    fine = F.transform(dimensions, lambda x: F.struct(F.lit("fine").alias("level"), x.alias("dim")))
    coarse = F.filter(F.array(*(F.struct(F.lit("coarse").alias("level"), F.when(F.arrays_overlap(dimensions, F.array(*map(F.lit, m))), F.lit(g)).alias("dim")) for g, m in groups.items())), lambda x: x["dim"].isNotNull())
    e = df.select(F.explode(F.concat(fine, coarse)).alias("l"), F.col(score).alias("_s"))
    return e.groupBy("l.level", "l.dim").agg(F.avg(F.greatest("_s", F.lit(0))).alias("all"), F.avg(F.when(F.col("_s") >= 0, F.col("_s"))).alias("valid"))


def long_documents(df: DataFrame, answer: str, pred: str, score: str, sources: str, pages: str, named: dict[str, str], none: str = "Not answerable") -> DataFrame:
    """(category, num, avg_score): overall accuracy and F1 (recall over answerable questions, precision over answered ones), a
    row per evidence source (name: source, an element of the sources) and per number of evidence pages; 0 without rows."""
    pages_of = F.size(pages)
    lines = {"overall_acc": F.lit(True), **{n: F.array_contains(sources, v) for n, v in named.items()}, "single-page": pages_of == 1, "multi-page": pages_of > 1, "unanswerable": pages_of == 0}
    asked, said = F.col(answer) != none, F.col(pred) != none
    sums = [x for k, c in lines.items() for x in (F.count(F.when(c, 1)).alias(f"n_{k}"), F.coalesce(F.avg(F.when(c, F.col(score))), F.lit(0.0)).alias(f"s_{k}"))]
    d = df.agg(*sums, F.avg(F.when(asked, F.col(score))).alias("_r"), F.avg(F.when(said, F.col(score))).alias("_p"))
    rows = [F.struct(F.lit(k).alias("category"), F.col(f"n_{k}").alias("num"), F.col(f"s_{k}").alias("avg_score")) for k in lines]
    f1 = F.struct(F.lit("overall_f1").alias("category"), F.col("n_overall_acc").alias("num"), F.try_divide(2 * F.col("_r") * F.col("_p"), F.col("_r") + F.col("_p")).alias("avg_score"))
    return d.select(F.explode(F.array(f1, *rows)).alias("l")).select("l.*")


def by_metadata(df: DataFrame, metadata: str, keys: Sequence[str], hit: str) -> DataFrame:
    """(key, value, correct, total, accuracy, place): accuracies (in per cent, two decimals) by each key of a JSON object, from
    the best down within a key, and the average of all rows (value null)."""
    fields = F.array(*(F.struct(F.lit(k).alias("key"), F.get_json_object(metadata, f"$.{k}").alias("value")) for k in keys), F.struct(F.lit("average").alias("key"), F.lit(None).cast("string").alias("value")))
    e = df.select(F.explode(fields).alias("f"), F.col(hit).cast("long").alias("_h"))
    d = e.groupBy("f.key", "f.value").agg(F.sum("_h").alias("correct"), F.count("*").alias("total")).withColumn("accuracy", F.round(100.0 * F.col("correct") / F.col("total"), 2))
    return d.withColumn("place", F.row_number().over(Window.partitionBy("key").orderBy(F.desc("accuracy"), "value")))  # a row per value


def subtotals(df: DataFrame, category: str, hit: str, parts: dict[str, Sequence[str]]) -> DataFrame:
    """(line, score): hits of every category and of every part (its categories), their sum (Final Score) and a tenth of it."""
    c = df.groupBy(F.col(category).alias("line")).agg(F.sum(F.col(hit).cast("double")).alias("score"))
    part = F.array_compact(F.array(*(F.when(F.col("line").isin(*m), F.lit(p)) for p, m in parts.items())))
    sums = c.select(F.explode(part).alias("line"), "score").groupBy("line").agg(F.sum("score").alias("score"))
    total = c.agg(F.coalesce(F.sum("score"), F.lit(0.0)).alias("_t")).select(F.explode(F.array(F.struct(F.lit("Final Score").alias("line"), F.col("_t").alias("score")), F.struct(F.lit("Final Score Norm").alias("line"), (F.col("_t") / 10).alias("score")))).alias("l")).select("l.*")
    return c.unionByName(sums).unionByName(total)


def measures_by_type(df: DataFrame, unit: str, kind: str, measures: Sequence[str], places: int = 2) -> DataFrame:
    """(kind, a column per measure, mean of the first two): means of the units' means, times 100 and rounded in between, by type
    and, as `overall`, of the types' means."""
    e = df.groupBy(unit).agg(F.max(kind).alias("kind"), *(F.round(F.avg(m) * 100, places).alias(m) for m in measures))
    t = e.groupBy("kind").agg(*(F.avg(m).alias(m) for m in measures))
    both = t.unionByName(t.agg(*(F.avg(m).alias(m) for m in measures)).withColumn("kind", F.lit("overall")))
    return both.withColumn("both", (F.col(measures[0]) + F.col(measures[1])) / 2)
