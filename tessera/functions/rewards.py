"""Rollout statistics: advantages, returns, losses, divergences; by group of rows or along the steps of a row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EPS = 1e-6


def _joined(df: DataFrame, by: str, *stats: Column) -> DataFrame:
    """df with statistics of its groups. They are aggregated first, with a partial sum per task, and joined back: a group of
    any size needs no task of its own, as a window over it would."""
    stat = df.groupBy(by).agg(*stats).withColumnRenamed(by, "_by")
    return df.join(stat, df[by].eqNullSafe(stat["_by"])).drop("_by")


def group_normalised(df: DataFrame, by: str, score: str, out: str = "advantage", eps: float = EPS) -> DataFrame:
    """df with (score - mean) / (sample deviation + eps) of its group; null in a group of one."""
    return _joined(df, by, F.avg(score).alias("_m"), F.stddev_samp(score).alias("_s")).withColumn(out, (F.col(score) - F.col("_m")) / (F.col("_s") + eps)).drop("_m", "_s")


def best_of_group(df: DataFrame, by: str, score: str, row_id: str, out: str = "advantage", eps: float = EPS) -> DataFrame:
    """The best row of a group (the smallest id of equals) has (best - second) / (deviation + eps), all others their score."""
    best = F.max(F.struct(F.col(score), -F.col(row_id))).alias("_b")
    d = _joined(df, by, best, F.stddev_samp(score).alias("_s"))
    top = F.col(row_id) == -F.col("_b.col2")
    rest = d.filter(~top).groupBy(by).agg(F.max(score).alias("_second")).withColumnRenamed(by, "_by")
    d = d.join(rest, d[by].eqNullSafe(rest["_by"]), "left").drop("_by")
    return d.withColumn(out, F.when(top, (F.col(score) - F.col("_second")) / (F.col("_s") + eps)).otherwise(F.col(score))).drop("_b", "_s", "_second")


def leave_one_out(df: DataFrame, by: str, score: str, out: str = "advantage") -> DataFrame:
    """score less the mean of the group's other rows; null in a group of one."""
    return _joined(df, by, F.sum(score).alias("_t"), F.count("*").alias("_n")).withColumn(out, F.col(score) - F.try_divide(F.col("_t") - F.col(score), F.col("_n") - 1)).drop("_t", "_n")


def groups_within(df: DataFrame, by: str, score: str, low: float, high: float) -> DataFrame:
    """Rows of the groups whose mean score is between low and high, both excluded."""
    keep = df.groupBy(by).agg(F.avg(score).alias("_m")).filter((F.col("_m") > low) & (F.col("_m") < high)).select(by)
    return df.join(keep, by, "left_semi")


def returns(rewards: Column, baseline: Column | float = 0.0) -> tuple[Column, Column]:
    """(sum of the rewards less the baseline, rewards to come at each step) of an array."""
    total = F.aggregate(rewards, F.lit(0.0), lambda a, x: a + x)
    ahead = F.aggregate(F.reverse(rewards), F.array().cast("array<double>"), lambda a, x: F.concat(F.array(x + F.coalesce(F.get(a, 0), F.lit(0.0))), a))
    return total - baseline, ahead


def until_end(tokens: Column, end: int) -> Column:
    """1 up to and including the first end token, 0 after it."""
    at = F.array_position(tokens, end)
    return F.transform(tokens, lambda x, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def masked_mean(values: Column, mask: Column, eps: float = 1e-8) -> Column:
    return F.sum(values * mask) / (F.sum(mask) + eps)


def masked_moments(df: DataFrame, values: str, mask: str, by: list[str] | None = None) -> DataFrame:
    """n, mean and var of the values under the mask: the variance with Bessel's correction where there are two or more."""
    v, m = F.col(values), F.col(mask)
    out = df.groupBy(*(by or [])).agg(F.sum(m).alias("n"), masked_mean(v, m).alias("mean"), F.sum(v * v * m).alias("_q"))
    plain = F.col("_q") / (F.col("n") + 1e-8) - F.col("mean") * F.col("mean")
    return out.withColumn("var", F.when(F.col("n") > 1, plain * F.col("n") / (F.col("n") - 1)).otherwise(plain)).drop("_q")


def whitened(df: DataFrame, values: str, mask: str, out: str = "whitened", eps: float = 1e-8) -> DataFrame:
    """(value - mean) / sqrt(var + eps) under the mask, over all rows; one row of moments is joined."""
    s = masked_moments(df, values, mask).select(F.col("mean").alias("_m"), F.col("var").alias("_v"))
    return df.crossJoin(F.broadcast(s)).withColumn(out, (F.col(values) - F.col("_m")) / F.sqrt(F.col("_v") + eps)).drop("_m", "_v")


def average_loss(df: DataFrame, by: str, loss: str, mask: str) -> DataFrame:
    """token: masked mean over all; seq: mean of the sequences' masked means."""
    s = df.groupBy(by).agg(F.sum(F.col(loss) * F.col(mask)).alias("t"), F.sum(mask).alias("n"))
    return s.agg((F.sum("t") / (F.sum("n") + 1e-8)).alias("token"), F.avg(F.col("t") / (F.col("n") + 1e-8)).alias("seq"))


def divergence(log_p: Column, log_q: Column, kind: str) -> Column:
    """Estimates of the divergence of p from q: kl, abs, mse, low_var_kl."""
    d = F.least(F.greatest(log_p - log_q, F.lit(-20.0)), F.lit(20.0))
    back = -d
    return {"kl": d, "abs": F.abs(d), "mse": 0.5 * d * d, "low_var_kl": F.least(F.greatest(F.exp(back) - back - 1, F.lit(-10.0)), F.lit(10.0))}[kind]


def clipped_objective(log_p: Column, log_old: Column, advantage: Column, low: float = 0.2, high: float = 0.3, dual: float = 3.0, kind: str = "ppo") -> Column:
    """Loss of a token: clipped ratio, and for a negative advantage at most `dual` times it. cispo: clipped ratio (held
    constant) times advantage times log p."""
    d = F.least(F.greatest(log_p - log_old, F.lit(-20.0)), F.lit(20.0))
    ratio = F.exp(d)
    held = F.least(F.greatest(ratio, F.lit(1 - low)), F.lit(1 + high))
    if kind == "cispo":
        return -advantage * held * log_p
    worse = F.greatest(-advantage * ratio, -advantage * held)
    return F.when(advantage < 0, F.least(worse, -advantage * dual)).otherwise(worse)


def sequence_objective(df: DataFrame, by: str, log_p: str, log_old: str, advantage: str, mask: str, low: float = 0.2, high: float = 0.3, dual: float = 3.0) -> DataFrame:
    """df with `loss`: clipped_objective() with one ratio a sequence (by), the geometric mean of its tokens' ratios under the
    mask, at every token that the mask holds (1 elsewhere)."""
    seq = df.groupBy(F.col(by).alias("_by")).agg(masked_mean(F.col(log_p) - F.col(log_old), F.col(mask)).alias("_mean"))
    ratio = F.col("_mean") * F.col(mask)
    return df.join(seq, F.col(by).eqNullSafe(F.col("_by"))).withColumn("loss", clipped_objective(ratio, F.lit(0.0), F.col(advantage), low, high, dual)).drop("_by", "_mean")


def value_loss(value: Column, old: Column, target: Column, clip: float) -> Column:
    """Half the larger squared error of the value and of the value clipped around the old one."""
    held = F.least(F.greatest(value, old - clip), old + clip)
    return 0.5 * F.greatest((value - target) * (value - target), (held - target) * (held - target))


def next_coefficient(coefficient: float, current: float, target: float, horizon: float, steps: int) -> float:
    """The penalty's coefficient after a batch of `steps`."""
    error = min(max(current / target - 1, -0.2), 0.2)
    return coefficient * (1 + error * steps / horizon)


def penalised(score: Column, log_p: Column, log_q: Column, coefficient: Column | float, kind: str = "kl") -> Column:
    return score - coefficient * divergence(log_p, log_q, kind)


def scattered(length: Column, score: Column) -> Column:
    """An array of `length` zeros but for the score at the last place."""
    return F.when(length > 0, F.concat(F.array_repeat(F.lit(0.0), length - 1), F.array(score))).otherwise(F.array().cast("array<double>"))


def throughput(df: DataFrame, seconds: str, tokens: str, by: list[str], devices: int = 1) -> DataFrame:
    """total seconds and tokens, milliseconds a token, tokens a second and device."""
    out = df.groupBy(*by).agg(F.sum(seconds).alias("seconds"), F.sum(tokens).alias("tokens"))
    return out.withColumns({"ms_per_token": F.try_divide(F.col("seconds") * 1000, F.col("tokens")), "tokens_per_second": F.try_divide(F.col("tokens"), F.col("seconds") * devices)})


def last_rows(df: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key: what a table holds after its rows were written in order. Ties: any of equal rows."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max(F.struct(order, *(c for c in rest if c != order))).alias("_r")).select(key, *(F.col(f"_r.{c}").alias(c) for c in rest))


def first_places(df: DataFrame, value: str, order: str) -> DataFrame:
    """Each value and where it is first."""
    return df.groupBy(value).agg(F.min(order).alias("first_at"))


def crossings(df: DataFrame, key: str, order: str, difference: str) -> DataFrame:
    """(key, crossings): changes of sign along the order, zero counting as positive."""
    sign = F.when(F.col(difference) < 0, -1).otherwise(1)
    w = Window.partitionBy(key).orderBy(order)
    s = df.select(key, order, sign.alias("_s")).withColumn("_p", F.lag("_s").over(w))
    return s.groupBy(key).agg(F.count(F.when(F.col("_s") != F.col("_p"), 1)).alias("crossings"))


def turn_pairs(df: DataFrame, key: str, order: str, role: str, text: str, speaker: str = "assistant") -> DataFrame:
    """(key, grp, input, output): each answer of the speaker with the texts before it since the last one, joined by line
    ends; answers without such texts are left out."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    mine = F.col(role) == speaker
    g = df.withColumn("grp", F.coalesce(F.sum(mine.cast("long")).over(w), F.lit(0)))
    said = F.transform(F.array_sort(F.collect_list(F.when(~mine, F.struct(order, text)))), lambda x: x[text])
    out = g.groupBy(key, "grp").agg(said.alias("_in"), F.max(F.when(mine, F.col(text))).alias("output"), F.max(mine).alias("_done"))
    return out.filter(F.col("_done") & (F.size("_in") > 0)).select(key, "grp", F.array_join("_in", "\n").alias("input"), "output")
