"""Mixing sources to target weights by iterative proportional fitting.

Token weights of the cells (source, language, topic) are raked until their sums over each margin meet the targets, and
documents are then sampled, each with its cell's calibrated probability. Only cells are iterated over; documents are read
once to sum them up and once to be drawn.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

MARGINS = ("source", "lang", "topic")
FLATTEN = 0.7  # default targets: token shares to this power, which raises small groups
KEEP = 0.7  # expected share of tokens kept
ROUNDS = 200
EPSILON = 1e-10
DRIVER_CELLS = 200_000
NONE = "(none)"


def tokens(text: str = "text") -> Column:
    """Words of the whole text, 0 for null or blank."""
    return F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+")).cast("long")


def topic(text: str = "text") -> Column:
    """What a text is about, told from its whole form: the first of these that holds."""
    t = F.coalesce(F.col(text), F.lit(""))
    return (
        F.when(t.contains("icense") | t.contains("icence") | t.contains("opyright"), "legal")
        .when((t.contains("@") & t.rlike(r"\w@[\w-]+\.\w")) | t.rlike(r"\d\.\d{1,3}\.\d{1,3}\.\d|\(\d{3}\) ?\d{3}-\d{4}"), "contact")
        .when(t.contains("|") & t.rlike(r"\|[^|\n]+\|"), "table")
        .when(F.octet_length(t) < 600, "note")
        .when(F.octet_length(t) < 3000, "article")
        .otherwise("long read")
    )


def shares(total: dict[str, float], power: float) -> dict[str, float]:
    """Default targets from a margin's token sums."""
    raised = {k: v**power for k, v in total.items() if v > 0}
    whole = sum(raised.values())
    return {k: v / whole for k, v in raised.items()}


def rake(cells: np.ndarray, weight: np.ndarray, targets: list[np.ndarray], rounds: int = ROUNDS, epsilon: float = EPSILON) -> np.ndarray:
    """Weights raked to the targets. cells: (n, margins) codes; targets: shares by code. A margin's target counts only
    among codes with weight; margins that can't all be met end at the last one raked. No cells, or cells without weight,
    give weights of 0."""
    if not weight.sum() > 0:
        return np.zeros(len(weight))
    w = weight / weight.sum()
    for _ in range(rounds):
        worst = 0.0
        for j, target in enumerate(targets):
            now = np.bincount(cells[:, j], w, len(target))
            want = np.where(now > 0, target, 0)
            want = want / want.sum() if want.sum() > 0 else now
            worst = max(worst, np.abs(now - want).max())
            w = w * np.divide(want, now, out=np.zeros_like(now), where=now > 0)[cells[:, j]]
        if worst < epsilon:
            break
    return w


def rake_table(cells: DataFrame, targets: list[dict[str, float] | None], margins: tuple[str, ...], rounds: int = ROUNDS, epsilon: float = EPSILON) -> DataFrame:
    """The same on a table of cells too many for the driver: each margin's sums are aggregated and joined back, and every
    round is a written table. A target is a given list or None, for the default, which is a table as well."""
    spark = cells.sparkSession
    whole = cells.agg(F.sum("n_tokens")).first()[0]
    w = cells.withColumn("w", F.col("n_tokens") / F.lit(float(whole)))
    wants = [spark.createDataFrame(list(t.items()), f"{m} string, want double") if t else materialize(cells.groupBy(m).agg(F.pow(F.sum("n_tokens"), F.lit(FLATTEN)).alias("want")), "targets") for m, t in zip(margins, targets, strict=True)]
    for _ in range(rounds):
        worst = 0.0
        for m, want in zip(margins, wants, strict=True):
            now = w.groupBy(m).agg(F.sum("w").alias("now")).filter("now > 0").join(want, m, "left").withColumn("want", F.coalesce("want", F.lit(0.0)))
            now = materialize(now, "margin")
            total, gap = now.agg(F.sum("want"), F.max(F.abs(F.col("now") - F.col("want")))).first()
            worst = max(worst, gap)
            w = w.join(now, m).withColumn("w", F.col("w") * F.col("want") / F.lit(total) / F.col("now")).drop("now", "want")
        w = materialize(w, "raked")
        if worst < epsilon:
            break
    return w


def probabilities(n: np.ndarray, w: np.ndarray, keep: float) -> np.ndarray:
    """min(1, c * w / n) by cell, with c such that the expected tokens are the kept share of all, or as near as can be."""
    ratio = np.divide(w, n, out=np.zeros(len(n)), where=n > 0)
    want, order = keep * n.sum(), np.argsort(-ratio)
    r, size = ratio[order], n[order].astype(float)
    mass = r * size
    sure = np.concatenate([[0], np.cumsum(size)])
    rest = mass.sum() - np.concatenate([[0], np.cumsum(mass)])
    for k in range(len(r) + 1):  # the k largest ratios are taken whole
        if rest[k] <= 0:
            return np.minimum(1, np.where(ratio > 0, 1.0, 0.0))
        c = (want - sure[k]) / rest[k]
        if k == len(r) or c * r[k] <= 1:
            return np.clip(c * ratio, 0, 1)
    return np.clip(ratio, 0, 1)


def calibrate(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, margins: tuple[str, ...] = MARGINS, keep: float = KEEP) -> DataFrame:
    """(margins..., n_docs, n_tokens, weight, p) of each cell of docs, which has a column per margin and n_tokens.

    Null margins are a group of their own. A margin without given targets aims at its token shares to the power FLATTEN.
    Up to DRIVER_CELLS cells, a checked count, are raked on the driver, more as a table, by the same formulas."""
    spark = docs.sparkSession
    named = [F.coalesce(F.col(m).cast("string"), F.lit(NONE)).alias(m) for m in margins]
    cells = materialize(docs.select(*named, "n_tokens").groupBy(*margins).agg(F.count("*").alias("n_docs"), F.sum("n_tokens").alias("n_tokens")), "cells")
    schema = ", ".join(f"`{m}` string" for m in margins) + ", n_docs long, n_tokens long, weight double, p double"
    given = [(targets or {}).get(m) for m in margins]
    if cells.filter("n_tokens > 0").isEmpty():
        return spark.createDataFrame([], schema)
    if cells.count() > DRIVER_CELLS:
        w = rake_table(cells.filter("n_tokens > 0"), given, margins).withColumn("ratio", F.col("w") / F.col("n_tokens"))
        lo, hi = 0.0, 1.0
        want = keep * float(cells.agg(F.sum("n_tokens")).first()[0])
        got = lambda c: w.agg(F.sum(F.least(F.lit(1.0), F.col("ratio") * c) * F.col("n_tokens"))).first()[0]
        while got(hi) < want * (1 - 1e-9) and hi < 1e30:
            lo, hi = hi, hi * 8
        for _ in range(60):
            mid = (lo + hi) / 2
            lo, hi = (mid, hi) if got(mid) < want else (lo, mid)
        return w.select(*margins, "n_docs", "n_tokens", F.col("w").alias("weight"), F.least(F.lit(1.0), F.col("ratio") * hi).alias("p"))
    c = cells.toPandas().sort_values(list(margins)).reset_index(drop=True)
    codes, goals = [], []
    for m, g in zip(margins, given, strict=True):
        g = g or shares(c.groupby(m)["n_tokens"].sum().to_dict(), FLATTEN)
        values = sorted(set(c[m]))
        codes.append(c[m].map({v: i for i, v in enumerate(values)}).to_numpy())
        goals.append(np.array([g.get(v, 0.0) for v in values]))
    n = c["n_tokens"].to_numpy(float)
    c["weight"] = rake(np.stack(codes, 1), n, goals)
    c["p"] = probabilities(n, c["weight"].to_numpy(), keep)
    return spark.createDataFrame(c, schema)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, seed: int = 17, text: str = "text") -> DataFrame:
    """docs with topic, n_tokens, p and drawn: each document's cell probability and whether it is drawn.

    A draw hashes doc_id, text and seed to a number in [0, 1) and compares it with p, so it doesn't change with the
    partitioning. Documents without tokens (null, empty or blank texts) can't move the mixture and have p 1. Null margins
    are groups of their own; rows repeated as a whole are drawn together. Columns of the four names are replaced, all others
    stay as they are. An empty table stays empty.
    """
    added = ("topic", "n_tokens", "p", "drawn")
    row = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c not in added))
    told = docs.select(row.alias("_row"), *(F.coalesce(F.col(m).cast("string"), F.lit(NONE)).alias(m) for m in MARGINS if m != "topic"), topic(text).alias("topic"), tokens(text).alias("n_tokens"), F.xxhash64(F.col("doc_id").cast("string"), F.col(text), F.lit(seed)).alias("_u"))
    cells = calibrate(told.select(*MARGINS, "n_tokens"), targets, keep=keep)
    out = told.join(cells.select(*MARGINS, "p"), list(MARGINS), "left")
    p = F.when(F.col("n_tokens") > 0, F.coalesce("p", F.lit(1.0))).otherwise(1.0)
    u = F.pmod(F.col("_u"), F.lit(1 << 52)) / F.lit(float(1 << 52))
    return out.select("_row.*", "topic", "n_tokens", p.alias("p"), (u < p).alias("drawn"))


def draw(docs: DataFrame, **kw) -> DataFrame:
    """The drawn rows of docs with all their columns as they were; keywords and cases as in mix()."""
    packed = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc"), "doc_id", "text", "source", "lang")
    return mix(packed, **kw).filter("drawn").select("_doc.*")


def op2_raked_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    """mix() of documents, p rounded to 6 places; nulls, empty texts, repeats and empty tables as it says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mix(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "source", "lang", "topic", "n_tokens", F.round("p", 6).alias("p"), "drawn")
