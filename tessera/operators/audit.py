"""Checks of records and tables: rules, uniqueness, leakage, expected counts, and resampled confidence intervals."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.answers import _let
from .ordered import numbered
from .report import with_quantiles


def violations(rules: Sequence[tuple[str, Column]]) -> Column:
    """Messages of the rules whose condition a row breaks; an unknown (null) condition is broken."""
    return F.array_compact(F.array(*(F.when(~F.coalesce(ok, F.lit(False)), F.lit(message)) for message, ok in rules)))


def safe_path(path: Column) -> Column:
    """Relative, without backslashes, empty parts or parts of dots."""
    return ~path.rlike(r"^/|\\|^[A-Za-z]:") & F.forall(F.split(path, "/"), lambda x: ~x.isin("", ".", ".."))


def record_rules(fields: Sequence[str], enums: dict[str, Sequence[str]], ids: dict[str, str], positive: Sequence[str], paths: Sequence[str]) -> list[tuple[str, Column]]:
    """Rules on columns: present and not blank, one of a list, of a pattern, not negative, safe paths."""
    out = [(f"{c}: missing", F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != "")) for c in fields]
    out += [(f"{c}: unknown value", F.col(c).isin(*v)) for c, v in enums.items()]
    out += [(f"{c}: malformed", F.col(c).cast("string").rlike(p)) for c, p in ids.items()]
    out += [(f"{c}: negative", F.col(c) >= 0) for c in positive]
    return out + [(f"{c}: unsafe path", safe_path(F.col(c))) for c in paths]


def unknown_fields(json: Column, known: Sequence[str]) -> Column:
    """Keys of a JSON object that aren't known, sorted."""
    return F.array_sort(F.array_except(F.json_object_keys(json), F.array(*(F.lit(k) for k in known))))


def repeated_values(df: DataFrame, fields: Sequence[str]) -> DataFrame:
    """(field, value, n) of values that occur more than once in their field."""
    e = df.select(F.explode(F.array(*(F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for c in fields))).alias("x")).select("x.*")
    return e.groupBy("field", "value").agg(F.count("*").alias("n")).filter("n > 1")


def expected_counts(df: DataFrame, by: str, expected: dict[str, int]) -> DataFrame:
    """(by, n, ok): rows per value and whether they are as many as expected; values that aren't there count 0."""
    want = df.sparkSession.createDataFrame(list(expected.items()), f"{by} string, _want long")
    return want.join(df.groupBy(F.col(by).cast("string").alias(by)).agg(F.count("*").alias("_n")), by, "left").select(by, F.coalesce("_n", F.lit(0)).alias("n"), (F.coalesce("_n", F.lit(0)) == F.col("_want")).alias("ok"))


def leaks(df: DataFrame, value: Column, split: str) -> DataFrame:
    """(digest, n_splits, n) of values in more than one split."""
    return df.groupBy(value.alias("digest")).agg(F.countDistinct(split).alias("n_splits"), F.count("*").alias("n")).filter("n_splits > 1")


def duplicates(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """(digest, n, first_id) of contents that occur more than once."""
    return df.groupBy(digest.alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first_id")).filter("n > 1")


def duplicate_members(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """(digest, first_id, member): a row per member of each group of equal contents, however large the group."""
    d = df.withColumn("digest", digest)
    first = duplicates(d, F.col("digest"), key).select("digest", "first_id")
    return d.join(first, "digest").select("digest", "first_id", F.col(key).alias("member"))


#: Reasons for which nothing ran, and how others of that kind begin.
RUNTIME_FAILURES = ("model_load_failed", "model_inference_failed")
RUNTIME_PREFIXES = ("backend_exception:", "not_run_after_")


def outcomes(returned: Column, reason: Column, valid: Column, predicted: Column, inter: Column) -> dict[str, Column]:
    """Flags of an attempt that don't exclude one another: whether it ran, its mask is valid, predicts anything, or nothing,
    or what is wanted. A reason may tell of a valid empty outcome, so it is no failure by itself."""
    r = F.coalesce(reason, F.lit(""))
    failed = ~returned | r.isin(*RUNTIME_FAILURES) | r.startswith(RUNTIME_PREFIXES[0]) | r.startswith(RUNTIME_PREFIXES[1])
    some = valid & (predicted > 0)
    return {"execution_success": ~failed, "mask_contract_valid": valid, "nonempty_prediction": some, "empty_prediction": ~some, "overlapping_prediction": valid & (inter > 0)}


def contract(df: DataFrame, levels: Sequence[Sequence[str]], expected: DataFrame) -> DataFrame:
    """(level, key, expected, n, ok): rows of every key of every level (columns joined by /) beside what expected says of it
    (level, key, expected): keys that aren't there count 0, keys that nothing is said of are expected 0 times."""
    each = F.array(*(F.struct(F.lit("/".join(x)).alias("level"), F.concat_ws("/", *(F.col(c).cast("string") for c in x)).alias("key")) for x in levels))
    n = df.select(F.explode(each).alias("l")).groupBy("l.level", "l.key").agg(F.count("*").alias("n"))
    j = expected.join(n, ["level", "key"], "full_outer")
    zero = lambda c: F.coalesce(F.col(c).cast("long"), F.lit(0)).alias(c)
    return j.select("level", "key", zero("expected"), zero("n")).withColumn("ok", F.col("expected") == F.col("n"))


def uncovered(df: DataFrame, by: Sequence[str], value: str, wanted: Sequence) -> DataFrame:
    """(by..., missing, foreign): groups in which a wanted value is missing, or another one occurs."""
    want = F.array(*map(F.lit, wanted))
    d = df.groupBy(*by).agg(F.collect_set(value).alias("_v"))
    return d.select(*by, F.array_sort(F.array_except(want, "_v")).alias("missing"), F.array_sort(F.array_except("_v", want)).alias("foreign")).filter((F.size("missing") > 0) | (F.size("foreign") > 0))


def schema_violations(json: Column, types: dict[str, str], required: Sequence[str], parameters: dict[str, dict[str, str]], action: str = "action", nested: str = "parameters") -> Column:
    """Messages on a record written as a JSON object: fields that are missing, unknown or not of their exact type (string,
    integer, number, boolean, object), and the same of the parameters that its action asks for."""

    none = F.array().cast("array<string>")

    def fits(value: Column, path: str, t: str) -> Column:
        kind = lambda k: F.when(k == "BIGINT", "integer").when(k.rlike("^(DECIMAL|DOUBLE)"), "number").when(k.startswith("OBJECT"), "object").otherwise(F.lower(k))
        return _let(F.schema_of_variant(F.try_variant_get(value, path, "variant")), lambda k: _let(kind(k), lambda k: (k == t) | ((k == "integer") & (t == "number"))))

    def rules(x: Column) -> Column:
        keys, inner = x["keys"], x["inner"]
        out = [F.transform(F.array_except(F.array(*map(F.lit, required)), keys), lambda x: F.concat(x, F.lit(": missing"))), F.transform(F.array_sort(F.array_except(keys, F.array(*map(F.lit, types)))), lambda x: F.concat(x, F.lit(": unknown")))]
        out.append(F.array_compact(F.array(*(F.when(F.array_contains(keys, f) & ~fits(x["value"], f"$.{f}", t), F.lit(f"{f}: not {t}")) for f, t in types.items()))))
        for a, wanted in parameters.items():
            names = F.array(*map(F.lit, wanted)) if wanted else none
            odd = F.concat(F.transform(F.array_except(names, inner), lambda x: F.concat(F.lit(f"{nested}."), x, F.lit(": missing"))), F.transform(F.array_sort(F.array_except(inner, names)), lambda x: F.concat(F.lit(f"{nested}."), x, F.lit(": unknown"))), F.array_compact(F.array(F.lit(None).cast("string"), *(F.when(F.array_contains(inner, f) & ~fits(x["value"], f"$.{nested}.{f}", t), F.lit(f"{nested}.{f}: not {t}")) for f, t in wanted.items()))))
            out.append(F.when(x["action"] == a, odd).otherwise(none))
        return F.when(keys.isNull(), F.array(F.lit("not an object"))).otherwise(F.concat(*out))

    # a record is parsed once for its values, and once for each of its lists of names
    named = lambda j: F.coalesce(F.json_object_keys(F.get_json_object(j, f"$.{nested}")), none)
    read = lambda j: F.struct(F.try_parse_json(j).alias("value"), F.json_object_keys(j).alias("keys"), named(j).alias("inner"), F.get_json_object(j, f"$.{action}").alias("action"))
    return _let(json, lambda j: _let(read(j), rules))


def varied_keys(df: DataFrame, key: Sequence[str | Column], *columns: str) -> DataFrame:
    """Keys with rows that differ in every one of the columns."""
    c = df.groupBy(*key).agg(F.count("*").alias("n"), *(F.countDistinct(x).alias(f"_{x}") for x in columns))
    for x in columns:
        c = c.filter(F.col(f"_{x}") > 1).drop(f"_{x}")
    return c


def one_match(entities: Column, wanted: Column) -> Column:
    """Whether exactly one entity is the wanted value."""
    return F.size(F.filter(entities, lambda x: x == wanted)) == 1


def ordered_digest(df: DataFrame, by: Sequence[str], order: str, value: str) -> DataFrame:
    """SHA-256 of the values in order, a line end after each, per group. The group's values meet in one row: a manifest."""
    text = F.concat(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, F.col(value).cast("string").alias("_v")))), lambda s: s["_v"]), "\n"), F.lit("\n"))
    return df.groupBy(*by).agg(F.sha2(text.cast("binary"), 256).alias("digest"), F.count("*").alias("n"))


def supervised(df: DataFrame, key: str, ids: str, labels: str, mark: int, ignore: int = -100) -> DataFrame:
    """(key, positions, n): places (from 0) whose id is the mark and whose label isn't ignored."""
    at = F.filter(F.sequence(F.lit(0), F.size(ids) - 1), lambda i: (F.get(F.col(ids), i) == mark) & (F.get(F.col(labels), i) != ignore))
    return df.select(key, at.alias("positions"), F.size(at).alias("n"))


def misaligned(df: DataFrame, expected: str) -> DataFrame:
    """Rows of supervised() joined with an expected count that differ, with both counts."""
    return df.filter(F.col("n") != F.col(expected))


def sampled_distances(df: DataFrame, key: str, label: str, vector: str, pairs: int, seed: int = 7) -> DataFrame:
    """(kind, n, mean, median) of distances within and across labels, over `pairs` partners per row, drawn by MD5 of the row's
    position and the draw."""
    d = numbered(df.select(key, label, vector), [key], "_at", total="_total")
    a = d.withColumn("_k", F.explode(F.sequence(F.lit(1), F.lit(pairs)))).withColumn("_o", _draw(F.col("_at"), F.col("_k"), seed, F.col("_total")).cast("long"))
    b = d.select(F.col("_at").alias("_o"), F.col(label).alias("_l2"), F.col(vector).alias("_v2"))
    gap = F.sqrt(F.aggregate(F.zip_with(vector, "_v2", lambda x, y: (x - y).cast("double") * (x - y)), F.lit(0.0), lambda t, x: t + x))
    j = a.join(b, "_o").filter(F.col("_at") != F.col("_o")).select(F.when(F.col(label) == F.col("_l2"), "within").otherwise("across").alias("kind"), gap.alias("_d"))
    return with_quantiles(j.groupBy("kind").agg(F.count("*").alias("n"), F.avg("_d").alias("mean")), j, ["kind"], "_d", {"median": 0.5})


def _draw(b: Column, j: Column, seed: int, n: Column) -> Column:
    digits = F.substring(F.md5(F.concat_ws("-", b.cast("string"), j.cast("string"), F.lit(str(seed))).cast("binary")), 1, 8)
    return (F.conv(digits, 16, 10).cast("long") % n).cast("int")


def bootstrap(df: DataFrame, group: Sequence[str], value: str, seed: int = 20260916, draws: int = 10_000) -> DataFrame:
    """estimate (mean of the groups' means) and its 95 % interval, from draws of as many groups with replacement. Groups are
    few and made one row; draws are rows, so they spread over tasks. Places are drawn by MD5, so any engine can repeat them."""
    g = df.groupBy(*group).agg(F.avg(value).alias("_m")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*group, "_m"))), lambda s: s["_m"]).alias("v"))
    return _intervals(df.sparkSession, g, [], seed, draws)


def paired_bootstrap(df: DataFrame, group: Sequence[str], variant: str, value: str, chosen, seed: int = 20260916, draws: int = 10_000) -> DataFrame:
    """The same of the differences of the chosen variant's group means from every other's, with contains_zero."""
    m = df.groupBy(variant, *group).agg(F.avg(value).alias("_m"))
    a = m.filter(F.col(variant) == chosen).select(*group, F.col("_m").alias("_c"))
    d = m.filter(F.col(variant) != chosen).join(a, list(group)).withColumn("_d", F.col("_c") - F.col("_m"))
    g = d.groupBy(variant).agg(F.transform(F.array_sort(F.collect_list(F.struct(*group, "_d"))), lambda s: s["_d"]).alias("v"))
    return _intervals(df.sparkSession, g, [variant], seed, draws).withColumn("contains_zero", (F.col("lower") <= 0) & (F.col("upper") >= 0))


BLOCK = 1 << 14  # 64-bit numbers of the generator that one task makes at a time


def _accepted(seed: int, n: int, block: int) -> np.ndarray:
    """Places below n that a block of NumPy's PCG64 stream gives: its 64-bit numbers are halves, the low one first, each is
    scaled to a place, and those that would favour some places are passed over. The generator leaps to the block."""
    g = np.random.PCG64(seed)
    g.advance(block * BLOCK)
    half = g.random_raw(BLOCK).view("<u4").astype(np.uint64) * np.uint64(n)
    return (half >> np.uint64(32))[(half & np.uint64(0xFFFFFFFF)) >= np.uint64((2**32 - n) % n)].astype(np.int64)


def numpy_draws(spark: SparkSession, n: int, draws: int, seed: int) -> DataFrame:
    """(draw, j, place): what default_rng(seed).integers(0, n, size=(draws, n)) holds. Blocks of the stream are made in tasks of
    their own; how many numbers each passes over tells where the next one's begin."""
    if n == 1:
        return spark.range(draws).select(F.col("id").alias("draw"), F.lit(0).cast("long").alias("j"), F.lit(0).cast("long").alias("place"))
    blocks = spark.range(-(-draws * n // (2 * BLOCK)) + 1).withColumnRenamed("id", "block")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            yield b.assign(n=[len(_accepted(seed, n, k)) for k in b["block"]])

    def make(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for block, before in zip(b["block"], b["before"], strict=True):
                place = _accepted(seed, n, block)
                at = before + np.arange(len(place))
                yield pd.DataFrame({"draw": at // n, "j": at % n, "place": place})[at < draws * n]

    counts = blocks.mapInPandas(count, "block long, n long")
    before = F.coalesce(F.sum("n").over(Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row per block
    return counts.select("block", before.alias("before")).repartition("block").mapInPandas(make, "draw long, j long, place long")


def numpy_bootstrap(df: DataFrame, group: Sequence[str], value: str, seed: int = 20260916, draws: int = 10_000) -> DataFrame:
    """bootstrap() with the places that NumPy's generator gives for the seed, so that published intervals come out again. The
    groups, in order of their names, are made one row: they are the units that are drawn, and few."""
    v = df.groupBy(*group).agg(F.avg(value).alias("_m")).agg(F.transform(F.array_sort(F.collect_list(F.struct(*group, "_m"))), lambda s: s["_m"]).alias("v"))
    n = df.select(*group).distinct().count()
    if not n:
        raise ValueError("no groups to draw from")
    means = numpy_draws(df.sparkSession, n, draws, seed).crossJoin(F.broadcast(v)).groupBy("draw").agg(F.avg(F.get("v", F.col("place").cast("int"))).alias("_s"), F.first("v").alias("v"))
    q = F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975)))
    estimate = F.aggregate("v", F.lit(0.0), lambda t, x: t + x) / F.size("v")
    return means.agg(F.max(estimate).alias("estimate"), q.alias("_q")).select("estimate", F.get("_q", 0).alias("lower"), F.get("_q", 1).alias("upper"))


def _intervals(spark: SparkSession, g: DataFrame, by: list[str], seed: int, draws: int) -> DataFrame:
    n = F.size("v")
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.get(F.col("v"), _draw(F.col("_b"), j, seed, n)))
    mean = lambda a: F.aggregate(a, F.lit(0.0), lambda t, x: t + x) / F.size(a)
    rows = spark.range(draws).withColumnRenamed("id", "_b").crossJoin(g).select(*by, mean(F.col("v")).alias("_e"), mean(drawn).alias("_s"))
    q = F.percentile("_s", F.array(F.lit(0.025), F.lit(0.975)))
    return rows.groupBy(*by).agg(F.max("_e").alias("estimate"), q.alias("_q")).select(*by, "estimate", F.get("_q", 0).alias("lower"), F.get("_q", 1).alias("upper"))
