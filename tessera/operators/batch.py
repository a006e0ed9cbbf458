"""Operations on batches: columns by name, rows by index, shards, folds of arrays."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def select(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """The columns of these names; names that df lacks are passed over."""
    return df.select(*[k for k in keys if k in df.columns])


def pop(df: DataFrame, keys: Iterable[str], row_id: str) -> tuple[DataFrame, DataFrame]:
    """(popped, rest): two frames that share row_id."""
    keys = [k for k in keys if k in df.columns and k != row_id]
    return df.select(row_id, *keys), df.drop(*keys)


def rename(df: DataFrame, old: list[str], new: list[str]) -> DataFrame:
    if len(old) != len(new):
        raise ValueError(f"{len(old)} old names, {len(new)} new names")
    return df.withColumnsRenamed(dict(zip(old, new, strict=True)))


def index_select(df: DataFrame, index: DataFrame, row_id: str) -> DataFrame:
    """The rows of df that index names by row_id, as often as it names them; index may carry a column of their order."""
    return df.join(index, row_id)


def fold_case(df: DataFrame) -> DataFrame:
    """Lower-case column names, but for single capitals (options)."""
    return df.toDF(*[c if len(c) == 1 and c.isupper() else c.lower() for c in df.columns])


def flatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Struct columns as flat columns named by their paths."""

    def walk(fields, prefix):
        for f in fields:
            path = [*prefix, f.name]
            if hasattr(f.dataType, "fields"):
                yield from walk(f.dataType.fields, path)
            else:
                yield F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path))

    return df.select(*walk(df.schema.fields, []))


def merge_maps(a: Column, b: Column) -> Column:
    """Both maps' entries; b wins."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(y, x))


def advantages(rewards: Column, values: Column, mask: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates of each step of an array; masked steps pass the carry on unchanged."""
    step = F.arrays_zip(rewards.alias("r"), values.alias("v"), mask.alias("m"))
    start = F.struct(F.lit(0.0).alias("next"), F.lit(0.0).alias("gae"), F.array().cast("array<double>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        gae = x["r"] + gamma * acc["next"] - x["v"] + gamma * lam * acc["gae"]
        kept = x["m"] > 0
        gae = F.when(kept, gae).otherwise(acc["gae"])
        return F.struct(F.when(kept, x["v"]).otherwise(acc["next"]).alias("next"), gae.alias("gae"), F.concat(F.array(gae), acc["out"]).alias("out"))

    return F.aggregate(F.reverse(step), start, fold, lambda acc: acc["out"])


def discounted(rewards: Column, mask: Column, gamma: float) -> Column:
    """Discounted returns of each step of an array; a masked step sets the running return back to 0 for those before it."""
    start = F.struct(F.lit(0.0).alias("run"), F.array().cast("array<double>").alias("out"))

    def fold(acc: Column, x: Column) -> Column:
        run = x["r"] + gamma * acc["run"]
        return F.struct((run * x["m"]).alias("run"), F.concat(F.array(run), acc["out"]).alias("out"))

    return F.aggregate(F.reverse(F.arrays_zip(rewards.alias("r"), mask.cast("array<double>").alias("m"))), start, fold, lambda acc: acc["out"])


def unflatten(df: DataFrame, sep: str = "/") -> DataFrame:
    """Columns named by paths as nested structs."""

    def build(paths: list[tuple[str, list[str]]]) -> list[Column]:
        heads: dict[str, list] = {}
        for full, path in paths:
            heads.setdefault(path[0], []).append((full, path[1:]))
        return [F.col(f"`{own[0][0]}`").alias(h) if len(own) == 1 and not own[0][1] else F.struct(*build(own)).alias(h) for h, own in heads.items()]

    return df.select(*build([(c, c.split(sep)) for c in df.columns]))


def cut(tokens: Column, most: int, how: str) -> Column:
    """A token array of at most `most`: from the right, the left, or (error) an error where it is longer."""
    if how == "error":
        return F.when(F.assert_true(F.size(tokens) <= most, "too many tokens").isNull(), tokens)
    return F.when(F.size(tokens) <= most, tokens).otherwise(F.slice(tokens, 1, most) if how == "right" else F.slice(tokens, F.size(tokens) - most + 1, most))


def box_fits(box: Column, width: Column, height: Column) -> Column:
    """Whether a box [x, y, w, h] overlaps the image, and is a pixel wide and high at least."""
    inside = lambda i, most: F.least(F.element_at(box, i) + F.element_at(box, i + 2), most) - F.greatest(F.element_at(box, i), F.lit(0))
    return (inside(1, width) > 0) & (inside(2, height) > 0) & (F.element_at(box, 3) >= 1) & (F.element_at(box, 4) >= 1)


def in_split(df: DataFrame, column: str, split: str, expected: int | None = None) -> DataFrame:
    """Rows of a split; none, or another number than expected, is an error."""
    out = df.filter(F.col(column) == split)
    n = out.agg(F.count("*").alias("_n"))
    fine = (F.col("_n") > 0) if expected is None else (F.col("_n") == expected)
    return out.crossJoin(F.broadcast(n.filter(F.assert_true(fine, f"split {split} has another number of rows").isNull()))).drop("_n")


def subset(df: DataFrame, keys: DataFrame, key: str, mode: str, n: int, seed: int = 7) -> DataFrame:
    """Rows of the keys, every one of which must be there: all, the first n by key, or n by hash."""
    k = keys.select(key).distinct().join(df.select(key, F.lit(True).alias("_there")).distinct(), key, "left")
    k = k.filter(F.assert_true(F.coalesce("_there", F.lit(False)), F.concat(F.lit("no row for "), F.col(key).cast("string"))).isNull()).drop("_there")
    out = df.join(k, key, "left_semi")
    if mode == "all":
        return out
    order = [F.col(key)] if mode == "first" else [F.md5(F.concat_ws("-", F.lit(str(seed)), F.col(key).cast("string")).cast("binary")), F.col(key)]
    return out.orderBy(*order).limit(n)
