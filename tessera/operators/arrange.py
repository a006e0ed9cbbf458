"""Rows by position: numbers over a whole table without a global window, slices, shards, chunks, repeats, padding."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered, numbered_within


def total(df: DataFrame) -> DataFrame:
    """(n): the number of rows, one row to join."""
    return df.agg(F.count("*").alias("_total"))


def sliced(df: DataFrame, order: list[str], start: int, end: int, step: int = 1) -> DataFrame:
    at = F.col("_at")
    return numbered(df, order, "_at").filter((at >= start) & (at < end) & ((at - start) % step == 0)).drop("_at")


def strided(df: DataFrame, index: str, rank: int, world: int) -> DataFrame:
    return df.filter(F.pmod(F.col(index), F.lit(world)) == rank)


def block(df: DataFrame, order: list[str], rank: int, size: int) -> DataFrame:
    return sliced(df, order, rank * size, (rank + 1) * size)


def chunked(df: DataFrame, order: list[str], chunks: int, out: str = "chunk") -> DataFrame:
    """df cut into chunks of one size, an error (when run) if the rows don't divide."""
    d = numbered(df, order, "_at", total="_total")
    even = F.assert_true(F.col("_total") % chunks == 0, f"rows can't be cut into {chunks} equal chunks")
    return d.withColumn(out, F.floor(F.col("_at") / (F.col("_total") / chunks)).cast("int")).filter(even.isNull()).drop("_at", "_total")


def spread(df: DataFrame, order: list[str], chunks: int, out: str = "chunk") -> DataFrame:
    """df cut into chunks that differ by one row at most."""
    return numbered(df, order, "_at", total="_total").withColumn(out, F.floor(F.col("_at") * chunks / F.col("_total")).cast("int")).drop("_at", "_total")


def folded(df: DataFrame, order: list[str], rows: int, value: str) -> DataFrame:
    """(row, values): `rows` consecutive rows as one, in order; the batch must divide into them."""
    d = numbered(df, order, "_at").withColumn("row", F.floor(F.col("_at") / rows))
    return d.groupBy("row").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", value))), lambda s: s[value]).alias("values"))


def repeated(df: DataFrame, order: list[str], times: int, interleaved: str | None = None, tiled: str | None = None) -> DataFrame:
    """df `times` over with the copy's number and, where named, its positions: a a b b (interleaved) and a b a b (tiled). Both
    come from one numbering."""
    d = numbered(df, order, "_at", total="_total").withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    places = {interleaved: F.col("_at") * times + F.col("copy"), tiled: F.col("copy") * F.col("_total") + F.col("_at")}
    return d.withColumns({k: x.cast("long") for k, x in places.items() if k}).drop("_at", "_total")


def padded(df: DataFrame, order: list[str], divisor: int, out: str = "pos") -> DataFrame:
    """df with rows added from its head, again and again, until the divisor divides; added rows have positions from n on."""
    d = numbered(df, order, out, total="_total")
    need = F.pmod(-F.col("_total"), F.lit(divisor))
    turns = F.when(need > F.col(out), F.ceil((need - F.col(out)) / F.col("_total"))).otherwise(0).cast("int")
    return d.withColumn("_turn", F.explode(F.sequence(F.lit(0), turns))).withColumn(out, F.col(out) + F.col("_turn") * F.col("_total")).drop("_turn", "_total")


def round_robin(df: DataFrame, shard: str, order: str, out: str = "pos", size: int | None = None) -> DataFrame:
    """Rows of the shards in turn, each shard's by its order; the first `size` of them."""
    d = numbered(numbered_within(df, [shard], [order], "_place"), ["_place", shard], out).drop("_place")
    return d if size is None else d.filter(F.col(out) < size)


def inverse(df: DataFrame, index: str, order: list[str]) -> DataFrame:
    """(from_pos, to_pos) of a permutation: the row at position i goes to index i; its inverse gives i at that index."""
    return numbered(df.select(index, *[c for c in order if c != index]), order, "from_pos").select("from_pos", F.col(index).alias("to_pos"))


def tertiles(df: DataFrame, order: list[str], out: str = "tertile", groups: int = 3) -> DataFrame:
    """min(groups - 1, rank * groups // n) by the order."""
    d = numbered(df, order, "_at", total="_total")
    return d.withColumn(out, F.least(F.lit(groups - 1), F.floor(F.col("_at") * groups / F.col("_total"))).cast("int")).drop("_at", "_total")


def reindexed(parts: list[DataFrame], key: str) -> DataFrame:
    """The parts one after another: part, original_index, and index from 0 over all."""
    u = None
    for k, p in enumerate(parts):
        x = p.select(F.lit(k).alias("part"), F.col(key).cast("long").alias("original_index"))
        u = x if u is None else u.unionByName(x)
    return numbered(u, ["part", "original_index"], "new_index")


def offset(df: DataFrame, index: str, least: int = 1_000_000) -> DataFrame:
    """(off): the least power of ten from `least` on that is over every index."""
    return df.agg(F.max(index).alias("m")).select(F.greatest(F.lit(least), F.pow(F.lit(10), F.length(F.col("m").cast("string")))).cast("long").alias("off"))


def circular(df: DataFrame, index: str, options: list[str], answer: str, off: int) -> DataFrame:
    """Each question once for every rotation of its options (those that are there, in order): index + turn * off, base, the
    options turned by one place a time, and the letter that the answer has then. Questions whose last option speaks of the
    others keep it last: they turn by one option fewer."""
    n = F.size(F.filter(F.array(*options), lambda x: x.isNotNull()))
    last = F.lower(F.element_at(F.filter(F.array(*options), lambda x: x.isNotNull()), -1))
    fixed = last.rlike(r"(all|none|both|neither|any) of|(^| )(above|other)( |\.|$)|not given")
    k = F.when(fixed & (n > 2), n - 1).otherwise(n)
    d = df.withColumns({"_n": n, "_k": k}).withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("_k") - 1)))
    letters = F.array(*(F.lit(c) for c in options))
    place = F.array_position(letters, F.col(answer)).cast("int") - 1
    source = lambda i: F.when(F.lit(i) < F.col("_k"), (F.lit(i) + F.col("turn")) % F.col("_k")).otherwise(F.lit(i))
    turned = [F.when(F.lit(i) < F.col("_n"), F.get(F.array(*options), source(i))).alias(c) for i, c in enumerate(options)]
    now = F.when(place < F.col("_k"), F.pmod(place - F.col("turn"), F.col("_k"))).otherwise(place)
    return d.select((F.col(index) + F.col("turn").cast("long") * off).alias(index), F.col(index).alias("base"), *turned, F.get(letters, now.cast("int")).alias(answer))


def circular_valid(df: DataFrame, base: str, k: str, order: str, options: int = 4) -> DataFrame:
    """(base, valid): whether each answer's place is one after the one before it, around `options`."""
    w = Window.partitionBy(base).orderBy(k)
    step = df.withColumn("_s", F.pmod(F.col(order) - F.lag(order).over(w), F.lit(options)))
    return step.groupBy(base).agg(F.bool_and(F.coalesce(F.col("_s") == 1, F.lit(True))).alias("valid"))


def refetched(df: DataFrame, ok: Column, order: list[str], seed: int = 7, tries: int = 5) -> DataFrame:
    """df where each row that isn't ok is replaced by a good one, picked by MD5 of its position, the try and the seed; after
    `tries` picks that aren't good it is left out. `pos` is the position of the replaced row, `picked` that of what it has."""
    d = numbered(df, order, "_at", total="_total").withColumn("_ok", F.coalesce(ok, F.lit(False)))
    bad = d.filter(~F.col("_ok")).select("_at", "_total").withColumn("_try", F.explode(F.sequence(F.lit(1), F.lit(tries))))
    draw = F.conv(F.substring(F.md5(F.concat_ws("-", "_at", "_try", F.lit(seed)).cast("binary")), 1, 8), 16, 10).cast("long")
    bad = bad.select("_at", "_try", (draw % F.col("_total")).alias("picked"))
    good = d.filter("_ok").drop("_ok", "_total").withColumnRenamed("_at", "picked")
    first = bad.join(good.select("picked"), "picked").groupBy("_at").agg(F.min_by("picked", "_try").alias("picked"))
    own = d.filter("_ok").drop("_ok", "_total").withColumn("picked", F.col("_at"))
    return own.unionByName(first.join(good, "picked")).withColumnRenamed("_at", "pos")
