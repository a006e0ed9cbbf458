"""Positions, running sums and order statistics, over a whole table or within keys, without a task that holds a key's rows.

Rows are range-partitioned by the order and written once, so that bounds are the same whoever reads them; what remains is a
row per part (and key) to add up.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import scratch

_ROW_BITS = 33  # monotonically_increasing_id() has the partition above these bits and the row's place in it below


def laid_out(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """df in ranges of the order (nulls first), written, with `__part` (the range, ascending) and `__at` (the row's place in it)."""
    spark = df.sparkSession
    n = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    d = df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("__row", F.monotonically_increasing_id())
    path = scratch(spark, "ordered")
    d.write.parquet(path)
    row = F.col("__row")
    return spark.read.schema(d.schema).parquet(path).withColumns({"__part": F.shiftright(row, _ROW_BITS).cast("int"), "__at": row.bitwiseAND((1 << _ROW_BITS) - 1)}).drop("__row")


def numbered(df: DataFrame, order: Sequence[str], out: str = "pos", parts: int | None = None, total: str | None = None) -> DataFrame:
    """df with each row's position in the order, from 0; nulls come first, rows that the order doesn't tell apart in some
    order. total: a column for the number of rows. The table is evaluated once to be laid out (and sampled for the bounds);
    the offsets are a row per range."""
    d = laid_out(df, order, parts)
    sizes = d.groupBy("__part").agg(F.count("*").alias("_n"))
    before = sizes.select(F.col("__part").alias("__range"), F.coalesce(F.sum("_n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("_n").over(Window.partitionBy()).alias(total or "__total"))
    return d.join(F.broadcast(before), F.col("__part") == F.col("__range")).withColumn(out, F.col("__at") + F.col("__before")).drop("__part", "__at", "__range", "__before", "__total")


def _same(by: Sequence[str]) -> Column:
    cond = F.col("__part") == F.col("__part2")
    for k, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    return cond


def _with_earlier(d: DataFrame, by: Sequence[str], sums: Mapping[str, Column]) -> DataFrame:
    """d (laid out by `by` first) with, for each name, the sum over the same key's rows in earlier parts; a key's rows in one
    part are one row to add up."""
    here = d.groupBy("__part", *by).agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    w = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    names = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    earlier = here.select(F.col("__part").alias("__part2"), *names, *(F.coalesce(F.sum(n).over(w), F.lit(0)).alias(n) for n in sums))
    return d.join(earlier, _same(by)).drop("__part2", *(f"_by{k}" for k in range(len(by))))


def numbered_within(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str = "pos", parts: int | None = None) -> DataFrame:
    """df with each row's position, from 0, among the rows of its key (nulls are a key), in the order."""
    d = laid_out(df, [*by, *order], parts)
    place = F.row_number().over(Window.partitionBy("__part", *by).orderBy("__at")) - 1
    return _with_earlier(d, by, {"__before": F.lit(1)}).withColumn(out, (place + F.col("__before")).cast("long")).drop("__part", "__at", "__before")


def running(df: DataFrame, by: Sequence[str], order: Sequence[str], sums: Mapping[str, str], parts: int | None = None) -> DataFrame:
    """df with a column for each of sums (name: column): the sum over the key's rows up to this one, in the order."""
    d = laid_out(df, [*by, *order], parts)
    w = Window.partitionBy("__part", *by).orderBy("__at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = _with_earlier(d, by, {f"_before_{n}": F.col(x) for n, x in sums.items()})
    return d.withColumns({n: F.sum(x).over(w) + F.col(f"_before_{n}") for n, x in sums.items()}).drop("__part", "__at", *(f"_before_{n}" for n in sums))


def quantiles(df: DataFrame, by: Sequence[str], value: str, at: Mapping[str, float]) -> DataFrame:
    """(by..., a column for each of `at`): exact quantiles of the values that aren't null, interpolated linearly between the
    two nearest ranks. Values are counted first; a running count over the distinct ones tells which hold the ranks, so
    equal values are one row and no task holds a key's values. A key without values isn't returned."""
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg(F.count("*").alias("_c"))
    upto = running(counts, by, ["_v"], {"_upto": "_c"})
    names = [F.col(c).alias(f"_by{k}") for k, c in enumerate(by)]
    total = upto.groupBy(*by).agg(F.max("_upto").alias("_n"))
    cond = F.lit(True)
    for k, c in enumerate(by):
        cond = cond & F.col(c).eqNullSafe(F.col(f"_by{k}"))
    d = upto.join(total.select(*names, "_n"), cond)
    cells = []
    for name, q in at.items():
        place = F.lit(float(q)) * (F.col("_n") - 1)
        for side, rank in (("lo", F.floor(place)), ("hi", F.ceil(place))):
            cells.append(F.max(F.when((rank >= F.col("_upto") - F.col("_c")) & (rank < F.col("_upto")), F.col("_v"))).alias(f"_{side}_{name}"))
    found = d.groupBy(*by).agg(F.max("_n").alias("_n"), *cells)

    def between(name: str, q: float) -> Column:
        place = F.lit(float(q)) * (F.col("_n") - 1)
        low, high = F.col(f"_lo_{name}").cast("double"), F.col(f"_hi_{name}").cast("double")
        return F.when(F.floor(place) == F.ceil(place), low).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high).alias(name)

    return found.select(*by, *(between(n, q) for n, q in at.items()))
