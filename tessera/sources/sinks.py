"""Results written out: shards of a fixed size, keyed checkpoints, summaries, submissions, predictions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.arrange import numbered


def sharded(df: DataFrame, order: list[str], rows: int = 10_000, name: str = "part") -> DataFrame:
    """df with `shard`: name-00000 and on, so many rows in order in each."""
    return numbered(df, order, "_at").withColumn("shard", F.format_string(f"{name}-%05d", F.floor(F.col("_at") / rows))).drop("_at")


def write_shards(df: DataFrame, path: str, order: list[str], rows: int = 10_000, name: str = "part") -> None:
    """A folder per shard, as JSON lines."""
    sharded(df, order, rows, name).write.partitionBy("shard").json(path)


def save_results(results: DataFrame, path: str, key: str) -> None:
    """Add results to a table of checkpoints: key, the row as JSON, and when; nothing is read or locked."""
    row = F.to_json(F.struct(*(c for c in results.columns if c != key)))
    results.select(F.col(key).cast("string").alias("key"), row.alias("row"), F.current_timestamp().alias("at")).write.mode("append").parquet(path)


def saved_results(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The last result of each key."""
    last = spark.read.parquet(path).groupBy("key").agg(F.max(F.struct("at", "row")).alias("_r"))
    return last.select("key", F.from_json("_r.row", schema).alias("row")).select("key", "row.*")


def number_text(value: Column) -> Column:
    """A double in the fewest digits that give it back, as Python writes it: 10000000.0, 0.0001, 1e-05, 1e+16."""
    text = value.cast("string")
    power = F.regexp_extract(text, r"E(-?\d+)$", 1).try_cast("int")
    plain = F.regexp_replace(text.try_cast("decimal(38,21)").cast("string"), r"(\.\d+?)0*$", "$1")
    digits = F.regexp_replace(F.substring_index(text, "E", 1), r"\.0$", "")
    spelt = F.concat(digits, F.when(power < 0, "e-").otherwise("e+"), F.lpad(F.abs(power).cast("string"), F.greatest(F.length(F.abs(power).cast("string")), F.lit(2)), F.lit("0")))
    return F.when(power.between(-4, 15), plain).when(power.isNotNull(), spelt).when(F.isnan(value), "nan").otherwise(F.replace(text, F.lit("Infinity"), F.lit("inf")))


def metric_rows(summary: DataFrame, by: list[str]) -> DataFrame:
    """(by, metric, value): a row per metric, without those that are null."""
    names = sorted(c for c in summary.columns if c not in by)
    return summary.unpivot(by, [F.col(c).cast("double").alias(c) for c in names], "metric", "value").filter("value is not null")


def canonical(df: DataFrame, columns: list[str]) -> DataFrame:
    """(line): rows as JSON with sorted keys, nulls written out."""
    return df.select(F.to_json(F.struct(*(F.col(c) for c in sorted(columns))), {"ignoreNullFields": "false"}).alias("line"))


def write_summary(rows: DataFrame, summary: DataFrame, path: str, by: list[str]) -> None:
    """results (a line per row, keys sorted), summary (JSON) and metrics (CSV of metric and value) below a folder."""
    canonical(rows, rows.columns).write.text(f"{path}/results")
    summary.write.option("ignoreNullFields", "false").json(f"{path}/summary")
    metric_rows(summary, by).withColumn("value", number_text(F.col("value"))).write.option("header", "true").csv(f"{path}/metrics")


def submission(df: DataFrame, index: str, answer: str) -> DataFrame:
    """One JSON object of index -> answer in index order: a submission file, whose rows meet in one task."""
    e = F.transform(F.array_sort(F.collect_list(F.struct(index, answer))), lambda s: F.struct(s[index].cast("string").alias("k"), s[answer].alias("v")))
    return df.agg(F.to_json(F.map_from_entries(e)).alias("submission"))


def predictions(df: DataFrame, image: str, masks: str, scores: Column | None = None) -> DataFrame:
    """(image_id, category_id, segmentation, score) as JSON lines, a row per mask of an image."""
    e = df.select(F.col(image).alias("image_id"), F.posexplode(masks).alias("_i", "_m"), *([scores.alias("_s")] if scores is not None else []))
    score = F.get("_s", F.col("_i")) if scores is not None else F.lit(1.0)
    return e.select("image_id", F.col("_i").alias("place"), F.to_json(F.struct("image_id", F.lit(1).alias("category_id"), F.col("_m").alias("segmentation"), score.alias("score"))).alias("line"))
