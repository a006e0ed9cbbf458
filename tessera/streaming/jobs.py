"""Streams of keyed results: one row per key, failures tried again, running meters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.ordered import numbered_within

ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def first_of_each(stream: DataFrame, key: str, event_time: str | None = None, delay: str = "1 hour") -> DataFrame:
    """The first row of each key. With an event time, keys are forgotten once the watermark has passed them, so state stays
    bounded, and rows later than delay are left out; without one no row is too late, and all keys stay in the RocksDB state
    store, on disk, which this sets."""
    if event_time is None:
        stream.sparkSession.conf.set(*ROCKS)
        return stream.dropDuplicates([key])
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark([key])


def meters(stream: DataFrame, by: str, value: str) -> DataFrame:
    """Running sum, count and mean of value; its state is one row per value of by."""
    return stream.groupBy(by).agg(F.sum(value).alias("total"), F.count(value).alias("n"), F.avg(value).alias("mean"))


def windowed_meters(stream: DataFrame, event_time: str, by: str, value: str, width: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """The same per window of event time; late rows are taken up to delay."""
    return stream.withWatermark(event_time, delay).groupBy(F.window(event_time, width).alias("window"), by).agg(F.sum(value).alias("total"), F.count(value).alias("n"))


def write_all(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what is there to a parquet table and stop; run again, it resumes after what it has written."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).outputMode("append").start()


def pending(wanted: DataFrame, results: DataFrame, key: str, failed: str) -> DataFrame:
    """Rows of wanted without a result that succeeded; failed is a condition on results."""
    return wanted.join(results.filter(f"NOT coalesce({failed}, false)").select(key).distinct(), key, "left_anti")


def accumulated(stream: DataFrame, group: str, score: str, low: float, high: float, size: int, order: str, path: str, checkpoint: str, lanes: int = 1) -> StreamingQuery:
    """Batches of rollouts: rows of each micro-batch whose group's mean score is between low and high join those that wait;
    whenever `size` groups are there, the first of them (by `order`, then by group) go to path with their lane and batch, in a
    folder a micro-batch. Groups are dealt to lanes by hash; each lane fills batches of its own.

    Means, places and batches are made of a row per group, in ranges of the order, so that no task holds a lane. Between
    micro-batches a lane is a row: its batches so far and the fewer than `size` groups that wait. Their rows lie in the
    checkpoint, in the folder of the micro-batch that they came with, and aren't written again. A micro-batch that is run again
    starts from the lanes after the one before it and replaces what it had written."""

    def run(d: DataFrame, epoch: int) -> None:
        _accumulate(d, epoch, group, score, low, high, size, order, path, f"{checkpoint}/accumulated", lanes)

    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _accumulate(d: DataFrame, epoch: int, group: str, score: str, low: float, high: float, size: int, order: str, path: str, state: str, lanes: int) -> None:
    spark, c = d.sparkSession, F.col
    mean = c("_mean")
    groups = d.groupBy(c(group).alias("_group")).agg(F.avg(score).alias("_mean"), F.min(order).alias("_first")).filter((mean > low) & (mean < high))
    groups = groups.select(F.pmod(F.xxhash64("_group"), F.lit(lanes)).cast("int").alias("lane"), "_group", "_first", F.array(F.lit(epoch).cast("long")).alias("_epochs"))
    last = spark.read.parquet(f"{state}/lanes/{epoch - 1}") if epoch else None
    if last is not None:
        held = last.select("lane", F.explode("_waiting").alias("_w")).select("lane", "_w.*")
        groups = groups.unionByName(held).groupBy("lane", "_group").agg(F.min("_first").alias("_first"), F.flatten(F.collect_list("_epochs")).alias("_epochs"))
    groups = groups.persist()
    at = numbered_within(groups, ["lane"], ["_first", "_group"], "_at")
    ends = groups.groupBy("lane").agg(F.count("*").alias("_n"))
    ends = ends.withColumn("_done", F.lit(0).cast("long")) if last is None else ends.join(last.select("lane", "_done"), "lane", "left").fillna(0, ["_done"])
    placed = at.join(F.broadcast(ends), "lane").withColumn("batch", F.when(c("_at") < c("_n") - c("_n") % size, c("_done") + F.floor(c("_at") / size)).cast("long"))
    placed = placed.select("lane", "_group", "_first", "_epochs", "batch")

    new = d.join(placed.filter(F.array_contains("_epochs", epoch)), c(group).eqNullSafe(c("_group"))).select(*d.columns, "lane", "batch")
    new.filter("batch IS NULL").select(*d.columns).write.mode("overwrite").parquet(f"{state}/rows/_epoch={epoch}")
    out = new.filter("batch IS NOT NULL")
    if epochs := [] if last is None else [r[0] for r in held.select(F.explode("_epochs")).distinct().collect()]:
        rows = spark.read.schema(StructType([*d.schema.fields, StructField("_epoch", LongType())])).option("basePath", f"{state}/rows").parquet(*(f"{state}/rows/_epoch={e}" for e in epochs))
        gone = placed.filter("batch IS NOT NULL").withColumn("_from", F.explode("_epochs"))
        out = out.unionByName(rows.join(gone, c(group).eqNullSafe(c("_group")) & (c("_epoch") == c("_from"))).select(*d.columns, "lane", "batch"))
    out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    after = placed.groupBy("lane").agg((F.max("batch") + 1).alias("_done"), F.collect_list(F.when(c("batch").isNull(), F.struct("_group", "_first", "_epochs"))).alias("_waiting"))
    if last is not None:
        after = after.join(last.select("lane", c("_done").alias("_before")), "lane", "full").select("lane", F.coalesce("_done", "_before").alias("_done"), F.coalesce("_waiting", F.array()).alias("_waiting"))
    after.fillna(0, ["_done"]).write.mode("overwrite").parquet(f"{state}/lanes/{epoch}")
    groups.unpersist()


def retried(results: DataFrame, key: str, at: str, failed: str) -> DataFrame:
    """The latest result of each key that didn't fail: what failed is left out and so is asked for again."""
    rest = [c for c in results.columns if c not in (key, at)]
    last = results.groupBy(key).agg(F.max(F.struct(at, *rest)).alias("_r")).select(key, F.col(f"_r.{at}").alias(at), *(F.col(f"_r.{c}").alias(c) for c in rest))
    return last.filter(f"NOT coalesce({failed}, false)")
