"""Best-fit packing of token sequences, planned over the histogram of lengths and not over documents.

Pieces of one length are alike, so best-fit in descending length is worked out for counts: sequences that are filled alike
are one range of sequence numbers. The plan has as many rows as lengths and ranges allow, however many documents there are,
and pieces take its slots by joining on their rank within their length.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches
from .encode import default_tokenizer, encoder, ended, gathered

CAPACITY = 2048
END_ID = 0
PIECES = "doc_id long, piece int, start long, length long, ids binary, part int, place long"
PLAN = "length long, lo long, hi long, per_sequence long, first_sequence long, first_offset long"


def plan(counts: Mapping[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int, int]], int]:
    """(rows of PLAN, number of sequences): best-fit in descending length for so many pieces of each length.

    Pieces lo to hi - 1 of a length go into the sequences from first_sequence on, per_sequence in each, the first at
    first_offset. Among open sequences those with the least room that fits come first; no other order of the pieces within a
    length would give another plan, as they are alike."""
    rows, rooms, opened = [], [], 0
    by_room: dict[int, list[tuple[int, int]]] = {}  # room left -> ranges (first sequence, how many)

    def put(room: int, first: int, n: int) -> None:
        if room and n:
            if not by_room.get(room):
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((first, n))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"a piece of {length} doesn't fit {capacity}")
        left, rank = counts[length], 0
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = by_room[room].pop()
                if not by_room[room]:
                    rooms.pop(at)
            else:
                room, first = capacity, opened
                n = -(-left // (capacity // length))
                opened += n
            each = room // length
            for take, per in ((min(n, left // each), each), (1, left % each)):
                if take and per and n and left and (per == each or left < each):
                    rows.append((length, rank, rank + take * per, per, first, capacity - room))
                    put(room - per * length, first, take)
                    first, n, left, rank = first + take, n - take, left - take * per, rank + take * per
            put(room, first, n)
    return rows, opened


def pieces(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Every document's ids and the end id, cut where they are over the capacity: doc_id, piece, start, length, ids (unsigned
    32 bits each, little-endian), and part and place (the piece's place among those of its length in its part).

    Only the first piece of a document that is cut may be shorter than the capacity. A null text is empty (the end id
    alone); a null doc_id is kept; repeated rows are each packed; texts of any length are encoded whole; other columns are not
    read, whatever their names. The table is written once: places count the rows of a task as it wrote them.
    """
    path = tokenizer or default_tokenizer()
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, part, seen = encoder(path), TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in gathered(batches):
            ids, lengths = ended(*enc.encode(b.column("text")), end_id)
            n = -(-lengths // capacity)
            doc = np.repeat(np.arange(len(n)), n)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
            head = lengths - (n - 1) * capacity
            size = np.where(piece == 0, head[doc], capacity)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * capacity)
            order = np.argsort(size, kind="stable")
            runs = np.flatnonzero(np.diff(size[order], prepend=-1))
            place = np.empty(len(size), np.int64)
            place[order] = np.arange(len(size)) - np.repeat(runs, np.diff(runs, append=len(size))) + seen[size[order]]
            seen += np.bincount(size, minlength=capacity + 1)
            offsets = np.concatenate([[0], np.cumsum(size)]) * 4
            raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(ids.astype("<u4"))])
            cols = [b.column("doc_id").take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start), pa.array(size), raw.cast(pa.binary()), pa.array(np.full(len(size), part, np.int32)), pa.array(place)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "piece", "start", "length", "ids", "part", "place"])

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    return materialize(given.mapInArrow(lean(run), PIECES), "pieces")


def placed(cut: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """What pieces() gave (with more or fewer columns beside length, part and place), with sequence_id and offset.

    The driver sees a row per length, the plan's rows are bounded by the capacity alone, and ranks within a length come from
    the places within parts and a running count over parts, so a length that most pieces have is in no single task."""
    spark = cut.sparkSession
    each = cut.groupBy("part", "length").agg(F.count("*").alias("_n"))
    counts = {r["length"]: r["n"] for r in each.groupBy("length").agg(F.sum("_n").alias("n")).toLocalIterator()}
    rows, _ = plan(counts, capacity)
    over = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = each.select("part", "length", F.coalesce(F.sum("_n").over(over), F.lit(0)).alias("_before"))
    ranked = cut.join(before, ["part", "length"]).withColumn("_rank", F.col("place") + F.col("_before"))
    slots = F.broadcast(spark.createDataFrame(rows, PLAN).withColumnRenamed("length", "_length"))
    at = ranked.join(slots, (F.col("length") == F.col("_length")) & (F.col("_rank") >= F.col("lo")) & (F.col("_rank") < F.col("hi")))
    nth = F.col("_rank") - F.col("lo")
    return at.withColumns({"sequence_id": F.col("first_sequence") + F.floor(nth / F.col("per_sequence")), "offset": F.col("first_offset") + nth % F.col("per_sequence") * F.col("length")}).select(*(c for c in cut.columns if c not in ("part", "place")), "sequence_id", "offset")


def pack(docs: DataFrame, capacity: int = CAPACITY, tokenizer: str | None = None, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids, sequence_id, offset) of every piece; see pieces() for nulls, long texts, repeats
    and other columns. An empty table gives no rows."""
    return placed(pieces(docs, capacity, tokenizer, end_id), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, ids): the packed sequences themselves, from rows of pack(); one is at most the capacity long."""
    parts = F.transform(F.array_sort(F.collect_list(F.struct("offset", "ids"))), lambda p: p["ids"])
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), F.aggregate(parts, F.lit(b""), lambda a, b: F.concat(a, b)).alias("ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents in sequences of 2048 tokens; the checksum is of the ids that the operator wrote."""
    cut = pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return placed(cut.withColumn("ids_crc32", F.crc32("ids")).drop("ids")).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
