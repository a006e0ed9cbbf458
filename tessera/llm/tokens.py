"""Token-ID output: whole texts to ids by the tokenizers library, ids to Simple-8b files in doc_id order, and back."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, AtomicFile, fresh_path, lean, materialize, open_range, partitions, small_batches
from .encode import default_tokenizer, encoder, ended, gathered
from .simple8b import pack_segment, read_segments

END_ID = 2
SEGMENT_IDS = 1 << 19
FILES = "file long, path string, n_docs long, n_ids long"


def write_tokens(docs: DataFrame, out: str, tokenizer: str | None = None, end_id: int = END_ID, parts: int | None = None) -> DataFrame:
    """Write every document's ids, each ended by end_id, to Simple-8b files under out, ascending by doc_id.

    Documents are range-partitioned by doc_id; a partition writes one file, renamed into place when whole. Returns the
    files as a written table (file, path, n_docs, n_ids): the table names the files that count, so a task run twice does
    no harm. A null text is empty (the end id alone); a null doc_id is kept and sorts first; repeated rows are each
    written, in order of their texts; other columns are not read. An empty table gives no files.
    """
    path = tokenizer or default_tokenizer()
    spark = docs.sparkSession
    small_batches(spark)
    n = parts or partitions(spark)
    ordered = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text").withColumn("file", F.spark_partition_id())

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, f, totals = encoder(path), None, [0, 0]
        for b in gathered(batches):
            if f is None:
                file = b.column("file")[0].as_py()
                f = AtomicFile(name := f"{out}/ids-{file:06d}.s8b")
            ids, lengths = ended(*enc.encode(b.column("text")), end_id)
            doc_ids, ends = b.column("doc_id").to_numpy(), np.cumsum(lengths)
            cuts = np.unique(np.append(np.searchsorted(ends, np.arange(SEGMENT_IDS, ends[-1], SEGMENT_IDS)), len(lengths)))
            lo = 0
            for hi in cuts[cuts > 0].tolist():
                f.write(pack_segment(doc_ids[lo:hi], lengths[lo:hi], ids[ends[lo] - lengths[lo] : ends[hi - 1]]))
                lo = hi
            totals[0] += len(lengths)
            totals[1] += len(ids)
        if f is not None:
            f.commit()
            yield pa.RecordBatch.from_pydict({"file": [file], "path": [name], "n_docs": [totals[0]], "n_ids": [totals[1]]})

    return materialize(ordered.mapInArrow(lean(write), FILES), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """One row per document from the files of write_tokens: doc_id, start, n_tokens, ids_crc32. start counts the ids of
    all documents before it; the files' starts come from their totals (one row per file)."""
    spark = files.sparkSession
    listed = sorted((r.file, r.path, r.n_ids) for r in files.select("file", "path", "n_ids").toLocalIterator())
    starts, at = [], 0
    for _, path, n in listed:
        starts.append((path, at))
        at += n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long"
    if not starts:
        return spark.createDataFrame([], schema)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for path, start in zip(b["path"], b["start"], strict=True):
                with open_range(path) as f:
                    for doc_ids, lengths, ids in read_segments(f):
                        ends = np.cumsum(lengths)
                        raw = memoryview(ids.astype("<u4").tobytes())
                        crc = [zlib.crc32(raw[4 * (e - k) : 4 * e]) for e, k in zip(ends.tolist(), lengths.tolist(), strict=True)]
                        known = pd.array(doc_ids, dtype="Int64")
                        known[doc_ids == NULL_ID] = pd.NA
                        yield pd.DataFrame({"doc_id": known, "start": start + ends - lengths, "n_tokens": lengths, "ids_crc32": crc})
                        start += int(ends[-1])

    return spark.createDataFrame(starts, "path string, start long").repartition(min(len(starts), 4096)).mapInPandas(lean(read), schema)


def token_output(docs: DataFrame, out: str | None = None, **kw) -> DataFrame:
    """write_tokens, then read_tokens."""
    return read_tokens(write_tokens(docs, out or fresh_path(docs.sparkSession, "tokens"), **kw))


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(spark.read.parquet(f"{sf_dir}/documents.parquet"))
