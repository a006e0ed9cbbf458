"""Exact removal of byte strings of LENGTH bytes that start in more than one place, by suffix arrays.

A window is a string of LENGTH bytes. Its anchor is its GRAM bytes of the smallest hash (the leftmost of equal ones), so
equal windows have equal anchors at equal offsets, and the windows of one anchor position are a run, the span. Only spans
whose anchor occurs twice can hold repeats, and spans equal as a whole need no sorting. The distinct rest is sharded by
anchor; each shard's bytes are sorted into a suffix array by Larsson-Sadakane refinement, Kasai's common prefixes tell
which windows are equal, and an anchor with more than MANY distinct spans, which is spread over shards, is merged across
them by binary search among the sorted 128-bit fingerprints of its windows. This filter loses nothing: equal windows meet.
Spans are told apart by 128 bits too (64 of the anchor, 64 of the whole): over 10^14 windows two different ones share a
fingerprint with probability below 10^-10.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, lean, materialize, partitions, small_batches

LENGTH = 400
GRAM = 32
BLOCK = 1 << 19  # starts judged at once in a long text; positions in a block need 20 bits
MANY = 512
SHARD_BYTES = 600_000  # a shard ends with the anchor that takes it beyond this, before PACKED but for very long anchors
PACKED = 1 << 20  # positions of a shard whose (group, next group, place) fit one 64-bit number
_POS = np.uint64((1 << 20) - 1)
_P = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]


def eights(b: np.ndarray) -> np.ndarray:
    """The 8 bytes at each position as a little-endian number (zeros beyond the end)."""
    x = np.zeros(len(b) + 7, dtype=np.uint64)
    x[: len(b)] = b
    for n in (1, 2, 4):
        x = x[:-n] | (x[n:] << np.uint64(8 * n))
    return x


def spans(text: bytes, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first start, last start, anchor position, anchor hash) of each run of windows with one anchor."""
    out = []
    for lo in range(0, max(0, len(text) - length + 1), BLOCK):
        part = np.frombuffer(text[lo : lo + BLOCK + length - 1], np.uint8)
        u = eights(part)
        n = len(part) - gram + 1
        h = u[:n] * _P[0]
        for i in range(8, gram, 8):
            h += u[i : i + n] * _P[i // 8]
        h ^= h >> np.uint64(32)
        h *= _P[4]
        h ^= h >> np.uint64(29)
        m = (h & ~_POS) | np.arange(n, dtype=np.uint64)
        width, have = length - gram + 1, 1
        while have < width:
            step = min(have, width - have)
            m = np.minimum(m[: len(m) - step], m[step:])
            have += step
        p = (m & _POS).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]]))
        last = np.append(first[1:], len(p)) - 1
        out.append((first + lo, last + lo, p[first] + lo, h[p[first]]))
    if not out:
        z = np.zeros(0, np.int64)
        return z, z, z, z.astype(np.uint64)
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def suffix_array(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(suffix array, 8-byte numbers, start of each text, end of each text) of the texts one after another, each
    followed by a terminator of its own, smaller than all bytes and ordered by text."""
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 1) - size - 1
    end = start + size
    n = int(end[-1]) + 1
    data = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    small = np.int32 if n < 1 << 31 else np.int64
    stop = np.repeat(end.astype(small), size + 1)
    u = eights(data)
    left = np.minimum(stop - np.arange(n), 8).astype(np.uint64) * np.uint64(8)
    key = u & np.where(left < 64, (np.uint64(1) << (left % np.uint64(64))) - np.uint64(1), ~np.uint64(0))
    key = key.byteswap()  # compare as byte strings
    sa = np.argsort(key).astype(small)
    # terminators first, by text
    is_end = np.zeros(n, dtype=bool)
    is_end[end] = True
    sa = np.concatenate([end.astype(small), sa[~is_end[sa]]])
    k = key[sa]
    head = np.concatenate([[True], k[1:] != k[:-1]])
    head[: len(texts) + 1] = True
    group = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    rank = np.empty(n, dtype=small)
    rank[sa] = group
    h = 8
    todo = np.flatnonzero(~(head & np.append(head[1:], True)))  # places of the suffix array in groups of several
    while len(todo):
        s = sa[todo]
        g = rank[s]
        second = rank[np.minimum(s + small(h), stop[s])]
        if n <= PACKED:
            packed = (g.astype(np.int64) << 40) | (second.astype(np.int64) << 20) | np.arange(len(s))
            packed.sort()
            order, pair = packed & (PACKED - 1), packed >> 20
            new = np.concatenate([[True], pair[1:] != pair[:-1]])
        else:
            order = np.lexsort((second, g))
            g, second = g[order], second[order]
            new = np.concatenate([[True], (g[1:] != g[:-1]) | (second[1:] != second[:-1])])
        s = s[order]
        sa[todo] = s
        rank[s] = todo[np.maximum.accumulate(np.where(new, np.arange(len(todo)), 0))]
        todo = todo[~(new & np.append(new[1:], True))]
        h *= 2
    return sa, u, start, end


def common_prefixes(sa: np.ndarray, u: np.ndarray, start: np.ndarray, end: np.ndarray, cap: int) -> tuple[np.ndarray, np.ndarray]:
    """(before, lcp) for each position that has cap bytes left in its text: the suffix before its own in the array and
    their common prefix, up to cap. Kasai's walk, all texts a position at a time: the prefix shrinks by one at most."""
    n = len(sa)
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    most = np.minimum(cap, np.repeat(end, np.diff(np.append(start, n)))[before] - before)
    most[before < 0] = 0
    lcp = np.zeros(n, dtype=np.int64)
    order = np.argsort(start - end, kind="stable")
    start, end = start[order], end[order]
    carry = np.zeros(len(start), dtype=np.int64)
    many = end - start - cap
    live_texts = np.searchsorted(-many, -np.arange(int(many[0]) + 1 if len(many) and many[0] >= 0 else 0), side="right").tolist()
    for t, a in enumerate(live_texts):
        i = start[:a] + t
        j, top = before[i], most[i]
        h = np.minimum(np.maximum(carry[:a] - 1, 0), top)
        live = np.flatnonzero(h < top)
        while len(live):
            x = u[i[live] + h[live]] ^ u[j[live] + h[live]]
            differ = x.view(np.uint8).reshape(-1, 8) != 0
            same = x == 0
            h[live] = np.minimum(h[live] + np.where(same, 8, differ.argmax(1)), top[live])
            live = live[same & (h[live] < top[live])]
        lcp[i] = h
        carry[:a] = h
    return before, lcp


def repeated_starts(texts: list[bytes], length: int = LENGTH) -> list[np.ndarray]:
    """For each text a flag per window start: the window also starts elsewhere among the texts."""
    sa, u, start, end = suffix_array(texts)
    before, lcp = common_prefixes(sa, u, start, end, length)
    hit = np.zeros(len(sa), dtype=bool)
    i = np.flatnonzero(lcp >= length)
    hit[i] = True
    hit[before[i]] = True
    return [hit[s : max(s, e - length + 1)] for s, e in zip(start.tolist(), end.tolist(), strict=True)]


def _runs(flags: np.ndarray, base: int) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return [(base + int(a), base + int(b) - 1) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def fingerprints(text: bytes, length: int = LENGTH) -> np.ndarray:
    """(windows, 2): 128 bits of each window."""
    view = memoryview(text)
    return np.frombuffer(b"".join([xxhash.xxh3_128_digest(view[i : i + length]) for i in range(len(text) - length + 1)]), np.uint64).reshape(-1, 2)


def repeats(docs: DataFrame, length: int = LENGTH, many: int = MANY) -> DataFrame:
    """(doc_id, th, lo, hi): runs of window starts that are repeated; th tells texts under one doc_id apart. docs has
    doc_id and text without nulls."""
    spark = docs.sparkSession
    keyed = docs.withColumn("th", F.xxhash64("text"))

    def anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            parts = []
            for d, th, text in zip(b["doc_id"].tolist(), b["th"].tolist(), b["text"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                lo, hi, p, f = spans(raw, length)
                if len(lo):
                    view = memoryview(raw)
                    h = np.array([xxhash.xxh3_64_intdigest(view[a : z + length], seed=o) for a, z, o in zip(lo.tolist(), hi.tolist(), (p - lo).tolist(), strict=True)], dtype=np.uint64)
                    parts.append(pd.DataFrame({"doc_id": d, "th": th, "lo": lo, "hi": hi, "f": f.view(np.int64), "h": h.view(np.int64)}))
            if parts:
                yield pd.concat(parts)

    found = materialize(keyed.filter(F.octet_length("text") >= length).mapInPandas(lean(anchors), "doc_id long, th long, lo long, hi long, f long, h long"), "spans")
    # written, here and below: Spark splits a very common key only where both sides of a join are shuffled tables, and
    # a table of known small size is broadcast before the other side has been shuffled
    twice = materialize(found.groupBy("f").agg(F.count("*").alias("c"), F.min("h").alias("h0"), F.max("h").alias("h1")).filter("c > 1").select("f", "h0", "h1"), "shared-anchors")
    held = materialize(found.join(twice, "f"), "shared-spans")
    same = held.filter("h0 = h1").select("doc_id", "th", "lo", "hi")
    mixed = held.filter("h0 <> h1")
    kinds = materialize(mixed.groupBy("f", "h").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "lo", "hi")).alias("r")), "span-kinds")
    whole = mixed.join(materialize(kinds.filter("c > 1").select("f", "h"), "whole-spans"), ["f", "h"]).select("doc_id", "th", "lo", "hi")
    spread = materialize(kinds.groupBy("f").agg(F.count("*").alias("k")).filter(F.col("k") > many), "spread-anchors")
    salted = kinds.join(spread, "f", "left").select("f", "h", "c", F.coalesce("k", F.lit(0)).alias("k"), "r.*").withColumn("salt", F.when(F.col("k") > many, F.pmod("h", F.ceil(F.col("k") / many))).otherwise(0).cast("long"))
    asked = salted.groupBy("doc_id", "th").agg(F.collect_list(F.struct("f", "c", "k", "lo", "hi", "salt")).alias("ask"))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, th, text, ask in zip(b["doc_id"].tolist(), b["th"].tolist(), b["text"], b["ask"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                rows += [(x["f"], x["salt"], x["k"], x["c"], d, th, x["lo"], raw[x["lo"] : x["hi"] + length]) for x in ask]
            yield pd.DataFrame(rows, columns=["f", "salt", "k", "c", "doc_id", "th", "lo", "bytes"])

    pieces = keyed.join(asked, ["doc_id", "th"]).mapInPandas(lean(cut), "f long, salt long, k long, c long, doc_id long, th long, lo long, bytes binary")
    ranges = partitions(spark)

    def sort(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size, last = 0, None

        def flush() -> pd.DataFrame:
            out, prints = [], []
            flags = repeated_starts([r[7] for r in rows], length)
            for (_, _, k, c, d, th, lo, raw), flag in zip(rows, flags, strict=True):
                if c == 1:
                    out += [(d, th, a, z, -1, None) for a, z in _runs(flag, lo)]
                if k > many:
                    fp = fingerprints(raw, length)
                    # a window known to repeat, or of a span that does, only answers for others
                    own = np.full(len(fp), c == 1) & ~flag
                    prints.append((fp[:, 0], fp[:, 1], np.full(len(fp), d), np.full(len(fp), th), lo + np.arange(len(fp)), own))
            if prints:
                fp, low, d, th, at, own = (np.concatenate(x) for x in zip(*prints, strict=True))
                part = (fp >> np.uint64(33)).astype(np.int64) * ranges >> 31
                order = np.lexsort((low, fp, part))
                cuts = np.searchsorted(part[order], np.arange(ranges + 1))
                for r in range(ranges):
                    if cuts[r] < cuts[r + 1]:
                        o = order[cuts[r] : cuts[r + 1]]
                        out.append((NULL_ID, 0, 0, 0, r, b"".join((fp[o].tobytes(), low[o].tobytes(), d[o].astype("<i8").tobytes(), th[o].astype("<i8").tobytes(), at[o].astype("<i8").tobytes(), own[o].astype("<i8").tobytes()))))
            rows.clear()
            return pd.DataFrame(out, columns=["doc_id", "th", "lo", "hi", "part", "prints"])

        for b in batches:
            for r in b.itertuples(index=False, name=None):
                if (r[0], r[1]) != last and size >= SHARD_BYTES:
                    yield flush()
                    size = 0
                last = (r[0], r[1])
                rows.append(r)
                size += len(r[7])
        if rows:
            yield flush()

    sorted_ = materialize(pieces.repartition(ranges, "f", "salt").sortWithinPartitions("f", "salt").mapInPandas(lean(sort), "doc_id long, th long, lo long, hi long, part long, prints binary"), "sorted")

    def merge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        runs: dict[int, list[np.ndarray]] = {}
        for b in batches:
            for part, raw in zip(b["part"].tolist(), b["prints"], strict=True):
                runs.setdefault(part, []).append(np.frombuffer(raw, np.uint64).reshape(6, -1))
        out = []
        for own in runs.values():
            a, z = (np.concatenate([x[i] for x in own]) for i in (0, 1))
            order = np.lexsort((z, a))
            a, z = a[order], z[order]
            for x in own:  # a run's print that is there more than once
                lo, hi = np.searchsorted(a, x[0], side="left"), np.searchsorted(a, x[0], side="right")
                m = hi - lo > 1
                for i in np.flatnonzero(m & (z[lo] != z[hi - 1])):  # equal in the first half only
                    m[i] = np.count_nonzero(z[lo[i] : hi[i]] == x[1, i]) > 1
                y = x[2:, m & (x[5] == 1)].view(np.int64)
                if y.shape[1]:
                    y = y[:3, np.lexsort((y[2], y[1], y[0]))]
                    new = np.concatenate([[True], (np.diff(y[0]) != 0) | (np.diff(y[1]) != 0) | (np.diff(y[2]) != 1)])
                    first = np.flatnonzero(new)
                    last = np.append(first[1:], y.shape[1]) - 1
                    out.append(pd.DataFrame({"doc_id": y[0, first], "th": y[1, first], "lo": y[2, first], "hi": y[2, last]}))
        if out:
            yield pd.concat(out)

    crossed = sorted_.filter("part >= 0").select("part", "prints").repartition(ranges, "part").mapInPandas(lean(merge), "doc_id long, th long, lo long, hi long")
    within = sorted_.filter("part < 0").select("doc_id", "th", "lo", "hi")
    return same.union(whole).union(within).union(crossed)


def remove_repeats(docs: DataFrame, length: int = LENGTH, with_text: bool = False, many: int = MANY) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document (and kept, the bytes left, if with_text).

    A byte goes if a string of `length` bytes that covers it also starts anywhere else, in the same document or another,
    as the texts are given. A null or empty text, or one shorter than that, keeps all. Rows are documents: repeated rows
    are copies of each other; rows with a null doc_id take part. Other columns are not read. An empty table gives no row.
    """
    small_batches(docs.sparkSession)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    runs = repeats(src, length, many).groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))

    def drop(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for d, text, runs in zip(b["doc_id"].tolist(), b["text"], b["runs"], strict=True):
                raw = text.encode("utf-8", "surrogatepass")
                edges: list[list[int]] = []
                for lo, hi in sorted((x["lo"], x["hi"]) for x in runs) if runs is not None else ():
                    if edges and lo <= edges[-1][1]:
                        edges[-1][1] = max(edges[-1][1], hi + length)
                    else:
                        edges.append([lo, hi + length])
                at, kept = 0, []
                for lo, hi in edges:
                    kept.append(raw[at:lo])
                    at = hi
                left = b"".join([*kept, raw[at:]])
                rows.append((d, len(raw), len(raw) - len(left), len(edges), hashlib.sha256(left).hexdigest(), *([left] if with_text else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if with_text else [])])
            out["doc_id"] = out["doc_id"].astype("Int64").mask(out["doc_id"] == NULL_ID)
            yield out

    joined = src.withColumn("th", F.xxhash64("text")).join(runs, ["doc_id", "th"], "left").select("doc_id", "text", "runs")
    return joined.mapInPandas(lean(drop), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
