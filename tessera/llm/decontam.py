"""Benchmark decontamination by latent semantic retrieval.

Words of the benchmark make up the vocabulary. Passages of the corpus are rows of a TF-IDF matrix over it; a randomised
SVD, whose products with the matrix are sums over partitions, gives a latent space. Windows of several lengths of every
document are compared with every item by cosine in that space: what is near there, and nothing else, is a candidate (items
all of whose words are common have no place in the space, their words are counted instead). Candidates are confirmed by
the longest common subsequence of words, of the item as a whole or clause by clause, so that clauses may have changed places;
or, for paraphrases, by a shorter one together with the item's answer (or its rarest words) at a higher cosine.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, lean, materialize, small_batches

RANK, OVERSAMPLE = 32, 8
PASSAGE = 32  # words of a passage in the fit
STEP = 8  # windows start at multiples of this
WINDOWS = (16, 48)
COMMON = 0.03  # a word in more than this share of passages weighs nothing
COSINE, COSINE_LIKELY = 0.62, 0.65
LCS_SURE, LCS_LIKELY, ANSWER = 0.8, 0.55, 0.5
ENOUGH = 0.5  # share of an item's distinct words that a region holds
CLAUSE = (6, 16)  # words of a clause: shorter ones join the next, longer ones are cut
WINDOW_ROWS = 1 << 14  # windows compared with a group of items at a time
GROUP = 256
BLOCK_CHARS = 8_000_000  # of benchmark text judged in one pass over the corpus
MOST_WORDS = 2_000_000  # distinct words of a benchmark
_WORD = re.compile(r"[^\W_]+").findall
_STOP = re.compile(r"[.!?;:\n]+").split


def words(text: str | None) -> list[str]:
    return _WORD((text or "").lower())


def lcs(a: list[int], b: list[int]) -> int:
    """Length of the longest common subsequence, a word of b at a time on bits of a."""
    where: dict[int, int] = {}
    for i, x in enumerate(a):
        where[x] = where.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for y in b:
        if m := where.get(y, 0):
            u = v & m
            v = ((v + u) | (v - u)) & full
    return len(a) - v.bit_count()


def clauses(text: str | None) -> list[int]:
    """Numbers of words of a text's clauses, in order: parts between stops, the short ones joined, the long ones cut."""
    least, most = CLAUSE
    out: list[int] = []
    left = 0
    for part in _STOP((text or "").lower()):
        left += len(_WORD(part))
        while left > most:
            out.append(least * 2 if left >= least * 3 else left)
            left -= out[-1]
        if left >= least:
            out.append(left)
            left = 0
    if left and out and left < least:
        out[-1] += left
    elif left:
        out.append(left)
    return out


def _alike(lengths: list[int]) -> list[tuple[int, int, tuple[int, ...]]]:
    """(from, to, windows) of groups of at most GROUP items of like length; lengths ascend. Where the longest item is over
    twice the widest of WINDOWS, there is a window of the shortest's length as well."""
    out, g = [], 0
    for k in range(1, len(lengths) + 1):
        if k == len(lengths) or k - g == GROUP or lengths[k] > 2 * max(lengths[g], WINDOWS[-1]):
            size = lengths[g] // (2 * STEP) * 2 * STEP
            out.append((g, k, WINDOWS + ((size,) if size > WINDOWS[-1] else ())))
            g = k
    return out


def numbered(docs: DataFrame, vocabulary: dict[str, int]) -> DataFrame:
    """id, th and ids: each document's words as ids of the vocabulary, 0 for other words."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        keep_only()
        get = known.value.get
        for b in batches:
            out = [np.fromiter(map(get, words(t), repeat(0)), np.uint32).tobytes() for t in b["text"]]
            yield pd.DataFrame({"id": b["id"], "th": b["th"], "ids": out})

    return docs.mapInPandas(lean(run), "id long, th long, ids binary")


def _passages(ids: list[bytes], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, first position of each passage, document of each passage) of the documents' words, passages of `size` words
    that don't cross documents."""
    own = [np.frombuffer(x, np.uint32) for x in ids]
    length = np.array([len(x) for x in own], dtype=np.int64)
    per = -(-length // size)
    doc = np.repeat(np.arange(len(own)), per)
    nth = np.arange(len(doc)) - np.repeat(np.cumsum(per) - per, per)
    return (np.concatenate(own) if own else np.zeros(0, np.uint32)), np.repeat(np.cumsum(length) - length, per) + nth * size, doc


def _summed(rows: np.ndarray, ids: np.ndarray, starts: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Sum over each passage of its words' rows. Words of no weight (not heavy) are left out before the gather."""
    hit = np.flatnonzero(heavy[ids])
    upto = np.searchsorted(hit, starts)
    out = np.zeros((len(starts), rows.shape[1]), rows.dtype)
    if len(hit):
        some = np.flatnonzero(np.append(upto[1:], len(hit)) > upto)
        out[some] = np.add.reduceat(rows[ids[hit]], upto[some], axis=0)
    return out


def _collect(df: DataFrame, v: int, width: int) -> np.ndarray:
    out = np.zeros((v, width))
    for r in df.toLocalIterator():
        out[r.w] = np.frombuffer(r.x, np.float64)
    return out


def _added(df: DataFrame) -> DataFrame:
    """Partial matrices (w, x), a row of doubles each, added up by w."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for w, x in zip(b["w"].tolist(), b["x"], strict=True):
                x = np.frombuffer(x, np.float64)
                total[w] = total[w] + x if w in total else x
        yield pd.DataFrame({"w": list(total), "x": [x.tobytes() for x in total.values()]}).astype({"w": "int64"})

    return df.repartition("w").mapInPandas(run, "w long, x binary")


def latent_space(table: DataFrame, v: int, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(idf, basis) of the vocabulary's TF-IDF matrix over all passages: basis (v, rank) holds the right singular vectors.
    Each pass sends a matrix of the vocabulary's size per task, which tasks add up by row."""

    def df_counts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        count = np.zeros((v, 1))
        n = 0
        for b in batches:
            ids, starts, _ = _passages(list(b["ids"]), PASSAGE)
            n += len(starts)
            if len(starts):
                hit = np.flatnonzero(ids)
                key = np.unique((np.searchsorted(starts, hit, side="right") - 1) * v + ids[hit])
                count[:, 0] += np.bincount(key % v, minlength=v)
        count[0] = n
        yield _rows(count)

    def _rows(m: np.ndarray) -> pd.DataFrame:
        some = np.flatnonzero(m.any(axis=1))
        return pd.DataFrame({"w": some, "x": [m[i].tobytes() for i in some]}).astype({"w": "int64"})

    counts = _collect(_added(table.select("ids").mapInPandas(lean(df_counts), "w long, x binary")), v, 1)[:, 0]
    idf = np.log((counts[0] + 1) / (counts + 1)).clip(0)
    idf[(counts > COMMON * counts[0])] = 0
    idf[counts == 0] = 0  # what no passage has has no place in the space
    idf[0] = 0
    heavy = idf > 0
    width = min(RANK + OVERSAMPLE, max(1, v - 1))
    omega = (np.random.default_rng(seed).standard_normal((v, width)) * idf[:, None]).astype(np.float32)
    sc = table.sparkSession.sparkContext

    def ranged(batches: Iterator[pd.DataFrame], shared=sc.broadcast((omega, idf, heavy))) -> Iterator[pd.DataFrame]:
        rows, weight, heavy = shared.value
        y = np.zeros((v, width))
        for b in batches:
            ids, starts, _ = _passages(list(b["ids"]), PASSAGE)
            if not len(starts):
                continue
            p = _summed(rows, ids, starts, heavy)
            hit = np.flatnonzero(heavy[ids])
            which = np.searchsorted(starts, hit, side="right") - 1
            sort = np.argsort(ids[hit], kind="stable")
            order, which = hit[sort], which[sort]
            if len(order):
                w, first = np.unique(ids[order], return_index=True)
                y[w] += np.add.reduceat(p[which], first, axis=0) * weight[w][:, None]
        yield _rows(y)

    y = _collect(_added(table.select("ids").mapInPandas(lean(ranged), "w long, x binary")), v, width)
    # y = (A'A) omega spans the leading right singular vectors; those of y itself, in order, are taken for them
    return idf, np.linalg.svd(y, full_matrices=False)[0][:, :RANK]


Item = tuple[int, list[int], list[int], list[int]]


def confirmed(item: Item, near: list[int], cosine: float) -> float:
    """Share of the item's words that a region repeats in order, as a whole or clause by clause; 0 if that is too little. An
    item's answer, or its rarest words, must be there where the share alone isn't sure."""
    _, want, answer, cut = item
    here = set(near)
    own = set(want)
    if len(own & here) < ENOUGH * len(own):
        return 0.0
    share = lcs(want, near) / len(want)
    if share < LCS_SURE and len(cut) > 1:
        at, kept = 0, 0
        for n in cut:
            kept += lcs(want[at : at + n], near)
            at += n
        share = max(share, kept / len(want))
    likely = share >= LCS_LIKELY and cosine >= COSINE_LIKELY and len(set(answer) & here) >= ANSWER * len(set(answer))
    return share if share >= LCS_SURE or likely else 0.0


def rarest(ids: list[int], idf: np.ndarray) -> list[int]:
    """The rarest third of an item's words, among those that the corpus has at all: one that is in no passage is in no
    paraphrase either."""
    own = sorted(set(ids), key=lambda w: (-idf[w], w))
    there = [w for w in own if idf[w] > 0]
    return (there or own)[: max(1, len(own) // 3)]


def search(table: DataFrame, items: list[Item], idf: np.ndarray, basis: np.ndarray) -> DataFrame:
    """(id, th, item_id, score): confirmed items of each document. items: (item_id, words, answer words, clauses), words as ids."""
    items = sorted(items, key=lambda x: len(x[1]))
    rows = (basis * idf[:, None]).astype(np.float32)
    vectors = np.stack([rows[x[1]].sum(0) for x in items])
    norms = np.linalg.norm(vectors, axis=1)
    vectors = (vectors / np.where(norms > 0, norms, 1)[:, None]).astype(np.float32)
    shared = table.sparkSession.sparkContext.broadcast((rows, vectors, norms == 0, idf > 0, items))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, vectors, free, heavy, items = shared.value
        groups = _alike([len(x[1]) for x in items])
        # a region that holds ENOUGH of an item's distinct words holds so many of those that weigh
        own = [np.unique(x[1]) for x in items]
        need = np.array([np.ceil(ENOUGH * len(w) - 1e-9) - np.count_nonzero(~heavy[w]) for w in own])
        beside = np.array([-(-len(x[1]) // 2 // STEP) + 1 for x in items])
        word = np.concatenate([w[heavy[w]] for w in own])
        item = np.concatenate([np.full(np.count_nonzero(heavy[w]), k) for k, w in enumerate(own)])
        order = np.argsort(word, kind="stable")
        item, offset = item[order], np.searchsorted(word[order], np.arange(len(rows) + 1))
        common = {k: np.isin(np.arange(len(rows)), items[k][1]) for k in np.flatnonzero(free).tolist()}

        for b in batches:
            out: dict[tuple[int, int], float] = {}
            texts = list(b["ids"])
            ids, starts, doc = _passages(texts, STEP)
            if len(starts):
                ends = np.append(starts[1:], len(ids))
                last = np.searchsorted(doc, doc, side="right")  # one past the document's last block
                begin = np.searchsorted(doc, doc)

                def judge(a: int, z: int, k: int, cosine: float) -> None:
                    """The region of the blocks a to z, and half the item's length on either side of it, within the document."""
                    d = int(doc[a])
                    if out.get((d, k), 0) >= LCS_SURE:
                        return
                    half = -(-len(items[k][1]) // 2)
                    lo, hi = max(starts[begin[a]], starts[a] - half), min(ends[last[a] - 1], ends[z - 1] + half)
                    if score := confirmed(items[k], ids[lo:hi].tolist(), cosine):
                        out[d, k] = max(score, out.get((d, k), 0))

                some = np.flatnonzero(np.bincount(np.searchsorted(starts, np.flatnonzero(heavy[ids]), side="right") - 1, minlength=len(starts)))
                block = _summed(rows, ids, starts, heavy)
                total = np.concatenate([np.zeros((1, block.shape[1])), np.cumsum(block, axis=0, dtype=np.float64)])
                weighty = np.zeros(len(starts) + 1, np.int64)
                weighty[some + 1] = 1
                weighty = np.cumsum(weighty)
                del block
                hit = np.flatnonzero(offset[ids + 1] > offset[ids])
                n = offset[ids[hit] + 1] - offset[ids[hit]]
                at_block = np.repeat(np.searchsorted(starts, hit, side="right") - 1, n)
                at_item = item[np.repeat(offset[ids[hit]] - np.cumsum(n) + n, n) + np.arange(int(n.sum()))]
                places = np.sort(at_item * (len(starts) + 1) + at_block)  # an item's words by block
                for g, end, windows in groups:
                    if free[g:end].all():
                        continue
                    for size in windows:
                        at = np.arange(len(starts))
                        at = at[(at - begin) % (size // 2 // STEP) == 0]
                        to = np.minimum(at + size // STEP, last[at])
                        kept = weighty[to] > weighty[at]  # without a word that weighs, a window has no place in the space
                        at, to = at[kept], to[kept]
                        for lo in range(0, len(at), WINDOW_ROWS):
                            a, z = at[lo : lo + WINDOW_ROWS], to[lo : lo + WINDOW_ROWS]
                            x = (total[z] - total[a]).astype(np.float32)
                            x /= np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9)
                            near = x @ vectors[g:end].T
                            r, k = np.nonzero(near >= COSINE)
                            key, lows, highs = (k + g) * (len(starts) + 1), np.maximum(a[r] - beside[k + g], begin[a[r]]), np.minimum(z[r] + beside[k + g], last[a[r]])
                            held = np.searchsorted(places, key + highs) - np.searchsorted(places, key + lows)
                            kept = held >= need[k + g]
                            for x, y in zip(r[kept].tolist(), k[kept].tolist(), strict=True):
                                judge(int(a[x]), int(z[x]), y + g, float(near[x, y]))
                for k, among in common.items():
                    n = np.concatenate([[0], np.cumsum(np.add.reduceat(among[ids].astype(np.int64), starts))])
                    width = -(-len(items[k][1]) // STEP) + 1
                    a = np.arange(len(starts))
                    z = np.minimum(a + width, last)
                    lo, hi = np.maximum(a - beside[k], begin), np.minimum(z + beside[k], last)
                    for r in np.flatnonzero(n[hi] - n[lo] >= np.ceil(ENOUGH * len(set(items[k][1])))).tolist():
                        judge(r, int(z[r]), k, 1.0)
            doc_ids, th = b["id"].tolist(), b["th"].tolist()
            yield pd.DataFrame([(doc_ids[d], th[d], items[k][0], s) for (d, k), s in out.items()], columns=["id", "th", "item_id", "score"]).astype({"id": "int64", "th": "int64", "item_id": "int64", "score": "float64"})

    return table.mapInPandas(lean(run), "id long, th long, item_id long, score double")


def _key(docs: DataFrame) -> tuple[Column, Column]:
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("id"), F.xxhash64(F.col("text").cast("string")).alias("th")


def _hits(docs: DataFrame, benchmark: DataFrame, item_col: str, text: str, answer: str | None) -> DataFrame:
    """(id, th, item_id, score): items found in each text. id is doc_id or 0 and th the text's hash, so that rows are judged
    by their own texts, those without an id too."""
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(*_key(docs), F.col("text").cast("string").alias("text"))
    bench = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(text).cast("string").alias("text"), (F.col(answer).cast("string") if answer else F.lit(None).cast("string")).alias("answer")).filter("item_id is not null and text is not null")
    found = _found(src, bench, 0)
    if found is None:
        return spark.createDataFrame([], "id long, th long, item_id long, score double")
    return materialize(found, "hits").groupBy("id", "th", "item_id").agg(F.max("score").alias("score"))


def _found(src: DataFrame, bench: DataFrame, depth: int) -> DataFrame | None:
    """Hits of the texts. A benchmark of over MOST_WORDS distinct words, which every worker holds, is halved by its items'
    hashes, again and again; each part has a space of its own and is searched in passes of its own."""
    vocabulary: dict[str, int] = {}
    n = 0
    for r in bench.toLocalIterator():
        n += 1
        for w in (*words(r.text), *words(r.answer)):
            vocabulary.setdefault(w, len(vocabulary) + 1)
        if len(vocabulary) > MOST_WORDS and n > 1 and depth < 60:
            half = F.shiftright(F.xxhash64("text", "item_id"), depth).bitwiseAND(1)
            parts = [x for x in (_found(src, bench.filter(half == k), depth + 1) for k in (0, 1)) if x is not None]
            return parts[0].union(parts[1]) if len(parts) == 2 else parts[0] if parts else None
    if not vocabulary:
        return None
    vocabulary = {w: i for i, w in enumerate(sorted(vocabulary), 1)}
    table = materialize(numbered(src, vocabulary), "numbered")
    idf, basis = latent_space(table, len(vocabulary) + 1)
    size = bench.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks, found = max(1, -(-size // BLOCK_CHARS)), None
    for k in range(blocks):
        items = []
        for r in sorted(bench.filter(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).toLocalIterator()):
            if ids := [vocabulary[w] for w in words(r.text)]:
                items.append((r.item_id, ids, [vocabulary[w] for w in words(r.answer)] or rarest(ids, idf), clauses(r.text)))
        if items:
            hits = search(table, items, idf, basis)
            found = hits if found is None else found.union(hits)
    return found


def contamination(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """(doc_id, item_id, score): every document and item found in it, with the share of the item's words that it repeats
    in order.

    Whole texts. Items that are null or without words are in no document; equal items, and items under one id, are each
    judged and reported by their ids. A null or empty document holds none; rows with a null doc_id are judged as one
    document of that id, rows repeated under one id count as one. Other columns are not read. The latent space is fitted
    once over the whole benchmark, whose words (MOST_WORDS distinct ones at most, else a ValueError) every worker holds;
    items of over BLOCK_CHARS characters together are searched in blocks, each by a pass over the numbered corpus, with the
    same result. Without an answer column the answer is the rarest third of the item's words that the corpus has. An empty table on either side
    gives no row.
    """
    hits = _hits(docs, benchmark, item_col, text, answer)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *_key(docs)).join(hits, ["id", "th"])
    return own.groupBy("doc_id", "item_id").agg(F.max("score").alias("score"))


def _judged(docs: DataFrame, hits: DataFrame, how: str) -> DataFrame:
    hits = hits.withColumnsRenamed({"id": "_hit_id", "th": "_hit_th"})
    own, th = F.coalesce(docs["doc_id"].cast("long"), F.lit(0)), F.xxhash64(docs["text"].cast("string"))
    return docs.join(hits, (own == hits["_hit_id"]) & (th == hits["_hit_th"]), how)


def decontaminate(docs: DataFrame, benchmark: DataFrame, item_col: str = "item_id", text: str = "text", answer: str | None = None) -> DataFrame:
    """docs without those that hold an item, each row judged by its own text, rows with a null doc_id too. All columns stay
    as they are; other cases as in contamination()."""
    return _judged(docs, _hits(docs, benchmark, item_col, text, answer).select("id", "th").distinct(), "left_anti")


def op6_lsa_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the items found in it: doc_id, contaminated, n_items, first_item, score. Nulls, repeats, ties and
    empty tables as in contamination(); each row is judged by its own text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hits = _hits(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id", "text", None)
    hits = hits.groupBy("id", "th").agg(F.count("*").alias("n_items"), F.min("item_id").alias("first_item"), F.max("score").alias("score"))
    return _judged(docs, hits, "left").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("n_items").isNotNull().alias("contaminated"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"), "first_item", "score")
