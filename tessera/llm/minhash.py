"""Near-duplicate documents by MinHash with tensored banding, candidates verified on whole shingle sets.

Two collections of GROUPS small groups of WIDTH minhashes each are computed; a table key joins one group of either, so
GROUPS x GROUPS tables of 2 x WIDTH minhashes cost 2 x GROUPS x WIDTH minhashes, about the square root of what separate
tables would. A pair is missed only if all groups of one collection differ: at the threshold of 0.8 at most
2 x (1 - 0.8^WIDTH)^GROUPS.

Equal sets are one class from the start. In small buckets all pairs are candidates. A larger bucket has a centre, its
smallest document, to which all members are compared; most groups of copies are one component after that. Buckets that
still hold several components are then judged whole, in blocks of bounded size, by products of 0/1 shingle matrices,
which give every intersection exactly. Members of the bucket's commonest component aren't compared with each other (no
link among them could join anything), so such a bucket costs its other members times its size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NULL_ID, keep_only, lean, materialize, remove, small_batches

WIDTH, GROUPS = 2, 12
SMALL = 12
#: Most members, and most shingles of all members, of a block of a large bucket; columns of a matrix at a time.
BLOCK_DOCS, BLOCK_SHINGLES, COLUMNS = 2048, 1 << 22, 2048
PERCENT = 80
#: Of 64 sketch bits, so many agree at least in a candidate: at a similarity of 0.8 57.6 do, with a deviation of 2.4 to
#: 2.7, so that fewer than 1e-8 of the pairs are lost by this.
AGREE = 40

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_P1, _P2, _P3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * _P3
    x = x ^ (x >> np.uint64(32))
    x = x * _P3
    return x ^ (x >> np.uint64(32))


class Shingler:
    """64-bit hashes of the distinct n-word shingles of texts; words are runs of bytes other than white space, A-Z folded."""

    MOST = 100_000

    def __init__(self, n: int):
        self.n, self.words = n, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()
        if not words:
            return np.zeros(0, np.uint64)
        if len(self.words) > self.MOST:
            self.words.clear()
        known = self.words
        for w in set(words).difference(known):
            known[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        n = min(self.n, len(h))
        out = np.full(len(h) - n + 1, len(h) if len(h) < self.n else 0, dtype=np.uint64)
        for i in range(n):
            out = mix(out * _P1 + h[i : len(h) - n + 1 + i] + _P2)
        return np.unique(out)


_SHINGLERS: dict[int, Shingler] = {}


def shingler(n: int) -> Shingler:
    keep_only(_SHINGLERS)
    return _SHINGLERS.setdefault(n, Shingler(n))


def _coefficients(k: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 63, k, dtype=np.uint64) | np.uint64(1)


def signatures(sets: list[np.ndarray], k: int) -> np.ndarray:
    """(len(sets), k) minhashes; no set is empty."""
    flat = np.concatenate(sets)
    at = np.cumsum([0] + [len(s) for s in sets[:-1]])
    out = np.empty((len(sets), k), dtype=np.uint64)
    for j, c in enumerate(_coefficients(k, 101)):
        x = flat * c
        x ^= x >> np.uint64(29)
        out[:, j] = np.minimum.reduceat(x * _P2, at)
    return out


def table_keys(sig: np.ndarray) -> np.ndarray:
    """(n, GROUPS * GROUPS) keys from (n, 2 * GROUPS * WIDTH) minhashes."""
    g = np.zeros((len(sig), 2 * GROUPS), dtype=np.uint64)
    for i in range(WIDTH):
        g = mix(g * _P1 + sig[:, i::WIDTH])
    a, b = g[:, :GROUPS], g[:, GROUPS:]
    table = np.arange(GROUPS * GROUPS, dtype=np.uint64).reshape(GROUPS, GROUPS)
    return mix((a[:, :, None] * _P1 + b[:, None, :]) * _P2 + table).reshape(len(sig), -1)


def sketch(sig: np.ndarray) -> np.ndarray:
    """64 one-bit minhashes: the minhashes' own bits, and second bits of the first ones."""
    bits = np.concatenate([sig >> np.uint64(17), sig >> np.uint64(43)], axis=1)[:, :64] & np.uint64(1)
    if bits.shape[1] < 64:
        raise ValueError("too few minhashes for a sketch")
    return (bits << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)


def describe(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th, n_shingles, f1, f2 (fingerprint of the set), sig (minhashes as bytes; empty for an empty set). docs has
    doc_id, th (hash of the text) and text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh, k = shingler(n), 2 * GROUPS * WIDTH
        for b in batches:
            sets = [sh(t) for t in b["text"]]
            full = [i for i, s in enumerate(sets) if len(s)]
            sig = [b""] * len(sets)
            f1, f2 = np.zeros(len(sets), np.int64), np.zeros(len(sets), np.int64)
            if full:
                own = [sets[i] for i in full]
                for i, row in zip(full, signatures(own, k), strict=True):
                    sig[i] = row.tobytes()
                at = np.cumsum([0] + [len(s) for s in own[:-1]])
                flat = np.concatenate(own)
                f1[full] = np.add.reduceat(mix(flat), at).view(np.int64)
                f2[full] = np.add.reduceat(mix(flat ^ _P1), at).view(np.int64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "th": b["th"], "n_shingles": [len(s) for s in sets], "f1": f1, "f2": f2, "sig": sig})

    return docs.mapInPandas(lean(run), "doc_id long, th long, n_shingles long, f1 long, f2 long, sig binary")


def _keys(reps: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if not len(b):
                continue
            sig = np.frombuffer(b"".join(b["sig"]), np.uint64).reshape(len(b), -1)
            keys, tables = table_keys(sig), GROUPS * GROUPS
            yield pd.DataFrame({"key": keys.ravel().view(np.int64), "doc": np.repeat(b["doc"].to_numpy(), tables), "sk": np.repeat(sketch(sig).view(np.int64), tables), "t": np.tile(np.arange(tables, dtype=np.int16), len(b)), "w": np.repeat(b["n_shingles"].to_numpy(np.int32), tables)})

    return reps.mapInPandas(lean(run), "key long, doc long, sk long, t short, w int")


def verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs (a, b) with inter, and sim, the exact similarity of the whole sets, on those that link."""
    joined = pairs.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("doc").alias("b"), F.col("set").alias("sb")), "b").select("a", "b", "sa", "sb")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            inter, union = [], []
            for x, y in zip(b["sa"], b["sb"], strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                i = len(np.intersect1d(x, y, assume_unique=True))
                inter.append(i)
                union.append(len(x) + len(y) - i)
            yield pd.DataFrame({"a": b["a"], "b": b["b"], "inter": inter, "total": union})

    return joined.mapInPandas(lean(run), "a long, b long, inter long, total long")


def components(links: DataFrame, name: str = "labels") -> DataFrame:
    """(doc, label): the smallest doc reachable from each doc of the links (a, b). Labels fall to the smallest of the
    neighbours' and then to their label's label, until none changes; each round is a written table, and goes with the next."""
    spark = links.sparkSession
    both = materialize(links.select("a", "b").union(links.select("b", "a")).distinct(), f"{name}-links")
    label = materialize(both.groupBy(F.col("a").alias("doc")).agg(F.min("b").alias("m")).select("doc", F.least("doc", "m").alias("label")), name)
    while True:
        near = both.join(label.select(F.col("doc").alias("b"), "label"), "b").groupBy(F.col("a").alias("doc")).agg(F.min("label").alias("low"))
        new = label.join(near, "doc").select("doc", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        up = label.select(F.col("doc").alias("label"), F.col("label").alias("top"))
        new = materialize(new.join(up, "label", "left").select("doc", "was", F.least("label", "top").alias("label")), name)
        remove(spark, label)
        if new.filter("label <> was").isEmpty():
            remove(spark, both)
            return new.select("doc", "label")
        label = new.select("doc", "label")


def joining_links(sets: list[np.ndarray], labels: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Of the links between rows of left and rows of right (index arrays), as many as join all labels that links join."""
    size = np.array([len(s) for s in sets])
    _, col, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner, shared = np.repeat(np.arange(len(sets)), size), df[col] > 1
    owner, col = owner[shared], (np.cumsum(df > 1) - 1)[col[shared]]
    order = np.argsort(col, kind="stable")
    owner, col, width = owner[order], col[order], int((df > 1).sum())
    inter = np.zeros((len(left), len(right)))
    for c in range(0, width, COLUMNS):
        lo, hi = np.searchsorted(col, [c, c + COLUMNS])
        m = np.zeros((len(sets), COLUMNS), np.float32)
        m[owner[lo:hi], col[lo:hi] - c] = 1
        inter += m[left] @ m[right].T
    ok = inter * 100 >= (size[left][:, None] + size[right] - inter) * percent
    names, own = np.unique(labels, return_inverse=True)
    ok &= own[left][:, None] != own[right]
    x, y = np.nonzero(ok)
    _, one = np.unique(own[left[x]] * len(names) + own[right[y]], return_index=True)
    parent = list(range(len(names)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(left[x[one]].tolist(), right[y[one]].tolist(), strict=True):
        p, q = root(int(own[i])), root(int(own[j]))
        if p != q:
            parent[p] = q
            out.append((i, j))
    return out


def split_bucket_links(large: DataFrame, label: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that join components within the large buckets. A third of the tables, chosen so that each group of
    either collection is in a third of its tables, holds all but 4e-5 of the pairs at 0.8. Buckets of the same members
    are judged once. A bucket over BLOCK_DOCS members or BLOCK_SHINGLES shingles is cut by hash into blocks; its members
    outside the commonest component, the others, are cut likewise, and each block meets each part of the others in one
    group, so that no group grows with the bucket."""
    tables = large.filter((F.floor(F.col("t") / GROUPS) + F.col("t") % GROUPS) % 3 == 0).select("key", "doc", "w")
    named = tables.join(label, "doc", "left").select("key", "doc", "w", F.coalesce("label", "doc").alias("label"))
    # a bucket by its labels first: a row per bucket and component
    part = named.groupBy("key", "label").agg(F.count("*").alias("n"), F.sum("w").alias("w"), F.bit_xor(F.xxhash64("doc")).alias("members"))
    split = part.groupBy("key").agg(F.count("*").alias("labels"), F.sum("n").alias("n"), F.sum("w").alias("total"), F.bit_xor("members").alias("members"), F.max(F.struct("n", "w", "label")).alias("top")).filter("labels > 1")
    once = split.groupBy("n", "total", "members").agg(F.min(F.struct("key", "top")).alias("r")).select(F.col("r.key").alias("key"), F.col("r.top.label").alias("common"), "n", "total", (F.col("n") - F.col("r.top.n")).alias("m"), (F.col("total") - F.col("r.top.w")).alias("rest"))
    cuts = lambda n, w: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK_DOCS), F.ceil(F.col(w) / BLOCK_SHINGLES)).cast("long")
    once = materialize(once.select("key", "common", cuts("n", "total").alias("blocks"), cuts("m", "rest").alias("parts")), "split-buckets")
    rows = named.join(once, "key").select("key", "doc", "label", F.pmod(F.xxhash64("doc", "key"), F.col("blocks")).alias("block"), F.pmod(F.xxhash64("key", "doc"), F.col("parts")).alias("part"), "blocks", "parts", (F.col("label") != F.col("common")).alias("other"))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    whole = rows.withColumn("j", every("parts")).select("key", F.col("block").alias("i"), "j", "doc", "label", F.lit(False).alias("asks"))
    asks = rows.filter("other").withColumn("i", every("blocks")).select("key", "i", F.col("part").alias("j"), "doc", "label", F.lit(True).alias("asks"))
    rows = whole.union(asks).join(sets, "doc")

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        asks = rows["asks"].to_numpy()
        left, right = np.flatnonzero(asks), np.flatnonzero(~asks)
        found = joining_links([np.frombuffer(x, np.uint64) for x in rows["set"]], rows["label"].to_numpy(), left, right, percent) if len(left) and len(right) else []
        doc = rows["doc"].to_numpy()
        return pd.DataFrame({"a": [min(doc[i], doc[j]) for i, j in found], "b": [max(doc[i], doc[j]) for i, j in found]}, dtype=np.int64)

    return rows.groupBy("key", "i", "j").applyInPandas(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, n: int = 2, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    Documents link when 100 * |A & B| >= percent * |A | B| over their sets of n-word shingles; component_id is the
    smallest doc_id reachable, kept says that it is the document's own. A text of fewer than n words has one shingle, the
    whole sequence; a null, empty or blank text has none and links with nothing. Rows with a null doc_id come back
    unlinked, with a null component_id and kept false. Rows repeated under one doc_id are one document with one row each:
    what any of their texts links with is linked. Ties do not arise: the smallest id stands for a component. An empty table
    gives no row. Other columns are not read. percent must be 80 or more for the tables' recall to hold.
    """
    spark = docs.sparkSession
    small_batches(spark)
    src = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID)).alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("th", F.xxhash64("text"))
    desc = materialize(describe(src, n), "signatures")
    able = desc.filter((F.col("n_shingles") > 0) & (F.col("doc_id") != NULL_ID))
    classes = materialize(able.groupBy("n_shingles", "f1", "f2").agg(F.min(F.struct("doc_id", "th")).alias("first"), F.min("sig").alias("sig")).select("n_shingles", "f1", "f2", F.col("first.doc_id").alias("doc"), F.col("first.th").alias("th"), "sig"), "classes")
    keys = _keys(classes.select("doc", "n_shingles", "sig"))
    shared = keys.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1")
    buckets = materialize(keys.join(shared, "key"), "buckets")
    few = buckets.filter(F.col("size") <= SMALL)
    other = few.select("key", F.col("doc").alias("b"), F.col("sk").alias("skb"))
    agree = lambda x, y: 64 - F.bit_count(F.col(x).bitwiseXOR(F.col(y))) >= AGREE
    pairs = few.join(other, "key").filter((F.col("doc") < F.col("b")) & agree("sk", "skb")).select(F.col("doc").alias("a"), "b").distinct()
    large = buckets.filter(F.col("size") > SMALL)
    # a third of the tables for the centres
    tables = large.filter(F.col("t") % 3 == 0)
    centre = tables.groupBy("key").agg(F.min(F.struct("doc", "sk")).alias("c"))
    star = tables.join(centre, "key").withColumns({"b": F.col("c.doc"), "skb": F.col("c.sk")}).filter((F.col("doc") != F.col("b")) & agree("sk", "skb"))
    pairs = materialize(pairs.union(star.select(F.least("doc", "b").alias("a"), F.greatest("doc", "b").alias("b"))).distinct(), "pairs")
    wanted = large.select("doc").union(pairs.select(F.col("a"))).union(pairs.select("b")).distinct()

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sh = shingler(n)
        for b in batches:
            yield pd.DataFrame({"doc": b["doc_id"], "set": [sh(t).tobytes() for t in b["text"]]})

    wanted = classes.join(wanted, "doc", "left_semi").select(F.col("doc").alias("doc_id"), "th").distinct()
    once = src.join(wanted, ["doc_id", "th"], "left_semi").dropDuplicates(["doc_id", "th"])
    sets = materialize(once.select("doc_id", "text").mapInPandas(lean(whole), "doc long, set binary"), "sets")
    links = verify(pairs, sets).filter(F.col("inter") * 100 >= F.col("total") * percent).select("a", "b")
    # a document given with several texts is in several classes, which are then one
    member = materialize(able.select("doc_id", "n_shingles", "f1", "f2").join(classes.select("n_shingles", "f1", "f2", "doc"), ["n_shingles", "f1", "f2"]).select("doc_id", "doc"), "members")
    many = member.groupBy("doc_id").agg(F.min("doc").alias("a"), F.max("doc").alias("z")).filter("a < z").select("doc_id", "a")
    links = materialize(links.union(member.join(many, "doc_id").filter("a < doc").select("a", F.col("doc").alias("b"))).distinct(), "links")
    label = components(links)
    fresh = materialize(split_bucket_links(large, label, sets, percent), "joining")
    if not fresh.isEmpty():
        label = components(links.union(fresh))
    found = member.join(label, "doc", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "doc")).alias("component_id"))
    out = desc.select("doc_id", "n_shingles").join(found, "doc_id", "left").select(F.nullif("doc_id", F.lit(NULL_ID)).alias("doc_id"), "n_shingles", "component_id").withColumn("component_id", F.coalesce("component_id", "doc_id"))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(False)))


def op5_minhash_tensored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """near_duplicates of documents on 2-word shingles; its docstring gives the result of nulls, empty texts, repeats."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP5_SQL = None
