"""Approximate nearest neighbours by cosine: inverted lists scanned with an adaptive dimension test.

Unit vectors are turned by a random rotation and kept in column blocks. Within a probed list, partial squared distances
grow block by block; after d of D dimensions a candidate goes on only while partial * D/d <= limit * (1 + EPS / sqrt(d))^2,
the test of the hypothesis that its whole distance is within the query's current k-th best. Survivors are scored exactly.
A query scans its nearest list first; its k-th best there is the limit that it carries to the others, where it is tightened
as they are scanned. How many lists are probed is measured on the fitting sample.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lean, materialize

EPS = 2.1
BLOCK_DIMS = 16
FIT_ROWS = 16_384
FIT_QUERIES = 512
#: Vectors of a salted part of a list, queries that meet it at once, and pairs whose distances are grown together.
SALT_ROWS, QUERY_ROWS, PAIRS = 4_096, 1_024, 1 << 18
#: So many of the true neighbours of sampled vectors are in the lists that a query probes by default.
FOUND = 0.98


def scaled(v: pd.Series) -> np.ndarray:
    """The vectors, each divided by a power of two if its components are so large or small that squares would over- or
    underflow: a cosine stays the same, to the last bit."""
    x = np.stack([np.asarray(a, dtype=np.float64) for a in v])
    _, e = np.frexp(np.abs(x).max(axis=1))
    return np.ldexp(x, np.where(np.abs(e) > 300, -e, 0)[:, None])


def unit_rows(v: pd.Series) -> np.ndarray:
    x = scaled(v)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; an empty centre keeps its place."""
    c = x[np.random.default_rng(seed).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        size = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(size > 0, total / np.where(size > 0, size, 1), c)
    return c


def usable(df: DataFrame, vec: str) -> DataFrame:
    """Rows whose vector is there, not zero, and all finite."""
    ok = F.col(vec).isNotNull() & F.coalesce(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False)) & F.coalesce(F.exists(vec, lambda x: x != 0), F.lit(False))
    return df.filter(ok)


def probes_needed(x: np.ndarray, centres: np.ndarray, k: int, share: float = FOUND, seed: int = 7) -> int:
    """Lists to probe, nearest first, so that this share of the k nearest of FIT_QUERIES rows of x is in them."""
    near = np.concatenate([np.argmax(x[i : i + 4096] @ centres.T, axis=1) for i in range(0, len(x), 4096)])
    asked = np.random.default_rng(seed).permutation(len(x))[:FIT_QUERIES]
    sim = x[asked] @ x.T
    sim[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return 1
    best = np.argpartition(-sim, k - 1, axis=1)[:, :k]
    place = np.argsort(np.argsort(-(x[asked] @ centres.T), axis=1, kind="stable"), axis=1, kind="stable")
    at = np.sort(np.take_along_axis(place, near[best], axis=1).ravel())
    return int(at[min(len(at) - 1, int(np.ceil(share * len(at))) - 1)]) + 1


def survivors(q: np.ndarray, limit: np.ndarray, x: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query rows, candidate rows) of the pairs that pass the test at every column block; limit: each query's bound on the
    squared distance, infinite where there is none."""
    dim = x.shape[1]
    step = max(1, PAIRS // max(1, len(q)))
    cuts = [*range(BLOCK_DIMS, dim, BLOCK_DIMS), dim]
    for lo in range(0, len(x), step):
        c = x[lo : lo + step]
        a = cuts[0]
        part = (q[:, :a] ** 2).sum(1)[:, None] + (c[:, :a] ** 2).sum(1) - 2 * (q[:, :a] @ c[:, :a].T)
        test = lambda d: limit * (1.0 if d == dim else (1 + EPS / np.sqrt(d)) ** 2) * (d / dim) + 1e-9
        i, j = np.nonzero(part <= test(a)[:, None])
        part = part[i, j]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if not len(i):
                break
            part = part + ((q[i, a:b] - c[j, a:b]) ** 2).sum(1)
            keep = part <= test(b)[i]
            i, j, part = i[keep], j[keep], part[keep]
        if len(i):
            yield i, j + lo


def search(vectors: DataFrame, queries: DataFrame, k: int = 5, lists: int | None = None, probes: int | None = None, id_col: str = "vec_id", vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest found, nearest first, ties to the smaller id.

    The score is the cosine of the original vectors in double precision. The query's own id is no candidate. Vectors that
    are null, empty, zero, of another length than most usable ones (the longer of equally common), or hold null or non-finite
    components take no part; neither do null ids. Repeated (id, vector) rows count once; an id given with several vectors
    answers with its nearest. Equal vectors are searched as one and hold their k + 1 smallest ids, which are all that a result
    of k can name. Centres are fitted on FIT_ROWS vectors at most, those of the smallest hashes; every vector is in a list.
    A list is scanned in salted parts of about SALT_ROWS vectors, each by QUERY_ROWS queries at once. There are `lists` lists,
    by default the square root of the distinct vectors (one to eight fitted vectors at most), and `probes` of them are probed,
    by default as many as hold FOUND of the sample's true neighbours; more while those may hold fewer than k candidates. An
    empty table, or no query, gives no row. Other columns are not read.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    base = usable(vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")), "v").filter("vec_id is not null")
    dim = base.groupBy(F.size("v").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if dim is None:
        return spark.createDataFrame([], schema)
    dim = dim[0]
    base = base.filter(F.size("v") == dim)
    # k+1 smallest ids of each distinct vector: a row per distinct (vector, id), then a bounded list per task and vector
    keyed = base.withColumn("h", F.xxhash64("v")).withColumn("salt", F.pmod(F.xxhash64("vec_id"), F.lit(64)))
    small = lambda c: F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), 1, k + 1)
    part = keyed.groupBy("h", "v", "salt").agg(F.slice(F.array_sort(F.collect_set("vec_id")), 1, k + 1).alias("ids"))
    distinct = materialize(part.groupBy("h", "v").agg(small("ids").alias("ids")), "distinct-vectors")
    count, fit = distinct.count(), distinct.orderBy("h").limit(FIT_ROWS).select("v").toPandas()
    x = unit_rows(fit["v"])
    n_lists = max(1, min(lists or int(np.sqrt(count)), -(-len(x) // 8)))
    turn, centres = rotation(dim), kmeans(x, n_lists)
    n_probes = max(1, min(probes or probes_needed(x, centres, k), n_lists))
    salts = max(1, round(count / n_lists / SALT_ROWS))

    asked = usable(queries.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")), "v").filter("vec_id is not null").filter(F.size("v") == dim).distinct()

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                u = unit_rows(b["v"])
                yield pd.DataFrame({"list": np.argmax(u @ centres.T, axis=1), "v": b["v"], "ids": b["ids"]})

    assigned = materialize(distinct.select("v", "ids").mapInPandas(lean(assign), "list int, v array<double>, ids array<long>"), "assigned")
    holds = np.zeros(n_lists, dtype=np.int64)
    for r in assigned.groupBy("list").agg(F.sum(F.size("ids")).alias("n")).collect():
        holds[r.list] = r.n
    # so many (vector, id) have k ids besides the query's own, as an id has at most `most` vectors
    most = assigned.select(F.explode("ids").alias("id")).groupBy("id").count().agg(F.max("count")).first()[0]
    need = most * (k + 1)

    def route(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                near = np.argsort(-(unit_rows(b["v"]) @ centres.T), axis=1, kind="stable")
                first = np.clip(1 + (np.cumsum(holds[near], axis=1) < need).sum(1), 1, n_lists)
                take = np.maximum(first, n_probes)
                at = np.arange(n_lists)
                pick = at < take[:, None]
                yield pd.DataFrame({"query_id": np.repeat(b["vec_id"].to_numpy(), take), "list": near[pick], "first": np.broadcast_to(at, near.shape)[pick] < np.repeat(first, take), "v": [v for v, n in zip(b["v"], take, strict=True) for _ in range(n)]})

    routed = materialize(asked.mapInPandas(lean(route), "query_id long, list int, first boolean, v array<double>"), "routed")

    def scan(key, q: pd.DataFrame, c: pd.DataFrame) -> pd.DataFrame:
        out: dict[int, list[tuple[float, int]]] = {}
        if len(q) and len(c):
            raw_q, raw_x = scaled(q["v"]), scaled(c["v"])
            norm_q, norm_x = np.linalg.norm(raw_q, axis=1), np.linalg.norm(raw_x, axis=1)
            uq, ux = (raw_q / norm_q[:, None]) @ turn, (raw_x / norm_x[:, None]) @ turn
            limit = (2 - 2 * q["least"].to_numpy(np.float64)).clip(0)
            limit[np.isnan(limit)] = np.inf
            ids, qid = c["ids"].to_numpy(), q["query_id"].to_numpy()
            for i, j in survivors(uq, limit, ux):
                s = np.einsum("ij,ij->i", raw_x[j], raw_q[i]) / (norm_x[j] * norm_q[i])
                order = np.lexsort((-s, i))
                i, j, s = i[order], j[order], s[order]
                begin = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                for lo, hi in zip(begin.tolist(), [*begin[1:].tolist(), len(i)], strict=True):
                    # all that can be among the k nearest: ties with the k-th other vector too (one may be the query itself)
                    hi = lo + int(np.searchsorted(-s[lo:hi], -s[min(hi - 1, lo + k)], side="right"))
                    row = int(i[lo])
                    found = [*out.get(row, ()), *((-float(s[m]), int(v)) for m in range(lo, hi) for v in ids[j[m]] if v != qid[row])]
                    found.sort()
                    out[row] = found = found[: k * most]
                    if len(found) == k * most:
                        limit[row] = min(limit[row], 2 + 2 * found[-1][0])
        rows = [(qid[i], v, -s) for i, f in out.items() for s, v in f]
        return pd.DataFrame(rows, columns=["query_id", "vec_id", "score"]).astype({"query_id": "int64", "vec_id": "int64", "score": "float64"})

    def scanned(q: DataFrame) -> DataFrame:
        """Candidates (query_id, vec_id, score) of routed queries with `least`, the k-th best score so far or null."""
        # a list meets its own queries in blocks of about QUERY_ROWS; its vectors are sent once for each
        per = q.groupBy("list").count().select("list", F.ceil(F.col("count") / QUERY_ROWS).alias("blocks"))
        held = assigned.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(salts)).cast("int")).join(F.broadcast(per), "list").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
        q = q.join(F.broadcast(per), "list").withColumn("block", F.pmod(F.xxhash64("query_id"), F.col("blocks"))).drop("blocks").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        found = q.groupBy("list", "salt", "block").cogroup(held.groupBy("list", "salt", "block")).applyInPandas(scan, "query_id long, vec_id long, score double")
        # a query given with several vectors, or an id that has several, keeps each candidate's best score
        return found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    rank = F.row_number().over(w).alias("rank")
    near = materialize(scanned(routed.filter("first").select("query_id", "list", "v", F.lit(None).cast("double").alias("least"))).select("*", rank).filter(F.col("rank") <= k), "first-found")
    least = near.groupBy("query_id").agg(F.min("score").alias("least"), F.count("*").alias("n")).select("query_id", F.when(F.col("n") == k, F.col("least")).alias("least"))
    # a query given with several vectors has the worse of their bounds: none is lost
    rest = routed.filter(~F.col("first")).select("query_id", "list", "v").join(least, "query_id", "left")
    found = near.select("query_id", "vec_id", "score").union(scanned(rest).select("query_id", "vec_id", "score")).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return found.select("*", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op8_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """search() for the vectors whose vec_id is divisible by 50, among all; unusable vectors, ties, repeats as it says."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return search(rows, rows.filter(F.col("vec_id") % 50 == 0))
