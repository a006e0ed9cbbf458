"""Work cut into balanced parts, sampling of fixed sizes, schedules. Parts are made within a batch (a key), in one task each;
batches spread over tasks."""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Sequence
from itertools import chain, combinations, groupby

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import numbered, numbered_within

_MANY = 64  # from so many parts on, states are arrays


def differencing(sizes: Sequence[int], parts: int, equal: bool) -> list[list[int]]:
    """Indices by largest differencing: the two states of the largest spread are merged, largest set onto smallest, until one
    is left; ties go to the state with the larger largest set. equal: every part gets as many.

    A state holds the sets that aren't empty, from the smallest up, so that all states together have a set an item at most,
    however many parts there are. A set is (sum, count, its first item, items as a tree of pairs): sets share no item, so the
    first one tells apart what sum and count don't."""
    items = sorted((s, i) for i, s in enumerate(sizes))
    if equal and len(items) % parts:
        raise ValueError(f"{len(items)} rows can't be cut into {parts} equal parts")
    if len(sizes) and not equal and parts >= _MANY and sum(map(abs, sizes)) < 1 << 62:
        return _in_arrays(sizes, parts)
    step = parts if equal else 1

    def entry(sets: list[tuple]) -> tuple:  # the heap takes the least: the largest spread, then the largest set
        total, count, first, _ = sets[-1]
        return (sets[0][0] if len(sets) == parts else 0) - total, -total, -count, -first, sets

    heap = [entry(sorted((s, 1, i, i) for s, i in items[at : at + step])) for at in range(0, len(items), step)]
    if not heap:
        return [[] for _ in range(parts)]
    heapq.heapify(heap)
    while len(heap) > 1:
        a = heapq.heappop(heap)[-1]
        heapq.heapreplace(heap, entry(_merged(a, heap[0][-1], parts)))
    return [_items(tree) for _, _, _, tree in reversed(heap[0][-1])] + [[] for _ in range(parts - len(heap[0][-1]))]


def _merged(a: list[tuple], b: list[tuple], parts: int) -> list[tuple]:
    """Two states as one: the k-th smallest set of a, empty ones first, with the k-th largest of b. The few sets of the shorter
    state are put in their places among those of the longer one, which isn't sorted anew. Both are used up."""
    over = max(0, len(a) + len(b) - parts)  # so many sets of either meet one of the other, the smallest of both
    both = [(x[0] + y[0], x[1] + y[1], x[2], (x[3], y[3])) for x, y in zip(a[:over], reversed(b[:over]), strict=True)]
    long, short = (a, b) if len(a) >= len(b) else (b, a)
    del long[:over]
    more = both + short[over:]
    if len(more) * 16 > len(long):
        return sorted(long + more)
    for x in more:
        insort(long, x)
    return long


def _items(tree) -> list[int]:
    """The items of a tree from left to right."""
    out, stack = [], [tree]
    while stack:
        x = stack.pop()
        if isinstance(x, tuple):
            stack += (x[1], x[0])
        else:
            out.append(x)
    return out


def _in_arrays(sizes: Sequence[int], parts: int) -> list[list[int]]:
    """The same for many parts, not equal. A state is four arrays of its sets in ascending order (sum, count, first item, last
    item), items of a set are linked. States of one item wait in falling order; as many of them as meet the same state one
    after another are put in at once: while it has room, it stays first; when it is full, as long as the smallest sets in turn
    are those from before and the spread keeps it first."""
    size = np.asarray(sizes, dtype=np.int64)
    n, then = len(size), np.full(len(size), -1, dtype=np.int64)
    single = np.lexsort((np.arange(n), size))[::-1]
    value = size[single]

    def key(state: tuple) -> tuple:
        total, count, first, _ = state
        return (int(total[0]) if len(total) == parts else 0) - int(total[-1]), -int(total[-1]), -int(count[-1]), -int(first[-1])

    def key_at(k: int) -> tuple:
        return -int(value[k]), -int(value[k]), -1, -int(single[k])

    def singles(lo: int, hi: int) -> tuple:
        i = single[lo:hi][::-1]
        return size[i], np.ones(len(i), dtype=np.int64), i, i

    def merged(a: tuple, b: tuple, over: int) -> tuple:
        x, y = [v[:over] for v in a], [v[:over][::-1] for v in b]
        then[x[3]] = y[2]
        both = x[0] + y[0], x[1] + y[1], x[2], y[3]
        new = [np.concatenate(v) for v in zip(both, (v[over:] for v in a), (v[over:] for v in b), strict=True)]
        by = np.lexsort((new[2], new[1], new[0]))
        return tuple(v[by] for v in new)

    heap, at = [], 0
    while True:
        if at < n and (not heap or key_at(at) < heap[0][0]):
            a, at = singles(at, at + 1), at + 1
        else:
            a = heapq.heappop(heap)[1]
        if at == n and not heap:
            break
        if at == n or (heap and heap[0][0] < key_at(at)):
            b = heapq.heappop(heap)[1]
            a = merged(a, b, max(0, len(a[0]) + len(b[0]) - parts))
        else:
            end = bisect_left(range(n), True, lo=at, key=lambda k: key_at(k) > heap[0][0]) if heap else n
            if room := parts - len(a[0]):
                end = min(end, at + room)
                a = merged(a, singles(at, end), 0)
            else:
                end = min(end, at + parts)
                low, v = a[0][: end - at], value[at:end]
                sums = low + v
                least, most = np.minimum.accumulate(sums)[:-1], np.maximum(np.maximum.accumulate(sums)[:-1], a[0][-1])
                spread = most - low[1:]
                good = (least > low[1:]) & ((spread > v[1:]) | ((spread == v[1:]) & (most > v[1:])))
                end = at + 1 + (len(good) if good.all() else int(np.argmin(good)))
                a = merged(a, singles(at, end), end - at)
            at = end
        heapq.heappush(heap, (key(a), a))
    out: list[list[int]] = []
    heads, after = a[2].tolist()[::-1], then.tolist()
    for i in heads:
        out.append(items := [])
        while i >= 0:
            items.append(i)
            i = after[i]
    return out + [[] for _ in range(parts - len(out))]


def _dealt(order: Sequence[int], weights: Sequence[int], parts: int, room: int | None = None) -> list[list[int]]:
    """Indices in the given order, each to the part of the least weight so far (the first of equals) among those that have
    room; a heap holds the parts that may still take some."""
    out: list[list[int]] = [[] for _ in range(parts)]
    open_parts = [(0, j) for j in range(parts)]
    for i in order:
        weight, j = heapq.heappop(open_parts)
        out[j].append(i)
        if room is None or len(out[j]) < room:
            heapq.heappush(open_parts, (weight + weights[i], j))
    return out


def least_filled(sizes: Sequence[int], parts: int, equal: bool) -> list[list[int]]:
    """Indices in their order, each to the part of the least sum. equal: counts come before sums."""
    extra = sum(sizes) + 1 if equal else 0
    return _dealt(range(len(sizes)), [s + extra for s in sizes], parts)


def even_chunks(order: Sequence[int], sizes: Sequence[int], chunks: int) -> list[list[int]]:
    """Indices of falling size in chunks of one length and like sums; dealt in turn if they don't divide."""
    each, rest = divmod(len(order), chunks)
    return [list(order[i::chunks]) for i in range(chunks)] if rest else _dealt(order, sizes, chunks, each)


def _per_batch(df: DataFrame, batch: str, row_id: str, size: str, cut: Callable[[list[int]], list[list[int]]]) -> DataFrame:
    def run(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(row_id)
        parts = cut(b[size].astype(int).tolist())
        counts = np.array([len(p) for p in parts])
        at = np.fromiter(chain.from_iterable(parts), dtype=np.int64, count=len(b))
        place = np.arange(len(b)) - np.repeat(np.cumsum(counts) - counts, counts)
        return pd.DataFrame({"row_id": b[row_id].array[at], "part": np.repeat(np.arange(len(parts)), counts), "place": place}).assign(batch=b[batch].iat[0])

    kind = {c.name: c.dataType.simpleString() for c in df.schema}
    return df.select(batch, row_id, size).groupBy(batch).applyInPandas(run, f"row_id {kind[row_id]}, part int, place int, batch {kind[batch]}")


def balanced(df: DataFrame, batch: str, row_id: str, size: str, parts: int, equal: bool = False, greedy: bool = False) -> DataFrame:
    """(batch, row_id, part, place): each batch's rows in parts of like size sums, by differencing or (greedy) in row order."""
    return _per_batch(df, batch, row_id, size, lambda s: (least_filled if greedy else differencing)(s, parts, equal))


def micro_batches(df: DataFrame, batch: str, row_id: str, size: str, most: int) -> DataFrame:
    """The same with min(rows, ceil(sum / most)) parts, those with the largest sum of squares first."""

    def cut(s: list[int]) -> list[list[int]]:
        parts = differencing(s, min(len(s), -(-sum(s) // most)) or 1, False)
        return sorted(parts, key=lambda p: (sum(s[i] ** 2 for i in p), min(p, default=0)), reverse=True)

    return _per_batch(df, batch, row_id, size, cut)


def restored(parts: DataFrame) -> DataFrame:
    """Rows of micro_batches() in their first order again: position of each in the parts laid end to end."""
    return numbered_within(parts, ["batch"], ["part", "place"], "at").select("batch", "row_id", "at")


def length_groups(df: DataFrame, batch: str, row_id: str, size: str, per_device: int, devices: int, seed: int = 7) -> DataFrame:
    """(batch, row_id, part, place): each batch's rows shuffled by hash, cut into megabatches of per_device * devices, each
    sorted by falling size and dealt evenly to the devices."""
    import xxhash

    def run(b: pd.DataFrame) -> pd.DataFrame:
        ids, sizes = b[row_id].tolist(), b[size].astype(int).tolist()
        order = sorted(range(len(ids)), key=lambda i: (xxhash.xxh64_intdigest(str(ids[i]), seed=seed), ids[i]))
        rows, mega = [], per_device * devices
        for k, at in enumerate(range(0, len(order), mega)):
            part = sorted(order[at : at + mega], key=lambda i: -sizes[i])
            for d, chunk in enumerate(even_chunks(part, sizes, devices)):
                rows += [(ids[i], k * devices + d, n) for n, i in enumerate(chunk)]
        return pd.DataFrame(rows, columns=["row_id", "part", "place"]).assign(batch=b[batch].iat[0])

    kind = {c.name: c.dataType.simpleString() for c in df.schema}
    return df.select(batch, row_id, size).groupBy(batch).applyInPandas(run, f"row_id {kind[row_id]}, part int, place int, batch {kind[batch]}")


def _hash(*columns: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", F.lit(str(seed)), *(c.cast("string") for c in columns)).cast("binary"))


def sampled(df: DataFrame, row_id: str, n: int, seed: int = 7) -> DataFrame:
    """The n rows of the least hashes of seed and id: a shuffle's head that any engine can repeat."""
    return df.orderBy(_hash(F.col(row_id), seed=seed), row_id).limit(n)


def fraction(df: DataFrame, by: str, row_id: str, rate: float, seed: int = 3) -> DataFrame:
    """floor(n * rate) rows of each group, those of the least hashes. Counts come from an aggregation, ranks from ranges of the
    ids in order, so that no task holds a group."""
    n = df.groupBy(F.col(by).alias("_by")).agg(F.count("*").alias("_n"))
    ranked = numbered_within(df.select(by, row_id, _hash(F.col(row_id), seed=seed).alias("_h")), [by], ["_h", row_id], "_r")
    ids = ranked.join(n, F.col(by).eqNullSafe(F.col("_by"))).filter(F.col("_r") < F.floor(F.col("_n") * rate)).select(row_id)
    return df.join(ids, row_id, "left_semi")


def repeats(df: DataFrame, row_id: str, times: float, seed: int = 7) -> DataFrame:
    """(row_id, copy): from 1 on, whole copies of the table and a hashed part of it for the rest; below 1 that part alone."""
    whole, rest = int(times), times - int(times)
    copies = df.select(row_id).withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(whole - 1)))) if whole else None
    part = numbered(df.select(row_id, _hash(F.col(row_id), seed=seed).alias("_h")), ["_h", row_id], "_at", total="_n").filter(F.col("_at") < F.floor(F.col("_n") * rest + 1e-9)).select(row_id, F.lit(whole).alias("copy"))
    return part if copies is None else copies.union(part)


def schedule(df: DataFrame, row_id: str, epochs: int, seed: int = 7) -> DataFrame:
    """(epoch, id, pos): every id once per epoch, in an order of its own; positions from 1. An epoch's order is cut into
    ranges, so that no task holds an epoch."""
    d = df.select(F.col(row_id).alias("id")).withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    d = d.withColumn("_h", _hash(F.col("epoch"), F.col("id"), seed=seed))
    return numbered_within(d, ["epoch"], ["_h", "id"]).select("epoch", "id", (F.col("pos") + 1).alias("pos"))


def of_fixed_size(items: Column, k: int, key: Column, seed: int = 7) -> Column:
    """k items, in order: of fewer with replacement, drawn by hash."""
    n = F.size(items)
    ranked = F.slice(F.array_sort(F.transform(items, lambda x, i: F.struct(_hash(key, i, seed=seed).alias("h"), i.alias("i")))), 1, k)
    few = F.transform(F.sequence(F.lit(1), F.lit(k)), lambda j: F.pmod(F.conv(F.substring(_hash(key, j, seed=seed), 1, 8), 16, 10).cast("long"), n).cast("int"))
    at = F.array_sort(F.when(n >= k, F.transform(ranked, lambda s: s["i"])).otherwise(few))
    return F.when(n > 0, F.transform(at, lambda i: F.get(items, i)))


def balanced_pairs(rows: DataFrame, strata: Sequence[str], key: str, action: str, difficulty: str, distractors: str, actions: Sequence[str], difficulties: Sequence[str]) -> list[tuple]:
    """A pair of rows from each stratum, stratum by stratum, that keeps the counts of actions and then of difficulties most
    even; ties by different actions, different difficulties, distance of distractors, ids.

    Rows of a stratum with one action, difficulty and number of distractors are alike but for their ids, so of each such class
    only the two first ids can be chosen: classes are made by aggregation, and the walk over strata, which carries the counts
    from one to the next, sees classes and not rows, a stratum at a time."""
    kind = [*strata, action, difficulty, distractors]
    first = rows.select(*kind, key).withColumn("_n", F.row_number().over(Window.partitionBy(*kind).orderBy(key))).filter("_n <= 2")
    classes = first.groupBy(*kind).agg(F.array_sort(F.collect_list(key)).alias("_ids")).orderBy(*kind)
    a, d, out = Counter(), Counter(), []

    def uneven(c: Counter, more: tuple, names: Sequence[str]) -> tuple:
        v = [c[n] + more.count(n) for n in names]
        return max(v) - min(v), sum((x - sum(v) / len(v)) ** 2 for x in v)

    def cost(pair: tuple) -> tuple:
        (x, i), (y, j) = pair
        return (*uneven(a, (x[action], y[action]), actions), x[action] == y[action], *uneven(d, (x[difficulty], y[difficulty]), difficulties), x[difficulty] == y[difficulty], -abs(x[distractors] - y[distractors]), i, j)

    for stratum, group in groupby(classes.toLocalIterator(), key=lambda r: tuple(r[s] for s in strata)):
        group = list(group)
        pairs = [sorted(((x, x["_ids"][0]), (y, y["_ids"][0])), key=lambda p: p[1]) for x, y in combinations(group, 2)]
        pairs += [[(x, x["_ids"][0]), (x, x["_ids"][1])] for x in group if len(x["_ids"]) > 1]
        best = min(pairs, key=cost, default=None)
        if best is None:
            raise ValueError(f"stratum {stratum} has no pair")
        a.update(x[action] for x, _ in best)
        d.update(x[difficulty] for x, _ in best)
        out += [(*stratum, i) for _, i in best]
    return out


def page_interval(pages: Column, most: int, limit: int = 20) -> Column:
    """Pages per group: at most `most` groups, or, where those would hold over `limit` pages, as few pages as keep to it."""
    groups = F.when(pages / most > limit, F.ceil(pages / limit)).otherwise(F.lit(most))
    return F.greatest(F.ceil(pages / groups), F.lit(1)).cast("long")


def clip_frames(count: Column, clips: int = 10, per: int = 10) -> Column:
    """Frame numbers of `clips` clips of `per` frames each out of `count` frames, which are taken again as often as needed."""
    return F.array_sort(F.transform(F.sequence(F.lit(0), F.lit(clips * per - 1)), lambda i: (i % count).cast("int")))
