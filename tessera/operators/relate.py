"""Joins of tables by key: strict ones that fail on gaps, annotation joins, paired variants, near-equal pairs."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import scratch
from .ordered import laid_out


def unknown(df: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Rows of df whose key isn't known."""
    return df.join(known.select(key).distinct(), key, "left_anti")


def strict(df: DataFrame, known: DataFrame, key: str, keep: Sequence[str]) -> DataFrame:
    """df with columns of `known`; a key that isn't known is an error when the row is reached."""
    k = known.select(key, *keep, F.lit(True).alias("_known"))
    d = df.join(k, key, "left")
    return d.filter(F.assert_true(F.coalesce("_known", F.lit(False)), F.concat(F.lit("unknown key "), F.col(key).cast("string"))).isNull()).drop("_known")


def answer_key(df: DataFrame, key_table: DataFrame, key: str, answer: str) -> DataFrame:
    """Rows with a known key, and its answer."""
    return df.join(key_table.select(key, answer), key)


def last_by(df: DataFrame, key: str, order: str) -> DataFrame:
    rest = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *rest)).alias("_r")).select(key, F.col(f"_r.{order}").alias(order), *(F.col(f"_r.{c}").alias(c) for c in rest))


def references(refs: DataFrame, annotations: DataFrame, mode: str = "all") -> DataFrame:
    """(image_id, ref_id, ann_id, category_id, text): references (ref_id, ann_id, sentences) with their annotations
    (ann_id, ann_order, image_id, category_id), the last one of an id. Text: all sentences joined (concat), the first, one by
    a hash of the reference (random), or a row each (all)."""
    text = {"concat": F.array(F.array_join("sentences", "")), "first": F.slice("sentences", 1, 1), "random": F.array(F.get("sentences", F.pmod(F.xxhash64("ref_id"), F.size("sentences")).cast("int"))), "all": F.col("sentences")}[mode]
    d = refs.join(last_by(annotations, "ann_id", "ann_order").drop("ann_order"), "ann_id")
    return d.select("image_id", "ref_id", "ann_id", "category_id", F.explode(text).alias("text"))


def reference_filter(refs: DataFrame, images: Sequence[int] = (), categories: Sequence[int] = (), ids: Sequence[int] = (), split: str | None = None) -> DataFrame:
    """References that meet all that is given; a split such as testA stands for every split that holds its last letter."""
    for col, values in (("image_id", images), ("category_id", categories), ("ref_id", ids)):
        if values:
            refs = refs.filter(F.col(col).isin(*values))
    if split is None:
        return refs
    return refs.filter(F.col("split").contains(split[-1]) if split in ("testA", "testB", "testC") else F.col("split").contains("test") if split == "test" else F.col("split") == split)


def annotation_ids(annotations: DataFrame, images: DataFrame) -> DataFrame:
    return annotations.join(images.select("image_id").distinct(), "image_id", "left_semi").select("ann_id").distinct()


def many_references(refs: DataFrame, annotations: DataFrame) -> DataFrame:
    """A row per reference and annotation id (an array; -1: no target, whose mask is null)."""
    return refs.withColumn("ann_id", F.explode_outer("ann_ids")).drop("ann_ids").join(annotations.select("ann_id", "mask"), "ann_id", "left")


def side_by_side(a: DataFrame, b: DataFrame, row_id: str) -> DataFrame:
    """Columns of both tables by row; a column of both must be equal in every row, else it is an error."""
    shared = [c for c in a.columns if c in b.columns and c != row_id]
    d = a.join(b.select(row_id, *(F.col(c).alias(f"_b_{c}") if c in shared else F.col(c) for c in b.columns if c != row_id)), row_id)
    for c in shared:
        d = d.filter(F.assert_true(F.col(c).eqNullSafe(F.col(f"_b_{c}")), f"column {c} differs").isNull()).drop(f"_b_{c}")
    return d


def variants(df: DataFrame, key: str, variant: str, value: str, names: Sequence) -> DataFrame:
    """A row per key, a column per variant; a key that lacks one or has it twice is an error. One aggregation."""
    each = [F.max(F.when(F.col(variant) == n, F.col(value))).alias(f"v{n}") for n in names]
    d = df.filter(F.col(variant).isin(*names)).groupBy(key).agg(*each, F.count("*").alias("_n"), F.countDistinct(variant).alias("_k"))
    fine = (F.col("_n") == len(names)) & (F.col("_k") == len(names))
    return d.filter(F.assert_true(fine, F.concat(F.lit("variants are missing or repeated for "), F.col(key).cast("string"))).isNull()).drop("_n", "_k")


def incomplete(df: DataFrame, key: str, variant: str, names: Sequence) -> DataFrame:
    """(key, n, missing): keys that lack a variant or have one twice."""
    d = df.groupBy(key).agg(F.count("*").alias("n"), F.collect_set(variant).alias("_s"))
    missing = F.filter(F.array(*(F.lit(n) for n in names)), lambda x: ~F.array_contains("_s", x))
    return d.select(key, "n", F.array_join(F.transform(missing, lambda x: x.cast("string")), ",").alias("missing")).filter((F.col("missing") != "") | (F.col("n") != len(names)))


def deltas(a: DataFrame, b: DataFrame, key: str, value: str) -> DataFrame:
    """(key, delta): b's value less a's; null where a side lacks the key."""
    x, y = a.select(F.col(key).alias("_a"), F.col(value).alias("_x")), b.select(F.col(key).alias("_b"), F.col(value).alias("_y"))
    return x.join(y, F.col("_a").eqNullSafe(F.col("_b")), "full_outer").select(F.coalesce("_a", "_b").alias(key), (F.col("_y") - F.col("_x")).alias("delta"))


def resolved(df: DataFrame, key: str, value: str, most: int = 64) -> DataFrame:
    """df whose value, where it is at most `most` characters long, is the key of another row, has that row's value instead."""
    other = df.select(F.col(key).cast("string").alias("_k"), F.col(value).alias("_v"))
    return df.join(other, (F.length(value) <= most) & (F.col(value) == F.col("_k")), "left").withColumn(value, F.coalesce("_v", value)).drop("_k", "_v")


def video_frames(expressions: DataFrame, masks: DataFrame, predictions: DataFrame) -> DataFrame:
    """(vid, exp, frame, anno, truth, prediction): expressions (vid, exp, annos, frames) by annotation and frame, with their
    masks (vid, anno, frame, mask) and predictions (vid, exp, frame, mask); masks that aren't there are null."""
    e = expressions.select("vid", "exp", F.explode("annos").alias("anno"), "frames").withColumn("frame", F.explode("frames")).drop("frames")
    t, p = masks.withColumnRenamed("mask", "truth"), predictions.withColumnRenamed("mask", "prediction")
    return e.join(t, ["vid", "anno", "frame"], "left").join(p, ["vid", "exp", "frame"], "left").select("vid", "exp", "frame", "anno", "truth", "prediction")


def video_areas(joined: DataFrame) -> DataFrame:
    """(vid, exp, frame, inter, total) of the annotations' union against the prediction, masks as bits of a long."""
    zero = lambda c: F.coalesce(F.col(c), F.lit(0).cast("long"))
    d = joined.groupBy("vid", "exp", "frame").agg(F.bit_or(zero("truth")).alias("t"), F.max(zero("prediction")).alias("p"))
    bits = lambda c: F.bit_count(c).cast("int")
    return d.select("vid", "exp", "frame", bits(F.col("t").bitwiseAND(F.col("p"))).alias("inter"), bits(F.col("t").bitwiseOR(F.col("p"))).alias("total"))


def same_content(a: DataFrame, b: DataFrame, key: str, digest: str) -> DataFrame:
    """(digest, a_ids, b_ids): contents that both tables hold, the number of rows and the first key on each side. A row per
    content: copies aren't expanded into pairs."""
    side = lambda d, n: d.groupBy(digest).agg(F.count("*").alias(f"n_{n}"), F.min(key).alias(f"first_{n}"))
    return side(a, "a").join(side(b, "b"), digest)


def back_to_parts(df: DataFrame, part: str, original: str, index: str) -> DataFrame:
    """Rows of a concatenation with the index of the table that each came from instead of that of the whole; `part` names it."""
    return df.drop(index).withColumnRenamed(original, index)


def images_of(images: DataFrame, annotations: DataFrame, ids: Sequence[int] = (), categories: Sequence[int] = ()) -> DataFrame:
    """Images (all their columns) among the ids, if given, that have an annotation of every one of the categories."""
    if ids:
        images = images.filter(F.col("image_id").isin(*ids))
    if categories:
        has = annotations.filter(F.col("category_id").isin(*categories)).groupBy("image_id").agg(F.count_distinct("category_id").alias("_k")).filter(F.col("_k") == len(set(categories)))
        images = images.join(has, "image_id", "left_semi")
    return images


def packed_answers(rows: DataFrame, packs: DataFrame, key: str, index: str) -> DataFrame:
    """rows with `answer`: the entry of their index in their key's JSON object (packs: key, pack); null if it isn't there."""
    p = packs.select(key, F.from_json("pack", "map<string,string>").alias("_m"))
    return rows.join(p, key, "left").withColumn("answer", F.try_element_at("_m", F.col(index).cast("string"))).drop("_m")


def looked_up(df: DataFrame, ids: str, objects: str, out: str = "masks") -> DataFrame:
    """df with the objects (a map) of its ids, in order; an id that isn't there is an error."""
    found = F.transform(ids, lambda x: F.try_element_at(F.col(objects), x))
    return df.withColumn(out, found).filter(F.assert_true(F.forall(out, lambda x: x.isNotNull()), "an object is missing").isNull())


def _l1(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y)), F.lit(0.0), lambda t, x: t + x)


def pivots(pixels: Column, n: int) -> list[Column]:
    """Mean distances (0 to 1) of the pixels from n fixed images: black, then white in every other block of half, a quarter,
    an eighth... of the pixels."""
    def apart(k: int) -> Column:
        white = lambda i: F.floor(i * 2**k / F.size(pixels)) % 2 == 1 if k else F.lit(False)
        return F.aggregate(F.transform(pixels, lambda x, i: F.abs(x - F.when(white(i), 255.0).otherwise(0.0))), F.lit(0.0), lambda t, x: t + x) / F.size(pixels) / 255

    return [apart(k) for k in range(n)]


def thumbnail_candidates(df: DataFrame, key: str, split: str, pixels: str, most: float, n: int = 3) -> DataFrame:
    """(a, b, left, right): pairs of different splits, a < b, whose distances from each of n pivots are in the same or in
    neighbouring cells of the width `most`.

    By the triangle inequality two rows at most `most` apart differ by no more than that in their distance from any pivot, so
    no near pair is lost; each pivot beyond the first tells apart rows that are alike in the ones before. The side that is
    looked up is copied to the 3^n cells around its own."""
    width = most * (1 + 1e-9) + 1e-12
    cells = [F.floor(x / width) for x in pivots(F.col("_p"), n)]
    d = df.select(F.col(key).alias("_k"), F.col(split).alias("_s"), F.col(pixels).alias("_p")).withColumns({f"_c{k}": x for k, x in enumerate(cells)})
    other = d.withColumnsRenamed({"_k": "_k2", "_s": "_s2", "_p": "_p2"})
    for k in range(n):
        other = other.withColumn(f"_c{k}", F.explode(F.array(F.col(f"_c{k}") - 1, F.col(f"_c{k}"), F.col(f"_c{k}") + 1)))
    j = d.join(other, [f"_c{k}" for k in range(n)]).filter((F.col("_k") < F.col("_k2")) & (F.col("_s") != F.col("_s2")))
    return j.select(F.col("_k").alias("a"), F.col("_k2").alias("b"), F.col("_p").alias("left"), F.col("_p2").alias("right"))


def _across(most: float):
    """The near pairs of two blocks (ids and pixels; a row each, of two splits). A slice of the left block at a time meets the
    whole right one, so that no matrix is larger than 2 MB."""

    def run(blocks: pa.Table) -> pa.Table:
        left, right = (blocks["_ids"][k].values for k in (0, 1))
        x, y = (blocks["_px"][k].values.to_numpy().reshape(len(ids), -1) for k, ids in enumerate((left, right)))
        y = np.ascontiguousarray(y.T)
        step, found = max(1, (1 << 18) // len(right)), []
        for lo in range(0, len(left), step):
            part = x[lo : lo + step]
            total = np.zeros((len(part), len(right)))
            for j in range(len(y)):  # in the pixels' order, so that sums are the same whoever adds them
                total += np.abs(part[:, j, None] - y[j])
            total = total / len(y) / 255
            i, j = np.nonzero(total <= most)
            found.append((i + lo, j, total[i, j]))
        i, j, gap = (np.concatenate(v) for v in zip(*found, strict=True))
        a, b = left.take(pa.array(i)), right.take(pa.array(j))
        less = pc.less(a, b)
        out = pa.table({"a": pc.if_else(less, a, b), "b": pc.if_else(less, b, a), "distance": pa.array(gap)})
        return out.filter(pc.not_equal(a, b))

    return run


def near_thumbnails(df: DataFrame, key: str, split: str, pixels: str, most: float, n: int = 3, block: int = 1024) -> DataFrame:
    """(a, b, distance): pairs of different splits whose mean absolute difference (0 to 1) is at most `most`, a < b.

    Rows lie in blocks of a split, in the order of the cells of their distances from n pivots. Two blocks meet where their
    ranges are within `most` for every pivot (by the triangle inequality no near pair is lost): each two are a group of two
    rows, dealt by hash, so that work and memory of a group are bounded by the block however many rows share a cell, and a row
    is copied once a block beside its own, not once a row."""
    kind = df.select(key).schema[0].dataType.simpleString()
    width = most * (1 + 1e-9) + 1e-12
    cells = [f"_c{k}" for k in range(n)]
    d = df.select(F.col(key).alias("_k"), F.col(split).alias("_s"), F.col(pixels).cast("array<double>").alias("_p"))
    d = d.filter("_k is not null and _s is not null and size(_p) > 0 and forall(_p, x -> x is not null)")
    d = d.withColumn("_n", F.size("_p")).withColumns({f"_x{k}": x for k, x in enumerate(pivots(F.col("_p"), n))})
    d = laid_out(d.withColumns({f"_c{k}": F.floor(F.col(f"_x{k}") / width) for k in range(n)}), ["_s", "_n", *cells, "_k"])
    ends = {f"_{side}{k}": end(f"_x{k}") for k in range(n) for side, end in (("lo", F.min), ("hi", F.max))}
    rows = d.groupBy("_s", "_n", "__part", F.floor(F.col("__at") / block)).agg(F.collect_list(F.struct("_k", "_p")).alias("_rows"), *(x.alias(c) for c, x in ends.items()))
    path = scratch(df.sparkSession, "blocks")
    flat = rows.select("_s", "_n", *ends, F.transform("_rows", lambda s: s["_k"]).alias("_ids"), F.flatten(F.transform("_rows", lambda s: s["_p"])).alias("_px"))
    flat.withColumn("_b", F.monotonically_increasing_id()).write.parquet(path)
    blocks = df.sparkSession.read.parquet(path)
    one = blocks.select("_b", "_s", "_n", *ends)
    two = one.withColumnsRenamed({c: f"{c}_" for c in ("_b", "_s", *ends)})
    near = F.col("_s") < F.col("_s_")
    for k in range(n):
        near = near & (F.col(f"_lo{k}") <= F.col(f"_hi{k}_") + width) & (F.col(f"_lo{k}_") <= F.col(f"_hi{k}") + width)
    met = one.join(F.broadcast(two), "_n").filter(near).select(F.col("_b").alias("_one"), F.col("_b_").alias("_two"))  # a row per block
    met = met.select("_one", "_two", F.explode(F.array("_one", "_two")).alias("_b")).join(blocks.select("_b", "_ids", "_px"), "_b")
    out = met.groupBy("_one", "_two").applyInArrow(_across(most), f"a {kind}, b {kind}, distance double")
    return out.withColumn("distance", F.round("distance", 8))


CODE_BITS = 64


def chunks(code: Column, bits: int) -> Column:
    """A code cut into bits + 1 parts: two codes that differ in at most `bits` places share one of them whole."""
    cut = [k * CODE_BITS // (bits + 1) for k in range(bits + 2)]
    return F.array(*(F.shiftrightunsigned(code, lo).bitwiseAND((1 << (hi - lo)) - 1 if hi - lo < CODE_BITS else -1) for lo, hi in zip(cut, cut[1:], strict=False)))


def image_candidates(df: DataFrame, key: str = "sample_id", split: str = "split", bits: int = 4, foreground: float = 0.002) -> DataFrame:
    """Pairs of different splits, a < b, in one bucket of aspects, that share a chunk of their codes and lie in the same or in
    neighbouring cells of the foreground's share; each pair once, with the columns of both (suffixes 1 and 2).

    Chunks lose no pair within `bits` (multi-index hashing), cells none within `foreground`: both are keys of the join, so a
    bucket of aspects is never crossed with itself. A pair that shares several chunks counts at the first."""
    cols = ["aspect", "dhash", "histogram", "edge", "mask", "foreground"]
    width = foreground * (1 + 1e-9) + 1e-12
    cell = F.floor(F.col("foreground") / width)
    own = df.select(F.rint(F.col("aspect") * 20).cast("long").alias("_b"), F.col(key).alias("_id"), F.col(split).alias("_s"), *cols).withColumns({"_chunks": chunks(F.col("dhash"), bits), "_cell": cell})
    own = own.select("*", F.posexplode("_chunks").alias("_at", "_chunk"))
    side = lambda k: own.withColumnsRenamed({c: f"{c}{k}" for c in ("_id", "_s", "_chunks", *cols)})
    other = side(2).withColumn("_cell", F.explode(F.array(F.col("_cell") - 1, F.col("_cell"), F.col("_cell") + 1)))
    first = F.array_position(F.zip_with("_chunks1", "_chunks2", lambda x, y: x == y), True) == F.col("_at") + 1
    j = side(1).join(other, ["_b", "_cell", "_at", "_chunk"]).filter((F.col("_id1") < F.col("_id2")) & (F.col("_s1") != F.col("_s2")) & first)
    return j.select(F.col("_id1").alias("a"), F.col("_id2").alias("b"), *(f"{c}{k}" for c in cols for k in (1, 2)))


def near_images(df: DataFrame, key: str = "sample_id", split: str = "split", bits: int = 4, histogram: float = 0.08, edge: float = 0.025, mask: float = 0.01, foreground: float = 0.002) -> DataFrame:
    """(a, b, hamming, histogram_l1, edge_mae, mask_mae): pairs of different splits in one bucket of aspects that pass all
    tests in turn. df has aspect, dhash (long), histogram, edge, mask (arrays of doubles), foreground."""
    gap = lambda c: _l1(F.col(f"{c}1"), F.col(f"{c}2"))
    hamming = F.bit_count(F.col("dhash1").bitwiseXOR(F.col("dhash2"))).cast("int")
    j = image_candidates(df, key, split, bits, foreground).filter((F.abs(F.col("aspect1") - F.col("aspect2")) <= 0.02) & (hamming <= bits))
    j = j.withColumns({"hamming": hamming, "histogram_l1": gap("histogram") / 3, "edge_mae": gap("edge") / F.size("edge1"), "mask_mae": gap("mask") / F.size("mask1")})
    return j.filter((F.col("histogram_l1") <= histogram) & (F.col("edge_mae") <= edge) & (F.col("mask_mae") <= mask) & (F.abs(F.col("foreground1") - F.col("foreground2")) <= foreground)).select("a", "b", "hamming", "histogram_l1", "edge_mae", "mask_mae")


def _nearest(most: int):
    """Of a task's pairs the number and the nearest `most`; batches are merged one at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, n = None, 0
        for b in batches:
            n += b.num_rows
            t = pa.Table.from_batches([b])
            t = t if best is None else pa.concat_tables([best, t])
            if best is not None and best.num_rows == most:  # what is farther than the last of them can't be among them
                t = t.filter(pc.less_equal(t["distance"], best["distance"][most - 1]))
            best = t.sort_by([(c, "ascending") for c in ("distance", "a", "b")]).slice(0, most)
        if best is not None:
            count = pa.array([n] + [0] * (best.num_rows - 1), pa.int64()) if best.num_rows else pa.array([], pa.int64())
            yield from best.append_column("n_pairs", count).combine_chunks().to_batches()

    return run


def reported(pairs: DataFrame, most: int = 200) -> DataFrame:
    """The nearest `most` pairs and, in each row, the number of all and whether some are left out. Pairs are made once: each
    task gives its own nearest, so that `most` rows a task meet in the end."""
    p = pairs.select("distance", "a", "b")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in p.schema)
    got = p.mapInArrow(_nearest(most), f"{kinds}, n_pairs long").agg(F.sum("n_pairs").alias("n_pairs"), F.array_sort(F.collect_list(F.struct("distance", "a", "b"))).alias("_p"))
    out = got.select("n_pairs", F.explode(F.slice("_p", 1, most)).alias("_p"))
    return out.select("_p.a", "_p.b", "_p.distance", "n_pairs", (F.col("n_pairs") > most).alias("truncated"))
