"""Caption scores from n-gram counts and common subsequences: BLEU over a corpus, ROUGE-L, and CIDEr with the corpus's own
document frequencies. Captions are rows (id, hypothesis, references): an array of tokens and an array of such arrays.

n-grams are counted within their caption and summed up over captions by aggregations; nothing holds a vocabulary.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.answers import _let
from ..session import scratch

#: Orders of n-grams, the guards of BLEU, the weight of recall in ROUGE-L, the spread and scale of CIDEr.
ORDERS = 4
TINY, SMALL = 1e-15, 1e-9
BETA = 1.2
SIGMA, SCALE = 6.0, 10.0
#: n-grams of more than one in so many captions are broadcast.
OFTEN = 1000


def ngrams(tokens: Column, n: Column) -> Column:
    """The n-grams of an array of tokens, repeats included, each an array."""
    last = F.size(tokens) - n
    return F.when(last >= 0, F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(tokens, i + 1, n))).otherwise(F.array().cast("array<array<string>>"))


def counted(df: DataFrame) -> DataFrame:
    """(id, n, gram, h, r): a row per distinct n-gram of a caption (id is a key), its count in the hypothesis and in each of the
    references; and a row with n = 0 and no gram. All of a caption is counted in its own row, without a shuffle."""
    times = lambda grams, g: F.size(F.filter(grams, lambda x: x == g))

    def tally(n: int) -> Callable[[Column], Column]:
        entry = lambda s, g: F.struct(F.lit(n).alias("n"), g.alias("gram"), times(s["h"], g).alias("h"), F.transform(s["r"], lambda r: times(r, g)).alias("r"))
        return lambda s: F.transform(F.array_distinct(F.concat(s["h"], F.flatten(s["r"]))), lambda g: entry(s, g))

    of = lambda n: F.struct(ngrams(F.col("hypothesis"), F.lit(n)).alias("h"), F.transform("references", lambda r: ngrams(r, F.lit(n))).alias("r"))
    none = F.array(F.struct(F.lit(0).alias("n"), F.lit(None).cast("array<string>").alias("gram"), F.lit(0).alias("h"), F.transform("references", lambda r: F.lit(0)).alias("r")))
    all_ = F.concat(none, *(_let(of(n), tally(n)) for n in range(1, ORDERS + 1)))
    return df.select("id", F.explode(all_).alias("s")).select("id", "s.*")


def bleu(df: DataFrame) -> DataFrame:
    """(n, bleu) for n from 1 to 4, over the whole corpus: counts clipped by the reference that has an n-gram most often, and
    the brevity of hypotheses against the reference of the closest length (the shorter of two)."""
    right = counted(df).groupBy("n").agg(F.sum(F.least("h", F.coalesce(F.array_max("r"), F.lit(0)))).alias("right"))
    size = F.size("hypothesis")
    closest = F.array_min(F.transform("references", lambda r: F.struct(F.abs(F.size(r) - size).alias("gap"), F.size(r).alias("len"))))["len"]
    lengths = df.agg(F.sum(size).alias("test"), F.sum(closest).alias("ref"), *(F.sum(F.greatest(size - (n - 1), F.lit(0))).alias(f"guess{n}") for n in range(1, ORDERS + 1)))
    orders = df.sparkSession.range(1, ORDERS + 1).select(F.col("id").cast("int").alias("n")).join(right, "n", "left").crossJoin(F.broadcast(lengths))
    share = (F.coalesce("right", F.lit(0)) + TINY) / (F.element_at(F.array(*(F.col(f"guess{n}") for n in range(1, ORDERS + 1))), F.col("n")) + SMALL)
    upto = F.exp(F.sum(F.log(share)).over(Window.orderBy("n").rowsBetween(Window.unboundedPreceding, 0)) / F.col("n"))  # four rows
    ratio = (F.col("test") + TINY) / (F.col("ref") + SMALL)
    return orders.select("n", (upto * F.when(ratio < 1, F.exp(1 - 1 / ratio)).otherwise(1.0)).alias("bleu"))


def common_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence of two arrays: one row of the table is folded over a, within it one over b."""

    def row(before: Column, x: Column) -> Column:
        step = lambda r, j: F.concat(r, F.array(F.when(F.get(b, j) == x, F.get(before, j) + 1).otherwise(F.greatest(F.get(before, j + 1), F.element_at(r, -1)))))
        return F.aggregate(F.sequence(F.lit(0), F.size(b) - 1), F.array(F.lit(0)), step)

    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(F.element_at(F.aggregate(a, F.array_repeat(F.lit(0), F.size(b) + 1), row), -1))


def rouge_l(df: DataFrame) -> DataFrame:
    """(id, rouge_l): F measure of the best precision and the best recall over the references."""
    lcs = F.transform("references", lambda r: common_length(F.col("hypothesis"), r))
    d = df.select("id", "hypothesis", "references", lcs.alias("l"))
    best = lambda size: F.coalesce(F.array_max(F.zip_with("l", "references", lambda n, r: F.when(size(r) > 0, n / size(r)))), F.lit(0.0))
    p, r = best(lambda r: F.size("hypothesis")), best(F.size)
    return d.select("id", F.when((p > 0) & (r > 0), (1 + BETA**2) * p * r / (r + BETA**2 * p)).otherwise(0.0).alias("rouge_l"))


def cider(df: DataFrame) -> DataFrame:
    """(id, cider): n-gram vectors weighed by log(captions / captions whose references hold the n-gram), the hypothesis clipped
    by each reference, with a penalty for another number of bigrams; mean over orders and references, times ten.

    An n-gram that more than one in OFTEN captions hold is looked up in a broadcast table: there are at most OFTEN times as many
    as a caption has n-grams on average, whatever the corpus; the rest are joined. What is added up is a row a reference."""
    spark = df.sparkSession
    g = counted(df)
    path = scratch(spark, "frequency")
    g.filter("n > 0 and exists(r, x -> x > 0)").groupBy("n", "gram").agg(F.count("*").alias("_df")).write.parquet(path)
    corpus = df.agg(F.count("*").cast("double").alias("_all"))
    frequency = spark.read.parquet(path).withColumnsRenamed({"n": "_n", "gram": "_g"}).crossJoin(F.broadcast(corpus))
    often = F.col("_df") > F.col("_all") / OFTEN
    same = (F.col("n") == F.col("_n")) & (F.col("gram") == F.col("_g"))
    tried = g.join(F.broadcast(frequency.filter(often).drop("_all")), same, "left").drop("_n", "_g")
    rest = (F.col("n") > 0) & F.col("_df").isNull()
    rare = tried.filter(rest).drop("_df").join(frequency.filter(~often).drop("_all"), same, "left").drop("_n", "_g")
    w = tried.filter(~rest).unionByName(rare).crossJoin(F.broadcast(corpus))
    w = w.withColumn("w", F.log("_all") - F.log(F.greatest(F.coalesce("_df", F.lit(0)), F.lit(1)).cast("double")))
    w = w.select("id", "n", (F.col("h") * F.col("w")).alias("h"), "w", F.posexplode_outer("r").alias("side", "r")).withColumn("r", F.col("r") * F.col("w"))
    dot = F.when(F.col("h") != 0, F.least("h", "r") * F.col("r"))  # zero counts weigh nothing
    sums = {"hh": F.col("h") * F.col("h"), "rr": F.col("r") * F.col("r"), "dot": dot}
    order = range(1, ORDERS + 1)
    s = w.groupBy("id", "side").agg(*(F.sum(F.when(F.col("n") == n, x)).alias(f"{c}{n}") for n in order for c, x in sums.items()))

    def cos(n: int) -> Column:
        both = F.sqrt(f"hh{n}") * F.sqrt(f"rr{n}")
        return F.coalesce(F.when(both > 0, F.col(f"dot{n}") / both).otherwise(F.col(f"dot{n}")), F.lit(0.0))

    total = s.select("id", "side", (sum((cos(n) for n in order), F.lit(0.0)) / ORDERS).alias("c"))
    each = df.select("id", "hypothesis", F.posexplode_outer("references").alias("side", "words"))
    pairs = lambda x: F.greatest(F.size(x) - 1, F.lit(0))
    gap = pairs("hypothesis") - pairs("words")
    each = each.select("id", "side", F.exp(-(gap * gap) / (2 * SIGMA**2)).alias("near"))
    return each.join(total, ["id", "side"], "left").groupBy("id").agg((F.sum(F.coalesce(F.col("c") * F.col("near"), F.lit(0.0))) / F.count("*") * SCALE).alias("cider"))
