"""Normalisation against the rule in plain Python, to its fixed point however many turns that takes."""

import random
import re
import unicodedata

from pyspark.sql import functions as F

from tessera.functions import answers


def plain(x):
    x = "".join(c for c in unicodedata.normalize("NFKD", x) if unicodedata.category(c) != "Mn")
    x = re.sub("[‘’´`]", "'", x)
    x = re.sub("[“”]", '"', x)
    x = re.sub("[‐‑‒–—−]", "-", x)
    old = None
    while x != old:
        old = x
        x = re.sub(r"((?<!^)\[[^\]]*\]|\[\d+\]|[•♦†‡*#+])*$", "", x.strip(" "))
        x = re.sub(r"(?<!^)( \([^)]*\))*$", "", x.strip(" "))
        x = re.sub(r'^"([^"]*)"$', r"\1", x.strip(" "))
    return re.sub(r"\s+", " ", re.sub(r"\.$", "", x)).lower().strip(" ")


def test_normalised(spark):
    r = random.Random(7)
    deep = "Rome" + "".join(f" ({i}) [{i}]" for i in range(25))
    texts = ["", " ", deep, '"Rome [1]" (x)', "Élan.", "a (b) c", *("".join(r.choice(["a", "É", " ", ' "', '"', " (x)", "[1]", "[z]", "*", ".", "–"]) for _ in range(r.randint(0, 12))) for _ in range(200))]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, t string").select("i", answers.normalized(F.col("t")).alias("n")).collect()
    assert {x.i: x.n for x in got} == {-1: None, **{i: plain(t) for i, t in enumerate(texts)}}
