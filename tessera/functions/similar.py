"""Best matching n-gram of a text: by Ratcliff and Obershelp's ratio, which has no built-in form; row by row in batches."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_FIELDS = "text string, similarity double, precision double, recall double, f1 double, jaccard double, rouge1 double, exact double"


def best_ngram(hay: str, needle: str, joint: str = " ") -> tuple:
    """Of the n-grams of hay as long as the needle that share a word with it, the most similar (the first of equals), and its
    scores by sets of words."""
    h, n = (list(x) for x in (hay, needle)) if joint == "" else (hay.split(), needle.split())
    want, best, gram = set(n), 0.0, None
    for i in range(len(h) - len(n) + 1):
        g = h[i : i + len(n)]
        if not want.isdisjoint(g):
            ratio = SequenceMatcher(None, joint.join(g), needle).ratio()
            if ratio > best:
                best, gram = ratio, g
    if gram is None:
        return ("", 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0)
    got = set(gram)
    both = len(got & want)
    p, r = both / len(got), both / len(want)
    overlap = sum(min(gram.count(w), n.count(w)) for w in want)
    return (joint.join(gram), best, p, r, 2 * p * r / (p + r) if p + r else 0.0, both / len(got | want), overlap / len(n), float(gram == n))


def with_best_ngram(df: DataFrame, hay: str, needle: str, joint: str = " ") -> DataFrame:
    """df with `best`: the n-gram and its scores; null texts count as empty."""

    @F.pandas_udf(_FIELDS)
    def find(h: pd.Series, n: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_ngram(a or "", b or "", joint) for a, b in zip(h, n, strict=True)], columns=[f.split()[0] for f in _FIELDS.split(", ")])

    return df.withColumn("best", find(hay, needle))
