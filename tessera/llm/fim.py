"""Fill-in-middle: texts cut in three by unit ranks that an event scan gives, and put together anew behind sentinels.

One Aho-Corasick automaton finds, in one pass over a text, the ASCII characters that change the class of what follows
(white space against words, line ends against lines) and the sentinels. Between two such events the text is of one class, so
the number of units in a gap follows from its length alone: every code point is a unit, or a gap that isn't empty starts one.
Ranks are looked up among the events by binary search and an offset in the gap.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, small_batches

#: White space of the words rule `[^\x20\x09-\x0D]+`, and the sentinels of prefix, suffix and middle.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
SENTINELS = ("<P>", "<S>", "<M>")
UNITS = ("chars", "words", "lines")
SPACE, LINE, SENTINEL = 0, 1, 2
PLAIN, PSM, SPM = "plain", "psm", "spm"


class Scanner:
    """One automaton over the class-changing characters and the sentinels."""

    def __init__(self):
        self.automaton = ahocorasick.Automaton()
        for c in SPACES:
            self.automaton.add_word(c, LINE if c == "\n" else SPACE)
        for k, s in enumerate(SENTINELS):
            self.automaton.add_word(s, SENTINEL + k)
        self.automaton.make_automaton()

    def __call__(self, text: str) -> Events:
        """Events of a text: the place of each event's last character, and its kind."""
        flat = np.fromiter(chain.from_iterable(self.automaton.iter(text)), np.int64)
        return Events(len(text), flat[::2], flat[1::2])


@dataclass
class Events:
    length: int
    at: np.ndarray
    kind: np.ndarray

    def sentinels(self) -> list[tuple[int, int]]:
        """(place of the last character, which sentinel), in order of place."""
        found = self.kind >= SENTINEL
        return list(zip(self.at[found].tolist(), (self.kind[found] - SENTINEL).tolist(), strict=True))

    def cuts(self, unit: str) -> tuple[np.ndarray, np.ndarray]:
        """(places, units): so many units start before each of the places, one entry per gap between events.

        chars: every code point is a unit. words: a word and the white space after it; white space before the first word
        belongs to the first unit. lines: a line and its end."""
        if unit == "lines":
            starts = self.at[self.kind == LINE] + 1
            starts = np.concatenate([[0], starts[starts < self.length]]) if self.length else np.empty(0, np.int64)
        else:
            spaces = self.at[self.kind < SENTINEL]
            gaps = np.concatenate([[0], spaces + 1])  # a gap reaches from here to the next event
            if unit == "chars":
                return gaps, gaps  # as many units as code points
            starts = gaps[np.concatenate([spaces, [self.length]]) > gaps]  # gaps that aren't empty hold a word
            if self.length:
                starts = np.concatenate([[0], starts[1:]])
        return starts, np.arange(len(starts))

    def count(self, unit: str) -> int:
        return self.length if unit == "chars" else len(self.cuts(unit)[0])

    def place(self, unit: str, ranks: list[int]) -> list[int]:
        """The places in the text where so many units are over."""
        places, units = self.cuts(unit)
        if not len(places):
            return [self.length] * len(ranks)
        gap = np.maximum(np.searchsorted(units, ranks, side="right") - 1, 0)
        if unit == "chars":
            return (places[gap] + np.asarray(ranks) - units[gap]).tolist()
        return [self.length if r > units[-1] else int(places[g]) for r, g in zip(ranks, gap.tolist(), strict=True)]


def drawn(seed: str, doc_id: int | None) -> list[int]:
    """The first four 8-digit groups of the hex sha256 of `seed:doc_id`; nothing after the colon for a null id."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    return [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]


def cut(scan: Scanner, text: str, doc_id: int | None, seed: str, unit: str, fim: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output) of one text."""
    events = scan(text)
    n, (h1, h2, h3, h4) = events.count(unit), drawn(seed, doc_id)
    if not text or events.sentinels() or h3 % 100 >= fim:
        return n, PLAIN, None, None, text
    a, b = events.place(unit, sorted((h1 % (n + 1), h2 % (n + 1))))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    p, s, m = SENTINELS
    if h4 % 100 < spm:
        return n, SPM, a, b - a, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, PSM, a, b - a, f"{p}{prefix}{s}{suffix}{m}{middle}"


def join(scan: Scanner, output: str, form: str) -> str:
    """The text again, from an output and its form: the sentinels are found by the automaton and name the parts."""
    if form == PLAIN:
        return output
    marks = scan(output).sentinels()
    ends = [at + 1 for at, _ in marks]
    widths = [len(s) for s in SENTINELS]
    starts = [end - widths[k] for end, (_, k) in zip(ends, marks, strict=True)]
    parts = {k: output[b:e] for (_, k), b, e in zip(marks, ends, [*starts[1:], len(output)], strict=True)}
    return parts[0] + parts[2] + parts[1]


def transform(docs: DataFrame, unit: str = "chars", seed: str = "1", fim: int = 90, spm: int = 20) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) of every document (doc_id, text), cut by units (chars, words or
    lines); fim of 100 documents are cut, spm of 100 of those have the suffix first.

    A null or empty text and one that holds a sentinel stay as they are (plain; the lengths are null). A null doc_id draws
    by the empty id; repeated rows are each given; texts of any length are cut whole; other columns are not read, whatever
    their names. An empty table gives no rows. Rows stay where they are: nothing is shuffled.
    """
    if unit not in UNITS:
        raise ValueError(f"unit must be one of {UNITS}")
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scan = Scanner()
        for b in batches:
            ids = [None if d == "" else int(d) for d in b["id"]]
            rows = [cut(scan, t, d, seed, unit, fim, spm) for d, t in zip(ids, b["text"], strict=True)]
            n, form, prefix, middle, output = zip(*rows, strict=True) if rows else ((),) * 5
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64"), "n": pd.array(n, "int64"), "form": form, "prefix_chars": pd.array(prefix, "Int64"), "middle_chars": pd.array(middle, "Int64"), "output": output})

    given = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.coalesce("text", F.lit("")).alias("text"))
    return given.mapInPandas(lean(run), "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str, form: str) -> Column:
    """A column: the exact texts, rebuilt from outputs and forms alone."""

    @F.pandas_udf("string")
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        scan = Scanner()
        for outputs, forms in batches:
            yield pd.Series([join(scan, o, f) for o, f in zip(outputs, forms, strict=True)], dtype=object)

    return run(output, form)


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of documents, cut by code points; SHA-256 of the outputs and of the texts rebuilt from them."""
    done = transform(spark.read.parquet(f"{sf_dir}/documents.parquet")).withColumn("restored", restored("output", "form"))
    return done.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


OP11_SQL = """WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
d AS (SELECT *, length(text) AS n, ('0x' || h[1:8])::BIGINT AS h1, ('0x' || h[9:16])::BIGINT AS h2, ('0x' || h[17:24])::BIGINT AS h3, ('0x' || h[25:32])::BIGINT AS h4 FROM t),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
  CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90 THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM d),
p AS (SELECT *, substring(text, 1, a) AS pre, substring(text, a + 1, b - a) AS mid, substring(text, b + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(text) AS restored_sha256 FROM p"""
