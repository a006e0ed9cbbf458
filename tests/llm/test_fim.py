"""Fill-in-middle against a plain computation, by every unit, and its edges."""

import hashlib
import random
import re

import pytest

from tessera.llm import fim

DOCS = "doc_id long, text string, n long, form string"


def units_of(text, unit):
    """The units of a text, one after another, by the rule and without events."""
    if unit == "chars":
        return list(text)
    if unit == "lines":
        return re.findall(r"[^\n]*\n|[^\n]+", text)
    words = re.findall(r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*", text)
    head = re.match(r"[\x20\x09-\x0D]*", text)[0]
    return [head + words[0], *words[1:]] if words else [head] if head else []


def plain(doc_id, text, unit, rate=90, spm=20):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(h[i : i + 8], 16) for i in (0, 8, 16, 24)]
    u = units_of(text, unit)
    n = len(u)
    if not text or re.search("<[PSM]>", text) or h[2] % 100 >= rate:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < spm else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def texts():
    r = random.Random(11)
    bits = ["a", "é", "日", "𝒜", " ", "\n", "\t", "\r\n", "<", "<P", "S>", "<S", "M>", "\u2028", "\u00a0", "word", "  ", "\n\n"]
    out = ["".join(r.choice(bits) for _ in range(r.randint(0, 40))) for _ in range(400)]
    return [None, "", " ", "\n", "x", "<P>", "a<M>b", "<S", " lead", "trail \n", "wort " * 60_000, *out]


@pytest.mark.parametrize("unit", fim.UNITS)
def test_forms_and_round_trip(spark, unit):
    rows = [(i, t) for i, t in enumerate(texts())] + [(None, "null id"), (7, "twice"), (7, "twice")]
    d = spark.createDataFrame([(i, t, 5, "other") for i, t in rows], DOCS)
    got = fim.transform(d, unit=unit).withColumn("back", fim.restored("output", "form")).collect()
    want = sorted((repr((i, *plain(i, t, unit), t or "")) for i, t in rows))
    assert sorted(repr((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back)) for r in got) == want
    assert {"plain", "psm", "spm"} == {r.form for r in got}


def test_events_are_sparse_and_overlaps_are_found():
    scan = fim.Scanner()
    assert scan("<P><<S>>x<M").sentinels() == [(2, 0), (6, 1)]
    assert len(scan("letters" * 100).at) == 0


def test_rates_and_empty(spark):
    d = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "doc_id long, text string")
    assert {r.form for r in fim.transform(d, fim=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(d, fim=100, spm=100).collect()} == {"spm"}
    assert fim.transform(d.limit(0)).collect() == []
    with pytest.raises(ValueError):
        fim.transform(d, unit="bytes")
