"""The training-data operators against brute force, exact round trips and small edge cases."""

import hashlib
import io
import itertools
import json
import random
import re
import time
import zipfile
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import ann, crf, decontam, encode, fst, minhash, raking, simple8b, styletree, suffix, tokens, warczip

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, lang_pred string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, lang, s, None, "x", "y") for i, t, lang, s in rows], DOCS)


@pytest.fixture(scope="module")
def edge(spark):
    long = " ".join(f"word{i % 97} and" for i in range(30_000))
    return docs(spark, [(1, None, "en", "a"), (2, "", None, None), (3, "  \n ", "en", "a"), (4, long, "en", "b"), (5, "tie one two three four five six", "en", "b"), (6, "tie one two three four five six", "en", "b"), (6, "tie one two three four five six", "en", "b"), (None, "no id here", "de", None)])


@pytest.fixture(scope="module")
def empty(spark):
    return docs(spark, [])


# 1: Simple-8b token files
@pytest.mark.parametrize("hi", [2, 300, 50257, 1 << 40, 1 << 63])
def test_simple8b_round_trip(hi):
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 1023, 1024, 1025, 9000):
        x = r.integers(0, hi, n, dtype=np.uint64)
        if n > 3:
            x[1] = (1 << 64) - 1 if hi == 1 << 63 else 0
        w, o = simple8b.encode_words(x)
        assert (simple8b.decode_words(w, o, n) == x).all()
    assert len(simple8b.encode_words(np.zeros(60, np.uint64))[0]) == 1


def test_token_output(spark, edge, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    got = sorted(tokens.token_output(edge).collect(), key=lambda r: r.start)
    at = 0
    src = sorted(((r.doc_id, r.text or "") for r in edge.collect()), key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
    for r, (d, t) in zip(got, src, strict=True):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 2]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    assert tokens.token_output(empty).count() == 0


def odd_texts():
    r = random.Random(4)
    return ["".join(r.choice(" \n\t'aselrvtdm1é!½ \x00x<|日") for _ in range(r.randint(0, 25))) for _ in range(500)] + ["a<|endoftext|>b", " x", " ", "日本 語", "", "we'll they've 'store", "a" * 300]


def test_encoder_equals_library():
    e = encode.TextEncoder(encode.default_tokenizer(), memo=50)
    for x, y in zip(e(odd_texts()), e.tok.encode_batch(odd_texts(), add_special_tokens=False), strict=True):
        assert x.tolist() == y.ids


# 10: transducers
def test_transducer_equals_library(spark, edge, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokens.default_tokenizer())
    c = fst.counter(tokens.default_tokenizer())
    assert c(odd_texts()).tolist() == [len(x.ids) for x in tok.encode_batch(odd_texts(), add_special_tokens=False)]
    got = {(r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in fst.token_counts(edge).collect()}
    assert got == {(r.doc_id, len((r.text or "").encode()), n := len(tok.encode(r.text or "", add_special_tokens=False).ids), n > 512) for r in edge.collect()}
    assert fst.token_counts(empty).count() == 0


# 2: raking
def test_raking_meets_margins():
    r = np.random.default_rng(0)
    cells = np.array(list(itertools.product(range(3), range(2), range(2))))
    goal = [np.array([0.5, 0.3, 0.2]), np.array([0.6, 0.4]), np.array([0.1, 0.9])]
    n = r.integers(1, 100, len(cells)).astype(float)
    w = raking.rake(cells, n, goal)
    for j, g in enumerate(goal):
        assert np.allclose(np.bincount(cells[:, j], w), g, atol=1e-8)
    p = raking.probabilities(n, w, 0.4)
    assert p.max() <= 1 and p.min() >= 0 and np.isclose((p * n).sum(), 0.4 * n.sum())


def test_raking_table_equals_driver(spark):
    rows = [(s, lang, t, 1, 10 * (i + 1)) for i, (s, lang, t) in enumerate(itertools.product("ab", "xy", "pq"))]
    cells = spark.createDataFrame(rows, "source string, lang string, topic string, n_docs long, n_tokens long")
    goal = [{"a": 0.7, "b": 0.3}, {"x": 0.5, "y": 0.5}, {"p": 0.2, "q": 0.8}]
    got = {(r.source, r.lang, r.topic): r.w for r in raking.rake_table(cells, goal, raking.MARGINS, rounds=12).collect()}
    codes = np.array([["ab".index(a), "xy".index(b), "pq".index(c)] for a, b, c, *_ in rows])
    want = raking.rake(codes, np.array([r[4] for r in rows], float), [np.array(list(g.values())) for g in goal])
    assert np.allclose([got[r[:3]] for r in rows], want, atol=1e-6)


def test_mix_edges(spark, edge, empty):
    out = raking.mix(edge).collect()
    assert len(out) == 8 and all(r.drawn for r in out if r.n_tokens == 0)
    assert raking.mix(empty).count() == 0


# 3: suffix arrays
def test_repeated_starts():
    r = random.Random(2)
    for length in (5, 9, 16):
        for _ in range(40):
            t = ["".join(r.choice("ab") for _ in range(r.randint(length, 60))).encode() for _ in range(r.randint(1, 6))]
            c = Counter(x[i : i + length] for x in t for i in range(len(x) - length + 1))
            for x, f in zip(t, suffix.repeated_starts(t, length), strict=True):
                assert [c[x[i : i + length]] > 1 for i in range(len(x) - length + 1)] == f.tolist()


def brute_removed(texts, length):
    c = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if c[t[i : i + length]] > 1:
                gone[i : i + length] = True
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(bytes(b for b, g in zip(t, gone, strict=True) if not g)).hexdigest()


@pytest.mark.parametrize("many", [512, 2])
def test_suffix_dedup(spark, many):
    r = random.Random(7)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(6))
    passage = " ".join(word() for _ in range(90))
    rows = [" ".join(word() for _ in range(r.randint(10, 150))) for _ in range(30)]
    rows += [f"{a} {passage} {b}" for a, b in zip(rows[:12], rows[12:24], strict=True)] + [passage + passage, passage[:450], rows[3], None, "", "ab" * 900]
    got = {x.doc_id: tuple(x)[1:] for x in suffix.remove_repeats(docs(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]), many=many).collect()}
    for i, want in enumerate(brute_removed([(t or "").encode() for t in rows], 400)):
        assert got[i] == want


def test_suffix_splits_a_very_common_anchor(spark, monkeypatch):
    """The spans of a passage that most documents share are joined by several tasks, and results stay."""
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeé") for _ in range(6))
    passage = " ".join(word() for _ in range(75))
    rows = [f"{word()} {word()} {passage} {word()} {word()}" for _ in range(400)]
    rows += [" ".join(word() for _ in range(100)) for _ in range(40)] * 2
    written = {}

    def watched(df, name):
        written[name] = suffix_materialize(df, name)
        return written[name]

    suffix_materialize = suffix.materialize
    monkeypatch.setattr(suffix, "materialize", watched)
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.1", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = {x.doc_id: tuple(x)[1:] for x in suffix.remove_repeats(docs(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]).repartition(8), many=16).collect()}
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    for i, want in enumerate(brute_removed([t.encode() for t in rows], 400)):
        assert got[i] == want
    held = written["shared-spans"]
    anchors = held.groupBy("f").count().agg(F.max("count")).first()[0]
    assert anchors >= 400
    assert held.groupBy(F.input_file_name()).count().agg(F.max("count")).first()[0] < anchors


def test_suffix_does_not_shuffle_copies_by_span(spark):
    """Copies beside near copies: the few spans that are there as a whole are broadcast, and results stay."""
    r = random.Random(9)
    words = ["".join(r.choice("abcdeé") for _ in range(6)) for _ in range(120)]
    near = lambda: " ".join(r.choice(words) if r.random() < 0.02 else w for w in words)
    rows = [" ".join(words)] * 60 + [near() for _ in range(400)]
    threshold = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(threshold)
    spark.conf.set(threshold, "4k")
    try:
        out = suffix.remove_repeats(docs(spark, [(i, t, "en", "a") for i, t in enumerate(rows)]))
        got = {x.doc_id: tuple(x)[1:] for x in out.collect()}
        plan = out._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set(threshold, before)
    for i, want in enumerate(brute_removed([t.encode() for t in rows], 400)):
        assert got[i] == want
    assert not re.search(r"hashpartitioning\(f#\d+L?, h#", plan)


def test_suffix_edges(spark, edge, empty):
    assert suffix.remove_repeats(edge).count() == 8
    assert suffix.remove_repeats(empty).count() == 0


# 4: style tree
PAGE = '<html><head><title>t</title></head><body><div class=top>{}</div><nav><a href=x>menu</a></nav><div class="ad">buy</div><article><h1>A &amp; B</h1><p>one<br>two<p>{}</p><section class="comments"><p>bad</p></section></article><script>var x="</p>"</script><footer>f</footer>'


def test_style_tree(spark):
    rows = [(i, f"http://h.example/{i}", PAGE.format("same everywhere", f"text {i}")) for i in range(8)] + [(90, None, None), (91, "x", ""), (92, "http://one.example/", PAGE.format("kept", "z"))]
    got = {r.page_id: r for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[3].text == "A & B\none two\ntext 3" and got[3].n_chars == len(got[3].text)
    assert got[90].text == got[91].text == "" and got[92].text.startswith("kept\nA & B")
    assert styletree.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_copies_are_no_template(spark):
    page = "<html><head><title>{0}</title></head><body><div class=top>Site name</div><div class=body><p>text {0}</div></body></html>"
    copies = [(i, "http://copies.example/a", page.format("one")) for i in range(6)]
    mixed = [(100 + i, f"http://mixed.example/{i}", page.format("one" if i < 70 else i)) for i in range(100)]
    got = {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(copies + mixed, "page_id long, url string, html string")).collect()}
    assert len(got) == 106 and all(got[i] == "Site name\ntext one" for i in range(6))
    assert all(got[100 + i] == f"text {'one' if i < 70 else i}" for i in range(100))


@pytest.mark.parametrize("tag", ["object data=x", "select name=x", "svg class=x", "svg class=x/", "math", "iframe src=x", "noscript", "template"])
def test_unclosed_elements_keep_the_page(tag):
    name = tag.split()[0]
    page = "<html><head><title>t</title></head><body><p>a</p>{}<article><p>b</p></article>{}<p>c</p></body></html>"
    pair = f"<{tag.strip('/')}>gone</{name}>"
    assert styletree.main_text(page.format(f"<{tag}>", "")) == "a\nb\nc"
    assert styletree.main_text(page.format(f"<{tag}>", pair)) == "a\nb\nc"
    assert styletree.main_text(page.format(pair, f"<{tag.strip('/')}>{pair} gone</{name.upper()} >")) == "a\nb\nc"
    assert styletree.main_text(page.format(f"<{tag}><!-- </{name}> -->", f"<script>'</{name}>'</script>")) == "a\nb\nc"


@pytest.mark.parametrize("end", ["", "<body>", "</head>", "</head><body>"])
def test_head_without_end_tag(end):
    head = "<html><head><meta charset=x><title>t</title><style>p {}</style><script>var x='</head>'</script><link href=x><noscript><img></noscript>"
    assert styletree.main_text(f"{head}{end}<article><p>a</p></article><p>b</p>") == "a\nb"
    assert styletree.main_text(f"{head}{end}<p>a</p><header>c</header><p>b</p>") == "a\nb"
    assert styletree.main_text(f"<html><head><title>t</title>{end}<article>a") == "a"


STYLE = "host string, html_id long, page long, node long, parent long, depth int, main boolean, hint boolean, text long, content long, look long"


def test_importance_is_composite(spark):
    """Node 1 has children 2 (constant text) and 3 (its own on every page) in one order; node 4 has only 2's like, 5."""
    rows = []
    for p in range(4):
        rows += [("h", p, p, 1, 0, 1, False, False, None, None, 7), ("h", p, p, 2, 1, 2, False, False, None, 1, None), ("h", p, p, 3, 1, 2, False, False, None, p, None)]
        rows += [("h", p, p, 4, 0, 1, False, False, None, None, 8), ("h", p, p, 5, 4, 2, False, False, None, 1, None), ("h", 9, 3, 6, 0, 1, False, False, None, p, None)]
    got = {r.node: r for r in styletree.importance(spark.createDataFrame(rows, STYLE)).collect()}
    g = styletree.GAMMA
    want = {1: (1 - g**2) * 0 + g**2 * 0.5, 2: 0, 3: 1, 4: 0, 5: 0}
    assert {k: r.importance for k, r in got.items()} == pytest.approx(want)
    assert {k for k, r in got.items() if r.low} == {2, 4, 5}  # 1 holds a node that isn't low; 6 is on one page


def test_entropies_decide_without_declarations(spark):
    """No element says what it is: the constant branches go, one rare child with them, also inside an article."""
    page = '<html><body><div class=a><p>Site</p><div class=l><p>Home</p><p>News</p>{}</div></div><div class=b><p>{}</p><p>Read more</p></div><article><p>{}</p><p>Follow us</p><div class=z>Tell a friend</div></article></body></html>'
    rows = [(i, f"http://h.example/{i}", page.format("<h2>Rare</h2>" if i == 3 else "", f"text {i}", f"story {i}")) for i in range(12)]
    got = {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: f"text {i}\nstory {i}" for i in range(12)}
    few = {r.page_id: r.text for r in styletree.extract(spark.createDataFrame(rows[:3], "page_id long, url string, html string")).collect()}
    assert few[0] == "Site\nHome\nNews\ntext 0\nRead more\nstory 0\nFollow us\nTell a friend"


KEPT = {
    "wrapper": ('<div class="layout sidebar right"><article><p>text</p></article></div><div class="sidebar">x</div>', "text"),
    "asp form": ('<form id="aspnetForm"><nav>x</nav><article><p>text</p><form>mail</form></article></form>', "text"),
    "header wrap": ('<div id="page-header-wrap"><header>x</header><article><h1>T</h1><p>text</p></article></div>', "T\ntext"),
    "restaurant": ('<main><section class="menu"><p>Soup 5</p><p>Bread 2</p></section></main>', "Soup 5\nBread 2"),
    "long menu": ('<main><p>Eat here.</p><section class="menu"><p>' + "Soup of the day, five euros. " * 9 + "</p></section></main>", "Eat here.\n" + " ".join(["Soup of the day, five euros."] * 9)),
    "legal story": ('<article><p>a</p><div class="story legal"><p>The court said so.</p></div></article>', "a\nThe court said so."),
    "share price": ('<article><p>a</p><div id="share-price"><p>It rose.</p></div><div id="related-work"><p>b</p></div><p class="search engine">c</p></article>', "a\nIt rose.\nb\nc"),
    "links in an article": ('<article><p>a</p><div class="related"><a href=x>' + "another story " * 20 + '</a></div><div class="share">Tell a friend</div><div class="promo">buy ' + "now " * 50 + "</div></article>", "a"),
    "comments": ('<article><p>a</p><section class="post-comments"><article class="comment"><p>I disagree.</p></article></section></article>', "a"),
    "teaser": ('<article><p>a</p></article><div class="sidebar"><article><p>teaser</p></article></div><aside><main>x</main></aside>', "a"),
    "hidden": ('<article><p>a</p><p hidden>x</p><p style="color:red; display: none">y</p><p class="hidden-gem">b</p></article>', "a\nb"),
}


@pytest.mark.parametrize("case", KEPT)
def test_articles_keep_their_text(case):
    page, want = KEPT[case]
    assert styletree.main_text(f"<html><body><nav>home</nav>{page}<footer>f</footer></body></html>") == want


def test_hints_are_judged_by_importance(spark, monkeypatch):
    """A hinted branch that is alike on a host's pages goes, one with a text of its own stays; without importance both stay."""
    page = "<html><body><article><p>story {0}</p><div class='story-share'><p>Tell your friends</p></div><div class='legal-news'><p>verdict {0}</p></div></article></body></html>"
    d = spark.createDataFrame([(i, f"http://h.example/{i}", page.format(i)) for i in range(6)], "page_id long, url string, html string")
    assert {r.page_id: r.text for r in styletree.extract(d).collect()} == {i: f"story {i}\nverdict {i}" for i in range(6)}
    off = styletree.importance
    monkeypatch.setattr(styletree, "importance", lambda rows: off(rows).withColumn("low", F.lit(False)))
    assert {r.page_id: r.text for r in styletree.extract(d).collect()} == {i: f"story {i}\nTell your friends\nverdict {i}" for i in range(6)}


def brute_importance(pages):
    """node path -> importance of one host's pages, from their trees, by the definition; pages are nested (tag, text, children)."""
    import math

    seen = {}

    def visit(page, path, node):
        tag, text, kids = node
        path = (*path, tag)
        seen.setdefault(path, []).append((text, tuple(k[0] for k in kids)))
        for k in kids:
            visit(page, path, k)

    for page in pages:
        for node in page:
            visit(page, (), node)

    def entropy(values):
        m = len(values)
        return -sum(c / m * math.log(c / m) for c in Counter(values).values()) / math.log(m) if m > 1 else 1.0

    def of(path):
        rows = seen[path]
        kids = [k for k in seen if k[:-1] == path]
        parts = [(of(k), len(seen[k])) for k in kids] + ([(entropy([t for t, _ in rows]), len(rows))] if any(t for t, _ in rows) else [])
        mean = sum(i * n for i, n in parts) / sum(n for _, n in parts)
        share = styletree.GAMMA ** len(kids) if any(k for _, k in rows) else 1.0
        return (1 - share) * entropy([k for _, k in rows]) + share * mean

    return {path: of(path) for path in seen}


@pytest.mark.parametrize("seed", range(3))
def test_importance_by_brute_force(spark, seed):
    """Random small hosts: every style node occurs at most once on a page."""
    r = random.Random(seed)
    pages = [[("div", r.choice(["a", "b", f"own {i}"]), [(t, r.choice(["x", f"y {r.randint(0, 2)}"]), []) for t in r.sample(["h2", "ul", "pre"], r.randint(1, 3))])] + [("section", f"z {r.randint(0, 1)}", [])] for i in range(9)]
    html = lambda n: f"<{n[0]}>{n[1]}{''.join(map(html, n[2]))}</{n[0]}>"
    d = spark.createDataFrame([(f"http://h/{i}", i, f"<body>{''.join(map(html, p))}<p>page {i}</p></body>") for i, p in enumerate(pages)], "url string, html_id long, html string")
    rows = styletree.style_rows(d)
    got = sorted(round(x.importance, 9) for x in styletree.importance(rows).collect())
    want = {k: v for k, v in brute_importance([[*p, ("p", f"page {i}", [])] for i, p in enumerate(pages)]).items()}
    counts = Counter(k for p in pages for n in p for k in [(n[0],), *((n[0], c[0]) for c in n[2])])
    assert got == sorted(round(v, 9) for k, v in want.items() if k == ("p",) or counts[k] >= styletree.MIN_PAGES)


BROKEN = {
    "open tags": "<a" * 500_000, "one tag": "<a" * 500_000 + ">", "quotes": "<a '>" * 200_000, "odd quotes": "<a \"'>" * 160_000 + "'", "svg": "<svg " * 200_000, "svg ends": "<svg " * 200_000 + ">", "titles": "<title></title " * 70_000,
    "nested": "<div>" * 200_000, "lists": "<ul>" + "<div>" * 80_000 + "<li></li>" * 60_000, "ends": "<div>" * 80_000 + "</p></ul>" * 60_000, "comment": "<!--" * 250_000, "cells": "<table>" + "<tr><td>" * 120_000, "lt": "<" * 1_000_000, "attributes": "<p " + "class='a' " * 100_000 + ">",
}


@pytest.mark.parametrize("kind", BROKEN)
def test_broken_pages_take_linear_time(kind):
    """Eight times the input takes about eight times as long, not sixty-four times."""
    took = []
    for part in (8, 1):
        page = "<article><p>a</p></article>" + BROKEN[kind][: len(BROKEN[kind]) // part]
        best = float("inf")
        for _ in range(3 if part == 8 else 1):
            began = time.process_time()
            assert styletree.main_text(page).startswith("a")
            best = min(best, time.process_time() - began)
        took.append(best)
    assert took[1] < 30 * max(took[0], 0.01)


def test_style_tree_edges(spark):
    """Extra columns, a very long page, repeated rows, ids beyond 2^53 beside null ones."""
    big = 2**60 + 1
    rows = [(big, "http://h/1", "<article>" + "<p>word</p>" * 50_000, "x", 1), (big, "http://h/1", "<article>" + "<p>word</p>" * 50_000, "x", 1), (None, "http://h/2", "<p>b", "y", 2)]
    got = styletree.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string, low long")).collect()
    assert sorted((r.page_id or 0, r.n_chars) for r in got) == [(0, 1), (big, 249_999), (big, 249_999)]


# 5: MinHash
def brute_components(rows, n, percent):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().translate(minhash._LOWER).split()
        sets[i] = {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set())
    top = {i: i for i in sets}
    find = lambda x: x if top[x] == x else find(top[x])
    for a, b in itertools.combinations(sorted(sets), 2):
        if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


@pytest.mark.parametrize("n", [2, 5])
def test_near_duplicates(spark, n):
    r = random.Random(n)
    base = [[f"w{r.randint(0, 4000)}" for _ in range(r.randint(30, 120))] for _ in range(40)]
    rows = []
    for k, b in enumerate(base):
        for _ in range(40 if k == 0 else r.randint(1, 4)):
            c = list(b)
            for _ in range(r.randint(0, 3)):
                c[r.randrange(len(c))] = f"n{r.randint(0, 9999)}"
            rows.append(" ".join(c))
    rows += [None, "", " ", "one", "ONE", rows[0].upper()]
    rows = list(enumerate(rows))
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in rows]), n=n).collect()}
    assert got == brute_components(rows, n, 80)


@pytest.mark.parametrize("block", [2048, 7])
def test_split_buckets_are_judged_whole(spark, monkeypatch, block):
    """Variants of a text that isn't there, near the threshold: only some of them link, and none is a centre for all."""
    for name, value in {"SMALL": 1, "BLOCK_DOCS": block, "COLUMNS": 64}.items():
        monkeypatch.setattr(minhash, name, value)
    r, rows = random.Random(3), []
    base = [f"w{i}" for i in range(120)]
    for _ in range(60):
        c = list(base)
        for k in r.sample(range(120), r.randint(2, 9)):
            c[k] = f"n{r.randint(0, 9999)}"
        rows.append(" ".join(c))
    rows = list(enumerate(rows))
    r.shuffle(rows)
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in minhash.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in rows])).collect()}
    want = brute_components(rows, 2, 80)
    assert got == want and 1 < len({c for _, c in want.values()}) < 60


def test_near_duplicate_edges(spark, edge, empty):
    out = minhash.near_duplicates(edge).collect()
    assert len(out) == 8 and {r.doc_id: r.component_id for r in out}[6] == 5 and {r.doc_id: r.kept for r in out}[1]
    assert minhash.near_duplicates(empty).count() == 0


def test_documents_of_several_texts(spark):
    """Texts under one id are one document: it links what either text links with, whichever row comes first."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    big = 2**60 + 1
    rows = [(1, a), (2, b), (3, a), (3, b), (3, b), (4, c), (big, c), (None, c)]
    for order in (rows, rows[::-1]):
        got = sorted((x.doc_id or 0, x.component_id or 0, x.kept) for x in minhash.near_duplicates(docs(spark, [(i, t, "en", "a") for i, t in order])).collect())
        assert got == [(0, 0, False), (1, 1, True), (2, 1, False), (3, 1, False), (3, 1, False), (3, 1, False), (4, 4, True), (big, 4, False)]


# 6: decontamination
def test_lcs():
    r = random.Random(1)
    for _ in range(200):
        a, b = ([r.randint(0, 5) for _ in range(r.randint(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert decontam.lcs(a, b) == t[-1][-1]


def test_decontamination(spark, empty):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    items = [(i, " ".join(word() for _ in range(r.randint(14, 50)))) for i in range(12)] + [(50, None), (51, "")]
    rows = []
    for i in range(80):
        w = [word() for _ in range(r.randint(20, 400))]
        if i % 8 == 0:
            w[10:10] = items[i // 8][1].upper().split()
        if i % 8 == 1:  # a near copy
            x = items[i // 8][1].split()
            x[3], x[9] = word(), word()
            w[15:15] = x
        rows.append((i, " ".join(w), "en", "a"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    src = docs(spark, [*rows, (100, None, None, None), (101, "", None, None)])
    hits = {(x.doc_id, x.item_id) for x in decontam.contamination(src, bench).collect()}
    assert hits == {(i, i // 8) for i in range(80) if i % 8 < 2}
    assert decontam.decontaminate(src, bench).count() == 82 - 20
    assert decontam.contamination(empty, bench).count() == 0
    assert decontam.contamination(src, spark.createDataFrame([], "item_id long, text string")).count() == 0


@pytest.mark.parametrize("longest", [640, 1000, 3000])
def test_long_items_beside_short_ones(spark, longest):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate([16, 30, 50, 120, longest])]
    rows = []
    for i in range(60):
        w = [word() for _ in range(r.randint(30, 300))]
        if i < 20:
            w[r.randint(0, 30) : 0] = items[i % 5][1].split()
        rows.append((i, " ".join(w), "en", "a"))
    hits = decontam.contamination(docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in hits} == {(i, i % 5) for i in range(20)}
    assert all(decontam.LCS_SURE <= x.score <= 1 for x in hits)


def test_items_of_all_lengths(spark):
    """Verbatim copies, and copies with a fifth of the words replaced in runs, of items of 5 to 5,000 words, one benchmark;
    documents without an id are judged, columns of any name stay."""
    r = random.Random(12)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    sizes = [5, 8, 15, 40, 100, 300, 600, 800, 1000, 2000, 5000]
    items = [(i, " ".join(word() for _ in range(n))) for i, n in enumerate(sizes)] + [(100, None)]
    items.append((200, items[4][1]))  # an equal item
    rows = []
    for i, n in enumerate(sizes):
        pad = lambda: [word() for _ in range(r.randint(0, 60))]
        own = items[i][1].split()
        rows.append((i, " ".join(pad() + own + pad()), "en", "a"))
        cut = n // 10  # a tenth at two places
        near = own[: n // 5] + [word() for _ in range(cut)] + own[n // 5 + cut : n // 2] + [word() for _ in range(cut)] + own[n // 2 + cut :]
        rows.append((1000 + i, " ".join(pad() + near + pad()), "en", "a"))
    rows += [(5000 + i, " ".join(word() for _ in range(r.randint(20, 500))), "en", "a") for i in range(30)]
    rows += [(None, items[3][1], "en", "a"), (None, "nothing of it", "en", "a")]
    src = docs(spark, rows).withColumn("th", F.lit(1)).withColumn("_hit_th", F.lit(2))
    bench = spark.createDataFrame(items, "item_id long, text string")
    hits = {(x.doc_id, x.item_id) for x in decontam.contamination(src, bench).collect()}
    want = {(d + i, i) for d in (0, 1000) for i in range(len(sizes))} | {(4, 200), (1004, 200), (None, 3)}
    assert hits == want
    left = decontam.decontaminate(src, bench)
    assert left.columns == src.columns and sorted((x.doc_id or 0) for x in left.collect()) == [0, *range(5000, 5030)]


def test_benchmark_in_blocks(spark, monkeypatch):
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    items = [(i, " ".join(word() for _ in range(30))) for i in range(30)]
    src = docs(spark, [(i, " ".join([word() for _ in range(40)] + (items[i][1].split() if i < 30 else [])), "en", "a") for i in range(60)])
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = sorted(map(tuple, decontam.contamination(src, bench).collect()))
    monkeypatch.setattr(decontam, "BLOCK_CHARS", 1000)
    assert one == sorted(map(tuple, decontam.contamination(src, bench).collect())) and [x[:2] for x in one] == [(i, i) for i in range(30)]
    monkeypatch.setattr(decontam, "MOST_WORDS", 200)  # parts with spaces of their own
    assert [x[:2] for x in one] == sorted(tuple(x)[:2] for x in decontam.contamination(src, bench).collect())


def paraphrases(kind, seed=6):
    """100 items in sentences, and a document for each that holds it in another form."""
    r = random.Random(seed)
    common = [f"w{i}" for i in range(12)]
    word = lambda: r.choice(common) if r.random() < 0.3 else "".join(r.choice("abcdefgh") for _ in range(6))
    items, rows = [], []
    for i in range(100):
        sentences = [[word() for _ in range(r.randint(7, 12))] for _ in range(4)]
        items.append((i, " ".join(" ".join(s) + "." for s in sentences)))
        if kind == "swapped halves":
            sentences = sentences[2:] + sentences[:2]
        flat = [w for s in sentences for w in s]
        if kind == "replaced":
            for k in r.sample(range(len(flat)), round(0.3 * len(flat))):
                flat[k] = word()
        if kind == "filled":
            flat = [x for w in flat for x in ((w, word()) if r.random() < 0.3 else (w,))]
        pad = lambda: [word() for _ in range(r.randint(20, 120))]
        rows.append((i, " ".join(pad() + flat + pad()), "en", "a"))
    rows += [(1000 + i, " ".join(word() for _ in range(300)), "en", "a") for i in range(100)]
    return items, rows


@pytest.mark.parametrize("kind", ["swapped halves", "replaced", "filled"])
def test_paraphrases_are_found(spark, kind, monkeypatch):
    items, rows = paraphrases(kind)
    src, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    hits = {(x.doc_id, x.item_id) for x in decontam.contamination(src, bench).collect()}
    assert sum((i, i) in hits for i in range(100)) >= 90 and all(d == i for d, i in hits)
    monkeypatch.setattr(decontam, "COSINE", 1.1)  # the search in the latent space is what finds them
    assert decontam.contamination(src, bench).count() == 0


def test_hits_by_brute_force(spark):
    """Every window of every size against every item, one by one, in the same space."""
    items, rows = paraphrases("replaced", 9)
    items, rows = items[:25] + [(500, "w1 w2 w3 w4 w5")], rows[:25] + rows[100:110] + [(700, "w3 w1 w2 w3 w4 w5 w9", "en", "a")]
    src, bench = docs(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = {(x.doc_id, x.item_id): round(x.score, 9) for x in decontam.contamination(src, bench).collect()}
    known = {w: i for i, w in enumerate(sorted({w for _, t in items for w in decontam.words(t)}), 1)}
    table = decontam.numbered(src.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("th"), "text"), known)
    idf, basis = decontam.latent_space(table, len(known) + 1)
    space = basis * idf[:, None]
    want = {}
    windows = {k: w for g, e, w in decontam._alike(sorted(len(decontam.words(t)) for _, t in items)) for k in [w]}
    sizes = {s for w in windows for s in w}
    for d, text, *_ in rows:
        ids = [known.get(w, 0) for w in decontam.words(text)]
        for i, t in items:
            own = [known[w] for w in decontam.words(t)]
            item = (i, own, decontam.rarest(own, idf), decontam.clauses(t))
            v, half = space[own].sum(0), -(-len(own) // 2)
            nothing = not np.linalg.norm(v)
            for size in [(-(-len(own) // 8) + 1) * 8] if nothing else sizes:
                for at in range(0, len(ids), 8 if nothing else size // 2):
                    part = ids[at : at + size]
                    x = space[part].sum(0)
                    cosine = 1.0 if nothing else float(x @ v / max(np.linalg.norm(x), 1e-9) / np.linalg.norm(v))
                    if cosine >= decontam.COSINE:
                        score = decontam.confirmed(item, ids[max(0, at - half) : at + len(part) + half], cosine)
                        want[d, i] = max(want.get((d, i), 0), score)
    want = {k: x for k, x in want.items() if x}
    assert set(got) == set(want) and all(abs(got[k] - x) < 1e-9 or got[k] >= decontam.LCS_SURE for k, x in want.items())


@pytest.mark.parametrize("text", ["", "a b c.", "a. b. c. d. e. f. g.", "a b c d e f g. " * 3, " ".join("abcdefghij" * 7), "a b c d e f; g"])
def test_clauses_cover_the_text(text):
    got = decontam.clauses(text)
    assert sum(got) == len(decontam.words(text)) and all(x <= decontam.CLAUSE[1] + decontam.CLAUSE[0] for x in got)


# 7: conditional random field
def test_forward_backward(monkeypatch):
    monkeypatch.setattr(crf, "CHUNK", 2)
    r = np.random.default_rng(0)
    em, tr = r.random((7, 2)) + 0.1, r.random((2, 2)) + 0.1
    p = crf.forward_backward(em, tr, np.array([4, 3]))
    for lo, hi in ((0, 4), (4, 7)):
        total = np.zeros((hi - lo, 2))
        for z in itertools.product(range(2), repeat=hi - lo):
            w = 0.5 * tr[:, z[0]].sum() * em[lo, z[0]] * np.prod([tr[a, b] * em[lo + i + 1, b] for i, (a, b) in enumerate(itertools.pairwise(z))])
            for i, x in enumerate(z):
                total[i, x] += w
        assert np.allclose(p[lo:hi], total / total.sum(1, keepdims=True))


def test_pair_marginals_by_enumeration():
    r = np.random.default_rng(3)
    em, tr = r.random((4, 5, 3)) + 0.05, r.random((3, 3)) + 0.05
    post, pair = crf.marginals(em, tr)
    for s in range(4):
        one, two = np.zeros((5, 3)), np.zeros((4, 3, 3))
        for z in itertools.product(range(3), repeat=5):
            w = np.prod([em[s, t, x] for t, x in enumerate(z)]) * np.prod([tr[a, b] for a, b in itertools.pairwise(z)])
            for t, x in enumerate(z):
                one[t, x] += w
            for t, (a, b) in enumerate(itertools.pairwise(z)):
                two[t, a, b] += w
        assert np.allclose(post[s], one / one.sum(1, keepdims=True)) and np.allclose(pair[s], two / two.sum((1, 2), keepdims=True))


def test_letterless_texts(spark):
    model = crf.fit([("the of and with this that", "en"), ("der die und nicht mit", "de")])
    rows = [(i, t, "en", "a") for i, t in enumerate(["½ ² Ⅷ ①", "12 34", "…!", "x", "½ a", "日本", None, ""])]
    assert [r.lang_pred == "und" for r in crf.identify(docs(spark, rows), model).orderBy("doc_id").collect()] == [True, True, True, False, False, False, True, True]


def test_language(spark, edge, empty):
    words = {"en": "the of and with this from that have which".split(), "de": "der die und nicht mit eine auf sich auch".split(), "fr": "les des est pour dans avec une qui sur".split()}
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(words[x]) for _ in range(30)), x, "a") for i, x in enumerate(r.choice(list(words)) for _ in range(240))]
    src = docs(spark, rows)
    model = crf.learn(src)
    got = crf.identify(src, model).withColumn("held", crf.held_out()).filter("held").collect()
    assert got and all(x.lang_pred == x.lang and 0.9 < x.score <= 1 for x in got)
    w, p = crf.Labeller(model).label(["the of and with dans avec une les und nicht auf sich"])[0]
    assert [model.langs[i] for i in p.argmax(1)] == ["en"] * 4 + ["fr"] * 4 + ["de"] * 4
    out = crf.identify(edge, model).collect()
    assert len(out) == 8 and {x.doc_id for x in out if x.lang_pred == "und"} == {1, 2, 3}
    assert crf.learn(empty) is None and {x.lang_pred for x in crf.identify(edge, None).collect()} == {"und"}


# 8: nearest neighbours
def test_search(spark):
    r = np.random.default_rng(2)
    x = r.standard_normal((600, 16))
    x[10:30] = x[9]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [1.0, None] * 8), (904, [1.0]), (None, x[0].tolist())]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = ann.search(t, t.filter("vec_id % 50 = 0"), lists=8, probes=8).collect()
    n = np.linalg.norm(x, axis=1)
    hit = 0
    for q in range(0, 600, 50):
        s = x @ x[q] / n / n[q]
        s[q] = -2
        want = np.lexsort((np.arange(600), -np.round(s, 12)))[:5]
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [g[0] for g in own] == [1, 2, 3, 4, 5]
        assert all(np.isclose(s[v], sc) for _, v, sc in own)
        hit += len({v for _, v, _ in own} & set(want.tolist()))
    assert hit >= 0.95 * 60
    assert ann.search(t.filter("vec_id < 0"), t).count() == 0


@pytest.mark.parametrize("n", [2, 4, 6, 8, 12])
def test_search_small_tables(spark, n):
    x = np.random.default_rng(n).standard_normal((n, 8))
    rows = [(900, [1.0, 2.0, 3.0])] + [(i, v.tolist()) for i, v in enumerate(x)]
    t = spark.createDataFrame(rows, "vec_id long, embedding array<double>").coalesce(1)
    got = Counter(r.query_id for r in ann.search(t, t).collect())
    assert got == {i: min(5, n - 1) for i in range(n)}


def test_search_magnitudes_and_carried_bounds(spark):
    """Tiny and huge vectors count by direction; several lists, few probed; a query table without rows; other columns."""
    r = np.random.default_rng(5)
    x = r.standard_normal((400, 12)) * 0.3 + r.standard_normal((8, 12))[r.integers(0, 8, 400)]
    x[7], x[8] = x[50] * 1e-200, x[50] * 1e200
    t = spark.createDataFrame([(i, v.tolist(), "x", 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, list string, salt long")
    got = ann.search(t, t.filter("vec_id % 50 = 0"), lists=16)
    assert got.columns == ["query_id", "rank", "vec_id", "score"]
    got = got.collect()
    u = x / np.abs(x).max(1, keepdims=True)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    hit = 0
    for q in range(0, 400, 50):
        s = u @ u[q]
        s[q] = -2
        own = sorted((g.rank, g.vec_id, g.score) for g in got if g.query_id == q)
        assert [g[0] for g in own] == [1, 2, 3, 4, 5] and all(np.isclose(s[v], sc) for _, v, sc in own)
        hit += len({v for _, v, _ in own} & set(np.argsort(-s)[:5].tolist()))
    assert hit >= 0.9 * 40
    assert {g.vec_id for g in got if g.query_id == 50 and g.rank < 3} == {7, 8}
    assert ann.search(t, t.filter("vec_id < 0")).count() == 0


def test_survivors_hold_all_within_the_bound():
    r = np.random.default_rng(6)
    q, x = r.standard_normal((20, 40)), r.standard_normal((500, 40))
    d = ((q[:, None] - x) ** 2).sum(2)
    limit = np.sort(d, axis=1)[:, 5]
    limit[3] = np.inf
    found = {(int(a), int(b)) for i, j in ann.survivors(q, limit, x) for a, b in zip(i, j, strict=True)}
    want = {(i, j) for i, j in zip(*map(np.ndarray.tolist, np.nonzero(d <= limit[:, None])), strict=True)}
    assert all((3, j) in found for j in range(500)) and len(want - found) <= 0.03 * len(want) and len(found) < 500 + 20 * 250


# 9: WARC in ZIP
def test_zip64_directory():
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w", zipfile.ZIP_STORED) as z:
        with z.open("a.txt", "w", force_zip64=True) as f:
            f.write(b"hello")
        z.writestr("b.txt", "there")
        z.comment = b"a comment PK\x05\x06 inside"
    m = warczip.central_directory(b)
    for name, want in (("a.txt", b"hello"), ("b.txt", b"there")):
        b.seek(warczip.member_start(b, m[name]))
        assert b.read(m[name].size) == want


def test_archives(spark, tmp_path):
    rows = [(i, f"http://x/{i}", ("p" * 150 if i % 3 else f"page {i} " * 20)) for i in range(20)] + [(30, None, None), (31, "u", "short"), (32, "u", "short"), (None, "u", "p" * 150)]
    got = warczip.read_records(warczip.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and by[2].record_type == "revisit" and by[2].refers_to == 1 and by[2].payload is None
    assert by[1].record_type == "response" and bytes(by[1].payload) == b"p" * 150 and by[32].record_type == "response" and by[30].payload_bytes == 0
    for i, _, h in rows:
        assert by[i].payload_digest == hashlib.sha256((h or "").encode()).hexdigest()
    assert json.loads('{"page_id": "1"}')["page_id"] == "1"


def test_archive_edges(spark, tmp_path):
    """A URL with line ends, ids beyond 2^53 beside a null one, a very long page, clashing columns, an empty table."""
    big = 2**60 + 1
    rows = [(big, "http://x/\r\n\r\nContent-Length: 1", "p" * 3_000_000, "a", 1), (big + 1, None, "p" * 3_000_000, "b", 2), (None, "u", "", "c", 3)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, kind string, digest long")
    by = {r.page_id: r for r in warczip.read_records(warczip.write_archives(pages, f"file://{tmp_path}/w")).collect()}
    assert by[big].url == "http://x/%0D%0A%0D%0AContent-Length: 1" and len(by[big].payload) == 3_000_000
    assert (by[big + 1].record_type, by[big + 1].refers_to, by[None].payload_bytes) == ("revisit", big, 0)
    assert warczip.read_records(warczip.write_archives(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_mixture_by_brute_force(spark):
    """Cells, raked weights, probabilities and draws of a table, computed again in plain Python; clashing columns stay."""
    r = random.Random(6)
    rows = [(i, " ".join("w" for _ in range(r.randint(1, 900))), r.choice(["en", "de", None]), r.choice(["a", "b", "c"])) for i in range(300)]
    src = docs(spark, rows).withColumns({"_source": F.lit("x"), "_topic": F.lit("y"), "topic": F.lit("mine"), "p": F.lit(7)})
    out = {x.doc_id: x for x in raking.mix(src).collect()}
    size = {i: len(t.split()) for i, t, *_ in rows}
    cell = {i: (s, lang or raking.NONE, out[i].topic) for i, _, lang, s in rows}
    n = Counter()
    for i, c in cell.items():
        n[c] += size[i]
    goal = []
    for m in range(3):
        total = Counter()
        for c, v in n.items():
            total[c[m]] += v
        goal.append({k: v**raking.FLATTEN for k, v in total.items()})
    w = {c: v / sum(n.values()) for c, v in n.items()}
    for _ in range(300):
        for m in range(3):
            now = Counter()
            for c, v in w.items():
                now[c[m]] += v
            w = {c: v * goal[m][c[m]] / sum(goal[m].values()) / now[c[m]] for c, v in w.items()}
    lo, hi = 0.0, 1e9
    for _ in range(200):
        mid = (lo + hi) / 2
        got = sum(min(1, mid * w[c] / n[c]) * n[c] for c in n)
        lo, hi = (mid, hi) if got < raking.KEEP * sum(n.values()) else (lo, mid)
    for i, c in cell.items():
        assert out[i].n_tokens == size[i] and out[i].p == pytest.approx(min(1, hi * w[c] / n[c]), abs=1e-6)
    kept = raking.draw(src)
    assert kept.columns == src.columns and {(x.doc_id, x.topic, x.p) for x in kept.collect()} == {(i, "mine", 7) for i, x in out.items() if x.drawn}
    assert abs(sum(size[i] for i, x in out.items() if x.drawn) / sum(size.values()) - raking.KEEP) < 0.1


def test_mixture_of_many_cells(spark, monkeypatch):
    r = random.Random(8)
    src = docs(spark, [(i, " ".join("w" for _ in range(r.randint(1, 900))), r.choice(["en", "de"]), r.choice(["a", "b", "c"])) for i in range(60)])
    p = {x.doc_id: x.p for x in raking.mix(src).collect()}
    monkeypatch.setattr(raking, "DRIVER_CELLS", 1)
    monkeypatch.setattr(raking, "ROUNDS", 12)
    assert {x.doc_id: x.p for x in raking.mix(src).collect()} == pytest.approx(p, abs=1e-4)


def test_pipeline_edges(spark, tmp_path):
    """Columns that the operators use themselves stay as given; repeated rows go together; an empty table stays empty."""
    import corpus_pipeline as p

    bench = spark.createDataFrame([(0, "one two three four five six seven eight nine ten eleven twelve")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(i, f"a text number {i} " * 3, "en", "a", 0.123, "mine", "note") for i in (1, 2, 2, 3)] + [(None, bench.first().text, "en", "a", 0.5, "mine", "x")]
    src = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score double, topic string, p string")
    for _, stage in p.STAGES[:4]:
        out = stage(spark, src, str(tmp_path))
        assert out.columns == src.columns and {tuple(r) for r in out.collect()} <= set(rows)
        assert stage(spark, src.limit(0), str(tmp_path)).count() == 0
    assert p.STAGES[4][1](spark, src.limit(0), str(tmp_path)).count() == 0
    assert p.STAGES[2][1](spark, src, str(tmp_path)).count() == 4


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline as p

    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    bench = spark.createDataFrame([(0, " ".join(word() for _ in range(30)))], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    item = bench.first().text
    rows = [(i, " ".join(word() for _ in range(60)), "en", "a", 1) for i in range(40)]
    rows += [(100, rows[0][1], "en", "a", 1), (101, rows[1][1] + " " + item, "en", "b", 1), (102, None, None, None, None), (103, "12 34", "en", "a", 5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    at = spark.read.parquet(f"{tmp_path}/documents.parquet")
    ids = []
    for k, (_, stage) in enumerate(p.STAGES):
        at = stage(spark, at, str(tmp_path))
        if k < 4:
            assert at.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        at.write.parquet(f"{tmp_path}/s{k}")
        at = spark.read.parquet(f"{tmp_path}/s{k}")
        ids.append({x.doc_id for x in at.collect()})
    assert ids[0] == {*range(40), 100, 101} and ids[1] == ids[0] - {100} and ids[2] == ids[1] - {101}
    assert ids[3] <= ids[2] and ids[4] == ids[3]
