"""Main text of web pages by a site style tree.

The DOMs of one host are merged: a style node is an element with its tag, classes and role, below its parent's style node;
a content node is a text block of a style node. Entropies are taken over a host's distinct pages, divided by the logarithm
of their number: of a node's contents and of its presentations (the styles of its children in order). The importance of
an inner node is composite: with l children styles, (1 - GAMMA^l) of its presentations' entropy and GAMMA^l of its children's
mean importance, its own text being one of them. A branch goes when its importance and that of all style nodes below it
are low; a content node, when it is on nearly all pages that have its style node.

What an element says of itself comes before that, in three degrees. Elements that HTML declares (nav, footer, aside, dialog,
roles, hidden ones) and reader comments go with all they hold. Elements that a form, a header or the words of their class
and id declare go too, but an article or main in them ends that, unless the page has another one outside. Inside an
article, words that can also be a subject (menu, legal, share...) count only where links or a few words are all there is. Where
noise words stand beside other words ("share price"), they are a hint: such branches go at a higher importance, LEAST_HINT,
if the host has pages enough to tell, and stay otherwise. Inside an article a branch without a hint goes only if it is all
but constant, its headings never.
"""

from __future__ import annotations

import html as htmllib
import re
from collections.abc import Collection, Iterator
from dataclasses import dataclass

import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, small_batches

LEAST = 0.35  # importance below which a branch goes
LEAST_MAIN = 0.1  # the same inside an article, and for content nodes anywhere
LEAST_HINT = 0.6  # the same for branches whose words hint at noise, wherever they are
LINKED, FEW_CHARS = 0.5, 80  # share of text in links, and length of text, by which a subject's word in an article counts
MIN_PAGES, MIN_MAIN = 4, 12  # fewer distinct pages of a host say nothing about a node
GAMMA = 0.9
WASTE = 16  # times a page's length that may be read in vain for the ends of quoted attributes

#: HTML element classes (fixed values of the HTML standard).
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title".split())  # text up to the end tag, or else to the end of the page
SKIPPED = frozenset("noscript template select svg math iframe object".split())  # with their contents, if they are closed
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
DECLARED_TAGS = frozenset("nav footer aside button menu dialog".split())
SOFT_TAGS = frozenset("form header".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu".split())
#: Words of classes and ids: reader comments; noise beside whatever other words; noise only alone or beside neutral words;
#: of these, subjects that an article may have.
COMMENT_WORDS = frozenset("comment comments disqus".split())
STRONG_WORDS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo cookie cookies consent gdpr newsletter breadcrumb breadcrumbs navbar navigation masthead popup modal".split())
SUBJECTS = frozenset("menu nav header banner notice notices reply replies respond share sharing social related recommended subscribe subscription login signup search widget legal promotion toolbar".split())
WEAK_WORDS = SUBJECTS | frozenset("sidebar aside footer pagination pager copyright".split())
NEUTRAL_WORDS = frozenset("site main page left right top bottom box block wrap wrapper container inner outer section area bar list item items global local primary secondary row col column grid layout module panel link links button buttons icon icons small large mobile desktop content body js".split())
KEEP_TAGS = frozenset(("article", "main"))
CLOSES_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul figure details".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("tr", "table"), "th": ("tr", "table"), "option": ("select",)}

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTR = re.compile(r"""\b(class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
_WORD = re.compile(r"[a-z0-9]+")
_END = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I) for tag in RAW}
_PAIRS = {tag: re.compile(rf"<!--.*?(?:-->|\Z)|<(script|style|textarea|title)(?=[\s/>]).*?(?:</\1(?=[\s/>])|\Z)|<(/?){tag}(?=[\s/>])[^>]*?(/?)>", re.I | re.S) for tag in SKIPPED}
_HEADING = frozenset(("header", "hgroup"))
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())


_HIDDEN = re.compile(r"""(?:^|\s)hidden(?=[\s=/]|$)|\bstyle\s*=\s*(?:"[^"]*|'[^']*|[^\s"'>]*)display\s*:\s*none""", re.I)


class _Node:
    """An open element: declared noise (hard, soft), inside an article, in a low branch, in an article that a soft declaration
    surrounds, and the case (of those that links and length decide) that it belongs to, 0 for none."""

    __slots__ = ("id", "hard", "soft", "main", "low", "rescued", "case", "tag")

    def __init__(self, tag: str, id: int, hard: bool, soft: bool, main: bool, low: bool, rescued: bool, case: int):
        self.tag, self.id, self.hard, self.soft, self.main, self.low, self.rescued, self.case = tag, id, hard, soft, main, low, rescued, case


@dataclass
class Page:
    blocks: list[tuple[int, bool, bool, bool, str]]  # style node, noise, inside an article, in a low branch, text
    parent: dict[int, tuple[int, int, bool, bool]]  # style node -> its parent, its depth, inside an article, hinted; no noise
    children: dict[int, list[int]]  # style node -> style nodes of its children in order


def declared(words: set[str]) -> tuple[bool, bool, bool, bool]:
    """(comments, noise, a subject's words alone, hint) by the words of an element's class and id."""
    if words & COMMENT_WORDS:
        return True, False, False, False
    if words & STRONG_WORDS:
        return False, True, False, False
    if weak := words & WEAK_WORDS:
        alone = all(w in WEAK_WORDS or w in NEUTRAL_WORDS or w.isdigit() for w in words)
        return False, alone, alone and weak <= SUBJECTS, not alone
    return False, False, False, False


def _hash(*parts: str | bytes) -> int:
    return xxhash.xxh64_intdigest(b"\0".join(x if isinstance(x, bytes) else x.encode("utf-8", "surrogatepass") for x in parts)) - (1 << 63)


def _closed(html: str, tag: str) -> dict[int, int]:
    """Where each element of the tag that has an end tag of its own starts, and where it ends."""
    opened, out = [], {}
    for m in _PAIRS[tag].finditer(html):
        if m[2] is None or m[3] and not m[2] and tag in ("svg", "math"):
            continue
        if not m[2]:
            opened.append(m.start())
        elif opened:
            out[opened.pop()] = m.end()
    return out


def parse(html: str, low: Collection[int] = ()) -> Page:
    """Text blocks in page order, and the page's style nodes. low: style nodes whose branches are marked as low.

    A head ends where HTML ends it, by its own tag or by the first text or element that can't be in one. Of an element of
    SKIPPED without an end tag only the start tag is left out, so that the page goes on after it. What follows the last >
    is text. Time is linear in the page's length, however broken it is: where quotes that never end have made the reader
    look WASTE times the page ahead, tags end at the next > from there on.
    """
    root = _Node("", 0, False, False, False, False, False, 0)
    stack, at_tag = [root], {}  # at_tag: places in the stack by tag
    blocks: list[tuple[_Node, str]] = []
    styles: list[tuple[_Node, int, int, bool]] = []  # element, its parent's style node, depth, hinted
    over, chars, linked = [0], [0], [0]  # of each case: the case around it, characters, characters in links
    in_link = False
    buffer: list[str] = []
    hold = root
    closed: dict[str, dict[int, int]] = {}
    whole, n = html, html.rfind(">") + 1
    html = html[:n]
    waste = WASTE * n

    def flush():
        if buffer:
            text = " ".join(htmllib.unescape("".join(buffer)).split())
            if text:
                blocks.append((hold, text))
                chars[hold.case] += len(text)
            buffer.clear()

    def pop(to: int):
        nonlocal hold
        flush()
        for x in reversed(stack[to:]):
            at_tag[x.tag].pop()
        del stack[to:]
        hold = stack[-1]

    def last(tags: tuple[str, ...]) -> int:
        return max((at_tag[t][-1] for t in tags if at_tag.get(t)), default=0)

    at = 0
    while at < n:
        lt = html.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            buffer.append(html[at:lt])
            if in_link and hold.case:
                linked[hold.case] += lt - at
        if lt == n:
            break
        mark = html[lt + 1 : lt + 2]
        if mark in "!?":
            end = html.find("-->", lt + 4) if html.startswith("<!--", lt) else html.find(">", lt)
            if end < 0:  # a comment without an end
                at = n + 1
                break
            at = end + (3 if html.startswith("<!--", lt) else 1)
            continue
        m = _TAG.match(html, lt) if waste > 0 else None
        if m is None and (mark.isascii() and mark.isalpha() or mark == "/"):
            waste -= n - lt
            m = _PLAIN_TAG.match(html, lt)
        if m is None:
            buffer.append("<")
            at = lt + 1
            continue
        at = m.end()
        tag = m[2].lower()
        if m[1]:  # end tag
            if tag in INLINE or tag in VOID:
                if tag == "br":
                    buffer.append(" ")
                elif tag == "a":
                    in_link = False
            elif at_tag.get(tag):
                pop(at_tag[tag][-1])
            continue
        if tag in RAW:
            end = _END[tag].search(html, at)
            at = end.end() if end else n + 1
            if tag != "title":
                buffer.append(" ")
            continue
        if tag in SKIPPED:
            if tag not in closed:
                closed[tag] = _closed(html, tag)
            at = closed[tag].get(lt, at)
            if tag not in ("svg", "math"):
                buffer.append(" ")
            continue
        if tag in INLINE or tag in VOID:
            if tag == "br":
                buffer.append(" ")
            elif tag == "hr":
                flush()
            elif tag == "a":
                in_link = True
            continue
        if tag in ("html", "head", "body"):
            flush()
            continue
        if tag in CLOSES_P and at_tag.get("p"):
            pop(at_tag["p"][-1])
        if tag in SIBLINGS:
            while (i := last(SIBLINGS[tag])) > last(SCOPES[tag]):
                pop(i)
                if tag != "tr":
                    break
        flush()
        attrs = {k.lower(): v.strip("\"'").lower() for k, v in _ATTR.findall(m[3])} if m[3] else {}
        words = set(_WORD.findall(attrs.get("class", ""))) | set(_WORD.findall(attrs.get("id", "")))
        up = stack[-1]
        keeps = tag in KEEP_TAGS or attrs.get("role") == "main"
        comments, noise, subject, hint = declared(words) if words and not keeps else (bool(words & COMMENT_WORDS), False, False, False)
        hard = up.hard or tag in DECLARED_TAGS or attrs.get("role") in NOISE_ROLES or comments or bool(m[3] and _HIDDEN.search(m[3]))
        # the heading of an article belongs to it
        soft = up.soft or tag in SOFT_TAGS and not (tag in _HEADING and up.main)
        rescued = up.rescued or keeps and not up.main and soft
        if keeps and not up.main:
            soft = False
        case = up.case
        if noise and subject and up.main and not (hard or soft):
            over.append(case), chars.append(0), linked.append(0)
            case = len(over) - 1
        elif noise:
            soft = True
        id = _hash(up.id.to_bytes(8, "little", signed=True), tag, " ".join(sorted(attrs.get("class", "").split())), attrs.get("role", ""))
        hold = _Node(tag, id, hard, soft, up.main or keeps, up.low or id in low, rescued, case)
        if not (hard or soft):
            styles.append((hold, up.id, len(stack), hint))
        at_tag.setdefault(tag, []).append(len(stack))
        stack.append(hold)
    if at <= n:
        buffer.append(whole[n:])
    flush()
    return _judged(blocks, styles, over, chars, linked)


def _judged(blocks: list, styles: list, over: list[int], chars: list[int], linked: list[int]) -> Page:
    """The page, once all of it is known: which cases are noise, and whether articles in soft noise stay."""
    for k in range(len(over) - 1, 0, -1):
        chars[over[k]] += chars[k]
        linked[over[k]] += linked[k]
    gone = [False] * len(over)
    for k in range(1, len(over)):
        gone[k] = gone[over[k]] or chars[k] < FEW_CHARS or linked[k] >= LINKED * chars[k]
    sound = lambda x: not (x.hard or x.soft)
    outside = any(x.main and not x.rescued and sound(x) and not gone[x.case] for x, _ in blocks)
    if not any(x.main and sound(x) and not gone[x.case] and not (x.rescued and outside) for x, _ in blocks):
        gone = [False] * len(over)  # an article isn't all noise for its words
    noise = lambda x: not sound(x) or gone[x.case] or x.rescued and outside
    page = Page([(x.id, noise(x), x.main, x.low, text) for x, text in blocks], {}, {})
    for x, parent, depth, hint in styles:
        if not noise(x):
            if not (x.main and x.tag in _HEADINGS):  # an article's headings are its own, however alike
                page.parent.setdefault(x.id, (parent, depth, x.main, hint))
            page.children.setdefault(parent, []).append(x.id)
    return page


def site(url: str | None) -> str:
    """Host of a URL in lower case, without user, port and a leading www.; empty if there is none."""
    m = re.match(r"\s*(?:[a-zA-Z][\w+.-]*:)?//([^/?#]*)", url or "")
    host = m[1].rpartition("@")[2].partition(":")[0].lower() if m else ""
    return host.removeprefix("www.")


def style_rows(pages: DataFrame) -> DataFrame:
    """(host, html_id, page, node, parent, depth, main, hint, text, content, look): of each page the style nodes that aren't
    declared noise (text null) and their content nodes (text: hash of the block). page: hash of the page's texts but for
    declared noise; pages that read alike there are one page, since copies would make any text look like a template."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, key, html in zip(b["url"], b["html_id"].tolist(), b["html"], strict=True):
                host, got = site(url), parse(html)
                texts: dict[int, list[str]] = {}
                for node, noise, _, _, text in got.blocks:
                    if not noise:
                        texts.setdefault(node, []).append(text)
                page = _hash(*(text for _, noise, _, _, text in got.blocks if not noise))
                for node, (parent, depth, main, hint) in got.parent.items():
                    own = texts.get(node)
                    look = got.children.get(node)
                    rows.append((host, key, page, node, parent, depth, main, hint, None, _hash(*own) if own else None, _hash(*map(str, look)) if look else None))
                    if own:
                        rows += [(host, key, page, node, parent, depth, main, hint, x, None, None) for x in {_hash(t) for t in own}]
            names = ("host", "html_id", "page", "node", "parent", "depth", "main", "hint", "text", "content", "look")
            columns = dict(zip(names, zip(*rows, strict=True), strict=True)) if rows else {n: () for n in names}
            # a column of numbers and nulls would become one of floats
            yield pd.DataFrame({n: pd.array(list(v), dtype="Int64") if n in ("text", "content", "look") else list(v) for n, v in columns.items()}).astype({"html_id": "int64", "page": "int64", "node": "int64", "parent": "int64", "depth": "int32", "main": "bool", "hint": "bool", "host": "object"})

    return pages.mapInPandas(lean(run), "host string, html_id long, page long, node long, parent long, depth int, main boolean, hint boolean, text long, content long, look long")


def importance(rows: DataFrame) -> DataFrame:
    """(host, node, n_pages, main, importance, low) of the style nodes on MIN_PAGES distinct pages of a host at least.

    Contents and looks are counted in two steps, so that a host of any size needs no task of its own; what a host's tree is
    made of is a row per style node. A node's kind of low importance is that of its branch: LEAST, LEAST_MAIN inside an article,
    or LEAST_HINT where its words hint at noise; a hinted branch goes as a whole."""
    nodes = rows.filter("text is null").select("host", "page", "node", "parent", "depth", "main", "hint", "content", "look").distinct()

    def entropy(col: str) -> DataFrame:
        c = nodes.groupBy("host", "node", col).agg(F.count("*").alias("c"))
        m = c.groupBy("host", "node").agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"), F.count(col).alias("k"))
        h = F.when(F.col("n") > 1, 1 - F.col("s") / F.col("n") / F.log("n")).otherwise(F.lit(1.0))
        return m.select("host", "node", h.alias(f"h_{col}"), (F.col("k") > 0).alias(f"has_{col}"))

    seen = nodes.groupBy("host", "node").agg(F.first("parent").alias("parent"), F.first("depth").alias("depth"), F.first("main").alias("main"), F.max("hint").alias("hint"), F.countDistinct("page").alias("n_pages")).filter(F.col("n_pages") >= MIN_PAGES)
    told = seen.join(entropy("content"), ["host", "node"]).join(entropy("look"), ["host", "node"])

    def tree(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values(["depth", "node"], ascending=[False, True])
        below: dict[int, list[tuple[float, int, bool]]] = {}
        out = []
        for node, parent, main, hint, n, hc, has_text, hl, has_look in b[["node", "parent", "main", "hint", "n_pages", "h_content", "has_content", "h_look", "has_look"]].itertuples(index=False, name=None):
            kids = below.get(node, [])
            parts = [(i, m) for i, m, _ in kids] + ([(hc, n)] if has_text else [])
            mean = sum(i * m for i, m in parts) / sum(m for _, m in parts) if parts else 1.0
            share = GAMMA ** len(kids) if has_look else 1.0
            value = (1 - share) * hl + share * mean
            least = LEAST_HINT if hint else LEAST_MAIN if main else LEAST
            low = value < least and (hint or not main or n >= MIN_MAIN) and (hint or all(x for _, _, x in kids)) and bool(parts)
            below.setdefault(parent, []).append((value, n, low))
            out.append((b["host"].iat[0], node, n, main, value, low))
        return pd.DataFrame(out, columns=["host", "node", "n_pages", "main", "importance", "low"])

    return told.groupBy("host").applyInPandas(tree, "host string, node long, n_pages long, main boolean, importance double, low boolean")


def repeated_texts(rows: DataFrame) -> DataFrame:
    """(host, node, text) of content nodes of low importance: 1 - log(c) / log(m) for a block on c of the m distinct pages
    that have its style node."""
    m = rows.filter("text is null and content is not null").groupBy("host", "node").agg(F.countDistinct("page").alias("m")).filter(F.col("m") >= MIN_MAIN)
    c = rows.filter("text is not null").groupBy("host", "node", "text").agg(F.countDistinct("page").alias("c")).filter("c > 1")
    return c.join(m, ["host", "node"]).filter(1 - F.log("c") / F.log("m") < LEAST_MAIN).select("host", "node", "text")


def main_text(html: str, low: Collection[int] = (), texts: Collection[tuple[int, int]] = ()) -> str:
    """The page's text without noise, without the branches of low importance, and without the content nodes of texts."""
    return "\n".join(text for node, noise, _, poor, text in parse(html, low).blocks if not noise and not poor and not (texts and (node, _hash(text)) in texts))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every page, from its whole html.

    A null html or url counts as empty; a page without a host is judged with the others that have none. Pages without
    main text have an empty one. Repeated rows give a row each and count once in their host's statistics, as do pages whose
    texts outside declared noise are equal. Other columns are not read. A node that is on fewer than MIN_PAGES (inside an
    article, and for content nodes, MIN_MAIN) distinct pages of a host is removed by declaration only. Very long and broken
    pages take time in proportion to their length. An empty table gives no row.
    """
    small_batches(pages.sparkSession)
    src = pages.select(F.col("page_id").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html")).withColumn("html_id", F.xxhash64("url", "html"))
    rows = materialize(style_rows(src.select("url", "html_id", "html")), "style-rows")
    branches = importance(rows).filter("low").select("host", "node", F.lit(None).cast("long").alias("text"))
    low = materialize(branches.union(repeated_texts(rows)), "low-nodes")

    # what is low on a page is a list no longer than the page's own nodes
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = []
            for html, nodes, texts in zip(b["html"], b["nodes"], b["texts"], strict=True):
                nodes, texts = (() if x is None else x for x in (nodes, texts))
                text.append(main_text(html, frozenset(map(int, nodes)), frozenset((x["node"], x["text"]) for x in texts)))
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": list(map(len, text))})

    if low.isEmpty():
        joined = src.withColumns({"nodes": F.lit(None).cast("array<long>"), "texts": F.lit(None).cast("array<struct<node:long,text:long>>")})
    else:
        own = rows.select("html_id", "host", "node", "text").join(low, (rows["host"] == low["host"]) & (rows["node"] == low["node"]) & rows["text"].eqNullSafe(low["text"]), "left_semi")
        told = F.col("text").isNotNull()
        lists = own.groupBy("html_id").agg(F.collect_set(F.when(~told, F.col("node"))).alias("nodes"), F.collect_set(F.when(told, F.struct("node", "text"))).alias("texts"))
        joined = src.join(lists, "html_id", "left")
    out = joined.select("page_id", "url", "html", "nodes", "texts").mapInPandas(lean(run), "page_id string, url string, text string, n_chars long")
    return out.withColumn("page_id", F.col("page_id").cast(pages.schema["page_id"].dataType))


def op4_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("page_id", F.col("page_id").cast("long")))
