"""Language identification of code-switched text by a linear-chain conditional random field.

Words are labelled with languages by forward-backward over the whole word sequence. Features of a word: its prefixes and
suffixes, character n-grams, and membership in each language's learned lexicon; transition weights are learned too. A
document's language is the label with the largest expected share of letters, and the score is that share.

A sequence is cut into chunks of CHUNK words. A chunk's product of (transition x emission) matrices carries messages
across it, so all chunks of a batch advance together and the chunk products are joined in order, exactly.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, release, small_batches

FIT_DOCS = 400  # labelled documents per language
FIT_CHARS = 100_000  # longest document to learn from
FIT_SEQUENCES = 1_200
FIT_WORDS = 64  # words in a training sequence
LEXICON = 300
BUCKETS = 1 << 16
CHUNK = 64
UND = "und"
_WORDS = re.compile(r"[^\W\d_]+").findall


def words_of(text: str) -> list[str]:
    """Runs of letters. Number signs that aren't digits (fractions, Roman numerals, circled numbers) make no word alone."""
    out = _WORDS(text)
    return out if text.isascii() else [w for w in out if w.isascii() or w.isalpha() or any(map(str.isalpha, w))]


@dataclass
class Model:
    uid: str
    langs: list[str]
    weights: np.ndarray  # (BUCKETS, K)
    trans: np.ndarray  # (K, K)
    lexicon: dict[str, int]  # word -> bits of the languages whose lexicon holds it

    def features(self, word: str) -> list[int]:
        """Buckets of a word's prefixes and suffixes of up to 3 letters, its trigrams and its lexicons."""
        w = f"<{word.lower()}>"
        n = len(w)
        parts = {w[:2], w[:4], w[-2:], w[n - 4 :] if n > 4 else w, *(w[i : i + 3] for i in range(n - 2))}
        return [*map(_BUCKET.__getitem__, parts), _BUCKET[f"lexicon {self.lexicon.get(w[1:-1], 0)}"]]

    def scores(self, words: list[str]) -> np.ndarray:
        """(len(words), K); words is not empty."""
        feats = [self.features(w) for w in words]
        size = np.fromiter(map(len, feats), np.int64, len(feats))
        rows = self.weights[np.fromiter(chain.from_iterable(feats), np.int64, int(size.sum()))]
        return np.add.reduceat(rows, np.cumsum(size) - size) / np.sqrt(size)[:, None]


class _Buckets(dict):
    """n-gram -> bucket; emptied when it has grown large."""

    def __missing__(self, gram):
        if len(self) > 200_000:
            self.clear()
        b = self[gram] = zlib.crc32(gram.encode("utf-8", "surrogatepass")) % BUCKETS
        return b


_BUCKET = _Buckets()


def forward_backward(em: np.ndarray, trans: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Label posteriors of every word. em: (N, K) emission factors of all sequences, one after another; trans: (K, K)
    factors; lengths: words of each sequence (each above 0)."""
    n, k = em.shape
    per = -(-lengths // CHUNK)
    seq = np.repeat(np.arange(len(lengths)), per)
    nth = np.arange(len(seq)) - np.repeat(np.cumsum(per) - per, per)
    begin = np.repeat(np.cumsum(lengths) - lengths, per) + nth * CHUNK
    size = np.minimum(CHUNK, np.repeat(lengths, per) - nth * CHUNK)
    order = np.argsort(-size, kind="stable")
    b, s = begin[order], size[order]
    active = np.searchsorted(-s, -np.arange(CHUNK), side="left")  # chunks longer than t
    m = np.broadcast_to(np.eye(k, dtype=em.dtype), (len(b), k, k)).copy()
    for t in range(int(s[0])):
        a = active[t]
        x = (m[:a].reshape(-1, k) @ trans).reshape(a, k, k) * em[b[:a] + t][:, None, :]
        m[:a] = x / x.sum((1, 2), keepdims=True)
    place = np.empty_like(order)
    place[order] = np.arange(len(order))
    m = m[place]
    # messages into each chunk, from the left and from the right, chunk by chunk of all sequences at once
    left, right = np.full((len(seq), k), 1.0 / k, em.dtype), np.full((len(seq), k), 1.0 / k, em.dtype)
    first = np.cumsum(per) - per
    for j in range(1, int(per.max())):
        at = first[per > j] + j
        v = np.einsum("nk,nkl->nl", left[at - 1], m[at - 1])
        left[at] = v / v.sum(1, keepdims=True)
    for j in range(1, int(per.max())):
        at = (first + per - 1 - j)[per > j]
        v = np.einsum("nkl,nl->nk", m[at + 1], right[at + 1])
        right[at] = v / v.sum(1, keepdims=True)
    left, right = left[order], right[order]
    post = np.empty_like(em)
    alpha = left
    for t in range(int(s[0])):
        a = active[t]
        x = (alpha[:a] @ trans) * em[b[:a] + t]
        alpha = x / x.sum(1, keepdims=True)
        post[b[:a] + t] = alpha
    beta = right.copy()
    back = trans.T.copy()
    for t in range(int(s[0]) - 1, -1, -1):
        a = active[t]
        at = b[:a] + t
        x = post[at] * beta[:a]
        post[at] = x / x.sum(1, keepdims=True)
        v = (beta[:a] * em[at]) @ back
        beta[:a] = v / v.sum(1, keepdims=True)
    return post


def marginals(em: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(label posteriors, pair posteriors) of sequences of one length. em: (N, T, K) emission factors; trans: (K, K) factors;
    the pairs are (N, T - 1, K, K): alpha_t(i) trans(i, j) em_t+1(j) beta_t+1(j), scaled to sum to one."""
    n, steps, k = em.shape
    alpha, beta = np.empty_like(em), np.ones_like(em)
    alpha[:, 0] = em[:, 0] / em[:, 0].sum(1, keepdims=True)
    for t in range(1, steps):
        x = (alpha[:, t - 1] @ trans) * em[:, t]
        alpha[:, t] = x / x.sum(1, keepdims=True)
    for t in range(steps - 2, -1, -1):
        x = (em[:, t + 1] * beta[:, t + 1]) @ trans.T
        beta[:, t] = x / x.sum(1, keepdims=True)
    post = alpha * beta
    pair = alpha[:, :-1, :, None] * trans * (em * beta)[:, 1:, None, :]
    return post / post.sum(2, keepdims=True), pair / pair.sum((2, 3), keepdims=True)


def fit(samples: list[tuple[str, str]], seed: int = 11, rounds: int = 45) -> Model | None:
    """Learn from (text, language) pairs. Sequences of FIT_WORDS words are spliced from documents of two languages half
    the time, so that transitions are learned."""
    by: dict[str, list[list[str]]] = {}
    for text, lang in samples:
        if words := words_of(text):
            by.setdefault(lang, []).append(words)
    langs = sorted(by)
    if not langs:
        return None
    counts = [Counter(w.lower() for d in by[x] for w in d) for x in langs]
    lexicon: dict[str, int] = {}
    for i, c in enumerate(counts):
        for w, _ in sorted(c.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            lexicon[w] = lexicon.get(w, 0) | 1 << i
    k, rng = len(langs), np.random.default_rng(seed)
    model = Model(uuid.uuid4().hex, langs, np.zeros((BUCKETS, k)), np.zeros((k, k)), lexicon)
    if k == 1:
        return model
    words, labels = [], []
    for _ in range(FIT_SEQUENCES):
        cut = int(rng.integers(1, FIT_WORDS)) if rng.random() < 0.5 else FIT_WORDS
        for want in (cut, FIT_WORDS - cut):
            y = int(rng.integers(k))
            got = 0
            while got < want:
                d = by[langs[y]][int(rng.integers(len(by[langs[y]])))]
                at = int(rng.integers(max(1, len(d) - want)))
                part = d[at : at + want - got]
                words += part
                labels += [y] * len(part)
                got += len(part)
    uniq = {w: i for i, w in enumerate(dict.fromkeys(words))}
    feats = [model.features(w) for w in uniq]
    widest = max(map(len, feats))
    x = np.full((len(feats), widest), BUCKETS)
    for i, f in enumerate(feats):
        x[i, : len(f)] = f
    norm = 1 / np.sqrt([len(f) for f in feats])[:, None]
    which, y = np.array([uniq[w] for w in words]), np.array(labels)
    w, t = np.zeros((BUCKETS + 1, k)), np.zeros((k, k))
    gold = np.zeros((len(y), k))
    gold[np.arange(len(y)), y] = 1
    same = np.arange(len(y)) % FIT_WORDS != 0
    gold_t = np.zeros((k, k))
    np.add.at(gold_t, (y[:-1][same[1:]], y[1:][same[1:]]), 1)
    mw, vw, mt, vt = np.zeros_like(w), np.zeros_like(w), np.zeros_like(t), np.zeros_like(t)
    for r in range(1, rounds + 1):
        e = (w[x].sum(1) * norm)[which]
        em, tr = np.exp(e - e.max(1, keepdims=True)), np.exp(t - t.max())
        post, pair = marginals(em.reshape(-1, FIT_WORDS, k), tr)
        post = post.reshape(-1, k)
        g = np.zeros((len(feats), k))
        np.add.at(g, which, gold - post)
        g *= norm
        gw = np.stack([np.bincount(x.ravel(), np.repeat(g[:, j], widest), BUCKETS + 1) for j in range(k)], 1)
        gw[BUCKETS] = 0
        gt = gold_t - pair.sum((0, 1))
        gw, gt = gw / len(y) - 1e-5 * w, gt / len(y) - 1e-5 * t
        for theta, grad, m1, v1, rate in ((w, gw, mw, vw, 0.25), (t, gt, mt, vt, 0.1)):
            m1 *= 0.9
            m1 += 0.1 * grad
            v1 *= 0.99
            v1 += 0.01 * grad**2
            theta += rate * (m1 / (1 - 0.9**r)) / (np.sqrt(v1 / (1 - 0.99**r)) + 1e-8)
    model.weights, model.trans = w[:BUCKETS].astype(np.float32), t
    return model


class Labeller:
    """Posteriors of whole texts under a model, with a memo of word scores."""

    MOST = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.tr = np.exp(model.trans - model.trans.max()).astype(np.float32)
        self.clear()

    def clear(self):
        self.index: dict[str, int] = {}
        self.table = np.zeros((0, len(self.model.langs)), np.float32)

    def ids(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))

    def label(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """(words, posteriors) of each text."""
        if len(self.index) > self.MOST:
            self.clear()
        words = [words_of(t) for t in texts]
        new = list(set(chain.from_iterable(words)).difference(self.index))
        if new:
            s = self.model.scores(new)
            self.index.update(zip(new, range(len(self.table), len(self.table) + len(new)), strict=True))
            self.table = np.concatenate([self.table, np.exp(s - s.max(1, keepdims=True)).astype(np.float32)])
        ids = [self.ids(w) for w in words]
        lengths = np.array([len(w) for w in words])
        if not lengths.sum():
            return [(w, np.zeros((0, len(self.model.langs)))) for w in words]
        post = forward_backward(np.maximum(self.table[np.concatenate(ids)], 1e-12), self.tr, lengths[lengths > 0])
        ends = np.cumsum(lengths)
        return [(w, post[e - n : e]) for w, e, n in zip(words, ends.tolist(), lengths.tolist(), strict=True)]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        pred, score, at = [], [], 0
        while at < len(texts):
            size, to = 0, at
            while to < len(texts) and (to == at or size < 1 << 20):
                size += len(texts[to] or "")
                to += 1
            for words, post in self.label([t or "" for t in texts[at:to]]):
                if not words:
                    pred.append(UND)
                    score.append(0.0)
                    continue
                share = np.fromiter(map(len, words), np.float64, len(words)) @ post
                share /= share.sum()
                best = int(np.argmax(share))
                pred.append(self.model.langs[best])
                score.append(float(min(1.0, max(0.0, share[best]))))
            at = to
        return pred, score


_LABELLERS: dict[str, Labeller] = {}


def labeller(model: Model) -> Labeller:
    keep_only(_LABELLERS, _BUCKET)
    if model.uid not in _LABELLERS:
        _LABELLERS.clear()
        _LABELLERS[model.uid] = Labeller(model)
    return _LABELLERS[model.uid]


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model | None:
    """A model from at most FIT_DOCS documents of each language, those of the smallest hashes, of FIT_CHARS characters at
    most; held-out documents are never among them. The counts per language, which set the share drawn, cover all rows."""
    able = docs.filter(F.col(text).isNotNull() & F.col(lang).isNotNull() & ~held_out() & (F.length(text) <= FIT_CHARS) & (F.length(text) > 0)).select(F.col(text).alias("t"), F.col(lang).cast("string").alias("l"), F.pmod(F.xxhash64(text), F.lit(1 << 30)).alias("h"))
    counts = able.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return None
    share = F.create_map(*(x for r in counts for x in (F.lit(r.l), F.lit(int(min(1.0, (1.5 * FIT_DOCS + 50) / max(r.n, 1)) * (1 << 30)) + 1))))
    drawn = able.filter(F.col("h") < F.element_at(share, F.col("l"))).distinct().toPandas().sort_values(["h", "t"])
    return fit(list(drawn.groupby("l").head(FIT_DOCS)[["t", "l"]].itertuples(index=False, name=None)))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """docs with lang_pred and score (columns of these names are replaced). A null, empty or letterless text is `und`
    with score 0, as is every text when there was nothing to learn from. Whole texts; no shuffle; repeated rows alike."""
    small_batches(docs.sparkSession)
    docs = docs.drop("lang_pred", "score")
    if model is None:
        return docs.withColumn("lang_pred", F.lit(UND)).withColumn("score", F.lit(0.0))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # weights of BUCKETS x languages: bounded

    @F.pandas_udf("lang_pred string, score double")
    def predict(t: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        lab = labeller(shared.value)
        for x in t:
            p, s = lab.predict(x.tolist())
            yield pd.DataFrame({"lang_pred": p, "score": s})
        release()

    cols = docs.columns
    name = "_crf"
    while name in cols:
        name += "_"
    return docs.withColumn(name, predict(F.col(text))).select(*cols, f"{name}.lang_pred", f"{name}.score")


def op7_crf_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """identify() for documents, learned from those that aren't held out; nulls, empty texts and repeats as it says. Rows
    with a null doc_id are not held out. An empty table gives no row."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs.select("doc_id", "text"), learn(docs)).select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), "lang_pred", "score")
