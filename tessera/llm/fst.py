"""Token counts by a byte-level BPE tokenizer compiled to deterministic finite-state transducers.

Two machines in cascade. The splitter reads one symbol per character (its class, with the two characters of look-ahead
that the split rule needs) and marks where pieces start; it has 8 states, so a text is cut into chunks, every chunk's map
from start state to end state is computed for all states at once, and the maps are composed by a parallel prefix scan to
give each chunk its true start. The counter reads a piece's bytes. After each prefix of a piece BPE has one encoding,
which ends in one token; which token follows from the tokens that ended earlier prefixes, so a state holds, for each
start from which a vocabulary token may still grow, its trie node, the token before it and the tokens emitted since.
A transition is annotated with the change of the token count. States are made when first met (the machine is compiled
lazily, from the vocabulary and merges alone) and kept in one dense table.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep_only, small_batches
from .tokens import default_tokenizer

CHUNK = 128
LIMIT = 512
#: Symbols of the splitter.
LETTER, NUMBER, OTHER, APOS1, APOS2, SPACE_N, SPACE_W, BLANK_N, BLANK_W, RESET = range(10)
#: Its states.
START, IN_L, IN_N, IN_O, AFTER_SPACE, IN_W, SHORT1, SHORT2 = range(8)


def byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in keep]
    return {chr(b): b for b in keep} | {chr(256 + i): b for i, b in enumerate(rest)}


def split_table() -> np.ndarray:
    """(state, symbol) -> new state, + 8 if a piece starts at the symbol."""
    t = np.zeros((8, 10), dtype=np.uint8)
    for s in range(8):
        for x in range(10):
            if x == RESET:
                to, new = START, True
            elif s in (SHORT1, SHORT2):
                to, new = (START if s == SHORT1 else SHORT1), False
            elif x in (LETTER, NUMBER):
                to = IN_L if x == LETTER else IN_N
                new = s not in (to, AFTER_SPACE)
            elif x == OTHER:
                to, new = IN_O, s not in (IN_O, AFTER_SPACE)
            elif x in (APOS1, APOS2):
                to, new = (IN_O, False) if s in (IN_O, AFTER_SPACE) else (SHORT1 if x == APOS1 else SHORT2, True)
            elif x == SPACE_N:
                to, new = AFTER_SPACE, True
            elif x == BLANK_N:
                to, new = START, True
            else:
                to, new = IN_W, s != IN_W
            t[s, x] = to + 8 * new
    return t


def char_classes() -> np.ndarray:
    """0 letter, 1 number, 2 other, 3 space, 4 other white space, for each code point."""
    c = np.full(0x110000, 2, dtype=np.uint8)
    for i in range(0x110000):
        k = unicodedata.category(chr(i))[0]
        if k == "L":
            c[i] = 0
        elif k == "N":
            c[i] = 1
    for i in (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000):
        c[i] = 4
    c[32] = 3
    return c


class Splitter:
    def __init__(self):
        self.classes = char_classes()
        t = split_table()
        self.flat = t.ravel()
        self.step = (t & 7).ravel()

    def symbols(self, cp: np.ndarray, breaks: np.ndarray) -> np.ndarray:
        """cp: code points; breaks: positions whose character only parts texts."""
        k = self.classes[cp]
        k[breaks] = 9
        after = np.empty_like(k)
        after[:-1], after[-1] = k[1:], 9
        sym = np.array([LETTER, NUMBER, OTHER, SPACE_W, BLANK_W, 0, 0, 0, 0, RESET], dtype=np.uint8)[k]
        solid = after < 3  # followed by no white space and no end
        sym[(k == 3) & solid] = SPACE_N
        sym[(k == 4) & solid] = BLANK_N
        at = np.flatnonzero(cp == 39)
        at = at[k[at] != 9]
        if len(at):
            ext = np.concatenate([cp, np.zeros(2, cp.dtype)])
            one, two = ext[at + 1], ext[at + 2]
            inside = np.concatenate([k, [9, 9]])[at + 1] != 9
            sym[at[inside & np.isin(one, [ord(c) for c in "stmd"])]] = APOS1
            pair = (((one == ord("r")) | (one == ord("v"))) & (two == ord("e"))) | ((one == ord("l")) & (two == ord("l")))
            sym[at[inside & pair & (np.concatenate([k, [9, 9]])[at + 2] != 9)]] = APOS2
        return sym

    def starts(self, sym: np.ndarray) -> np.ndarray:
        """True where a piece starts."""
        n = len(sym)
        rows = -(-n // CHUNK)
        grid = np.full(rows * CHUNK, RESET, dtype=np.uint8)
        grid[:n] = sym
        cols = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
        maps = np.broadcast_to(np.arange(8, dtype=np.uint8), (rows, 8)).copy()
        for x in cols:  # every chunk, from every state
            maps = self.step[maps * np.uint8(10) + x[:, None]]
        hop = 1
        while hop < rows:  # inclusive scan: maps[i] becomes the map of chunks 0..i
            maps[hop:] = np.take_along_axis(maps[hop:].copy(), maps[:-hop].copy().astype(np.intp), axis=1)
            hop *= 2
        state = np.zeros(rows, dtype=np.uint8)
        state[1:] = maps[:-1, START]
        out = np.empty((CHUNK, rows), dtype=bool)
        for i, x in enumerate(cols):
            t = self.flat[state * np.uint8(10) + x]
            out[i] = t >= 8
            state = t & 7
        return out.T.ravel()[:n]


class Counter:
    """The counting transducer. table[state * 256 + byte] = next state * 256 + emitted + 128, or -1 before it is compiled."""

    MOST = 110_000
    LONG = 64

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            j = json.load(f)
        alphabet = byte_alphabet()
        raw = {k: bytes(alphabet[c] for c in k) for k in j["model"]["vocab"]}
        self.bytes = {i: raw[k] for k, i in j["model"]["vocab"].items()}
        ids = {raw[k]: i for k, i in j["model"]["vocab"].items()}
        self.merges = {}
        for r, m in enumerate(j["model"]["merges"]):
            a, b = m if isinstance(m, list) else m.split(" ")
            self.merges[ids[raw[a]], ids[raw[b]]] = (r, ids[raw[a] + raw[b]])
        self.single = [ids[bytes([b])] for b in range(256)]
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for b, i in sorted(ids.items()):
            if self.bpe(b) != (i,):
                continue  # a token that no text gives
            at = 0
            for x in b:
                at = self.child[at].setdefault(x, len(self.child))
                if at == len(self.token):
                    self.child.append({})
                    self.token.append(-1)
            self.token[at] = i
        self.pairs: dict[tuple[int, int], bool] = {}
        self.reset()

    def reset(self):
        self.states, self.index = [], {}
        self.table = np.full(4096 * 256, -1, dtype=np.int32)
        self.state(((0, -1, 0),))

    def bpe(self, b: bytes) -> tuple[int, ...]:
        part = [self.single[x] for x in b] if hasattr(self, "single") else []
        while len(part) > 1:
            best = min(((m[0], i, m[1]) for i in range(len(part) - 1) if (m := self.merges.get((part[i], part[i + 1])))), default=None)
            if best is None:
                break
            part[best[1] : best[1] + 2] = [best[2]]
        return tuple(part)

    def follows(self, a: int, b: int) -> bool:
        """Whether b can come right after a in an encoding."""
        if a < 0:
            return True
        if (k := self.pairs.get((a, b))) is None:
            k = self.pairs[a, b] = self.bpe(self.bytes[a] + self.bytes[b]) == (a, b)
        return k

    def state(self, key: tuple) -> int:
        if (i := self.index.get(key)) is None:
            i = self.index[key] = len(self.states)
            self.states.append(key)
            if 256 * (i + 1) > len(self.table):
                self.table = np.concatenate([self.table, np.full(len(self.table), -1, dtype=np.int32)])
        return i

    def compile(self, at: int) -> int:
        """Compile one transition, at = state * 256 + byte."""
        byte, grown, found = at & 255, [], None
        for node, before, since in self.states[at >> 8]:
            to = self.child[node].get(byte)
            if to is None:
                continue
            tok = self.token[to]
            if found is None and tok >= 0 and self.follows(before, tok):
                found = (tok, 1 - since)
            grown.append((to, before, since))
        tok, emitted = found
        key = (*((n, b, s + emitted) for n, b, s in grown if self.child[n]), (0, tok, 0))
        value = self.state(key) * 256 + emitted + 128
        self.table[at] = value
        return value

    def one(self, piece: bytes) -> int:
        at, n = 0, 0
        for b in piece:
            v = int(self.table[at | b])
            if v < 0:
                v = self.compile(at | b)
            n += (v & 255) - 128
            at = v & ~255
        return n

    def counts(self, data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Tokens of each piece data[start : start + length]; all pieces advance together, longest first."""
        if len(self.states) > self.MOST:
            self.reset()
        out = np.zeros(len(start), dtype=np.int64)
        long = np.flatnonzero(length > self.LONG)
        for i in long.tolist():
            out[i] = self.one(data[start[i] : start[i] + length[i]].tobytes())
        short = np.flatnonzero(length <= self.LONG)
        order = short[np.argsort(-length[short].astype(np.int16), kind="stable")]
        st, ln = start[order], length[order]
        ends = np.searchsorted(-ln, -np.arange(0, self.LONG + 1), side="left")  # pieces longer than c: the first ends[c]
        at, total = np.zeros(len(order), dtype=np.int32), np.zeros(len(order), dtype=np.int32)
        for c in range(int(ln[0]) if len(ln) else 0):
            k = int(ends[c])
            key = at[:k] | data[st[:k] + c]
            v = self.table[key]
            if len(missing := np.flatnonzero(v < 0)):
                for m in np.unique(key[missing]).tolist():
                    self.compile(m)
                v[missing] = self.table[key[missing]]
            total[:k] += (v & 255) - 128
            at[:k] = v & ~255
        out[order] = total
        return out


class TokenCounter:
    """Counts of whole texts, equal to the library's default: a special string inside a text is one token."""

    BATCH_CHARS = 1 << 20

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.splitter, self.counter = Splitter(), Counter(path)

    def _some(self, texts: list[str]) -> np.ndarray:
        extra = np.zeros(len(texts), dtype=np.int64)
        parts, owner = [], []
        for i, t in enumerate(texts):
            own = [t]
            for s in self.special:
                if s in t:
                    own = [y for x in own for y in x.split(s)]
            extra[i] = len(own) - 1
            parts += own
            owner += [i] * len(own)
        joined = "\x00".join(parts)
        cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        if not len(cp):
            return extra
        sizes = np.array([len(p) for p in parts])
        breaks = (np.cumsum(sizes + 1) - 1)[:-1]
        begins = self.splitter.starts(self.splitter.symbols(cp, breaks))
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        if len(data) == len(cp):
            at = np.flatnonzero(begins)
            bounds = at
        else:
            width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
            at = np.flatnonzero(begins)
            bounds = (np.cumsum(width) - width)[at]
        length = np.diff(np.append(bounds, len(data)))
        gap = np.zeros(len(cp), dtype=bool)
        gap[breaks] = True
        keep = ~gap[at]
        part = np.searchsorted(breaks, at[keep], side="right")
        n = self.counter.counts(data, bounds[keep], length[keep])
        return extra + np.bincount(np.array(owner)[part], weights=n, minlength=len(texts)).astype(np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        out, at, size = [], 0, 0
        for i, t in enumerate(texts):
            size += len(t) + 1
            if size >= self.BATCH_CHARS:
                out.append(self._some(texts[at : i + 1]))
                at, size = i + 1, 0
        if at < len(texts):
            out.append(self._some(texts[at:]))
        return np.concatenate(out) if out else np.zeros(0, np.int64)


_COUNTERS: dict[str, TokenCounter] = {}


def counter(path: str) -> TokenCounter:
    keep_only(_COUNTERS)
    if path not in _COUNTERS:
        _COUNTERS[path] = TokenCounter(path)
    return _COUNTERS[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, tokenizer: str | None = None, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns with n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows are counted each; other columns, a column named as an
    output among them, are not read unless kept. An empty table gives no row. No shuffle.
    """
    small_batches(docs.sparkSession)
    path = tokenizer or default_tokenizer()
    src = docs.select(*(F.col(c) for c in keep), F.coalesce(F.col(text), F.lit("")).alias("_text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            texts = b.pop("_text").tolist()
            n = counter(path)(texts)
            b["n_bytes"], b["n_tokens"] = [len(t.encode()) for t in texts], n
            b["over_limit"] = n > limit
            yield b

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema if f.name != "_text")
    return src.mapInPandas(count, f"{schema}, n_bytes long, n_tokens long, over_limit boolean")


def op10_fst_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("doc_id", F.col("doc_id").cast("long")))
