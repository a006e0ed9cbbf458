"""Whole texts to token ids, equal to the tokenizers library's, by encoding each distinct part of a batch once.

The pre-tokenizer of the byte-level vocabulary starts a piece at every space that no white space follows, so a text may be
cut there and its parts encoded alone. Parts of an Arrow batch are cut and made distinct by Arrow; those that a worker has
met before come from its memo, the others are encoded by the library, many in one call; ids are then gathered by NumPy.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import keep_only

#: Characters from here on may be of another class in another version of Unicode: texts with them go through the library whole.
BEYOND = "[^\\x00-\\x{24f}]"
#: Parts that don't stand alone behind a space: empty ones, and those that begin with white space of any engine's kind.
LEADING = "^(?:[\\s\\x0b\\x1c-\\x1f\\x{85}\\x{a0}]|\\z)"
JOINED = 30
#: Batches are gathered to about this size, so that a part is looked up once for many texts.
GROUP_BYTES = 5 << 20
#: Marks a text's first part, which has no space before it, among the keys; no part begins with it (it is beyond U+024F).
HEAD = "\ue000"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Store:
    """Known keys as an Arrow array, and their ids one after another in one array that doubles when it is full."""

    def __init__(self):
        self.keys = pa.array([], pa.string())
        self.starts = np.zeros(1024, np.int64)
        self.lengths = np.zeros(1024, np.int64)
        self.ids = np.zeros(4096, np.uint32)
        self.used = 0

    def add(self, keys: pa.Array, ids: np.ndarray, lengths: np.ndarray) -> None:
        at, n, to = len(self.keys), len(keys), self.used + len(ids)
        while at + n > len(self.starts):
            self.starts, self.lengths = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.lengths, 2 * len(self.lengths))
        while to > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.keys = pa.concat_arrays([self.keys, keys])
        self.lengths[at : at + n] = lengths
        self.starts[at : at + n] = self.used + np.cumsum(lengths) - lengths
        self.ids[self.used : to] = ids
        self.used = to

    def find(self, keys: pa.Array) -> np.ndarray:
        """Places of the keys, -1 for those that aren't known; one pass over both, in Arrow."""
        return pc.fill_null(pc.index_in(keys, value_set=self.keys), -1).to_numpy().astype(np.int64)

    def take(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the places one after another, length of each)."""
        lengths = self.lengths[places]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        at = np.repeat((self.starts[places] - (ends - lengths)).astype(np.int32), lengths)
        at += np.arange(total, dtype=np.int32)
        return self.ids[at], lengths


class TextEncoder:
    """ids of whole texts. Texts that hold a special token's string, or characters beyond U+024F, go through the library
    whole; so do all texts where the vocabulary isn't of the kind that may be cut (tried once on probes)."""

    def __init__(self, path: str, memo: int = 700_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.most = memo
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        names = self.tok.get_vocab()
        self.opens = np.zeros(max(names.values(), default=0) + 1, bool)  # tokens that begin with a space
        self.opens[[i for s, i in names.items() if s.startswith("Ġ")]] = True
        self.cut = re.compile(r" (?=\S)").split
        self.store = _Store()
        probe = pa.array(["It's 12 (odd)  \n\tthings, isn't it?  ", "so it's plain\ntext, as\n\n here: 'tis", " led"])
        self.fast = True
        self.fast = self.encode(probe)[0].tolist() == self._whole(probe.to_pylist())[0].tolist()
        self.store = _Store()

    def _whole(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        ids = [np.array(e.ids, np.uint32) for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array([len(x) for x in ids], np.int64)

    def _learn(self, keys: list[str]) -> None:
        """Encode parts that aren't known: those behind a space joined to longer texts, whose ids fall apart at the tokens that
        begin with a space; first parts, and parts that hold or begin with white space of their own, one by one."""
        joined, alone = [], []
        for k in keys:
            (joined if k and k[0] != HEAD and not k[0].isspace() and " " not in k else alone).append(k)
        ids, _ = self._whole([" " + " ".join(joined[i : i + JOINED]) for i in range(0, len(joined), JOINED)])
        starts = np.flatnonzero(self.opens[ids])
        if len(starts) == len(joined) and (not len(ids) or starts[0] == 0):
            self.store.add(pa.array(joined, pa.string()), ids, np.diff(np.append(starts, len(ids))))
        else:
            alone = keys
        if alone:
            self.store.add(pa.array(alone, pa.string()), *self._whole([k[1:] if k[:1] == HEAD else " " + k for k in alone]))

    def _places(self, keys: pa.Array) -> np.ndarray:
        """Places of keys that differ from one another; unknown ones are learnt."""
        places = self.store.find(keys)
        if (new := places < 0).any():
            missing = keys.filter(pa.array(new))
            self._learn(missing.to_pylist())
            places[new] = self.store.find(missing)
        return places

    def _gather(self, coded: pa.DictionaryArray, at: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """ids of texts from their parts' places in the dictionary. A text's first part stands for itself, the others are
        behind a space."""
        if len(self.store.keys) > self.most:
            self.store = _Store()
        first = np.zeros(len(at), bool)
        first[offsets[:-1]] = True
        behind, ahead = np.zeros(len(coded.dictionary), bool), np.zeros(len(coded.dictionary), bool)
        behind[at[~first]] = True
        ahead[at[first]] = True
        heads = pc.binary_join_element_wise(HEAD, coded.dictionary.filter(pa.array(ahead)), "")
        places = self._places(pa.concat_arrays([coded.dictionary.filter(pa.array(behind)), heads]))
        of_part, of_head = np.zeros(len(behind), np.int64), np.zeros(len(behind), np.int64)
        of_part[behind], of_head[ahead] = places[: int(behind.sum())], places[int(behind.sum()) :]
        place = of_part[at]
        place[first] = of_head[at[first]]
        ids, lengths = self.store.take(place)
        return ids, np.add.reduceat(lengths, offsets[:-1])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after another, number of ids of each) of an array of strings without nulls."""
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        if not self.fast:
            return self._whole(texts.to_pylist())
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy().astype(np.int64) - parts.offsets[0].as_py()
        coded = pc.dictionary_encode(parts.flatten())
        at = coded.indices.to_numpy().astype(np.int64)
        whole = pc.match_substring_regex(coded.dictionary, BEYOND).to_numpy(zero_copy_only=False)[at]
        uneven = pc.match_substring_regex(coded.dictionary, LEADING).to_numpy(zero_copy_only=False)[at]
        uneven[offsets[:-1]] = False
        whole, uneven = np.logical_or.reduceat(whole, offsets[:-1]), np.logical_or.reduceat(uneven, offsets[:-1])
        for s in self.special:
            whole |= pc.match_substring(texts, s).to_numpy(zero_copy_only=False)
        uneven &= ~whole
        if not whole.any() and not uneven.any():
            return self._gather(coded, at, offsets)
        groups = []
        for of, how in ((whole, self._whole), (uneven, self._cut_unevenly), (~whole & ~uneven, lambda t: self.encode(pa.array(t, pa.string())))):
            if of.any():
                groups.append((of, *how(texts.filter(pa.array(of)).to_pylist())))
        lengths = np.zeros(len(texts), np.int64)
        for of, _, n in groups:
            lengths[of] = n
        out = np.zeros(int(lengths.sum()), np.uint32)
        for of, ids, _ in groups:
            out[np.repeat(of, lengths)] = ids
        return out, lengths

    def _cut_unevenly(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Texts where white space follows spaces: cut only at the spaces that none follows."""
        parts = pa.array([self.cut(t) for t in texts], pa.list_(pa.string()))
        coded = pc.dictionary_encode(parts.flatten())
        return self._gather(coded, coded.indices.to_numpy().astype(np.int64), parts.offsets.to_numpy().astype(np.int64))

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        ids, lengths = self.encode(pa.array(texts, pa.string()))
        return np.split(ids, np.cumsum(lengths)[:-1]) if len(texts) else []


_ENCODERS: dict[str, TextEncoder] = {}


def encoder(path: str) -> TextEncoder:
    keep_only(_ENCODERS)
    if path not in _ENCODERS:
        _ENCODERS[path] = TextEncoder(path)
    return _ENCODERS[path]


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together to about GROUP_BYTES each."""
    held: list[pa.RecordBatch] = []
    size = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            size += b.nbytes
        if size >= GROUP_BYTES:
            yield pa.concat_batches(held) if len(held) > 1 else held[0]
            held, size = [], 0
    if held:
        yield pa.concat_batches(held) if len(held) > 1 else held[0]


def ended(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The same with an end id after each text's."""
    return np.insert(ids, np.cumsum(lengths), np.uint32(end_id)), lengths + 1
