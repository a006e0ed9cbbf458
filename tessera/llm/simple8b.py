"""Simple-8b word-aligned integer coding, vectorised over blocks.

A 64-bit word holds a 4-bit selector (top) and 60 payload bits. Selectors 0-13 pack COUNTS[s] ids of WIDTHS[s] bits,
first id lowest. Selector 14 is an escape: one id of 61 bits or more, its low 60 bits here and the rest in the
following word of selector 15. Ids are cut into blocks of BLOCK; each block starts a new word and its first word's
index is stored, so blocks decode independently and all at once. A segment is

    magic S8B1 | n_docs n_ids n_words (u64) | doc_id[n_docs] i64 | doc length[n_docs] u64 | block offset[n_blocks] u64 | words u64
"""

from __future__ import annotations

import struct

import numpy as np

BLOCK = 1024
COUNTS = np.array([60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 1, 0], dtype=np.int64)
WIDTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 60, 60], dtype=np.int64)
MAGIC = b"S8B1"
LOW60 = np.uint64((1 << 60) - 1)
_WIDTH = np.maximum(1, np.frexp(np.arange(1 << 18))[1]).astype(np.uint8)


def bit_width(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, 1 at least."""
    top = int(ids.max()) if len(ids) else 0
    if top < len(_WIDTH):
        return _WIDTH[ids]
    w = np.ones(len(ids), dtype=np.uint8)
    for b in range(1, top.bit_length()):
        w += ids >= np.uint64(1 << b)
    return w


def encode_words(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, first word of each block) of an array of unsigned ids."""
    ids = np.ascontiguousarray(ids, dtype=np.uint64)
    n = len(ids)
    blocks = -(-n // BLOCK)
    if not blocks:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    w = np.zeros((blocks, BLOCK + 60), dtype=np.uint8)  # beyond a block's end anything fits
    padded = np.zeros(blocks * BLOCK, dtype=np.uint64)
    padded[:n] = ids
    flat = np.zeros(blocks * BLOCK, dtype=np.uint8)
    flat[:n] = bit_width(ids)
    w[:, :BLOCK] = flat.reshape(blocks, BLOCK)
    sel = np.full((blocks, BLOCK), 13, dtype=np.uint8)
    sel[w[:, :BLOCK] > 60] = 14
    for s in range(12, -1, -1):
        c = int(COUNTS[s])
        ok = w <= WIDTHS[s]
        run = 1
        while run < c:
            step = min(run, c - run)
            ok = ok[:, : ok.shape[1] - step] & ok[:, step:]
            run += step
        hit = ok[:, :BLOCK]
        if not hit.any():
            break  # fewer bits and more ids can't fit either
        sel[hit] = s
    length = np.full(blocks, BLOCK, dtype=np.int64)
    length[-1] = n - (blocks - 1) * BLOCK
    lane, pos = np.arange(blocks), np.zeros(blocks, dtype=np.int64)
    lanes, poss, sels, nth = [], [], [], []
    used = np.zeros(blocks, dtype=np.int64)
    while len(lane):
        s = sel[lane, pos]
        lanes.append(lane), poss.append(pos), sels.append(s), nth.append(used[lane])
        used[lane] += 1 + (s == 14)
        pos = pos + COUNTS[s]
        live = pos < length[lane]
        lane, pos = lane[live], pos[live]
    offsets = np.zeros(blocks, dtype=np.int64)
    np.cumsum(used[:-1], out=offsets[1:])
    lane, pos, s = np.concatenate(lanes), np.concatenate(poss), np.concatenate(sels)
    at = offsets[lane] + np.concatenate(nth)
    words = np.zeros(int(used.sum()), dtype=np.uint64)
    wide = np.zeros((blocks, BLOCK + 60), dtype=np.uint64)
    wide[:, :BLOCK] = padded.reshape(blocks, BLOCK)
    first, wide = lane * (BLOCK + 60) + pos, wide.ravel()
    for k in np.unique(s):
        m = s == k
        c, width = int(COUNTS[k]), int(WIDTHS[k])
        word = np.full(int(m.sum()), int(k) << 60, dtype=np.uint64)
        if k == 14:
            v = wide[first[m]]
            words[at[m]] = word | (v & LOW60)
            words[at[m] + 1] = np.uint64(15 << 60) | (v >> np.uint64(60))
            continue
        p = first[m]
        for j in range(c):
            word |= wide[p + j] << np.uint64(width * j)
        words[at[m]] = word
    return words, offsets.astype(np.uint64)


def decode_words(words: np.ndarray, offsets: np.ndarray, n: int) -> np.ndarray:
    """The n ids again; every selector's words are unpacked at once."""
    out = np.zeros(n, dtype=np.uint64)
    if not n:
        return out
    blocks = len(offsets)
    s = (words >> np.uint64(60)).astype(np.int64)
    count = COUNTS[s]
    length = np.full(blocks, BLOCK, dtype=np.int64)
    length[-1] = n - (blocks - 1) * BLOCK
    off = offsets.astype(np.int64)
    total = np.add.reduceat(count, off)
    ends = np.append(off[1:], len(words)) - 1
    ends -= s[ends] == 15
    count[ends] -= total - length  # the last word of a block may be partly empty
    start = np.concatenate(([0], np.cumsum(count)[:-1]))
    for k in np.unique(s):
        if k == 15:
            continue
        m = np.flatnonzero(s == k)
        width = int(WIDTHS[k])
        mask = np.uint64((1 << width) - 1)
        v, st, ct = words[m], start[m], count[m]
        if k == 14:
            out[st] = (v & LOW60) | ((words[m + 1] & np.uint64(15)) << np.uint64(60))
            continue
        for j in range(int(COUNTS[k])):
            x = ct > j
            out[st[x] + j] = (v[x] >> np.uint64(width * j)) & mask
    return out


def pack_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray) -> bytes:
    words, offsets = encode_words(ids)
    return b"".join((MAGIC, struct.pack("<3Q", len(doc_ids), len(ids), len(words)), np.asarray(doc_ids, "<i8").tobytes(), np.asarray(lengths, "<u8").tobytes(), offsets.astype("<u8").tobytes(), words.astype("<u8").tobytes()))


def read_segments(f):
    """(doc_ids, lengths, ids) of each segment of an open file."""
    while head := f.read(28):
        if len(head) < 28 or head[:4] != MAGIC:
            raise ValueError("not a Simple-8b segment")
        n_docs, n_ids, n_words = struct.unpack("<3Q", head[4:])
        doc_ids = np.frombuffer(f.read(8 * n_docs), "<i8")
        lengths = np.frombuffer(f.read(8 * n_docs), "<u8").astype(np.int64)
        offsets = np.frombuffer(f.read(8 * -(-n_ids // BLOCK)), "<u8")
        words = np.frombuffer(f.read(8 * n_words), "<u8")
        yield doc_ids, lengths, decode_words(words, offsets, n_ids)
