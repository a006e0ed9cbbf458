"""Packing against best-fit over single pieces, against the library, and its edges."""

import random
import zlib
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pytest

from tessera.llm import encode, packing


def best_fit(lengths, capacity):
    """Best-fit in descending order, a piece at a time: the number of sequences."""
    rooms, n = [], 0
    for x in sorted(lengths, reverse=True):
        at = bisect_left(rooms, x)
        room = rooms.pop(at) if at < len(rooms) else capacity
        n += room == capacity and at >= len(rooms)
        insort(rooms, room - x) if room > x else None
    return n


def filled(rows):
    out = {}
    for length, lo, hi, per, first, offset in rows:
        for k in range(hi - lo):
            out.setdefault(first + k // per, []).append((offset + k % per * length, length))
    return out


@pytest.mark.parametrize("seed", range(30))
def test_plan_equals_best_fit_by_piece(seed):
    r = random.Random(seed)
    capacity = r.choice([10, 64, 2048])
    top = r.choice([3, capacity // 2, capacity])
    lengths = [min(capacity, max(1, int(r.expovariate(1 / max(1, top / 3))))) for _ in range(r.randint(1, 600))]
    if seed % 3 == 0:
        lengths += [r.randint(1, capacity)] * 500  # a length that most pieces have
    rows, n = packing.plan(Counter(lengths), capacity)
    seqs = filled(rows)
    assert n == len(seqs) == best_fit(lengths, capacity)
    assert Counter(x for s in seqs.values() for _, x in s) == Counter(lengths)
    for s in seqs.values():
        at = 0
        for offset, x in sorted(s):
            assert offset == at
            at += x
        assert at <= capacity


def test_plan_is_bounded_by_lengths():
    few, many = ({x: k for x in range(1, 2049)} for k in (3, 3_000_000))
    assert len(packing.plan(many)[0]) < 10 * 2048 and len(packing.plan(few)[0]) < 10 * 2048
    with pytest.raises(ValueError):
        packing.plan({0: 1})


def test_packs_whole_documents(spark):
    from tokenizers import Tokenizer

    r = random.Random(12)
    texts = [None, "", " ", "<|endoftext|>x", "long words and more " * 3000, *(" ".join(r.choice(["ab", "über", "x1", "\n"]) for _ in range(r.randint(0, 90))) for _ in range(300))]
    rows = [(i, t, 1, 2) for i, t in enumerate(texts)] + [(None, "no id", 1, 2), (5, texts[5], 1, 2)]
    d = spark.createDataFrame(rows, "doc_id long, text string, length long, sequence_id long").repartition(3)
    got = packing.pack(d, capacity=100)
    out = got.collect()
    tok = Tokenizer.from_file(encode.default_tokenizer())
    want = Counter()
    for i, t, *_ in rows:
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        n = -(-len(ids) // 100)
        cuts = [0, *range(len(ids) - 100 * (n - 1), len(ids) + 1, 100)]
        want.update((i, k, a, b - a, np.array(ids[a:b], "<u4").tobytes()) for k, (a, b) in enumerate(zip(cuts, cuts[1:])))
    assert Counter((x.doc_id, x.piece, x.start, x.length, bytes(x.ids)) for x in out) == want
    by_seq = {}
    for x in out:
        by_seq.setdefault(x.sequence_id, []).append(x)
    for s in by_seq.values():
        at = 0
        for x in sorted(s, key=lambda x: x.offset):
            assert x.offset == at
            at += x.length
        assert at <= 100
    assert len(by_seq) == best_fit([x.length for x in out], 100)
    for x in packing.sequences(got).collect():
        assert bytes(x.ids) == b"".join(bytes(y.ids) for y in sorted(by_seq[x.sequence_id], key=lambda y: y.offset)) and x.n_tokens * 4 == len(x.ids)


def test_query_and_empty(spark, tmp_path):
    d = spark.createDataFrame([(i, "a b c " * i) for i in range(20)], "doc_id long, text string")
    d.write.parquet(f"{tmp_path}/documents.parquet")
    got = packing.op12_packing(spark, str(tmp_path)).collect()
    by_doc = {x.doc_id: x for x in packing.pack(d).collect()}
    assert len(got) == 20 and all(x.ids_crc32 == zlib.crc32(by_doc[x.doc_id].ids) for x in got)
    assert packing.pack(d.limit(0)).collect() == []
