"""Conversation repair against an exhaustive search, whole and cut into segments, and its edges."""

import hashlib
import heapq
import itertools
import random
import re
import zlib

import pytest

from tessera.llm import repair

ROWS = "conv_id long, turn long, role string, text string, key string, cost long"
ACCEPT = re.compile("(s?(ua)+)?")


def search(turns):
    """(cost, audit, lines) of the cheapest edits, the ASCII-least of those: a best-first search over edits, a letter at a
    time, that knows the grammar only as a pattern of initials."""
    might = re.compile("(s?(ua)*u?)?")
    heap, seen = [(0, "", 0, "", ())], set()
    while heap:
        cost, audit, k, roles, lines = heapq.heappop(heap)
        if k == len(turns) and ACCEPT.fullmatch(roles):
            return cost, audit, lines
        mark = (k, roles[-1:])
        if mark in seen:
            continue
        seen.add(mark)
        options = [(5, "I", k, r, f"{r}:") for r in ("user", "assistant")]
        if k < len(turns):
            initial, fault, role, text = turns[k]
            more = 5 if fault == repair.TRUNCATED else 0
            options.append((2, "D", k + 1, "", None))
            if fault != repair.MUST_GO:
                options += [(more, "K", k + 1, role or "?", f"{role}:{text}"), *((1 + more, "R", k + 1, r, f"{r}:{text}") for r in ("user", "assistant"))]
        for c, letter, j, role, line in options:
            now = roles + role[:1]
            if might.fullmatch(now):
                heapq.heappush(heap, (cost + c, audit + letter, j, now, lines if line is None else (*lines, line)))


def some_turns(r, n):
    return [(role[:1], r.choice([0, 0, 0, 1, 2]), role, f"t{k}") for k, role in enumerate(r.choices(["user", "assistant", "system", "tool", "user", "assistant"], k=n))]


@pytest.mark.parametrize("seed", range(60))
def test_edits_equal_exhaustive_search(seed):
    r = random.Random(seed)
    turns = some_turns(r, r.randint(0, 7))
    letters, lines, _ = repair.walk(turns, repair.START)
    cost, audit, want = search(turns)
    assert (letters, tuple(lines)) == (audit, want)
    v = repair.AT_END
    for initial, fault, *_ in reversed(turns):
        v = repair.before(initial, fault, v)
    assert v[repair.START] == cost == repair.through(repair.matrix(turns), repair.AT_END)[repair.START]


@pytest.mark.parametrize("seed", range(20))
def test_segments_compose(seed):
    r = random.Random(seed)
    turns = some_turns(r, 40)
    cuts = sorted({0, 40, *r.sample(range(40), 6)})
    parts = [turns[a:b] for a, b in itertools.pairwise(cuts)]
    ends = [repair.AT_END]
    for p in reversed(parts):
        ends.insert(0, repair.through(repair.matrix(p), ends[0]))
    state, letters, lines = repair.START, "", []
    for k, p in enumerate(parts):
        a, b, state = repair.walk(p, state, ends[k + 1], k == len(parts) - 1)
        letters, lines = letters + a, lines + b
    assert (letters, lines) == repair.walk(turns, repair.START)[:2]


def report(rows):
    """conv_id -> report, by the contract's words."""
    out = {}
    for conv in {r[0] for r in rows}:
        mine = sorted(((t is not None, t or 0, role or " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv), key=lambda x: (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()))
        turns, seen, n = [], set(), [0, 0, 0]
        for _, _, role, text in mine:
            rest = text.rstrip(" \t\n\x0b\x0c\r")
            k = 0 if not rest else 1 if (role, text) in seen else 2 if rest[-1] not in ".!?" else 3
            seen.add((role, text))
            if k < 3:
                n[k] += 1
            turns.append((role[:1], {3: 0, 2: 2}.get(k, 1), role, text))
        known = {t for some, t, *_ in mine if some}
        cost, audit, lines = search(turns)
        out[conv] = (max(known) - min(known) + 1 - len(known) if known else 0, *n, sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in itertools.pairwise(turns)), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def some_rows(seed, conversations, most):
    r = random.Random(seed)
    said = ["Yes.", "No!", "", " \n", "cut off", "Why?", None, "é.", "x" * 5000 + "."]
    return [(c if c else None, r.choice([t, t, t + 1, None]), r.choice(["user", "assistant", "system", None, ""]), r.choice(said)) for c in range(conversations) for t in range(r.randint(1, most))]


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.mark.parametrize("conversations,most,parts", [(40, 6, "4"), (3, 60, "16"), (1, 150, "8")])
def test_reports(spark, conversations, most, parts):
    """Few long conversations over many partitions are cut by the bounds; nulls, ties, repeats and clashing names."""
    rows = some_rows(conversations, conversations, most)
    rows += rows[:2]
    d = spark.createDataFrame([(*x, "k", 7) for x in rows], ROWS)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = repair.repaired(d, d).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert {x.conv_id: tuple(x[f] for f in FIELDS) for x in got} == report(rows) and len(got) == len({x[0] for x in rows})


def test_query_and_empty(spark, tmp_path):
    r = random.Random(3)
    rows = [(c, t, "assistant" if t % 2 else "user", f"Text {r.random()}. More!") for c in range(120) for t in range(1 if c > 60 else r.randint(1, 5))] + [(None, None, None, None), (7, None, "user", "Null turn.")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    kept = []
    for c, t, role, text in rows:
        code = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        kept += [(c, t, "user" if code == 4 else role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    want = report(kept)
    nothing = (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    got = {x.conv_id: tuple(x[f] for f in FIELDS) for x in repair.op13_repair(spark, str(tmp_path)).collect()}
    assert got == {c: want.get(c, nothing) for c in {x[0] for x in rows}} and nothing in got.values()
    none = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert repair.repaired(none, none).collect() == []
