"""Conversation repair: the cheapest edits that make a conversation's roles follow the grammar `(s?(ua)+)?`.

A backward pass gives the cost to go from every turn and grammar state; a forward walk takes, among the transitions that are
tight against those costs, the edit of the ASCII-least letter. Segments of a conversation compose: a segment is a matrix of
least costs from state to state, products of matrices (sums and minima) give the costs to go at its end, and its walks from
every state give the state it is left in. So conversations are cut where the range bounds of their rows cut them, and no
task holds more than a partition's rows, however long a conversation is.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from itertools import groupby

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, materialize, partitions, small_batches

#: White space of the contract, ends of sentences, costs of the edits.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
STOPS = ".!?"
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 1, 2, 5, 5
SOUND, MUST_GO, TRUNCATED = 0, 1, 2
#: Grammar states: nothing yet, after system, after user, after assistant. WANTED: the initials that may come, and the state
#: they lead to. NEXT: the state after the one role, user or assistant, that may be put in.
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
WANTED = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
ROLE = {USER: "user", ASSISTANT: "assistant"}
FAR = 1 << 60
#: Costs to go after the last row, by state: what is left to insert.
AT_END = (0, 2 * INSERT, INSERT, 0)
LEGAL = ("su", "ua", "au")
Turn = tuple[str, int, str, str]  # initial of the role, fault, role, text

REPORT = "key string, conv_id long, edge boolean, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def before(initial: str, fault: int, after: Sequence[int]) -> tuple[int, int, int, int]:
    """Costs to go before a row, by state, from those after it; inserts before the row are in them."""
    v = [min(FAR, DELETE + x) for x in after]
    if fault != MUST_GO:
        more = CUT_OFF if fault == TRUNCATED else 0
        for s in STATES:
            v[s] = min(v[s], REROLE + more + after[NEXT[s]])
            if (t := WANTED[s].get(initial)) is not None:
                v[s] = min(v[s], KEEP + more + after[t])
    u, a = min(v[USER], INSERT + v[ASSISTANT]), min(v[ASSISTANT], INSERT + v[USER])
    return min(v[START], INSERT + u), min(v[SYSTEM], INSERT + u), u, a


def matrix(turns: Sequence[Turn]) -> list[list[int]]:
    """[state before the turns][state after them]: least costs."""
    columns = []
    for t in STATES:
        v: Sequence[int] = [0 if s == t else FAR for s in STATES]
        for initial, fault, *_ in reversed(turns):
            v = before(initial, fault, v)
        columns.append(v)
    return [[columns[t][s] for t in STATES] for s in STATES]


def through(m: Sequence[Sequence[int]], after: Sequence[int]) -> list[int]:
    return [min(min(FAR, x + y) for x, y in zip(row, after, strict=True)) for row in m]


def walk(turns: Sequence[Turn], state: int, end: Sequence[int] = AT_END, last: bool = True) -> tuple[str, list[str], int]:
    """(letters of the edits, repaired turns as `role:text`, state after them) from a state, towards costs to go at the end;
    last: nothing comes after the turns, so what is missing there is inserted."""
    costs = [tuple(end)]
    for initial, fault, *_ in reversed(turns):
        costs.append(before(initial, fault, costs[-1]))
    letters, out = [], []
    for k, (initial, fault, role, text) in enumerate(turns):
        v, w = costs[len(turns) - k], costs[len(turns) - k - 1]
        more = CUT_OFF if fault == TRUNCATED else 0
        while v[state] != DELETE + w[state] and v[state] == INSERT + v[NEXT[state]]:
            state = NEXT[state]
            letters.append("I")
            out.append(f"{ROLE[state]}:")
        if v[state] == DELETE + w[state]:
            letters.append("D")
            continue
        t = WANTED[state].get(initial)
        if t is not None and v[state] == KEEP + more + w[t]:
            letters.append("K")
            out.append(f"{role}:{text}")
            state = t
        else:
            state = NEXT[state]
            letters.append("R")
            out.append(f"{ROLE[state]}:{text}")
    while last and end[state]:
        state = NEXT[state]
        letters.append("I")
        out.append(f"{ROLE[state]}:")
    return "".join(letters), out, state


def illegal(initials: Sequence[str]) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials, initials[1:], strict=False))


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by crc32 of `conv_id:turn` modulo 20: 0 drops a row, 1 empties its
    text, 2 removes its sentence ends, 3 repeats it under the same turn, 4 makes its role user. Nulls count as one space, in
    the key and as role and text; the ids themselves stay null."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(known("conv_id"), F.lit(":"), known("turn")).cast("binary")) % 20
    d = conversations.select("conv_id", "turn", code.alias("_code"), known("role").alias("role"), known("text").alias("text")).filter("_code <> 0")
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    copies = F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return d.select("conv_id", "turn", F.when(F.col("_code") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_copy")).drop("_copy")


def _key(name: str = "conv_id") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def _in_order(rows: DataFrame) -> DataFrame:
    """Rows range-partitioned and sorted by conversation, turn (nulls first), role and the text's SHA-256, with `rest` (the
    last character of the text that isn't white space, empty for none). Equal rows are told apart by where they were read, so
    that bounds fall between them too."""
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    d = rows.select(_key().alias("key"), F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    d = d.withColumns({"sha": F.sha2("text", 256), "rest": F.right(F.rtrim("text", F.lit(SPACES)), F.lit(1)), "tie": F.monotonically_increasing_id()})
    by = ["key", "turn", "role", "sha", "tie"]
    return d.repartitionByRange(partitions(rows.sparkSession), *by).sortWithinPartitions(*by)


def _turns(roles, texts, rests, again) -> tuple[list[Turn], list[int]]:
    """Turns with their faults, and the counts of blank, duplicate and truncated ones: a row's first fault counts."""
    turns, counts = [], [0, 0, 0]
    for role, text, rest, repeated in zip(roles, texts, rests, again, strict=True):
        fault = SOUND
        if not rest:
            fault, counts[0] = MUST_GO, counts[0] + 1
        elif repeated:
            fault, counts[1] = MUST_GO, counts[1] + 1
        elif rest not in STOPS:
            fault, counts[2] = TRUNCATED, counts[2] + 1
        turns.append((role[:1], fault, role, text))
    return turns, counts


def _seen_before(roles, texts) -> Iterator[bool]:
    seen: set[tuple[str, str]] = set()
    for pair in zip(roles, texts, strict=True):
        yield pair in seen
        seen.add(pair)


def _reports(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A report for each conversation of a partition as if it were whole; edge: it is the first or the last one there, so that
    it may not be."""

    def conversations():
        held: list = []
        for b in batches:
            cols = [b.column(c).to_pylist() for c in ("key", "conv_id", "turn", "role", "text", "rest")]
            for _, rows in groupby(zip(*cols, strict=True), key=lambda r: r[0]):
                rows = list(rows)
                if held and held[0][0] != rows[0][0]:
                    yield held
                    held = []
                held += rows
        if held:
            yield held

    names = [x.split()[0] for x in REPORT.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "boolean": pa.bool_()}[x.split()[1]] for x in REPORT.split(", ")]
    schema = pa.schema(list(zip(names, types, strict=True)))
    out: list[tuple] = []
    first, waiting = True, None
    for rows in conversations():
        key, conv_id, turn, role, text, rest = zip(*rows, strict=True)
        turns, counts = _turns(role, text, rest, _seen_before(role, text))
        known = {t for t in turn if t is not None}
        letters, repaired, _ = walk(turns, START)
        v: Sequence[int] = AT_END
        for initial, fault, *_ in reversed(turns):
            v = before(initial, fault, v)
        sha = hashlib.sha256("\n".join(repaired).encode()).hexdigest()
        gaps = max(known) - min(known) + 1 - len(known) if known else 0
        if waiting:
            out.append(waiting)
        waiting = (key[0], conv_id[0], first, gaps, *counts, illegal([t[0] for t in turns]), v[START], letters, sha)
        first = False
        if len(out) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)
            out = []
    if waiting:
        out.append((*waiting[:2], True, *waiting[3:]))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], schema=schema)


def _of_segments(rows: DataFrame) -> DataFrame:
    """Reports of conversations whose rows lie in several partitions: first rows of equal ones by an aggregation, segments as
    matrices, costs to go and states at their bounds by composition, then the walks, and the hash over the segments in order."""
    d = _in_order(rows).withColumns({"part": F.spark_partition_id(), "pos": F.monotonically_increasing_id()})
    d = materialize(d, "cut-conversations")
    firsts = d.groupBy("key", "role", "sha").agg(F.min("pos").alias("_first"), F.count("*").alias("_n")).filter("_n > 1").drop("_n")
    d = materialize(d.join(firsts, ["key", "role", "sha"], "left").withColumn("again", F.coalesce(F.col("pos") > F.col("_first"), F.lit(False))).drop("_first", "sha", "tie"), "cut-conversations")

    def turns_of(g: pd.DataFrame, texts: bool) -> list[Turn]:
        g = g.sort_values("pos")
        return _turns(g["role"], g["text"] if texts else g["role"], g["rest"], g["again"])[0]

    def measure(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        turns = turns_of(g, False)
        return pd.DataFrame({"key": [k[0]], "part": [k[1]], "m": [[x for row in matrix(turns) for x in row]], "inner": [illegal([t[0] for t in turns])], "head": [turns[0][0]], "tail": [turns[-1][0]]})

    def backward(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("part", ascending=False)
        v, ends, bounds = list(AT_END), [], 0
        for m in g["m"]:
            ends.append(v)
            v = through([m[4 * s : 4 * s + 4] for s in STATES], v)
        tails, heads = g["tail"].tolist()[1:], g["head"].tolist()[:-1]
        bounds = sum(a + b not in LEGAL for a, b in zip(tails, heads, strict=True))
        return pd.DataFrame({"key": k[0], "part": g["part"], "ends": ends, "last": [i == 0 for i in range(len(g))], "cost": v[START], "illegal": int(g["inner"].sum()) + bounds})

    def exits(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        turns, end = turns_of(g, False), g["ends"].iloc[0]
        return pd.DataFrame({"key": [k[0]], "part": [k[1]], "exit": [[walk(turns, s, end, False)[2] for s in STATES]]})

    def forward(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        g, state, enter = g.sort_values("part"), START, []
        for x in g["exit"]:
            enter.append(state)
            state = x[state]
        return pd.DataFrame({"key": k[0], "part": g["part"], "enter": enter})

    def edit(k: tuple, g: pd.DataFrame) -> pd.DataFrame:
        letters, repaired, _ = walk(turns_of(g, True), int(g["enter"].iloc[0]), g["ends"].iloc[0], bool(g["last"].iloc[0]))
        return pd.DataFrame({"key": [k[0]], "part": [k[1]], "letters": [letters], "repaired": ["\n".join(repaired) if repaired else None]})

    slim = d.select("key", "part", "pos", "role", "rest", "again")
    backs = slim.groupBy("key", "part").applyInPandas(measure, "key string, part int, m array<long>, inner long, head string, tail string").groupBy("key").applyInPandas(backward, "key string, part int, ends array<long>, last boolean, cost long, illegal long")
    backs = materialize(backs, "segments")
    gone = slim.join(backs.select("key", "part", "ends"), ["key", "part"]).groupBy("key", "part").applyInPandas(exits, "key string, part int, exit array<int>")
    enters = gone.groupBy("key").applyInPandas(forward, "key string, part int, enter int").join(backs.select("key", "part", "ends", "last"), ["key", "part"])
    edits = d.join(materialize(enters, "segments"), ["key", "part"]).groupBy("key", "part").applyInPandas(edit, "key string, part int, letters string, repaired string")
    edits = materialize(edits, "segments")

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """Segments come in order, one conversation after another."""
        key, state = None, None
        for b in batches:
            for k, letters, repaired in zip(b["key"], b["letters"], b["repaired"], strict=True):
                if k != key:
                    if state:
                        yield pd.DataFrame({"key": [key], "audit": ["".join(state[1])], "repaired_sha256": [state[0].hexdigest()]})
                    key, state = k, [hashlib.sha256(), [], False]
                state[1].append(letters)
                if repaired is not None:
                    state[0].update(("\n" * state[2] + repaired).encode())
                    state[2] = True
        if state:
            yield pd.DataFrame({"key": [key], "audit": ["".join(state[1])], "repaired_sha256": [state[0].hexdigest()]})

    hashes = edits.repartition("key").sortWithinPartitions("key", "part").mapInPandas(lean(hashed), "key string, audit string, repaired_sha256 string")
    blank, again = F.col("rest") == "", F.col("again")
    stops = F.col("rest").isin(*STOPS)
    n = lambda c: F.count(F.when(c, 1))
    gaps = F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count_distinct("turn"), F.lit(0))
    counts = d.groupBy("key").agg(F.max("conv_id").alias("conv_id"), gaps.alias("gaps"), n(blank).alias("blank"), n(~blank & again).alias("duplicate"), n(~blank & ~again & ~stops).alias("truncated"))
    return counts.join(backs.filter("last").select("key", "illegal", "cost"), "key").join(hashes, "key")


def repaired(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """A report for every conv_id of ids: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256, from rows
    (conv_id, turn, role, text).

    Rows of a conversation come by turn, nulls first; rows of one turn by role and by the SHA-256 of their text; equal rows
    one after another. A null role or text is one space. Rows of a null conv_id are one conversation of their own. A
    conversation without rows has zeros, an empty audit and the hash of nothing. Other columns are not read, whatever their
    names; texts of any length are whole; empty tables give no rows or such zeros.

    Conversations that lie within a partition are done in one pass over it. At most one conversation is cut by each bound
    between partitions, so the keys of those that are cut are fewer than partitions: they are broadcast.
    """
    spark = rows.sparkSession
    small_batches(spark)
    found = materialize(_in_order(rows).mapInArrow(lean(_reports), REPORT), "conversations")
    cut = F.broadcast(found.filter("edge").groupBy("key").agg(F.count("*").alias("_n")).filter("_n > 1").select("key"))
    whole = found.join(cut, "key", "left_anti").drop("edge")
    if not cut.isEmpty():
        own = rows.withColumn("_key", _key())
        whole = whole.unionByName(_of_segments(own.join(cut.withColumnRenamed("key", "_key"), "_key", "left_semi").select("conv_id", "turn", "role", "text")))
    every = ids.select(_key().alias("key"), F.col("conv_id").cast("long").alias("_id")).groupBy("key").agg(F.max("_id").alias("_id"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    return every.join(whole.drop("conv_id"), "key", "left").select(F.col("_id").alias("conv_id"), *(zero(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")), F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation of the table, with faults planted in it, repaired."""
    given = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    return repaired(damaged(given), given)


_LINE = "chr(10) || r.role || ':' || r.text"
_MORE = "CASE WHEN r.fault = 't' THEN 5 ELSE 0 END"
_KEEP = "list_transform(list_filter([{'n': 1, 'i': 's', 't': 2}, {'n': 1, 'i': 'u', 't': 3}, {'n': 2, 'i': 'u', 't': 3}, {'n': 3, 'i': 'a', 't': 4}, {'n': 4, 'i': 'u', 't': 3}], lambda e: e.n = n AND e.i = r.i AND r.fault NOT IN ('b', 'd')), lambda e: {'c': " + _MORE + " + v[e.t].c, 'a': 'K' || v[e.t].a, 't': " + _LINE + " || v[e.t].t})"
_REROLE = "list_transform(list_filter([CASE n WHEN 3 THEN 4 ELSE 3 END], lambda t: r.fault NOT IN ('b', 'd')), lambda t: {'c': 1 + " + _MORE + " + v[t].c, 'a': 'R' || v[t].a, 't': chr(10) || CASE t WHEN 3 THEN 'user' ELSE 'assistant' END || ':' || r.text || v[t].t})"
_STEP = "list_transform([1, 2, 3, 4], lambda n: list_sort(list_concat([{'c': 2 + v[n].c, 'a': 'D' || v[n].a, 't': v[n].t}], list_concat(" + _KEEP + ", " + _REROLE + ")))[1])"
_PUT = "lambda w: {{'c': 5 + w[{0}].c, 'a': 'I' || w[{0}].a, 't': chr(10) || '{1}:' || w[{0}].t}}"
_USER, _ASSISTANT = (f"list_transform([w], {_PUT.format(*x)})[1]" for x in ((3, "user"), (4, "assistant")))
_CLOSE = f"list_transform(list_transform([{_STEP}], lambda w: [w[1], w[2], list_sort([w[3], {_ASSISTANT}])[1], list_sort([w[4], {_USER}])[1]]), lambda w: [list_sort([w[1], {_USER}])[1], list_sort([w[2], {_USER}])[1], w[3], w[4]])[1]"
#: The cost, the audit and the lines to go as one triple by state and row, backwards: least triples instead of a forward walk.
OP13_SQL = f"""WITH k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS id FROM conversations),
d AS (SELECT *, xor(list_reduce(list_transform(string_split(id, ''), lambda x: ascii(x)::BIGINT), lambda z, x: list_reduce(range(8), lambda y, j: CASE WHEN y % 2 = 1 THEN xor(y // 2, 3988292384) ELSE y // 2 END, xor(z, x)), 4294967295), 4294967295) % 20 AS code FROM k),
x AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM d WHERE code <> 0),
o AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text), copy) AS k FROM x),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again, right(rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS rest, left(role, 1) AS i, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS p FROM o),
g AS (SELECT *, CASE WHEN rest = '' THEN 'b' WHEN again THEN 'd' WHEN rest NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
c AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated,
  count(*) FILTER (p || i NOT IN ('su', 'ua', 'au')) AS illegal, list({{'i': i, 'fault': fault, 'role': role, 'text': text}} ORDER BY k DESC) AS turns FROM g GROUP BY conv_id),
v AS (SELECT *, list_reduce(turns, lambda v, r: {_CLOSE}, [{{'c': 0::BIGINT, 'a': '', 't': ''}}, {{'c': 10::BIGINT, 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}}, {{'c': 5::BIGINT, 'a': 'I', 't': chr(10) || 'assistant:'}}, {{'c': 0::BIGINT, 'a': '', 't': ''}}])[1] AS best FROM c)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(substring(coalesce(best.t, ''), 2)) AS repaired_sha256 FROM (SELECT DISTINCT conv_id FROM conversations) e LEFT JOIN v ON e.conv_id IS NOT DISTINCT FROM v.conv_id"""
