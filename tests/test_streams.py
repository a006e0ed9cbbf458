"""Batches accumulated over micro-batches, against a plain computation."""

import random

import duckdb
import pytest

from tessera.plans import catalog, frames
from tessera.streaming import jobs

NAN = float("nan")
SCHEMA = "uid long, sample_id long, reward double"


def plain(files, low, high, size):
    """Rows by batch: groups of a file whose mean is in bounds join those that wait, the first ones fill batches."""
    waiting, out, done = {}, {}, 0
    for rows in files:
        for uid in {r[0] for r in rows}:
            mine = [r for r in rows if r[0] == uid]
            known = [r[2] for r in mine if r[2] is not None]
            if known and low < sum(known) / len(known) < high:
                waiting.setdefault(uid, []).extend(mine)
        ranked = sorted(waiting, key=lambda u: (min(r[1] for r in waiting[u]), u is not None, u))
        for lo in range(0, len(ranked) - size + 1, size):
            out[done] = sorted((r for u in ranked[lo : lo + size] for r in waiting.pop(u)), key=str)
            done += 1
    return out


def files(seed):
    r = random.Random(seed)
    ids = iter(r.sample(range(10_000), 2_000))
    made = [[(u, next(ids), r.choice([None, *(float(x) for x in range(0, 101, 5))])) for u in r.sample([None, *range(25)], n) for _ in range(r.randint(1, 4))] for n in (13, 9, 2, 17, 1, 12)]
    made[0] += [(900, next(ids), 50.0), (900, next(ids), NAN)]  # a mean that isn't a number is out of bounds
    return made


@pytest.mark.parametrize("seed", [1, 2])
def test_accumulated(spark, tmp_path, seed):
    """Two runs over the same checkpoint; groups come again while they wait, null is a group."""
    made = files(seed)
    for part in (made[:3], made[3:]):
        for rows in part:
            spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", "1").parquet(f"{tmp_path}/in")
        jobs.accumulated(stream, "uid", "reward", 20, 80, 4, "sample_id", f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    got = {}
    for x in spark.read.parquet(f"{tmp_path}/out").collect():
        got.setdefault(x.batch, []).append((x.uid, x.sample_id, x.reward))
    assert {b: sorted(rows, key=str) for b, rows in got.items()} == plain(made, 20, 80, 4)


def test_accumulated_again_after_a_failure(spark, tmp_path):
    """A micro-batch that is run again replaces what it wrote; lanes fill batches of their own."""
    made = files(3)[:3]
    run = lambda e: jobs._accumulate(spark.createDataFrame(made[e], SCHEMA), e, "uid", "reward", 0, 101, 2, "sample_id", f"{tmp_path}/out", f"{tmp_path}/cp", 3)
    for e in (0, 1, 1, 2, 2):
        run(e)
    rows = spark.read.parquet(f"{tmp_path}/out").collect()
    assert len({r.sample_id for r in rows}) == len(rows)
    per = {}
    for r in rows:
        per.setdefault((r.lane, r.batch), set()).add(r.uid)
    assert all(len(u) == 2 for u in per.values()) and len({lane for lane, _ in per}) > 1
    for lane in {lane for lane, _ in per}:
        assert sorted(b for x, b in per if x == lane) == list(range(sum(x == lane for x, _ in per)))


def test_accumulated_query_counts_a_null_user(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, r.choice([None, *range(14)]), "click", r.choice([None, *(float(x) for x in range(101))])) for i in range(400)]
    rows += [(400 + i, 77, "click", v) for i, v in enumerate((50.0, NAN))]
    spark.createDataFrame(rows, "event_id long, user_id long, event_type string, value double").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = sorted(map(tuple, catalog.QUERIES["SM04_accumulated"](spark, str(tmp_path)).collect()))
    sql = catalog.ORACLES["SM04_accumulated"]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    assert got == sorted(con.execute(sql).fetchall()) == [(0, 5), (1, 5), (2, 5)]


def test_a_stream_has_no_time_limit(spark, tmp_path):
    """A run that takes long is waited for: the limit of 600 s ended whole jobs on large tables."""

    class Slow:
        def awaitTermination(self, timeout=None):
            assert timeout is None
            spark.range(1).write.parquet(self.out)
            return True

    def run(stream, p):
        q = Slow()
        q.out = f"{p}/out"
        return q

    spark.createDataFrame([(1, 1, "click", 50.0)], "event_id long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    assert frames._streamed(frames.Tables(spark, str(tmp_path)), "slow", run).count() == 1
