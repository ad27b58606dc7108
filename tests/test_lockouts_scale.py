"""Lockouts of keys that are cut into pieces, against a plain fold."""

import random
from datetime import datetime, timedelta

import pytest

from tessera.operators import sessions as S


def plain(attempts, most, seconds):
    out, recent = {}, {}
    for key, i, ts, success in sorted(attempts, key=lambda a: (str(a[0]), a[2], a[1])):
        past = [x for x in recent.get(key, []) if (ts - x).total_seconds() < seconds]
        out[i] = (len(past) >= most, len(past))
        if len(past) < most:
            recent[key] = [] if success else [*past, ts]
        else:
            recent[key] = past
    return out


def made(kind, n=1500):
    """One hot key and several others: attempts without a pause, with pauses, of failures only, all at one time."""
    r, t0 = random.Random(hash(kind) % 100), datetime(2024, 1, 1)
    t, rows = t0, []
    for i in range(n):
        step = {"dense": r.random() * 40, "paused": 2000 if r.random() < 0.02 else r.random() * 30, "failures": 7, "at once": 0}[kind]
        t += timedelta(seconds=int(step))
        rows.append(("hot", i, t, kind != "failures" and r.random() < 0.15))
    rows += [(r.choice(["a", "b", None]), n + i, t0 + timedelta(seconds=r.randint(0, 9000)), r.random() < 0.3) for i in range(200)]
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("kind", ["dense", "paused", "failures", "at once"])
def test_pieces_of_a_hot_key(spark, kind):
    rows = made(kind)
    d = spark.createDataFrame(rows, "client_key string, attempt_id long, ts timestamp, success boolean").repartition(4)
    got = {r.attempt_id: (r.locked, r.failures) for r in S.lockouts(d, seconds=600, piece=400).collect()}
    assert got == plain(rows, S.MAX_ATTEMPTS, 600)


def test_no_attempts(spark):
    assert S.lockouts(spark.createDataFrame([], "client_key string, attempt_id long, ts timestamp, success boolean")).collect() == []


def test_ordered_stream(spark, tmp_path):
    """Attempts that come in any order over three batches, within the watermark, are judged as if they had come in order."""
    from tessera.streaming import streams as ST

    r, t0 = random.Random(4), datetime(2024, 1, 1)
    rows = [(r.choice("ab"), i, t0 + timedelta(seconds=r.randint(0, 400), microseconds=r.randint(0, 3) * 400), r.random() < 0.15) for i in range(90)]
    end = ("end", 1000, t0 + timedelta(days=3), False)
    schema = "client_key string, attempt_id long, ts timestamp, success boolean"
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        for i, part in enumerate([rows[:30], rows[30:60], rows[60:], [end]]):
            spark.createDataFrame(part, schema).coalesce(1).write.parquet(f"{tmp_path}/in{i}")
            out = ST.ordered_lockout_stream(ST.read_stream(spark, f"{tmp_path}/in*", schema), seconds=120)
            q = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
            q.awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = {x.attempt_id: (x.locked, x.failures) for x in spark.read.schema("client_key string, attempt_id long, locked boolean, failures int").parquet(f"{tmp_path}/out").collect()}
    assert got == plain(rows, S.MAX_ATTEMPTS, 120)


def test_ordered_stream_makes_few_calls_for_many_attempts(monkeypatch):
    """A key's attempts are a few entries of state and one timer, not some for each attempt; they are judged in pieces as the watermark passes."""
    import pandas as pd

    from tessera.streaming import streams as ST

    class Held(dict):
        def exists(self): return bool(self)
        def get(self): return iter(self.get_rows())
        def get_rows(self): return list(self.values())
        def put(self, rows): self.clear(), self.update(enumerate(rows))
        def getValue(self, k): calls.append("get"); return self[k]
        def updateValue(self, k, v): calls.append("update"); self[k] = v
        def removeKey(self, k): del self[k]

    class Handle:
        def getMapState(self, *_): return Held()
        def getListState(self, *_): return Held()
        def registerTimer(self, ms): calls.append("timer"); timers.add(ms)

    class Now:
        def __init__(self, ms): self.ms = ms
        def getCurrentWatermarkInMs(self): return self.ms
        def getExpiryTimeInMs(self): return self.ms

    calls, timers = [], set()
    r, t0 = random.Random(5), datetime(2024, 1, 1)
    rows = [("k", i, t0 + timedelta(seconds=r.randint(0, 40_000)), r.random() < 0.15) for i in range(3000)]
    fold = ST.OrderedLockouts(S.MAX_ATTEMPTS, 600)
    fold.init(Handle())
    for part in (rows[:2000], rows[2000:]):
        frame = pd.DataFrame(part, columns=["client_key", "attempt_id", "ts", "success"])
        list(fold.handleInputRows(("k",), iter([frame]), Now(0)))
    got, passed = {}, 0
    for minutes in (100, 101, 400, 2000):
        mark = int((t0 - datetime(1970, 1, 1)).total_seconds() + minutes * 60) * 1000
        while due := sorted(t for t in timers if t <= mark):
            timers.remove(due[0])
            for frame in fold.handleExpiredTimer(("k",), Now(mark), Now(due[0])):
                got |= {x.attempt_id: (x.locked, x.failures) for x in frame.itertuples()}
        passed = sum(x[2] <= t0 + timedelta(minutes=minutes) for x in rows)
        assert len(got) == passed
    assert got == plain(rows, S.MAX_ATTEMPTS, 600) and not fold.waiting and not fold.recent
    assert len(calls) < 150
