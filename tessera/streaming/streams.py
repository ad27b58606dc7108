"""Streaming forms: the batch functions on streams, windows with late data, lockouts with state."""

from __future__ import annotations

import heapq
import math
import uuid
from collections.abc import Iterator
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.governance import govern
from ..operators.retrieval import build_index, index_of
from ..operators.sessions import LOCKOUT_SECONDS, MAX_ATTEMPTS, upsert_sessions
from ..operators.structure import chunks as cut_chunks
from ..sources import versions
from ..sources.shared import scratch, written

#: Buckets of sessions, deltas before they are compacted, and segments of a size that are merged into one.
BUCKETS, COMPACT, MERGE = 64, 8, 4


def read_stream(spark, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def govern_stream(messages: DataFrame, users: DataFrame, out: str, checkpoint: str, limit: int = 1) -> StreamingQuery:
    """Messages as they come: passed and masked, blocked, and the audit trail, each below `out`.

    A batch that is run again overwrites its own folder, so nothing is counted twice.
    """
    def write(batch: DataFrame, number: int) -> None:
        with scratch():  # what the batch was judged to be is written once, and goes when its parts are
            for name, part in zip(("passed", "blocked", "audit"), govern(batch, users, limit)):
                part.write.mode("overwrite").parquet(f"{out}/{name}/batch={number}")

    return messages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, by: str = "event_type", size: str = "5 minutes", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(start, by, n, total) over tumbling or sliding windows; rows later than `late` are dropped.

    Where windows slide by a part of their size, rows are counted once, in panes as long as the
    slide, and a window is the sum of its panes: state and shuffle hold a row for each pane, and no
    event is copied for each window that it lies in.
    """
    timed = events.withWatermark("ts", late)
    pane = slide or size
    if slide and _micros(events, size) % _micros(events, slide):
        pane = None
    w = F.window("ts", pane) if pane else F.window("ts", size, slide)
    found = timed.groupBy(w.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    if slide and pane:
        over = F.window(F.window_time("w"), size, slide)
        found = found.groupBy(over.alias("w"), by).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    return found.select(F.col("w.start").alias("start"), by, "n", "total")


def _micros(df: DataFrame, interval: str) -> int:
    """How long an interval is, in microseconds."""
    zero = "TIMESTAMP '1970-01-01 00:00:00'"
    return df.sparkSession.range(1).selectExpr(f"unix_micros({zero} + INTERVAL {interval}) - unix_micros({zero})").first()[0]


def activity_sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("s"), "user_id").agg(F.count("*").alias("n")).select(
        "user_id", F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n"
    )


def lockout_stream(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, seconds: int = LOCKOUT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """attempts (client_key, attempt_id, ts, success) with locked and failures, as they come.

    State is the times of the last failures, at most max_attempts of them; it goes with a success,
    and when the watermark has passed the lockout. Within a batch attempts are taken in order of time.
    """
    span = pd.Timedelta(seconds=seconds)

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        recent = [pd.Timestamp(t, unit="us") for t in state.get[0]] if state.exists else []
        rows = []
        for r in pd.concat(frames).sort_values(["ts", "attempt_id"]).itertuples():
            recent = [t for t in recent if r.ts - t < span]
            locked = len(recent) >= max_attempts
            rows.append((key[0], r.attempt_id, locked, len(recent)))
            if not locked:
                recent = [] if r.success else [*recent, r.ts]
        if not recent:
            if state.exists:
                state.remove()
        else:
            state.update(([int(t.value // 1000) for t in recent],))
            state.setTimeoutTimestamp(max(int(recent[-1].value // 10**6) + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["client_key", "attempt_id", "locked", "failures"])

    return attempts.withWatermark("ts", late).groupBy("client_key").applyInPandasWithState(
        step, "client_key string, attempt_id long, locked boolean, failures int", "recent array<long>", "append", GroupStateTimeout.EventTimeTimeout
    )


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Rows that are told at once.
FRAME_ROWS = 10_000
#: Attempts of a key that wait together in one entry of the state, neighbours in time.
WAIT_TOGETHER = 256


class OrderedLockouts(StatefulProcessor):
    """The fold of one key's attempts in order of time, whatever order and batches they come in.

    Attempts wait in the map state `waiting`, WAIT_TOGETHER neighbours in time to an entry, until
    the watermark has passed them. A key's first timer then judges all that the watermark has
    passed, in order of time: entries are merged, each read when the time of its first attempt has
    come. The list state `recent` has the times of the last failures, at most max_attempts of them,
    and goes with a success or when a timer finds that the lockout has run out.
    """

    def __init__(self, max_attempts: int, seconds: int):
        self.max_attempts, self.seconds = max_attempts, seconds

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long, name string", "times array<long>, ids array<long>, successes array<boolean>")
        self.recent = handle.getListState("recent", "t long")

    def wait(self, rows: list[tuple]) -> None:
        """Keep rows (time, id, success), in order of time, until a timer at the first one's time or later."""
        for i in range(0, len(rows), WAIT_TOGETHER):
            part = rows[i : i + WAIT_TOGETHER]
            self.waiting.updateValue((part[0][0] // 1000, uuid.uuid4().hex), tuple(map(list, zip(*part))))
        self.handle.registerTimer(rows[0][0] // 1000)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for frame in rows:  # a frame at a time; what it holds is state before the next one comes
            micros = frame["ts"].astype("datetime64[us]").astype("int64")
            self.wait(sorted(zip(micros.tolist(), frame["attempt_id"].tolist(), frame["success"].tolist())))
        yield self.told([])

    def due(self, upto: int) -> Iterator[tuple]:
        """The waiting attempts up to a millisecond, in order; what was read and lies later waits again, and a timer calls for the rest."""
        every = sorted(self.waiting.keys())
        entries = [k for k in every if k[0] <= upto]
        if len(entries) < len(every):
            self.handle.registerTimer(every[len(entries)][0])
        held, at = [], 0
        while held or at < len(entries):
            while at < len(entries) and (not held or entries[at][0] * 1000 <= held[0][0]):
                for row in zip(*self.waiting.getValue(entries[at])):
                    heapq.heappush(held, row)
                self.waiting.removeKey(entries[at])
                at += 1
            if held[0][0] // 1000 > upto:
                break
            yield heapq.heappop(held)
        if held:
            self.wait(sorted(held))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto, span = timerValues.getCurrentWatermarkInMs(), self.seconds * 1_000_000
        before = [t for (t,) in self.recent.get()] if self.recent.exists() else []
        recent, out = before, []
        for t, i, success in self.due(upto):
            recent = [x for x in recent if t - x < span]
            locked = len(recent) >= self.max_attempts
            out.append((key[0], i, locked, len(recent)))
            if not locked:
                recent = [] if success else [*recent, t]
            if len(out) == FRAME_ROWS:
                yield self.told(out)
                out = []
        recent = [t for t in recent if upto * 1000 - t < span]  # what comes later than the watermark does not see the others
        if recent:
            self.recent.put([(t,) for t in recent])
            self.handle.registerTimer(recent[-1] // 1000 + self.seconds * 1000 + 1)
        elif before:
            self.recent.clear()
        yield self.told(out)

    def told(self, rows: list) -> pd.DataFrame:
        # Plain objects: text of pandas' own kind comes in chunks, which the state's writer does not take.
        return pd.DataFrame(rows, columns=["client_key", "attempt_id", "locked", "failures"], dtype=object)

    def close(self) -> None:
        pass


def ordered_lockout_stream(attempts: DataFrame, max_attempts: int = MAX_ATTEMPTS, seconds: int = LOCKOUT_SECONDS, late: str = "10 minutes") -> DataFrame:
    """attempts (client_key, attempt_id, ts, success) with locked and failures, as the watermark passes them.

    In the order of time over all batches, so that an attempt that comes late, but within `late`,
    is judged in its place. No batch of a key is held in memory. Needs the state store that keeps
    its rows outside the heap, which the session is set to.
    """
    attempts.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    return attempts.withWatermark("ts", late).groupBy("client_key").transformWithStateInPandas(
        OrderedLockouts(max_attempts, seconds), "client_key string, attempt_id long, locked boolean, failures int", "Append", "EventTime"
    )


def upsert_stream(changes: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Latest-wins sessions, kept below `path` as a base and deltas by buckets of sessions; latest() merges them.

    A batch writes those of its changes that say something new, in the buckets that they touch; of
    a batch that ran before, or the same changes under another checkpoint, nothing is written.
    After COMPACT deltas base and deltas become a new base.
    """
    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, held = versions.current(spark, path)
        if held.get("done", {}).get(checkpoint, -1) >= number:
            return
        parts = held.get("parts", [])
        held = {"parts": parts, "done": held.get("done", {}) | {checkpoint: number}}
        with scratch():
            keyed = written(batch.withColumn("bucket", F.pmod(F.xxhash64("session_id"), F.lit(BUCKETS)).cast("int")), "changes")
            news = upsert_sessions(keyed.limit(0), keyed)
            if parts:
                touched = [r["bucket"] for r in keyed.select("bucket").distinct().collect()]  # BUCKETS at most
                news = _news(news, _merged(_parts(spark, path, parts).where(F.col("bucket").isin(touched))))
            news = written(news.withColumn("seq", F.lit(version + 1)), "news")
            if not news.isEmpty():
                name = versions.new_part("delta")
                news.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
                held["parts"] = [*parts, name]
        versions.commit(spark, path, version + 1, held)
        if len(held["parts"]) > COMPACT:
            compact(spark, path)

    return changes.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _parts(spark, path: str, parts: list[str]) -> DataFrame:
    found = [spark.read.parquet(f"{path}/{p}") for p in parts]
    return found[0] if len(found) == 1 else reduce(lambda a, b: a.unionByName(b), found)


def _merged(rows: DataFrame) -> DataFrame:
    """One row for each session: the latest updated_at wins, then the later delta; the first created_at stays."""
    rest = [c for c in rows.columns if c not in ("session_id", "created_at")]
    latest_row = F.max_by(F.struct(*rest), F.struct("updated_at", "seq"))
    return rows.groupBy("session_id").agg(latest_row.alias("s"), F.min("created_at").alias("created_at")).select("session_id", "s.*", "created_at")


def _news(changes: DataFrame, known: DataFrame) -> DataFrame:
    """Changes that alter a session: it is new, later, as late with other values, or created earlier."""
    rest = [c for c in changes.columns if c not in ("session_id", "bucket")]
    old = known.select(F.col("session_id").alias("__id"), F.struct(*rest).alias("__old"))
    later = F.col("updated_at") > F.col("__old.updated_at")
    other = (F.col("updated_at") == F.col("__old.updated_at")) & ~F.struct(*[c for c in rest if c != "created_at"]).eqNullSafe(F.struct(*[F.col(f"__old.{c}").alias(c) for c in rest if c != "created_at"]))
    earlier = F.col("created_at") < F.col("__old.created_at")
    return changes.join(old, F.col("session_id").eqNullSafe(F.col("__id")), "left").where(F.col("__old").isNull() | later | other | earlier).drop("__id", "__old")


def compact(spark, path: str) -> None:
    """Merge base and deltas into a new base; the old parts go once the new version is there."""
    version, held = versions.current(spark, path)
    name = versions.new_part("base")
    _merged(_parts(spark, path, held["parts"])).repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/{name}")
    versions.commit(spark, path, version + 1, held | {"parts": [name]})
    versions.drop_parts(spark, path, held["parts"])


def latest(spark, path: str) -> DataFrame:
    """The sessions as the last batch of upsert_stream left them."""
    _, held = versions.current(spark, path)
    return _merged(_parts(spark, path, held["parts"])).drop("bucket", "seq")


def index_stream(chunks: DataFrame, path: str, checkpoint: str, documents: bool = False) -> StreamingQuery:
    """An index below `path` of chunks (chunk_id, title, section, tags, category, text) as they come; read_index() reads it.

    With `documents` the stream holds documents (doc_id, source, content), which each batch cuts
    into chunks; a chunk's id is a hash of document, section and part. A batch is a segment. What
    comes again replaces what there was, a document without content (a chunk that says deleted)
    takes it away: the segment names those that it makes obsolete in segments before it. As soon as
    MERGE segments are alike in size (by powers of MERGE) they become one, without what is obsolete.
    A batch holds a document once; a batch that ran before changes nothing.
    """
    def add(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        version, held = versions.current(spark, path)
        if held.get("done", {}).get(checkpoint, -1) >= number:
            return
        segments, name, seq = held.get("segments", []), versions.new_part("segment"), version + 1
        with scratch():
            key = "doc_id" if documents else "chunk_id"
            came = written(batch, "batch")
            there = came.where("content IS NOT NULL") if documents else (came.where("NOT coalesce(deleted, false)") if "deleted" in came.columns else came)
            rows = written(chunk_rows(there) if documents else there, "rows")
            index = build_index(rows)
            keys = rows.select("chunk_id", F.col(key).cast("string").alias("key"))
            index["lengths"].join(keys, "chunk_id").withColumn("seq", F.lit(seq)).write.parquet(f"{path}/{name}/lengths")
            index["postings"].withColumn("seq", F.lit(seq)).write.parquet(f"{path}/{name}/postings")
            gone = came.select(F.col(key).cast("string").alias("key")).distinct()
            if segments:
                gone = gone.join(_tables(spark, path, segments, "lengths").select("key").distinct(), "key", "left_semi")
            else:
                gone = gone.limit(0)
            gone.withColumn("seq", F.lit(seq)).write.parquet(f"{path}/{name}/gone")
            size = rows.count()
        segments = [*segments, {"name": name, "size": size}]
        versions.commit(spark, path, seq, {"segments": segments, "done": held.get("done", {}) | {checkpoint: number}})
        merge_segments(spark, path)

    return chunks.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _tables(spark, path: str, segments: list[dict], table: str) -> DataFrame:
    schema = {
        "lengths": "chunk_id bigint, doc_len bigint, key string, seq int", "postings": "token string, chunk_id bigint, tf bigint, doc_len bigint, seq int",
        "gone": "key string, seq int",
    }[table]
    return spark.read.schema(schema).parquet(*[f"{path}/{s['name']}/{table}" for s in segments])


def _live(spark, path: str, segments: list[dict], every: list[dict]) -> tuple[DataFrame, DataFrame]:
    """(postings, lengths) of segments without what any segment of `every` made obsolete; both with seq."""
    gone = _tables(spark, path, every, "gone")
    if gone.isEmpty():
        # All are live, and so are their postings.
        return _tables(spark, path, segments, "postings").where("chunk_id IS NOT NULL"), _tables(spark, path, segments, "lengths")
    last = gone.groupBy("key").agg(F.max("seq").alias("last"))
    lengths = _tables(spark, path, segments, "lengths").join(last, "key", "left").where("last IS NULL OR seq >= last").drop("last")
    postings = _tables(spark, path, segments, "postings").join(lengths.select("chunk_id", "seq"), ["chunk_id", "seq"], "left_semi")
    return postings, lengths


def merge_segments(spark, path: str) -> None:
    """Make one of MERGE segments or more of a tier, again while a tier has so many."""
    while True:
        version, held = versions.current(spark, path)
        tiers: dict[int, list[dict]] = {}
        for s in held["segments"]:
            tiers.setdefault(int(math.log(max(s["size"], 1), MERGE)), []).append(s)
        many = next((t for t in tiers.values() if len(t) >= MERGE), None)
        if many is None:
            return
        name = versions.new_part("segment")
        postings, lengths = _live(spark, path, many, held["segments"])
        lengths.write.parquet(f"{path}/{name}/lengths")
        postings.write.parquet(f"{path}/{name}/postings")
        # What these made obsolete may lie in segments that stay as they are.
        _tables(spark, path, many, "gone").groupBy("key").agg(F.max("seq").alias("seq")).write.parquet(f"{path}/{name}/gone")
        size = _tables(spark, path, [{"name": name}], "lengths").count()
        kept = [s for s in held["segments"] if s not in many]
        versions.commit(spark, path, version + 1, held | {"segments": [*kept, {"name": name, "size": size}]})
        versions.drop_parts(spark, path, [s["name"] for s in many])


def chunk_rows(docs: DataFrame) -> DataFrame:
    """Documents (doc_id, source, content) as chunks to be indexed."""
    return cut_chunks(docs).select(
        F.xxhash64("doc_id", "section_no", "part").alias("chunk_id"), "doc_id", "title", "section", "source",
        F.col("meta.tags").alias("tags"), F.col("meta.category").alias("category"), "text",
    )


def read_index(spark, path: str) -> dict[str, DataFrame]:
    """The index that index_stream has written so far: document frequencies, number and mean length of chunks follow from what is live."""
    _, held = versions.current(spark, path)
    postings, lengths = _live(spark, path, held["segments"], held["segments"])
    return index_of(postings.drop("seq"), lengths.select("chunk_id", "doc_len"))


def replay(stream: DataFrame, folder: str, schema: str, mode: str = "append") -> DataFrame:
    """Run a stream over all there is and read its result: for checks against the batch form."""
    spark = stream.sparkSession
    q = stream.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(schema).parquet(f"{folder}/out")
