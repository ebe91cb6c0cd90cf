"""A stream of file changes: coalesced, flushed by rule, applied to a graph store."""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SMALL_CHANGE, FLUSH_SIZE, FLUSH_AGE, QUIET = 3, 200, 5.0, 1.0


def coalesced(events: DataFrame) -> DataFrame:
    """``(path, change, arrival_ts, first_ts)``: the last event of each path of ``events`` (path, change, arrival_ts), a partial maximum."""
    return events.groupBy("path").agg(F.max_by("change", F.struct("arrival_ts", "change")).alias("change"), F.max("arrival_ts").alias("arrival_ts"), F.min("arrival_ts").alias("first_ts"))


def requeue(failed: DataFrame, pending: DataFrame) -> DataFrame:
    """Pending changes with failed ones put back where no newer event of the path waits."""
    return coalesced(pending.select("path", "change", "arrival_ts").unionByName(failed.select("path", "change", "arrival_ts")))


def quiet_sessions(events: DataFrame, key: str, ts: str, gap: str) -> DataFrame:
    """``(key, start, end, n)``: bursts of a key separated by quiet of ``gap``; for streams and tables alike."""
    return events.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("n")).select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def flush_due(pending: DataFrame, now: float, size: int = FLUSH_SIZE, age: float = FLUSH_AGE, quiet: float = QUIET) -> DataFrame:
    """One row ``(n, oldest_age, newest_age, due)`` of pending changes with arrival_s, first_s in seconds."""
    row = pending.agg(F.count("*").alias("n"), (F.lit(now) - F.min("first_s")).alias("oldest_age"), (F.lit(now) - F.max("arrival_s")).alias("newest_age"))
    return row.withColumn("due", (F.col("n") > 0) & ((F.col("n") >= size) | (F.col("oldest_age") >= age) | (F.col("newest_age") >= quiet)))


def coalesce_stream(events: DataFrame, quiet_ms: int = 1000, age_ms: int = 5000) -> DataFrame:
    """A streaming ``(path, change, first_ms, last_ms)``: a path's last event once it has been quiet, or pending too long.

    State is one row a path, with a processing-time timeout; keyed by path, so
    it's dealt over all tasks.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = state.getCurrentProcessingTimeMs()
        first, last, change = state.get if state.exists else (None, None, None)
        if not state.hasTimedOut:
            for pdf in batches:
                if not len(pdf):
                    continue
                pdf = pdf.sort_values(["arrival_ms", "change"])
                first = int(pdf.arrival_ms.iloc[0]) if first is None else min(first, int(pdf.arrival_ms.iloc[0]))
                if last is None or int(pdf.arrival_ms.iloc[-1]) >= last:
                    last, change = int(pdf.arrival_ms.iloc[-1]), pdf.change.iloc[-1]
        if last is None:
            return
        if state.hasTimedOut or now - last >= quiet_ms or now - first >= age_ms:
            if state.exists:
                state.remove()
            yield pd.DataFrame({"path": [key[0]], "change": [change], "first_ms": [first], "last_ms": [last]})
        else:
            state.update((first, last, change))
            state.setTimeoutDuration(max(1, min(quiet_ms, age_ms - (now - first))))

    return events.groupBy("path").applyInPandasWithState(step, "path string, change string, first_ms long, last_ms long", "first long, last long, change string", "append", "ProcessingTimeTimeout")


def apply_batches(events: DataFrame, handle: Callable[[DataFrame, bool], None], checkpoint: str, **trigger):
    """Start a query that hands each micro-batch, coalesced, to ``handle(changes, small)``.

    small: fewer than 3 files, so that only the unreachable-symbol pass need be
    redone. A batch that fails is replayed from the checkpoint; ``handle`` must
    be idempotent by (path, arrival_ts).
    """

    def each(batch: DataFrame, _: int) -> None:
        changes = coalesced(batch).cache()
        n = changes.count()
        if n:
            handle(changes, n < SMALL_CHANGE)
        changes.unpersist()

    return events.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def rate_limited(requests: DataFrame, limit: int = 200, seconds: int = 60, tie: str | None = None) -> DataFrame:
    """``requests`` (session, ts) with ``allowed``: fewer than ``limit`` allowed ones of the session in the ``seconds`` before.

    Refused requests don't count, so the answer to one depends on those to all
    before it: sessions are streamed in order of time (then of ``tie``), and
    only the times of the last allowed ones are held, however many there are.
    """
    own = requests.select("*", F.unix_micros(F.col("ts").cast("timestamp")).alias("_at"), F.col("session").alias("_of"))
    order = ["_of", "_at", *([tie] if tie else [])]
    window = seconds * 1_000_000

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, recent = None, deque()
        for batch in batches:
            allowed = []
            for of, at in zip(batch.column(batch.num_columns - 1).to_pylist(), batch.column(batch.num_columns - 2).to_pylist()):
                if of != session:
                    session, recent = of, deque()
                while recent and at - recent[0] >= window:
                    recent.popleft()
                allowed.append(len(recent) < limit)
                if allowed[-1]:
                    recent.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], pa.array(allowed, pa.bool_())], names=[*batch.schema.names[:-2], "allowed"])

    schema = T.StructType([*requests.schema.fields, T.StructField("allowed", T.BooleanType())])
    return own.repartition("_of").sortWithinPartitions(*order).mapInArrow(run, schema)
