"""Streams whose state ends: closed windows in append mode, switches with event-time timers, centroids that are forgotten."""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .events import BUCKETS, LATE, advance, bucket, closed, drain

#: How long a switch may stay on without an event, and how long the centroid of a name that is not heard is kept.
IDLE_MS, KEEP_MS = 6 * 3_600_000, 30 * 86_400_000
SWITCHED = "user_id bigint, event_type string, opened_at timestamp_ntz, closed_at timestamp_ntz, peak double, timed_out boolean"
MOVED = "key {kind}, samples bigint, centroid array<double>"


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """A state store with timers, for streams that start inside."""
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        yield
    finally:
        spark.conf.set(key, before)


class _Switch(StatefulProcessor):
    """Switches of a bucket's (user, type) series: on from ``enter``, off at ``leave`` or after ``idle_ms`` without an event."""

    def __init__(self, enter: float, leave: float, idle_ms: int) -> None:
        self.enter, self.leave, self.idle = enter, leave, 1_000 * idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("switches", "held string, timer_ms bigint")

    def _held(self) -> tuple[dict[tuple, list], int | None]:
        held, timer = self.now.get() if self.now.exists() else ("[]", None)
        return {tuple(e[:2]): e[2:] for e in json.loads(held)}, timer

    def _due(self, entry: list) -> int:
        return -(-(entry[1] + self.idle) // 1_000)

    def _keep(self, held: dict[tuple, list]) -> None:
        if not held:  # switches that are off need no state
            self.now.clear()
            return
        timer = min(self._due(e) for e in held.values())
        self.handle.registerTimer(timer)
        self.now.update((json.dumps([[*k, *e] for k, e in held.items()]), timer))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held, timer = self._held()
        done = advance(pd.concat(list(rows)), held, self.enter, self.leave, self.idle)
        if timer is not None:
            self.handle.deleteTimer(timer)
        self._keep(held)
        yield closed(done)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held, _ = self._held()
        over = [k for k, e in held.items() if self._due(e) <= max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs() - 1)]
        done = [(*k, opened, last + self.idle, peak, True) for k in over for opened, last, peak in [held.pop(k)]]
        self._keep(held)
        yield closed(done)

    def close(self) -> None:
        pass


def timed_switches(events: DataFrame, enter: float, leave: float, idle_ms: int = IDLE_MS, late: str = LATE, buckets: int = BUCKETS) -> DataFrame:
    """Events of each (user_id, event_type) series from on to off: (user_id, event_type, opened_at, closed_at, peak, timed_out).

    ``events`` is a stream with user_id, event_type, event_id, ts, score. An event switches on from ``enter`` and off at ``leave``
    or below. A switch without an event for ``idle_ms`` goes off then: within a micro-batch when the next event
    shows it, else by a timer as soon as the watermark passes. So state is kept for switches that are on alone, and for
    no longer than ``idle_ms`` behind the watermark. Rows of a micro-batch are taken in order of time. Series share state, timers
    and calls by ``buckets``; results do not depend on their number.
    """
    rows = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    rows = rows.select(F.col("user_id").cast("string").alias("user"), "event_type", "event_id", "ts", "score", bucket(buckets).alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(_Switch(enter, leave, idle_ms), SWITCHED, "append", "EventTime")


class _Centroid(StatefulProcessor):
    """A moving centroid per key; it is forgotten ``keep_ms`` after the key's last vector."""

    def __init__(self, alpha: float, keep_ms: int) -> None:
        self.alpha, self.keep_ms = alpha, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("centroid", "samples bigint, centroid array<double>, timer_ms bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        samples, mean, timer = self.now.get() if self.now.exists() else (0, None, None)
        mean = None if mean is None else np.array(mean, float)
        places, held, latest = [], [], None
        for frame in rows:  # as plain matrices, so that a key's vectors of a micro-batch take little more than their numbers
            latest = frame["ts"].max() if latest is None else max(latest, frame["ts"].max())
            frame = frame[frame["v"].notna()]
            if len(frame):
                places.append(frame["place"].to_numpy())
                held.append(np.stack([np.asarray(v, float) for v in frame["v"]]))
        if held:
            vectors = np.concatenate(held)
            for i in np.argsort(np.concatenate(places), kind="stable"):
                mixed = vectors[i] if mean is None else (1 - self.alpha) * mean + self.alpha * vectors[i]
                mean, samples = mixed / (np.linalg.norm(mixed) + 1e-9), samples + 1
        if mean is None:
            return
        ends = int(latest.timestamp() * 1_000) + self.keep_ms
        if timer is not None:
            self.handle.deleteTimer(timer)
            ends = max(ends, timer)
        self.handle.registerTimer(ends)
        self.now.update((samples, mean.tolist(), ends))
        yield pd.DataFrame({"key": [key[0]], "samples": [samples], "centroid": [mean.tolist()]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.now.clear()
        return iter(())

    def close(self) -> None:
        pass


def moving_centroids(vectors: DataFrame, key: str, order: str, vector: str, time: str, alpha: float = 0.30, keep_ms: int = KEEP_MS, late: str = LATE) -> DataFrame:
    """Moving centroid of each key after each micro-batch that has vectors of it: (key, samples, centroid).

    Like ``identity.moving_centroids`` on a stream: vectors of a micro-batch are blended in by ``order``. A key's state ends by a
    timer once the watermark of ``time`` lies ``keep_ms`` behind its last vector; it then begins anew. The row with the
    most samples is a key's newest. Null vectors count for nothing.
    """
    rows = vectors.select(F.col(key).alias("key"), F.col(order).alias("place"), F.col(vector).cast("array<double>").alias("v"), F.col(time).cast("timestamp").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Centroid(alpha, keep_ms), MOVED.format(kind=dict(rows.dtypes)["key"]), "append", "EventTime")


def drain_timed(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """``events.drain`` with a state store that has timers."""
    with keyed_state(stream.sparkSession):
        return drain(stream, name, mode)
