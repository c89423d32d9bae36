"""Streaming twins of the batch operators: windows with watermarks and stateful hysteresis."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..storage import new_path

#: Times of the windows and how late a row may come.
WINDOW, SLIDE, GAP, LATE = "1 hour", "15 minutes", "30 minutes", "2 hours"
#: Groups that series of switches are dealt out to; a call and a state for each, instead of one for each series.
BUCKETS = 1_024


def read_events(spark: SparkSession, path: str, schema, files_per_batch: int | None = 1) -> DataFrame:
    """Parquet files of a folder as a stream of events; None takes all files that are there as one micro-batch.

    Files come by the time they were written. Where that is not the order of their rows, as with a table whose parts were
    written together, only one micro-batch keeps rows from coming late or in the wrong order.
    """
    source = spark.readStream.schema(schema)
    return (source if files_per_batch is None else source.option("maxFilesPerTrigger", files_per_batch)).parquet(path)


def _timed(events: DataFrame, late: str) -> DataFrame:
    rows = events.withColumn("ts", F.col("ts").cast("timestamp"))
    return rows.withWatermark("ts", late) if rows.isStreaming else rows


def _plain(column: str) -> Column:
    """Without a time zone, as the tables have their times."""
    return F.col(column).cast("timestamp_ntz")


def tumbling(events: DataFrame, window: str = WINDOW, late: str = LATE) -> DataFrame:
    """Events and summed values by type and window: (window_start, event_type, n, total)."""
    per = _timed(events, late).groupBy(F.window("ts", window), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return per.select(_plain("window.start").alias("window_start"), "event_type", "n", "total")


def sliding(events: DataFrame, window: str = WINDOW, slide: str = SLIDE, late: str = LATE) -> DataFrame:
    per = _timed(events, late).groupBy(F.window("ts", window, slide), "event_type").agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"))
    return per.select(_plain("window.start").alias("window_start"), "event_type", "n", "mean")


def sessions(events: DataFrame, gap: str = GAP, late: str = LATE) -> DataFrame:
    """A user's sessions: events that lie less than ``gap`` apart: (user_id, session_start, session_end, n)."""
    per = _timed(events, late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return per.select("user_id", _plain("session_window.start").alias("session_start"), _plain("session_window.end").alias("session_end"), "n")


def bucket(buckets: int) -> Column:
    """Bucket of a (user_id, event_type) series."""
    return F.pmod(F.xxhash64("user_id", "event_type"), F.lit(buckets).cast("long"))


def advance(rows: pd.DataFrame, held: dict[tuple, list], enter: float, leave: float, idle: int | None = None) -> list[tuple]:
    """Take a bucket's rows (user, event_type, event_id, ts, score), series by series in order of time, and give what is closed.

    ``held`` has a series' (opened, last, peak) while its switch is on, in microseconds; it is changed in place. Gives
    (user, event_type, opened, closed, peak, timed_out).
    """
    codes = rows.groupby(["user", "event_type"], sort=False, dropna=False).ngroup().to_numpy()
    micros = rows["ts"].astype("datetime64[us]").astype("int64").to_numpy()
    order = np.lexsort((rows["event_id"].to_numpy(), micros, codes))
    users, kinds, done, now, before = rows["user"].tolist(), rows["event_type"].tolist(), [], None, None
    key, opened, last, peak = (), None, None, 0.0

    def keep() -> None:
        if now is not None and opened is not None:
            held[key] = [opened, last, peak]

    for i, code, at, score in zip(order.tolist(), codes[order].tolist(), micros[order].tolist(), rows["score"].to_numpy(float)[order].tolist()):
        if code != before:
            keep()
            now, before, key = i, code, (users[i], kinds[i])
            opened, last, peak = held.pop(key, (None, None, 0.0))
        if opened is not None and idle is not None and at - last > idle:
            done.append((*key, opened, last + idle, peak, True))
            opened = None
        if opened is None and score >= enter:
            opened, peak = at, score
        elif opened is not None:
            peak = max(peak, score)
            if score <= leave:
                done.append((*key, opened, at, peak, False))
                opened = None
        last = at if last is None else max(last, at)
    keep()
    return done


def closed(done: list[tuple]) -> pd.DataFrame:
    """Rows that ``advance`` gives as (user_id, event_type, opened_at, closed_at, peak, timed_out)."""
    out = pd.DataFrame(done, columns=["user_id", "event_type", "opened_at", "closed_at", "peak", "timed_out"])
    out["user_id"] = pd.array([None if u is None else int(u) for u in out["user_id"]], "Int64")
    for c in ("opened_at", "closed_at"):
        out[c] = pd.to_datetime(out[c].astype("int64"), unit="us")
    return out.astype({"peak": float, "timed_out": bool})


def switch_events(events: DataFrame, enter: float, leave: float, buckets: int = BUCKETS) -> DataFrame:
    """Stateful hysteresis of each (user_id, event_type) series: (user_id, event_type, opened_at, closed_at, peak).

    State is since when a switch is on, and its peak; an event is given out when its switch goes off. Rows of
    a micro-batch are taken in order of time; what is later than the watermark is dropped before. Series share state and
    calls by ``buckets``; results do not depend on their number.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {tuple(e[:2]): e[2:] for e in json.loads(state.get[0])} if state.exists else {}
        done = advance(pd.concat(list(frames)), held, enter, leave)
        if held:
            state.update((json.dumps([[*k, *e] for k, e in held.items()]),))
        elif state.exists:  # switches that are off need no state
            state.remove()
        if done:
            yield closed(done).drop(columns="timed_out")

    rows = events.select(F.col("user_id").cast("string").alias("user"), "event_type", "event_id", "ts", "score", bucket(buckets).alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(
        step, "user_id long, event_type string, opened_at timestamp_ntz, closed_at timestamp_ntz, peak double", "switches string", "append", GroupStateTimeout.NoTimeout
    )


def drain(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over all that is there into a table in the shared folder, and read that table.

    In complete mode each micro-batch writes the whole table anew, else rows are added. No rows pass through the driver.
    """
    spark = stream.sparkSession
    path = new_path(spark, name)
    spark.createDataFrame([], stream.schema).write.parquet(path)  # for a stream without any micro-batch
    sink = stream.writeStream.outputMode(mode).option("checkpointLocation", new_path(spark, f"{name}-checkpoint")).trigger(availableNow=True)
    if mode == "complete":
        query = sink.foreachBatch(lambda rows, _: rows.write.mode("overwrite").parquet(path)).start()
    else:
        query = sink.format("parquet").start(path)
    try:
        query.awaitTermination()
    finally:
        query.stop()
    return spark.read.schema(stream.schema).parquet(path)
