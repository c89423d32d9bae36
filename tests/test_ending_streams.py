"""Streams whose state ends, and stages that count themselves."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from parley.sources import sinks, stages
from parley.streaming import events as S
from parley.streaming import timed

START = dt.datetime(2024, 1, 1)
SCHEMA = "event_id long, ts timestamp_ntz, user_id long, event_type string, score double"


def at(minutes: float) -> dt.datetime:
    return START + dt.timedelta(minutes=minutes)


def files(spark, folder, batches: list[list[tuple]], schema: str = SCHEMA) -> None:
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(f"{folder}/b{k:02d}")


def run(spark, stream, mode: str, path) -> tuple[list, list]:
    """All rows of a stream over one file a batch, and the state's rows after each batch."""
    with timed.keyed_state(spark):
        query = stream.writeStream.outputMode(mode).format("parquet").option("checkpointLocation", f"{path}/check").trigger(availableNow=True).start(f"{path}/out")
        query.awaitTermination()
    sizes = [p.stateOperators[0].numRowsTotal for p in query.recentProgress if p.stateOperators]
    return spark.read.parquet(f"{path}/out").collect(), sizes


def test_switches_end_and_their_state_with_them(spark, tmp_path):
    day = 1_440
    batches = [
        [(1, at(0), 1, "a", 60.0), (2, at(10), 1, "a", 80.0), (3, at(20), 1, "a", 30.0), (4, at(5), 2, "a", 55.0), (5, at(7), 3, "b", 10.0)],
        [(6, at(30), 1, "a", 70.0), (7, at(40), 2, "a", 56.0)],  # 1 is on again, 2 stays on
        [(8, at(day), 4, "a", 20.0)],  # a day later: timers of 1 and 2 pass
        [(9, at(day + 1), 2, "a", 40.0), (10, at(2 * day), 5, "a", 51.0)],
        [(11, at(4 * day), 6, "a", 1.0)],
    ]
    files(spark, tmp_path / "in", batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    rows, sizes = run(spark, timed.timed_switches(stream, 50.0, 35.0, 60 * 60_000), "append", tmp_path)
    found = sorted((r.user_id, r.opened_at, r.closed_at, r.peak, r.timed_out) for r in rows)
    assert found == [(1, at(0), at(20), 80.0, False), (1, at(30), at(90), 70.0, True), (2, at(5), at(100), 56.0, True), (5, at(2 * day), at(2 * day + 60), 51.0, True)]
    assert max(sizes) > 0 and sizes[-1] == 0


def test_one_batch_gives_the_same_switches(spark, tmp_path):
    """A gap inside a batch ends a switch like a timer does."""
    rows = [(k, at(37 * k), k % 2, "a", float(k * 37 % 100)) for k in range(80)] + [(100 + k, at(5_000 + 37 * k), k % 2, "a", float(k * 53 % 100)) for k in range(40)] + [(200, at(20_000), 9, "z", 0.0)]
    whole, parts = tmp_path / "whole", tmp_path / "parts"
    files(spark, whole / "in", [rows])
    files(spark, parts / "in", [rows[k : k + 17] for k in range(0, len(rows), 17)])
    found = []
    for folder in (whole, parts):
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
        found.append(sorted(map(tuple, run(spark, timed.timed_switches(stream, 50.0, 35.0, 300 * 60_000), "append", folder)[0])))
    assert found[0] == found[1] and len(found[0]) > 10 and any(r[-1] for r in found[0])


def test_closed_windows_come_once_and_state_goes(spark, tmp_path):
    batches = [[(10 * b + k, at(600 * b + 7 * k), k % 2, "ab"[k % 2], 1.0) for k in range(20)] for b in range(6)]
    files(spark, tmp_path / "in", batches)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in")).withColumnRenamed("score", "value")
    rows, sizes = run(spark, S.tumbling(stream), "append", tmp_path)
    last = max(r[1] for b in batches for r in b) - dt.timedelta(hours=2)
    expected = {}
    for b in batches:
        for _, ts, _, kind, _ in b:
            hour = ts.replace(minute=0, second=0)
            if hour + dt.timedelta(hours=1) <= last:
                expected[hour, kind] = expected.get((hour, kind), 0) + 1
    assert {(r.window_start, r.event_type): r.n for r in rows} == expected and len(rows) == len(expected)
    assert max(sizes) < len(expected)


def test_moving_centroids_carry_on_and_are_forgotten(spark, tmp_path):
    rows = [(k, k % 3, [float(k + 1), 1.0, float(k % 4)], at(k)) for k in range(30)]
    kind = "place long, name long, v array<double>, at timestamp_ntz"
    files(spark, tmp_path / "in", [rows[:10], rows[10:11], rows[11:], [(99, 7, [1.0, 0.0, 0.0], at(100_000))]], kind)
    stream = spark.readStream.schema(kind).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    found, sizes = run(spark, timed.moving_centroids(stream, "name", "place", "v", "at"), "append", tmp_path)
    import numpy as np

    for name in range(3):
        mean = None
        for _, n, v, _ in rows:
            if n == name:
                mixed = np.array(v) if mean is None else 0.7 * mean + 0.3 * np.array(v)
                mean = mixed / (np.linalg.norm(mixed) + 1e-9)
        newest = max((r for r in found if r.key == name), key=lambda r: r.samples)
        assert newest.samples == 10 and newest.centroid == pytest.approx(mean.tolist())
    assert max(sizes) > sizes[-1] and {r.key for r in found} == {0, 1, 2, 7}


def test_centroids_of_a_table_whose_parts_come_in_any_order(spark, tmp_path):
    """The last vectors lie in the part that was written first; none is late, and all are blended by their ids."""
    from parley.plans import catalogue

    for low in (40_000, 20_000, 0):
        rows = [(low + k, [float(k % 7), 1.0, float(low)], k % 2) for k in range(20)]
        spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.mode("append").parquet(str(tmp_path / "embeddings.parquet"))
    names = ("stream_moving_centroids", "ema_centroid")
    stream, batch = (sorted(map(tuple, catalogue.QUERIES[n](spark, str(tmp_path)).collect())) for n in names)
    assert stream == batch and {r[1] for r in stream} == {30}


def test_series_share_state_by_bucket(spark, tmp_path):
    rows = [(k, at(k), k % 50, "ab"[k % 2], float(60 if k < 300 or k % 3 else 20)) for k in range(400)]
    found = []
    for buckets in (1, 3):
        folder = tmp_path / str(buckets)
        files(spark, folder / "in", [rows[:150], rows[150:]])
        stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(folder / "in"))
        one, sizes = run(spark, timed.timed_switches(stream, 50.0, 35.0, 300 * 60_000, buckets=buckets), "append", folder)
        found.append(sorted(map(tuple, one)))
        # A row of state a bucket, and what its timers need.
        assert max(sizes) <= 3 * buckets
    assert found[0] == found[1] and len(found[0]) > 10


def test_stages_count_in_their_own_jobs(spark, tmp_path):
    log = stages.Stages(spark)
    spark.sparkContext.setJobGroup("staged", "one job")
    log.run("kept", spark.range(100).where("id % 3 = 0"), lambda df: df.write.parquet(str(tmp_path / "kept")), {"even": F.count(F.when(F.col("id") % 2 == 0, 1)), "total": F.sum("id")})
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("staged"))
    spark.sparkContext.setJobGroup("plain", "the same without counts")
    spark.range(100).where("id % 3 = 0").write.parquet(str(tmp_path / "plain"))
    assert jobs == len(spark.sparkContext.statusTracker().getJobIdsForGroup("plain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    bad = spark.range(10).select(F.raise_error(F.lit("no such thing")).alias("x"))
    assert log.run("optional", bad, lambda df: df.collect(), needed=False) is None
    with pytest.raises(Exception):
        log.run("needed", bad, lambda df: df.collect())
    rows = log.table().orderBy("place").collect()
    assert [(r.stage, r.rows) for r in rows] == [("kept", 34), ("optional", None), ("needed", None)]
    assert rows[0].counts == {"even": 17, "total": sum(range(0, 100, 3))} and rows[0].ms >= 0 and rows[0].failure is None and rows[1].failure
    report = stages.run_report(sinks.quality_report(spark.createDataFrame([("f", 0.0, 1.0, "s")], "file_id string, start double, end double, speaker_id string")), log).first()
    assert set(report.timings_ms) == {"kept", "optional", "needed"} and len(report.failures) == 2 and report.warnings == ["optional failed and was left out"] and report.segments == 1
