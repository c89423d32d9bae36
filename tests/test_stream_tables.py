"""Streams end in tables of the shared folder, not on the driver."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from parley.streaming import events as streams


@pytest.mark.parametrize("mode", ["complete", "append"])
def test_streams_end_in_files(spark, tmp_path, mode):
    rows = spark.range(40).select(F.col("id").alias("event_id"), F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 20)").alias("ts"), (F.col("id") % 2).alias("user_id"), F.lit("a").alias("event_type"), (F.col("id") * 37 % 100).cast("double").alias("value"))
    rows.repartition(2).write.parquet(str(tmp_path / "e"))
    stream = streams.read_events(spark, str(tmp_path / "e"), rows.schema)
    made = streams.sessions(stream) if mode == "complete" else streams.switch_events(stream.withColumn("score", F.col("value")), 60, 30)
    table = streams.drain(made, f"files_{mode}", mode)
    assert table.count() and table.inputFiles() and all(f.endswith(".parquet") for f in table.inputFiles())
    if mode == "complete":
        assert sorted(map(str, table.collect())) == sorted(map(str, streams.sessions(rows).collect()))
