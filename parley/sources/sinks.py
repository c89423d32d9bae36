"""Sinks: segment tables, timelines, reports, event logs and registries."""

from __future__ import annotations

import json
from datetime import UTC, datetime
from html import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import is_action, preview, short_clock, word_count
from ..operators import rollup
from ..operators.segments import complete

VOICE = ("vq_jitter_pct", "vq_shimmer_db", "vq_hnr_db", "vq_cpps_db")


def segments_csv(rows: DataFrame, path: str) -> None:
    """All 39 segment columns with a header; missing values are empty."""
    complete(rows).write.mode("overwrite").option("header", True).option("emptyValue", "").csv(path)


def segments_jsonl(rows: DataFrame, path: str) -> None:
    complete(rows).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def timeline_csv(rows: DataFrame, path: str) -> None:
    complete(rows).select("start", "end", "speaker_id").write.mode("overwrite").option("header", True).csv(path)


def speakers_csv(parts: list[DataFrame], path: str) -> None:
    """Speaker rows of several frames; the header is the sorted union of their columns."""
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part, allowMissingColumns=True)
    rows.select(*sorted(rows.columns)).write.mode("overwrite").option("header", True).csv(path)


def formatted_events(events: DataFrame, enter: float = 0.50, leave: float = 0.35, median: int = 5, source: str = "frames") -> DataFrame:
    """Events with fixed decimals: seconds with six, scores with four, and the settings they were found with, with two."""
    fixed = lambda c, places: F.format_string(f"%.{places}f", c.cast("double"))
    seconds = lambda c: fixed(F.col(c) / 1000, 6)
    setting = lambda x: F.lit(f"{x:.2f}")
    return events.select("file_id", seconds("start_ms").alias("start"), seconds("end_ms").alias("end"), "label", fixed(F.coalesce("score", F.lit(0.0)), 4).alias("score"), F.lit(source).alias("source"), setting(enter).alias("enter"), setting(leave).alias("leave"), F.lit(median).alias("median_k"))


def events_csv(events: DataFrame, path: str) -> None:
    formatted_events(events).write.mode("overwrite").option("header", True).csv(path)


def frames_jsonl(top: DataFrame, path: str) -> None:
    """Frames with their best labels: rows of ``timeline.frame_top`` gathered per frame."""
    item = F.struct("place", "label", "score")
    rows = top.groupBy("file_id", "frame").agg(F.array_sort(F.collect_list(item)).alias("_t"))
    rows.select("file_id", "frame", F.transform("_t", lambda x: F.struct(x["label"].alias("label"), x["score"].alias("score"))).alias("top")).write.mode("overwrite").json(path)


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").json(path)


def quality_report(rows: DataFrame) -> DataFrame:
    """One row per file: segments, speakers, flagged rows and means of the voice figures over what is known."""
    whole = complete(rows)
    return whole.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("segments"), F.countDistinct("speaker_id").alias("speakers"), F.count(F.when(F.col("error_flags") != "", 1)).alias("flagged"),
        *[F.avg(c).alias(f"{c}_mean") for c in VOICE],
    )


def registry_json(registry: DataFrame, path: str, version: str = "1.0", kept: dict[str, object] | None = None, now: str | None = None) -> None:
    """Registry rows (name, centroid, samples, last_seen) as JSON lines; readers take the parts of the folder together.

    The first line has what stands beside the speakers: ``kept`` (what ``readers.registry_metadata`` found: config, metadata
    and others, with their version, else ``version``), the time of the first and of this save, and in metadata the number
    of speakers. Names are not gathered: each is a line of its own. An empty ``kept`` writes a flat registry without it.
    """
    now = now or datetime.now(UTC).replace(microsecond=0).isoformat().replace("+00:00", "Z")
    entry = F.struct(*[F.col(c) if c in registry.columns else F.lit(None).cast("string").alias(c) for c in ("centroid", "samples", "last_seen")])
    rows = registry.select(F.map_from_arrays(F.array("name"), F.array(entry)).alias("speakers"))
    if kept == {}:
        rows.select(F.to_json("speakers").alias("value")).write.mode("overwrite").text(path)
        return
    head = {"version": version, "created_at": now, **(kept or {}), "updated_at": now}
    head["metadata"] = {**(head.get("metadata") or {}), "total_speakers": registry.count()}
    said = F.lit(json.dumps(head))
    first = rows.sparkSession.range(1).select(F.from_json(said, F.schema_of_json(said)).alias("h"), F.create_map().cast(rows.schema["speakers"].dataType).alias("speakers")).select("h.*", "speakers")
    first.unionByName(rows, allowMissingColumns=True).write.mode("overwrite").json(path)


def report_sections(segments: DataFrame, moments: int = 10) -> dict[str, DataFrame]:
    """Sections of a report by title, each a query for ``html_report``.

    ``segments`` has file_id, ord, speaker, text, start_ms, end_ms, valence, arousal.
    """
    counted = segments.withColumn("words", word_count(F.col("text")))
    clock = short_clock(F.col("start_ms")).alias("time")
    return {
        "Executive summary": rollup.quick_take(segments).orderBy("file_id"),
        "Speakers": rollup.core(counted).orderBy("file_id", F.desc("duration_ms"), "speaker"),
        "Moments to check": rollup.moments_in_order(segments, "arousal", moments).orderBy("file_id", "moment"),
        "Action items": segments.where(is_action(F.col("text"), F.lit(None).cast("string"))).select("file_id", clock, "speaker", preview(F.col("text")).alias("text")).orderBy("file_id", "time"),
        "Transcript": segments.orderBy("file_id", "start_ms", "ord").select("file_id", clock, "speaker", "text"),
    }


def html_report(summary: dict[str, DataFrame], rows: int = 100) -> str:
    """A page with the first rows of each table of a report; what is shown is bounded by ``rows`` a table."""
    parts = []
    for title, table in summary.items():
        head = "".join(f"<th>{escape(c)}</th>" for c in table.columns)
        body = "".join("<tr>" + "".join(f"<td>{escape('' if v is None else str(v))}</td>" for v in row) + "</tr>" for row in table.limit(rows).collect())
        parts.append(f"<h2>{escape(title)}</h2><table><tr>{head}</tr>{body}</table>")
    return f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>Report</title></head><body>{''.join(parts)}</body></html>"
