"""Readers of label tables, registries, caches and audio files."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import sound


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Labels of a CSV file in its order: (place, label); the column display_name, else the last one."""
    rows = spark.read.option("header", True).csv(path)
    column = "display_name" if "display_name" in rows.columns else rows.columns[-1]
    numbered = rows.select(F.trim(F.col(column)).alias("label"), F.monotonically_increasing_id().alias("_row"))
    return numbered.where("label <> ''").select(F.col("_row").alias("place"), "label")


def label_groups(spark: SparkSession, path: str) -> DataFrame:
    """Label groups of a CSV file with columns audioset or label, and group or task: (label lower-cased, group)."""
    rows = spark.read.option("header", True).csv(path)
    pick = lambda *names: F.coalesce(*[F.col(n) for n in names if n in rows.columns])
    found = rows.select(F.lower(F.trim(pick("audioset", "label"))).alias("label"), F.trim(pick("group", "task")).alias("group"))
    return found.where("label <> '' and group <> ''").dropDuplicates(["label"])


def speaker_registry(spark: SparkSession, path: str) -> DataFrame:
    """Registry of a JSON file, flat or wrapped with metadata: (name, centroid, samples, last_seen)."""
    entry = "struct<centroid:array<float>,samples:bigint,last_seen:string>"
    text = _objects(spark, path)
    wrapped = F.from_json("value", f"struct<speakers:map<string,{entry}>>")["speakers"]
    flat = F.map_filter(F.from_json("value", f"map<string,{entry}>"), lambda _, v: v["centroid"].isNotNull())
    return text.select(F.explode(F.coalesce(wrapped, flat)).alias("name", "e")).select("name", "e.centroid", "e.samples", "e.last_seen")


def _objects(spark: SparkSession, path: str) -> DataFrame:
    """JSON objects of the files of a path, one a row: whole files, or lines that each begin an object."""
    return spark.read.text(path, wholetext=True).select(F.explode(F.split("value", r"\n(?=\{)")).alias("value"))


def registry_metadata(spark: SparkSession, path: str) -> dict[str, object]:
    """What a registry says beside its speakers (version, config, metadata, times); empty for a flat registry."""
    fields = F.map_filter(F.from_json("value", "map<string,string>"), lambda k, _: k != "speakers")
    # Entries of a flat registry are objects with a centroid.
    own = F.map_filter(fields, lambda _, v: F.get_json_object(v, "$.centroid").isNull())
    rows = _objects(spark, path).select(F.explode(own).alias("k", "v")).distinct().collect()

    def value(text: str | None) -> object:
        try:
            return json.loads(text)
        except (TypeError, ValueError):
            return text

    return {r.k: value(r.v) for r in rows}


def cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON rows of a cache; rows that cannot be read are left out."""
    rows = spark.read.schema(f"{schema}, _broken string").option("columnNameOfCorruptRecord", "_broken").json(path)
    return rows.where("_broken is null").drop("_broken")


def audio(spark: SparkSession, path: str, chunk_s: int = sound.CHUNK_S) -> DataFrame:
    """PCM files as chunk rows: (file_id, chunk, start_ms, rate, samples array<float>, error); see ``sound.read``."""
    return sound.read(spark, path, chunk_s)


def tone(spark: SparkSession, seconds: int = 1, hertz: float = 440.0, rate: int = 16_000) -> DataFrame:
    """A sine tone as rows (sample, value), for smoke tests."""
    return spark.range(seconds * rate).select(F.col("id").alias("sample"), (0.5 * F.sin(2 * np.pi * hertz * F.col("id") / rate)).alias("value"))
