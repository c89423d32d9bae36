"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_written: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Only a local session, whose executors are threads of the driver, gets a temporary folder where that is unset; on a
    cluster each executor would write to a disk of its own, so there it is an error.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors see")
        named = tempfile.mkdtemp(prefix="parley-shared-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def new_path(spark: SparkSession, label: str) -> str:
    """A path nobody has used yet in the shared folder."""
    _written.append(f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}")
    return _written[-1]


def remove(spark: SparkSession, path: str) -> None:
    """Delete a table of this process from the shared folder that nothing reads any more."""
    if path in _written:
        _written.remove(path)
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def remove_table(df: DataFrame) -> None:
    """Delete a table that ``materialise`` has written."""
    for path in [p for p in _written if any(f"{p.split('://')[-1]}/" in f for f in df.inputFiles()[:1])]:
        remove(df.sparkSession, path)


def clear(spark: SparkSession) -> None:
    """Delete what this process has written to the shared folder; call it once results are written themselves."""
    while _written:
        remove(spark, _written[-1])


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def broadcast_if_small(df: DataFrame, limit_bytes: int = 8_000_000) -> DataFrame:
    """``df``, a written table, marked for broadcast if its measured size is within the bound; else as it is, for a
    shuffled join. Strings count with their length, other columns with 8 bytes."""
    width = sum((F.coalesce(F.length(c), F.lit(0)) + 16 if kind in ("string", "binary") else F.lit(8) for c, kind in df.dtypes), F.lit(16))
    size = df.agg(F.sum(width.cast("long"))).first()[0] or 0
    return F.broadcast(df) if size <= limit_bytes else df
