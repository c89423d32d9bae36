"""Exact duplicate removal with DataFrame functions only."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import SPACE, named, plain


def normalised(text: Column) -> Column:
    """Text with each run of white space as one blank; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ")


def exact_classes(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    content_hash: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """Class of each row among rows with equal normalised text.

    Returns all rows as (id, keep_id, group_size, kept, text_sha256). Rows are grouped by a 128-bit content hash and,
    inside a hash, by the bytes of the text themselves, so that texts whose hashes collide stay apart. The grouping
    has a partial aggregate before its exchange: a class that holds a third of all rows leaves each task as one row.
    Only classes of two rows or more come back to the rows, over an equi-join that adaptive execution splits when
    one key is hot.

    Null text is the empty text. The smallest id of a class stays; a null id never is the smallest unless the class
    has no other, and then stays. Repeated rows with the kept id are all marked as kept. Further columns are ignored.
    An empty table gives an empty result.
    """
    clean = docs.select(F.col(id_col).alias("_id"), normalised(F.col(text_col)).alias("_clean"))
    clean = clean.select("_id", "_clean", content_hash(F.col("_clean")).alias("_hash"), F.sha2("_clean", 256).alias("_sha"))
    classes = (
        clean.groupBy("_hash", "_sha", "_clean")
        .agg(F.min("_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size"))
        .where("group_size > 1")
        .select(F.col("_hash").alias("_h"), F.col("_sha").alias("_s"), "keep_id", "group_size")
    )
    rows = clean.select("_id", "_hash", "_sha")
    joined = rows.join(classes, (F.col("_hash") == F.col("_h")) & (F.col("_sha") == F.col("_s")), "left")
    keep = F.when(F.col("group_size").isNull(), F.col("_id")).otherwise(F.col("keep_id"))
    return joined.select(
        F.col("_id").alias(id_col),
        keep.alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        F.col("_id").eqNullSafe(keep).alias("kept"),
        F.col("_sha").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows that stay, with all their columns; of rows that repeat both the kept id and the text, one stays.

    The row with the smallest id of each class is chosen by one aggregate over (hash, bytes), so texts cross the
    network once. Ties of the id are broken by a hash of all columns, so the text is sent once. Columns may have any name and type.
    """
    rows, names = plain(docs)
    ident, text = F.col(names[id_col]), F.col(names[text_col])
    # Maps and variants cannot be hashed; as JSON they can.
    tie = [F.to_json(F.struct(c)) if re.search("map<|variant", kind) else F.col(c) for c, kind in rows.dtypes]
    order = F.struct(ident.isNull().alias("n"), ident.alias("i"), F.xxhash64(*tie).alias("t"))
    keyed = rows.select(F.md5(normalised(text)).alias("hash"), normalised(text).alias("clean"), F.struct(*rows.columns).alias("row"), order.alias("place"))
    kept = keyed.groupBy("hash", "clean").agg(F.min_by("row", "place").alias("row"))
    return named(kept.select("row.*"), docs)
