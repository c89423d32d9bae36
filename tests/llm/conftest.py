"""Documents that hold the cases every operator must stand."""

from __future__ import annotations

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
SPACES = "[\x20\x09-\x0d]+"


def words(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))


def edge_rows() -> list[tuple]:
    """Nulls in any column, empty and blank texts, one very long text, ties, repeated rows and near copies."""
    rng = random.Random(4)
    base = words(rng, 120)
    near = base.replace(base.split()[60], "changed", 1)
    long = words(rng, 30_000)
    twice = (12, words(rng, 60) + " " + base[:300], "fr", "c", 2)
    rows = [
        (1, base, "en", "a", 9), (2, base, "en", "b", 9), (3, near, "en", "a", None), (4, None, None, None, None), (5, "", "en", "b", 0), (6, " \t\n ", "en", "b", 4),
        (7, long, "en", "c", 1), (8, "x" * 5_000, "de", "c", 5), (9, "one two", "en", None, 7), (10, "One  TWO", "en", "a", 8), (None, "no id here at all", "en", "a", 3),
        (11, base.replace(" ", "\n", 3), "en", "b", 1), twice, twice, (13, "é ½ 日本語 🎉 ▁x\x00y", "xx", "a", 1),
    ]
    rows += [(100 + k, words(rng, rng.randint(1, 200)), "en", rng.choice("abc"), k) for k in range(60)]
    rows += [(200 + k, near + f" tail{k}", "en", "hot", k) for k in range(25)]
    return rows


@pytest.fixture(scope="session")
def edge_docs(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(edge_rows(), SCHEMA)
    # Columns whose names an operator may use inside.
    return docs.withColumns({c: F.lit(1) for c in ("id", "key", "keep_id", "size", "_row", "n", "score")})


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
