"""Secrets in texts: three patterns, and character Markov models of random strings and ordinary identifiers."""

from __future__ import annotations

from collections.abc import Sequence
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .shared import materialise, plain

KINDS = ("assign", "access", "hex", "random")
#: Letters of the names of an assignment stand in either case; classes instead of a flag, so that it holds for A-Z only.
_NAMES = "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in name) for name in ("password", "passwd", "secret", "token", "api_?key"))
ASSIGN = rf"""({_NAMES})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run that fails by its length is one match of these patterns' loose forms, so runs of some length are found alike.
ACCESS, HEX, RUN = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}", r"[A-Za-z0-9+/_=-]{16,}"
LEAST_VALUE = 12
#: What the models tell apart; letters are folded to one case.
ALPHABET = "abcdefghijklmnopqrstuvwxyz0123456789+/_=-."
#: Runs that are labelled as ordinary: words and short numbers parted by signs.
ORDINARY = r"^[+/_=-]*([A-Za-z]+|[0-9]{1,8})([+/_=-]+([A-Za-z]+|[0-9]{1,8}))*[+/_=-]*$"
#: Weight of the uniform distribution in each context, and the log-likelihood ratio from which a run is a secret.
PRIOR, LEAST_RATIO = 50.0, 12.0


def _found(text: Column, pattern: str, kind: int, value: int = 0) -> Column:
    """Matches in order: array<struct<kind, k, gap, len, value>>; gap is the length of the text between two matches."""
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    values = F.regexp_extract_all(text, F.lit(pattern), F.lit(value)) if value else matches
    gaps = F.transform(F.split(text, pattern, -1), F.length)
    rows = F.transform(F.arrays_zip(matches.alias("m"), values.alias("v")), lambda x, k: F.struct(
        F.lit(kind).alias("kind"), k.alias("k"), x["m"].alias("m"), x["v"].alias("value")))
    rows = F.zip_with(rows, gaps, lambda r, g: F.struct(r["kind"].alias("kind"), r["k"].alias("k"), g.alias("gap"), F.length(r["m"]).alias("len"), r["value"].alias("value")))
    return F.when(text.rlike(pattern), F.filter(rows, lambda r: r["kind"].isNotNull())).otherwise(F.array().cast("array<struct<kind:int,k:int,gap:int,len:int,value:string>>"))


def candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All matches of the patterns and all runs that the models shall judge, a row with a null kind for texts without any.

    (row, id, kind, start, stop, value, touched): ``row`` tells rows of the table apart, places count code points,
    ``touched`` marks runs that share a character with a match of a pattern.
    """
    rows, names = plain(docs)
    text = F.coalesce(F.col(names[text_col]), F.lit(""))
    found = F.concat(_found(text, ASSIGN, 0, 2), _found(text, ACCESS, 1), _found(text, HEX, 2), _found(text, RUN, 3))
    # The number of a row must come before the matches are exploded, hence two steps.
    numbered = rows.select(F.monotonically_increasing_id().alias("row"), F.col(names[id_col]).alias("id"), found.alias("found"))
    each = numbered.select("row", "id", F.explode_outer("found").alias("f")).select("row", "id", "f.*").repartition("row")
    # Places follow from the lengths of all matches and gaps before: a sum in order, whatever the number of matches.
    passed = F.sum(F.col("gap").cast("long") + F.col("len")).over(W.partitionBy("row", "kind").orderBy("k").rowsBetween(W.unboundedPreceding, 0))
    placed = each.select("row", "id", "kind", (passed - F.col("len")).alias("start"), passed.alias("stop"), "value")
    fine = F.col("kind").isNull() | (F.col("kind") != 0) | (F.length("value") >= LEAST_VALUE)
    # A text whose matches all fail keeps a row, so that it keeps its place in the result.
    first = F.row_number().over(W.partitionBy("row").orderBy(F.when(fine, 0).otherwise(1), "kind", "start"))
    some = placed.withColumns({"_fine": fine, "_first": first}).where("_fine or _first = 1")
    blank = {c: F.when(F.col("_fine"), F.col(c)) for c in ("kind", "start", "stop", "value")}
    some = some.withColumns(blank).drop("_fine", "_first")
    w, base = W.partitionBy("row").orderBy("start", "kind"), F.col("kind") < 3
    before = F.max(F.when(base, F.col("stop"))).over(w.rowsBetween(W.unboundedPreceding, 0))
    after = F.min(F.when(base, F.col("start"))).over(w.rowsBetween(0, W.unboundedFollowing))
    touched = (F.col("kind") == 3) & (F.coalesce(before > F.col("start"), F.lit(False)) | F.coalesce(after < F.col("stop"), F.lit(False)))
    return some.withColumn("touched", F.coalesce(touched, F.lit(False)))


def _steps(value: Column) -> Column:
    """Neighbouring characters of a value, folded, as places in the alphabet: array<struct<a, b>>; time in proportion."""
    place = lambda c: F.instr(F.lit(ALPHABET), c) - 1
    places = F.transform(F.split(F.lower(value), ""), place)
    n = F.size(places)
    return F.arrays_zip(F.slice(places, 1, F.greatest(n - 1, F.lit(0))).alias("a"), F.slice(places, 2, F.greatest(n - 1, F.lit(0))).alias("b"))


def train(found: DataFrame, prior: float = PRIOR) -> tuple[list[float], list[float]]:
    """Log-likelihood ratios of a step from one character to the next: (trained random strings, uniform ones), both
    against ordinary identifiers, as flat tables of the alphabet's square.

    Labelled samples are values that a pattern found (random) and runs that touch none and consist of words and short
    numbers (ordinary). Each distinct value counts once, so that copies have no weight. Counts come from all rows; the
    driver gets at most two numbers for each pair of characters. Contexts without a sample are uniform.
    """
    label = F.when(F.col("kind") < 3, 1).when(~F.col("touched") & F.col("value").rlike(ORDINARY), 0)
    samples = found.select(label.alias("label"), "value").where("label is not null and value is not null").distinct()
    steps = samples.select("label", F.explode(_steps(F.col("value"))).alias("s")).groupBy("label", "s.a", "s.b").count()
    size = len(ALPHABET)
    counts = {label: [[0] * size for _ in range(size)] for label in (0, 1)}
    for row in steps.where("a >= 0 and b >= 0").collect():
        counts[row.label][row.a][row.b] = row["count"]
    chance = {label: [[(c + prior / size) / (sum(row) + prior) for c in row] for row in table] for label, table in counts.items()}
    trained = [log(r / o) for rs, os_ in zip(chance[1], chance[0]) for r, o in zip(rs, os_)]
    uniform = [log(1 / size / o) for os_ in chance[0] for o in os_]
    return trained, uniform


def ratio(value: Column, table: Sequence[float]) -> Column:
    """Summed log-likelihood ratio of a value's steps."""
    held = F.split(F.lit(",".join(repr(x) for x in table)), ",").cast("array<double>")
    terms = F.transform(_steps(value), lambda s: F.coalesce(F.get(held, s["a"] * len(ALPHABET) + s["b"]), F.lit(0.0)))
    return F.aggregate(terms, F.lit(0.0), lambda t, x: t + x)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_ratio: float = LEAST_RATIO, prior: float = PRIOR) -> DataFrame:
    """Spans of secrets: (row, id, kind, start, stop, value, score), a row with a null kind for each text without one.

    Kinds are assign (a name such as password or token, a sign, and a value of 12 characters or more), access (AKIA and
    more, 18 or more), hex (16 or more) and random: runs of 16 or more of ``[A-Za-z0-9+/_=-]`` that touch none of these
    and that a character Markov model of random strings (trained, or uniform) finds likelier than that of
    ordinary identifiers by ``least_ratio`` in the natural logarithm, which is the score. Places count code points.

    Only DataFrame functions are used. Texts are read once and never leave their task; matches are written, since both
    the models and the verdicts read them. Null and empty texts have no span; repeated rows each have theirs, told apart
    by ``row``; null ids stay null. An empty table gives an empty result; further columns are ignored.
    """
    found = materialise(candidates(docs, id_col, text_col), "secrets")
    trained, uniform = train(found, prior)
    score = F.when((F.col("kind") == 3) & ~F.col("touched"), F.greatest(ratio(F.col("value"), trained), ratio(F.col("value"), uniform)))
    judged = found.withColumn("score", score)
    kept = F.coalesce((F.col("kind") < 3) | (F.col("score") >= least_ratio), F.lit(False))
    first = F.row_number().over(W.partitionBy("row").orderBy(F.when(kept, 0).otherwise(1), "start", "kind")) == 1
    rows = judged.withColumns({"_kept": kept, "_first": first}).where("_kept or _first")
    own = {c: F.when(F.col("_kept"), F.col(c)) for c in ("kind", "start", "stop", "value", "score")}
    names = F.get(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return rows.withColumns(own).select("row", F.col("id").alias(id_col), names.alias("kind"), "start", "stop", "value", "score")


def digest(spans: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """One row a text: (id, n_assign, n_access, n_hex, n_random, base_sha256, spans)."""
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    span = F.struct("start", order.alias("place"), F.concat_ws(":", "kind", "start", "stop").alias("s"))
    base = F.col("kind").isNotNull() & (F.col("kind") != "random")
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    per = spans.groupBy("row", id_col).agg(*[count(k) for k in KINDS], F.sort_array(F.collect_list(F.when(base, span))).alias("b"), F.sort_array(F.collect_list(F.when(F.col("kind").isNotNull(), span))).alias("a"))
    return per.select(id_col, *[f"n_{k}" for k in KINDS], F.sha2(F.array_join("b.s", ","), 256).alias("base_sha256"), F.array_join("a.s", ",").alias("spans"))
