"""Mixing overlapping sources to target weights by min-cost flow."""

from __future__ import annotations

import heapq
from collections.abc import Mapping, Sequence
from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise, named, plain, word_count

#: Fixed values of the production mix: weights repeat over the sorted sources; all targets share this part of all words.
WEIGHTS, SHARE, MOST_PASSES = (3, 1, 2), Fraction(3, 2), 2


#: The flow is solved on the driver; a mix of more sources or membership patterns than this is refused.
MOST_NODES = 50_000


def fill_targets(sizes: Mapping, weights: Mapping, total: Fraction, most: int) -> dict:
    """Split ``total`` by weight; a target stops at ``most`` times its source's size, the excess goes to the others.

    Returns exact fractions. If all targets are stopped, the rest of the total is not given out.
    """
    open_, given, left = dict(weights), {}, Fraction(total)
    while open_:
        unit = left / sum(open_.values())
        full = [k for k, w in open_.items() if unit * w > most * sizes[k]]
        if not full:
            return given | {k: unit * w for k, w in open_.items()}
        for k in full:
            given[k] = Fraction(most * sizes[k])
            left -= given[k]
            del open_[k]
    return given


def least_cost_flow(capacity: Mapping, quotas: Mapping, most: int) -> dict:
    """Route words from membership patterns to source quotas at the least repetition cost.

    ``capacity`` has the words of each pattern (a tuple of sources), ``quotas`` the words each source wants. The r-th
    pass over a pattern costs 2 r - 1 a word, so costs grow with the square of the passes and passes are spread out.
    Returns {(pattern, source): words}. Successive cheapest paths with node potentials; the graph has one node for a
    pattern and one for a source, never one for a document.
    """
    patterns, sources = list(capacity), list(quotas)
    node = {("p", p): i + 1 for i, p in enumerate(patterns)} | {("s", s): len(patterns) + 1 + i for i, s in enumerate(sources)}
    end = len(node) + 1
    arcs: list[list[int]] = []  # to, capacity left, cost, index of the arc back
    out: list[list[int]] = [[] for _ in range(end + 1)]

    def arc(a: int, b: int, room: int, cost: int) -> int:
        out[a].append(len(arcs))
        arcs.append([b, room, cost])
        out[b].append(len(arcs))
        arcs.append([a, 0, -cost])
        return len(arcs) - 2

    routes = {}
    for p in patterns:
        for r in range(1, most + 1):
            arc(0, node["p", p], int(capacity[p]), 2 * r - 1)
        for s in p:
            if s in quotas:
                routes[p, s] = arc(node["p", p], node["s", s], most * int(capacity[p]), 0)
    for s in sources:
        arc(node["s", s], end, int(quotas[s]), 0)
    height = [0] * (end + 1)
    while True:
        far = [float("inf")] * (end + 1)
        via = [-1] * (end + 1)
        far[0], queue = 0, [(0, 0)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for k in out[a]:
                b, room, cost = arcs[k]
                if room > 0 and d + cost + height[a] - height[b] < far[b]:
                    far[b], via[b] = d + cost + height[a] - height[b], k
                    heapq.heappush(queue, (far[b], b))
        if via[end] < 0:
            return {key: arcs[k + 1][1] for key, k in routes.items() if arcs[k + 1][1]}
        top = max(x for x in far if x < float("inf"))
        height = [h + min(x, top) for h, x in zip(height, far)]
        path, at = [], end
        while at:
            path.append(via[at])
            at = arcs[via[at] ^ 1][0]
        flow = min(arcs[k][1] for k in path)
        for k in path:
            arcs[k][1] -= flow
            arcs[k ^ 1][1] += flow


def mix(
    sized: DataFrame,
    quotas: Mapping,
    seed: int = 17,
    most: int = MOST_PASSES,
) -> DataFrame:
    """Words that each document gives to the mix.

    ``sized`` has (id, members array<string>, size long): a document may belong to several sources. Documents are
    summed by membership pattern; ``least_cost_flow`` routes each pattern's words to the quotas; then documents are
    taken in the order of a seeded hash: whole passes for all, and in the last pass those before a threshold. The
    threshold is found by descending through leading bits of the hash, 256 branches at a time, so that only sums per
    branch reach the driver and no source is ever ordered in one task. Rows with the threshold hash itself share
    what is left in proportion to their size.

    Returns (id, members, size, passes int, part long, taken long): taken = passes * size + part <= most * size.
    Sizes of null or below 0 count as 0. A document without members gives nothing. Reruns give the same rows; the
    order of rows and partitions has no influence.
    """
    rows = materialise(_drawn(sized, F.col("id"), F.col("members"), F.col("size"), seed), "sized")
    table = _solve(rows, quotas, most)
    # The plan has a row for a membership pattern, at most MOST_NODES, as the driver has just solved it.
    joined = rows.join(F.broadcast(table), rows["_pattern"] == table["_of"], "left").withColumns(_given())
    return joined.select("id", "members", F.col("_size").alias("size"), F.col("_passes").alias("passes"), F.col("_part").alias("part"), (F.col("_passes") * F.col("_size") + F.col("_part")).alias("taken"))


def _drawn(rows: DataFrame, ident: Column, members: Column, size: Column, seed: int) -> DataFrame:
    """``rows`` with size, membership pattern (the sorted sources; null without members) and seeded draw of each document."""
    size = F.greatest(F.coalesce(size.cast("long"), F.lit(0)), F.lit(0)).cast("long")
    draw = F.shiftrightunsigned(F.xxhash64(F.lit(seed), ident.cast("string"), size), 8)
    return rows.withColumns({"_size": size, "_pattern": F.when(F.size(members) > 0, F.array_sort(F.array_distinct(members))), "_draw": draw})


def _solve(rows: DataFrame, quotas: Mapping, most: int) -> DataFrame:
    """Route the patterns' words to the quotas: (_of, _all, _cut, _left, _tied) for each pattern.

    ``_all`` whole passes go to every document; in the last pass draws below ``_cut`` go whole and those at it share
    ``_left`` of their ``_tied`` words.
    """
    capacity = {tuple(r["_pattern"]): r["words"] for r in _few(rows.where("_pattern is not null").groupBy("_pattern").agg(F.sum("_size").alias("words")))}
    flow = least_cost_flow({p: w for p, w in capacity.items() if w}, {k: int(v + Fraction(1, 2)) for k, v in quotas.items()}, most)
    plan = {}
    routed: dict = {}
    for (pattern, _), v in flow.items():
        routed[pattern] = routed.get(pattern, 0) + v
    for pattern, words in capacity.items():
        plan[pattern] = divmod(routed.get(pattern, 0), words) if words else (0, 0)
    cuts = _thresholds(rows, {p: rest for p, (_, rest) in plan.items()})
    return rows.sparkSession.createDataFrame([(list(p), int(plan[p][0]), *map(int, cuts[p])) for p in plan], "_of array<string>, _all int, _cut long, _left long, _tied long")


def _few(table: DataFrame) -> list:
    """Rows of a table that the driver may hold: the flow's nodes are few, or else it is no plan for one machine."""
    rows = table.limit(MOST_NODES + 1).collect()
    if len(rows) > MOST_NODES:
        raise ValueError(f"more than {MOST_NODES} sources or membership patterns")
    return rows


def _given() -> dict[str, Column]:
    """Whole passes and the part of the last pass of a document that is joined with its pattern's plan."""
    size = F.col("_size")
    #: size * left / tied without overflow of a long, rounded down.
    share = F.floor(size.cast("decimal(38,0)") * F.col("_left") / F.greatest("_tied", F.lit(1))).cast("long")
    part = F.when(F.col("_draw") < F.col("_cut"), size).when(F.col("_draw") == F.col("_cut"), share)
    return {"_passes": F.coalesce("_all", F.lit(0)), "_part": F.coalesce(part, F.lit(0)).cast("long")}


def _copies() -> Column:
    """Whole documents nearest to the words given: a part of half a document or more is one more copy."""
    return (F.col("_passes") + F.when((F.col("_part") > 0) & (2 * F.col("_part") >= F.col("_size")), 1).otherwise(0)).cast("int")


def _thresholds(rows: DataFrame, wanted: Mapping[tuple, int]) -> dict:
    """For each pattern (cut, left, tied): draws below ``cut`` fit whole; those at it share ``left`` of ``tied`` words."""
    bits = 56
    found = {p: (-1, 0, 0) if not w else None for p, w in wanted.items()}
    at = {p: (0, w) for p, w in wanted.items() if w}  # leading bits chosen so far, words still wanted
    used = 0
    while at:
        used += 8
        table = rows.sparkSession.createDataFrame([(list(p), lead) for p, (lead, _) in at.items()], "_of array<string>, lead long")
        branch = F.shiftright("_draw", bits - used)
        inside = rows.join(F.broadcast(table), (rows["_pattern"] == table["_of"]) & (F.shiftright(branch, 8) == F.col("lead")))
        sums: dict = {}
        summed = inside.groupBy("_pattern", branch.alias("branch")).agg(F.sum("_size").alias("words"), F.min("_draw").alias("least"), F.max("_draw").alias("most"))
        for r in summed.collect():
            sums.setdefault(tuple(r["_pattern"]), []).append((r["branch"], r["words"], r["least"], r["most"]))
        ahead = {}
        for p, (_, want) in at.items():
            for b, words, least, most in sorted(sums[p]):
                if want < words:
                    if least == most:
                        found[p] = (least, want, words)
                    else:
                        ahead[p] = (b, want)
                    break
                want -= words
        at = ahead
    return found


def production_targets(sizes: Mapping, weights: Sequence[int] = WEIGHTS, share: Fraction = SHARE, most: int = MOST_PASSES) -> dict:
    """Targets of the standing mix: sources by code point, null last, with repeating weights."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    return fill_targets(sizes, {s: weights[i % len(weights)] for i, s in enumerate(order)}, share * sum(sizes.values()), most)


def mix_documents(docs: DataFrame, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """The standing mix over a table of documents, one source each: (doc_id, size, source_size, target, taken).

    ``taken`` meets the targets to the word, so the document at a threshold may give a part. Null text has size 0 and is taken 0 words; null source is a source of its own, the last one.
    Repeated rows are separate documents that share their draw. Further columns are ignored; an empty table gives
    an empty result.
    """
    sized, sizes, targets = _standing(docs, id_col)
    mixed = mix(sized.select("id", F.array("source").alias("members"), "size"), targets, seed)
    table = docs.sparkSession.createDataFrame([(s, int(sizes[s]), float(targets[s])) for s in sizes], "_source string, source_size long, target double")
    source = F.col("members")[0]
    joined = mixed.join(F.broadcast(table), source.eqNullSafe(F.col("_source")), "left")
    return joined.select(F.col("id").alias(id_col), "size", "source_size", "target", "taken")


def _standing(docs: DataFrame, id_col: str) -> tuple[DataFrame, dict, dict]:
    """Documents with their sizes, and the sizes and targets of the sources; a row for a source reaches the driver."""
    sized = materialise(docs.select(F.col(id_col).alias("id"), F.col("source"), word_count(F.col("text")).alias("size")), "words")
    sizes = {r["source"]: r["words"] for r in _few(sized.groupBy("source").agg(F.sum("size").alias("words")))}
    return sized, sizes, production_targets(sizes)


def mixed_documents(docs: DataFrame, seed: int = 17, id_col: str = "doc_id") -> DataFrame:
    """The mix itself: rows of ``docs``, each as often as the standing mix takes it as a whole; others are left out.

    The plan is solved on sizes alone and then applied in one pass over the rows, so texts are not shuffled. Columns may
    have any name, and sources any characters.
    """
    sized, _, targets = _standing(docs, id_col)
    small = materialise(_drawn(sized, F.col("id"), F.array("source"), F.col("size"), seed), "sized")
    table = F.broadcast(_solve(small, targets, MOST_PASSES))
    rows, names = plain(docs)
    rows = _drawn(rows, F.col(names[id_col]), F.array(names["source"]), word_count(F.col(names["text"])), seed)
    joined = rows.join(table, F.col("_pattern") == F.col("_of"), "left").withColumns(_given()).withColumn("_copies", _copies())
    return named(joined.where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))), docs)
