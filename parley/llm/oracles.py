"""Longer SQL twins of corpus queries, put together from the rounds or patterns that repeat in them."""

from __future__ import annotations

from . import secret_spans as S


def _kmeans(k: int = 16, rounds: int = 3) -> str:
    gap = "list_sum(list_transform(list_zip(a.v, c.v), lambda p: (p[1] - p[2]) * (p[1] - p[2])))"
    parts = [
        "k AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * x::DOUBLE) AS BIGINT)) AS v FROM embeddings"
        " WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64)",
        f"c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS c, v FROM k ORDER BY sha256('1:' || vec_id) LIMIT {k})",
    ]
    for t in range(rounds + 1):
        parts.append(f"a{t} AS MATERIALIZED (SELECT vec_id, any_value(a.v) AS v, min({gap} * {k} + c.c) AS m FROM k a CROSS JOIN c{t} c GROUP BY vec_id)")
        if t < rounds:
            parts.append(
                f"c{t + 1} AS MATERIALIZED (WITH x AS (SELECT m % {k} AS c, unnest(v) AS x, unnest(range(64)) AS j FROM a{t}), s AS (SELECT c, j, sum(x) AS s, count(*) AS n FROM x GROUP BY c, j),"
                f" y AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY j) AS v FROM s GROUP BY c) SELECT c{t}.c, coalesce(y.v, c{t}.v) AS v FROM c{t} LEFT JOIN y ON y.c = c{t}.c)"
            )
    last = f"""
        SELECT vec_id, CAST(m % {k} AS INTEGER) AS cluster, CAST(m // {k} AS BIGINT) AS distance, CAST(sum(m // {k}) OVER (PARTITION BY m % {k}) AS BIGINT) AS cluster_inertia,
               CAST(sum(m // {k}) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.v, ',')) AS centroid_sha256
        FROM a{rounds} a JOIN c{rounds} c ON c.c = a.m % {k}"""
    return "WITH " + ",\n".join(parts) + last


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _secrets() -> str:
    found = " UNION ALL ".join(
        f"SELECT doc_id, {n} AS kind, unnest(regexp_extract_all(t, {_quoted(p)}, 0)) AS m, unnest(regexp_extract_all(t, {_quoted(p)}, {g})) AS value,"
        f" unnest(range(len(regexp_extract_all(t, {_quoted(p)})))) AS k, unnest(string_split_regex(t, {_quoted(p)})[: len(regexp_extract_all(t, {_quoted(p)}))]) AS gap FROM d"
        for n, (p, g) in enumerate([(S.ASSIGN, 2), (S.ACCESS, 0), (S.HEX, 0), (S.RUN, 0)])
    )
    size, prior = len(S.ALPHABET), S.PRIOR
    chance = lambda n: f"(coalesce(sum(n) FILTER (l = {n}), 0) + {prior} / {size})"
    return f"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
        p AS (SELECT doc_id, kind, value, sum(length(gap) + length(m)) OVER (PARTITION BY doc_id, kind ORDER BY k) AS stop, length(m) AS n FROM f),
        q AS (SELECT doc_id, kind, value, stop - n AS start, stop FROM p WHERE kind > 0 OR length(value) >= {S.LEAST_VALUE}),
        r AS (SELECT *, kind = 3 AND EXISTS (SELECT 1 FROM q b WHERE b.kind < 3 AND b.doc_id = q.doc_id AND b.start < q.stop AND q.start < b.stop) AS touched FROM q),
        l AS (SELECT DISTINCT CASE WHEN kind < 3 THEN 1 ELSE 0 END AS l, value FROM r WHERE kind < 3 OR NOT touched AND regexp_matches(value, {_quoted(S.ORDINARY)})),
        e AS (SELECT l, string_split(lower(value), '') AS x FROM l),
        g AS (SELECT l, strpos({_quoted(S.ALPHABET)}, unnest(x[: len(x) - 1])) AS a, strpos({_quoted(S.ALPHABET)}, unnest(x[2 :])) AS b FROM e WHERE len(x) > 1),
        h AS (SELECT l, a, b, count(*)::DOUBLE AS n FROM g GROUP BY ALL UNION ALL SELECT 0, i, j, 0 FROM range(1, {size + 1}) x(i), range(1, {size + 1}) y(j)),
        c AS (SELECT a, b, {chance(1)} AS r, {chance(0)} AS o FROM h GROUP BY a, b),
        s AS (SELECT a, sum(r) AS r, sum(o) AS o FROM c GROUP BY a),
        m AS (SELECT c.a, c.b, ln((c.r / s.r) / (c.o / s.o)) AS trained, ln((1.0 / {size}) / (c.o / s.o)) AS uniform FROM c JOIN s ON c.a = s.a),
        z AS (SELECT DISTINCT value FROM r WHERE kind = 3 AND NOT touched),
        y AS (SELECT value, string_split(lower(value), '') AS x FROM z),
        v AS (SELECT value, strpos({_quoted(S.ALPHABET)}, unnest(x[: len(x) - 1])) AS a, strpos({_quoted(S.ALPHABET)}, unnest(x[2 :])) AS b FROM y),
        w AS (SELECT value, greatest(sum(trained), sum(uniform)) AS score FROM v JOIN m USING (a, b) GROUP BY value),
        k AS (SELECT r.*, ['assign', 'access', 'hex', 'random'][kind + 1] || ':' || start || ':' || stop AS s FROM r LEFT JOIN w ON w.value = r.value WHERE kind < 3 OR NOT touched AND w.score >= {S.LEAST_RATIO})
        SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
               sha256(coalesce(string_agg(s, ',' ORDER BY start, kind) FILTER (kind < 3), '')) AS base_sha256, coalesce(string_agg(s, ',' ORDER BY start, kind), '') AS spans
        FROM d LEFT JOIN k ON k.doc_id = d.doc_id GROUP BY d.doc_id
    """


KMEANS, SECRETS = _kmeans(), _secrets()
