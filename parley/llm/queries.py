"""Registered queries of the corpus operators, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ball_kmeans, bwt_merge, exact_dedup, hidden_states, host_paths, line_crf, merge_dropout, mixing, rule_ensemble, secret_spans, sketch_join, token_alignment, warc
from .oracles import KMEANS, SECRETS


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(_table(spark, sf_dir, "documents"))


def op2_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(_table(spark, sf_dir, "pages"))


def op3_line_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = line_crf.fit(docs, _table(spark, sf_dir, "labels"))
    found = line_crf.apply_rules(docs, model)
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_merge_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge_dropout.encode(_table(spark, sf_dir, "documents"))


def op5_rule_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = rule_ensemble.fit(docs, _table(spark, sf_dir, "labels"))
    return rule_ensemble.score(docs, model)


def op6_bwt_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt_merge.remove_repeats(_table(spark, sf_dir, "documents")).drop("kept")


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_classes(_table(spark, sf_dir, "documents"))


def op8_hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hidden_states.score(_table(spark, sf_dir, "documents"))


def op9_host_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_paths.extract(_table(spark, sf_dir, "pages"))


def op10_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.near_groups(_table(spark, sf_dir, "documents"), width=4, percent=85)


def op11_ball_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ball_kmeans.digest(ball_kmeans.cluster_vectors(_table(spark, sf_dir, "embeddings")))


def op12_secret_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_spans.digest(secret_spans.scan(_table(spark, sf_dir, "documents"))).drop("n_random")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.tallied(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_mix_sources": op1_mix_sources,
    "op2_warc_segments": op2_warc_segments,
    "op3_line_labels": op3_line_labels,
    "op4_merge_dropout": op4_merge_dropout,
    "op5_rule_ensemble": op5_rule_ensemble,
    "op6_bwt_merge": op6_bwt_merge,
    "op7_exact_dedup": op7_exact_dedup,
    "op8_hidden_states": op8_hidden_states,
    "op9_host_paths": op9_host_paths,
    "op10_sketch_join": op10_sketch_join,
    "op11_ball_kmeans": op11_ball_kmeans,
    "op12_secret_spans": op12_secret_spans,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op11_ball_kmeans": KMEANS,
    "op12_secret_spans": SECRETS,
    "op2_warc_segments": r"""
        WITH p AS (
            SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), f AS (
            SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 100 AND page_id <> first THEN first END AS refers_to
        FROM f
    """,
    "op7_exact_dedup": r"""
        WITH d AS (
            SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
            FROM documents
        )
        SELECT doc_id,
               min(doc_id) OVER (PARTITION BY text_sha256) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               doc_id = min(doc_id) OVER (PARTITION BY text_sha256) AS kept,
               text_sha256
        FROM d
    """,
    "op6_bwt_merge": r"""
        WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, strlen(coalesce(text, '')) AS n FROM documents),
        w AS (SELECT doc_id, i, md5_number(substring(x, 2 * i - 1, 200)) AS h FROM (SELECT doc_id, x, unnest(range(1, n - 98)) AS i FROM d WHERE n >= 100)),
        f AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS r FROM w),
        g AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 100 THEN 0 ELSE 1 END AS c FROM f WHERE r > 1),
        k AS (SELECT doc_id, i, sum(c) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g),
        s AS (SELECT doc_id, min(i) AS a, max(i) + 99 AS b FROM k GROUP BY doc_id, run),
        t AS (SELECT doc_id, a, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) + 1 AS p FROM s),
        y AS (
            SELECT t.doc_id, p, substring(x, 2 * p - 1, 2 * (a - p)) AS part FROM t JOIN d USING (doc_id)
            UNION ALL SELECT d.doc_id, coalesce(m.b, 0) + 1, substring(x, 2 * coalesce(m.b, 0) + 1) FROM d LEFT JOIN (SELECT doc_id, max(b) AS b FROM s GROUP BY doc_id) m USING (doc_id)
        ),
        z AS (SELECT doc_id, string_agg(part, '' ORDER BY p) AS x FROM y GROUP BY doc_id)
        SELECT d.doc_id, d.n AS n_bytes, coalesce(q.r, 0) AS n_removed, coalesce(q.c, 0) AS n_spans, sha256(unhex(z.x)) AS kept_sha256
        FROM d JOIN z USING (doc_id) LEFT JOIN (SELECT doc_id, CAST(sum(b - a + 1) AS BIGINT) AS r, count(*) AS c FROM s GROUP BY doc_id) q USING (doc_id)
    """,
    "op10_sketch_join": r"""
        WITH RECURSIVE d AS (
            SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
        ),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS g FROM d
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT a, b FROM c JOIN n x ON a = x.doc_id JOIN n y ON b = y.doc_id WHERE 100 * c >= 85 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT doc_id AS id, doc_id AS seen FROM documents UNION SELECT r.id, e.b FROM r JOIN e ON r.seen = e.a)
        SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(seen) FROM r WHERE r.id = d.doc_id) AS component_id
        FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
    """,
}
