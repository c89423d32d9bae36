"""SQL twins of the catalogue's queries, written on their own from the operators' definitions."""

from __future__ import annotations

SEG = r"""
WITH wc AS (SELECT *, 400 * len(regexp_extract_all(coalesce(text, ''), '\S+')) AS d FROM conversations),
seg0 AS (
    SELECT conv_id AS file_id, turn AS ord, role AS speaker, text, d,
           CAST(greatest(0, coalesce(sum(d) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
               + CASE turn % 3 WHEN 1 THEN 700 WHEN 2 THEN -100 ELSE 0 END) AS BIGINT) AS start_ms
    FROM wc
),
seg AS (SELECT file_id, ord, speaker, text, start_ms, CAST(start_ms + d AS BIGINT) AS end_ms, CAST(d AS BIGINT) AS dur FROM seg0)
"""
TURNS = SEG + """,
t0 AS (SELECT *, lag(speaker) OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS prev FROM seg),
turns AS (
    SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS turn, ord, speaker, start_ms, end_ms, dur AS duration_ms
    FROM t0 WHERE prev IS DISTINCT FROM speaker AND dur > 0
),
cuts AS (
    SELECT * FROM (SELECT file_id, ord, speaker, lag(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, ord) - start_ms AS over_ms FROM seg)
    WHERE over_ms > 0
),
lat AS (
    SELECT * FROM (SELECT file_id, turn, start_ms - lag(end_ms) OVER (PARTITION BY file_id ORDER BY turn) AS latency_ms FROM turns)
    WHERE latency_ms BETWEEN 0 AND 5000
)
"""
FRAMES = """
WITH frm0 AS (
    SELECT user_id AS file_id, event_type AS label, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS frame,
           least(value / 100, 1.0) AS score
    FROM events
),
frm AS (SELECT *, (frame - 1) * 500 AS start_ms, (frame - 1) * 500 + 1000 AS end_ms FROM frm0)
"""
SWITCH = FRAMES + """,
s1 AS (SELECT *, CASE WHEN score >= 0.5 THEN 1 WHEN score <= 0.35 THEN 0 END AS sw FROM frm),
s2 AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY file_id, label ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM s1),
s3 AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY file_id, label ORDER BY frame), 0) AS was FROM s2),
s4 AS (SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, label ORDER BY frame) AS ev FROM s3),
hys AS (
    SELECT file_id, label, ev, min(frame) FILTER (st = 1) AS f1, max(frame) FILTER (st = 1) AS f2, max(frame) FILTER (st = 0) AS fx,
           min(start_ms) FILTER (st = 1) AS start_ms, max(end_ms) FILTER (st = 1) AS e2, max(end_ms) FILTER (st = 0) AS ex, max(score) AS score
    FROM s4 WHERE st = 1 OR was = 1 GROUP BY ALL
),
eva AS (SELECT file_id, label, start_ms, coalesce(ex, e2) AS end_ms, score FROM hys),
runb AS (SELECT file_id, label, f1 AS first_frame, f2 + 1 AS end_frame, (f1 - 1) * 500 AS start_ms, (f2 - 1) * 500 + 1000 AS end_ms, score FROM hys)
"""
OVERLAPS = SEG + """,
pair AS (
    SELECT a.file_id, a.ord AS ord_a, b.ord AS ord_b, a.speaker AS spk_a, b.speaker AS spk_b, a.start_ms AS sa, b.start_ms AS sb,
           least(a.end_ms, b.end_ms) - b.start_ms AS overlap_ms
    FROM seg a JOIN seg b ON a.file_id = b.file_id AND (a.start_ms, a.ord) < (b.start_ms, b.ord) AND b.start_ms < a.end_ms AND a.start_ms < b.end_ms
    WHERE least(a.end_ms, b.end_ms) - b.start_ms >= 50
),
onset AS (
    SELECT file_id, sb AS at_ms, CASE WHEN sa = sb THEN spk_a ELSE spk_b END AS interrupter, CASE WHEN sa = sb THEN spk_b ELSE spk_a END AS interrupted, overlap_ms
    FROM pair WHERE spk_a <> spk_b AND sb - sa <= 150
),
sides AS (SELECT file_id, spk_a AS speaker, overlap_ms FROM pair UNION ALL SELECT file_id, spk_b, overlap_ms FROM pair),
sums AS (SELECT file_id, speaker, sum(overlap_ms) AS overlap_ms FROM sides GROUP BY ALL),
made AS (SELECT file_id, interrupter AS speaker, count(*) AS n FROM onset GROUP BY ALL),
got AS (SELECT file_id, interrupted AS speaker, count(*) AS n FROM onset GROUP BY ALL),
byspk AS (SELECT s.file_id, s.speaker, s.overlap_ms, coalesce(m.n, 0) AS interruptions FROM sums s LEFT JOIN made m USING (file_id, speaker))
"""
COVER = SEG + ",\n" + SWITCH.strip().removeprefix("WITH ") + """,
sev AS (
    SELECT g.file_id, g.ord, e.label, least(g.end_ms, e.end_ms) - greatest(g.start_ms, e.start_ms) AS overlap_ms,
           (least(g.end_ms, e.end_ms) - greatest(g.start_ms, e.start_ms)) * greatest(e.score, 0) AS weight
    FROM seg g JOIN eva e ON g.file_id = e.file_id AND g.start_ms < e.end_ms AND e.start_ms < g.end_ms
),
lab AS (SELECT file_id, ord, label, sum(overlap_ms) AS overlap_ms, sum(weight) AS weight FROM sev GROUP BY ALL),
top3 AS (
    SELECT * FROM (SELECT file_id, ord, label, overlap_ms, weight / overlap_ms AS score,
                          row_number() OVER (PARTITION BY file_id, ord ORDER BY round(weight, 6) DESC, round(weight / overlap_ms, 6) DESC, label) AS place FROM lab)
    WHERE place <= 3
),
snr AS (
    SELECT file_id, ord, greatest(-5.0, least(35.0, 35 - 35 * least(1.0, 0.5 * least(1.0, o / dur) + 0.5 * least(1.0, w / dur)))) AS snr_db
    FROM (SELECT file_id, ord, sum(overlap_ms) AS o, sum(weight) AS w FROM sev GROUP BY ALL) JOIN seg USING (file_id, ord)
    WHERE dur > 0 AND o > 0
)
"""
TOKENS = r"""
WITH tk AS (
    SELECT conv_id, turn, role, text, lower(text) AS low, ' ' || lower(text) || ' ' AS pad,
           list_filter(regexp_extract_all(lower(text), '[\p{L}\p{N}][\p{L}\p{N}''-]*'), lambda w: length(w) > 1 OR w IN ('i', 'a')) AS w
    FROM conversations
)
"""


def _count(column: str, part: str) -> str:
    quoted = part.replace("'", "''")
    return f"(length({column}) - length(replace({column}, '{quoted}', ''))) // {len(part)}"


FILLERS = " + ".join(_count("pad", f" {p} ") for p in ("you know", "i mean", "sort of", "kind of", "let me see", "let's see"))
SINGLE = "('um','uh','erm','er','mm','hmm','like','kinda','right','okay','ok','so','well','uhh','umm','basically','literally','actually','totally','absolutely','definitely','anyway')"
MARKS = " + ".join(_count("pad", p) for p in (" - ", "—", " -- ", "... ", " … ", " i - i ", " we - we ", " they - they ", " you - you ", " he - he ", " she - she ", " it - it "))
ALLOC = SEG + r""",
spans AS (SELECT file_id, ord, dur, dur * 1.0 / sum(dur) OVER (PARTITION BY file_id) AS share FROM seg),
txt AS (SELECT file_id, regexp_extract_all(string_agg(text, ' ' ORDER BY ord), '\S+') AS w FROM seg GROUP BY file_id),
al AS (SELECT s.file_id, s.ord, greatest(1, CAST(floor(len(t.w) * s.share) AS BIGINT)) AS n, t.w FROM spans s JOIN txt t USING (file_id) WHERE len(t.w) > 0),
al2 AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY file_id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS gone FROM al)
"""
UNIT = """
WITH part AS (SELECT label, generate_subscripts(embedding, 1) AS i, unnest(embedding)::DOUBLE AS x, vec_id FROM embeddings),
mean AS (SELECT label, i, avg(x) AS x FROM part GROUP BY ALL),
cen AS (SELECT label, i, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9) AS x FROM mean),
cen2 AS (SELECT label, i, x / (sqrt(sum(x * x) OVER (PARTITION BY label)) + 1e-9) AS x FROM cen),
len AS (SELECT vec_id, sqrt(sum(x * x)) + 1e-9 AS n FROM part GROUP BY ALL),
sim AS (SELECT p.vec_id, 'speaker_' || c.label AS name, sum(p.x * c.x) / any_value(l.n) AS s FROM part p JOIN cen2 c ON p.i = c.i JOIN len l ON p.vec_id = l.vec_id GROUP BY ALL),
best AS (SELECT vec_id, name, s FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) AS r FROM sim) WHERE r = 1)
"""
PROPS = """
WITH ev AS (SELECT *, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)
"""
SHARES = """
WITH n AS (SELECT user_id, event_type, sum(value) AS s FROM events GROUP BY ALL),
sh AS (SELECT user_id, event_type, s / sum(s) OVER (PARTITION BY user_id) AS p FROM n)
"""

SQL: dict[str, str] = {
    "flow_turns": TURNS + "SELECT * FROM turns",
    "flow_interruptions": TURNS + "SELECT * FROM cuts",
    "flow_latency": TURNS + """
        SELECT f.file_id, coalesce(round(avg(latency_ms) / 1000, 6), 0.0) AS avg_sec, coalesce(round(median(latency_ms) / 1000, 6), 0.0) AS median_sec, count(latency_ms) AS count
        FROM (SELECT DISTINCT file_id FROM seg) f LEFT JOIN lat USING (file_id) GROUP BY f.file_id""",
    "flow_dominance": SEG + "SELECT file_id, speaker, CAST(sum(dur) AS BIGINT) AS speech_ms, CASE WHEN sum(sum(dur)) OVER (PARTITION BY file_id) > 0 THEN round(sum(dur) / sum(sum(dur)) OVER (PARTITION BY file_id) * 100, 6) ELSE 0 END AS dominance_pct FROM seg GROUP BY file_id, speaker",
    "flow_balance_entropy": SEG + """
        , d AS (SELECT file_id, speaker, sum(dur) / nullif(sum(sum(dur)) OVER (PARTITION BY file_id), 0) AS p FROM seg GROUP BY file_id, speaker)
        SELECT file_id, count(*) AS speakers, CASE WHEN count(*) FILTER (p > 0) > 1 THEN round(-sum(CASE WHEN p > 0 THEN p * log2(p) END) / log2(count(*) FILTER (p > 0)), 6) ELSE 0 END AS balance
        FROM d GROUP BY file_id""",
    "flow_silence_pace": TURNS + """
        , f AS (SELECT file_id, max(end_ms) AS total_ms, CAST(sum(dur) AS BIGINT) AS speech_ms FROM seg GROUP BY file_id),
        o AS (SELECT file_id, count(*) AS turns, avg(duration_ms) AS mean FROM turns GROUP BY file_id), c AS (SELECT file_id, count(*) AS cuts FROM cuts GROUP BY file_id)
        SELECT file_id, total_ms, speech_ms, round(greatest(0.0, least(1.0, (total_ms - speech_ms) / total_ms)), 6) AS silence_ratio, coalesce(turns, 0) AS turns,
               round(coalesce(turns, 0) / (total_ms / 60000), 6) AS turns_per_min, round(coalesce(mean / 1000, 0), 6) AS avg_turn_sec,
               coalesce(cuts, 0) AS interruptions, round(coalesce(cuts, 0) / (total_ms / 60000), 6) AS interruptions_per_min
        FROM f LEFT JOIN o USING (file_id) LEFT JOIN c USING (file_id)""",
    "flow_topic_coherence": SEG + r"""
        , l AS (SELECT *, list_distinct(list_filter(regexp_extract_all(lower(text), '\S+'), lambda w: length(w) > 3)) AS own FROM seg),
        p AS (SELECT file_id, own, lag(own) OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS prev FROM l),
        j AS (SELECT file_id, CASE WHEN len(prev) > 0 AND len(own) > 0 THEN len(list_intersect(own, prev)) / len(list_distinct(list_concat(own, prev))) END AS sim FROM p)
        SELECT file_id, count(sim) AS pairs, round(coalesce(avg(sim), CASE WHEN count(*) < 2 THEN 1 ELSE 0 END), 6) AS coherence FROM j GROUP BY file_id""",
    "flow_energy_buckets": SEG + """
        , f AS (SELECT file_id, max(end_ms) AS total_ms FROM seg GROUP BY file_id),
        w AS (SELECT file_id, total_ms, unnest(range(0, greatest(total_ms // 30000, 1))) AS win FROM f WHERE total_ms > 0),
        b AS (SELECT file_id, win, win * 30000 AS ws, least((win + 1) * 30000, total_ms) AS we FROM w)
        SELECT b.file_id, win AS "window", ws AS window_start_ms, we AS window_end_ms, count(DISTINCT speaker) AS speakers,
               CAST(coalesce(sum(least(end_ms, we) - greatest(start_ms, ws)), 0) AS BIGINT) AS speech_ms, round(coalesce(sum(least(end_ms, we) - greatest(start_ms, ws)), 0) / 30000, 6) AS density,
               round(coalesce(avg((ord % 10) / 10.0), 0) * coalesce(sum(least(end_ms, we) - greatest(start_ms, ws)), 0) / 30000, 6) AS energy
        FROM b LEFT JOIN seg ON b.file_id = seg.file_id AND start_ms < we AND ws < end_ms GROUP BY ALL""",
    "speaker_rollup_core": SEG + "SELECT file_id, speaker, count(*) AS segments, CAST(sum(dur) AS BIGINT) AS duration_ms, CAST(sum(dur) / 400 AS BIGINT) AS words, CASE WHEN sum(dur) > 0 THEN round((sum(dur) / 400) * 60000.0 / sum(dur), 6) ELSE 0 END AS wpm FROM seg GROUP BY file_id, speaker",
    "speaker_rollup_median": PROPS + "SELECT user_id AS file_id, event_type AS speaker, round(coalesce(median(value), 0), 6) AS med_value, round(coalesce(median(k), 0), 6) AS med_k FROM ev GROUP BY ALL",
    "speaker_vote_argmax": """
        SELECT user_id AS file_id, event_type, n AS votes FROM (
            SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY ALL)
        ) WHERE r = 1""",
    "speaker_emotion_distribution": SHARES + "SELECT user_id, event_type, round(p, 6) AS share FROM sh",
    "speaker_top5_labels": SHARES + "SELECT user_id, place, event_type, round(p, 6) AS share FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY round(p, 9) DESC, event_type) AS place FROM sh) WHERE place <= 5",
    "speaker_loudness_orderstat": """
        WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY value) - 1 AS p, count(*) OVER (PARTITION BY user_id) AS n FROM events)
        SELECT user_id, CASE WHEN max(n) >= 4 THEN round(greatest(0, (max(value) FILTER (p = floor(n * 0.75)) - max(value) FILTER (p = floor(n * 0.25))) * 20), 6) ELSE 0 END AS spread FROM r GROUP BY user_id""",
    "speaker_lead": SEG + """
        , s AS (SELECT file_id, speaker, CAST(sum(dur) AS BIGINT) AS d FROM seg GROUP BY ALL)
        SELECT file_id, speaker, d AS duration_ms, n AS speakers, round(CASE WHEN a > 0 THEN d / a * 100 ELSE 0 END, 6) AS share_pct
        FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY d DESC, speaker) AS r, sum(d) OVER (PARTITION BY file_id) AS a, count(*) OVER (PARTITION BY file_id) AS n FROM s) WHERE r = 1""",
    "overlap_pairs": OVERLAPS + "SELECT file_id, ord_a, ord_b, overlap_ms FROM pair",
    "overlap_by_speaker": OVERLAPS + "SELECT file_id, speaker, CAST(overlap_ms AS BIGINT) AS overlap_ms, interruptions FROM byspk",
    "overlap_by_file": OVERLAPS + """
        , f AS (SELECT file_id, max(end_ms) - min(start_ms) AS span FROM seg GROUP BY file_id), p AS (SELECT file_id, sum(overlap_ms) AS o, count(*) AS n FROM pair GROUP BY file_id)
        SELECT file_id, CAST(coalesce(o, 0) AS BIGINT) AS overlap_ms, coalesce(n, 0) AS pairs, round(coalesce(coalesce(o, 0) / nullif(span, 0), 0), 6) AS overlap_ratio FROM f LEFT JOIN p USING (file_id)""",
    "interruption_onsets": OVERLAPS.replace("\npair AS (", "\nsnap AS (SELECT file_id, ord, speaker, start_ms - start_ms % 4000 AS start_ms, end_ms FROM seg),\npair AS (").replace("FROM seg a JOIN seg b", "FROM snap a JOIN snap b") + "SELECT * FROM onset",
    "ema_centroid": """
        WITH RECURSIVE o AS (SELECT label, CAST(embedding AS DOUBLE[]) AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS r FROM embeddings),
        m AS (
            SELECT label, r, list_transform(e, lambda x: x / (sqrt(list_dot_product(e, e)) + 1e-9)) AS c FROM o WHERE r = 1
            UNION ALL SELECT label, r, list_transform(b, lambda x: x / (sqrt(list_dot_product(b, b)) + 1e-9))
            FROM (SELECT o.label, o.r, list_transform(range(1, len(o.e) + 1), lambda i: 0.7 * m.c[i] + 0.3 * o.e[i]) AS b FROM m JOIN o ON o.label = m.label AND o.r = m.r + 1)
        )
        SELECT label, r AS samples, CAST(unnest(range(0, len(c))) AS INTEGER) AS place, round(unnest(c), 6) AS x FROM m QUALIFY r = max(r) OVER (PARTITION BY label)""",
    "longest_segment": SEG + "SELECT file_id, ord, end_ms - start_ms AS length_ms FROM seg QUALIFY row_number() OVER (PARTITION BY file_id ORDER BY end_ms - start_ms DESC, start_ms, ord) = 1",
    "text_emotion_rollup": """
        WITH r AS (
            SELECT user_id, event_type AS label, value, CASE WHEN event_id % 3 = 0 AND user_id % 7 <> 0 THEN 1 ELSE 0 END AS f
            FROM events WHERE user_id % 11 <> 0 AND event_type IN ('click', 'error', 'purchase')
        ),
        s AS (SELECT user_id, label, f, sum(value) AS s FROM r GROUP BY ALL),
        p AS (SELECT user_id, label, s FROM s WHERE s > 0 QUALIFY f = max(f) OVER (PARTITION BY user_id))
        SELECT user_id, label, round(s / sum(s) OVER (PARTITION BY user_id), 6) AS share FROM p
        UNION ALL SELECT DISTINCT user_id, 'neutral', 1.0 FROM events WHERE user_id NOT IN (SELECT user_id FROM p)""",
    "event_rows": SWITCH + "SELECT file_id, printf('%.6f', start_ms / 1000) AS start, printf('%.6f', end_ms / 1000) AS \"end\", label, printf('%.4f', score) AS score, 'frames' AS source, '0.50' AS enter, '0.35' AS leave, 5 AS median_k FROM eva",
    "audio_quality_gate": """
        WITH x AS (
            SELECT vec_id // 40 AS key, (vec_id % 40) * 64 + i - 1 AS pos, embedding[i]::DOUBLE * CASE WHEN vec_id // 40 % 5 = 4 THEN 8 WHEN vec_id % 3 = 0 THEN 1 ELSE 0.015625 END AS x
            FROM embeddings, (SELECT unnest(range(1, 65)) AS i) WHERE vec_id // 40 % 5 <> 3 OR vec_id % 40 < 8
        ),
        n AS (SELECT key, count(*) AS n, avg(x * x) AS power, avg(CASE WHEN abs(x) > 0.95 THEN 1.0 ELSE 0.0 END) AS clipping, least(400, count(*) // 20) AS frame, least(400, count(*) // 20) // 2 AS hop FROM x GROUP BY key),
        f AS (SELECT key, frame, hop, unnest(range(0, n - frame, hop)) AS a FROM n WHERE frame >= 64),
        e AS (SELECT f.key, a, avg(x * x) AS e FROM f JOIN x ON x.key = f.key AND pos >= a AND pos < a + frame GROUP BY f.key, a),
        l AS (SELECT key, count(*) AS k, quantile_cont(e, 0.05) AS lo, quantile_cont(e, 0.85) AS hi, max(e) AS top FROM e GROUP BY key),
        g AS (SELECT n.*, k, lo, CASE WHEN lo <= 0 THEN 10 ELSE 10 * log10((hi + 1e-12) / (lo + 1e-12)) END AS snr, 10 * log10((top + 1e-12) / (lo + 1e-12)) AS r FROM n LEFT JOIN l USING (key)),
        h AS (SELECT *, n >= 1600 AND snr >= 6 AND clipping < 0.03 AND r >= 12 AS fine, CASE WHEN n < 800 THEN 'too_short' WHEN sqrt(power) < 1e-8 THEN 'silent' WHEN frame < 64 THEN 'insufficient_length' WHEN coalesce(k, 0) < 5 THEN 'insufficient_frames' END AS early FROM g)
        SELECT key, round(CASE early WHEN 'too_short' THEN -40 WHEN 'silent' THEN -60 WHEN 'insufficient_length' THEN -30 WHEN 'insufficient_frames' THEN -30 ELSE snr END, 6) AS snr_db, round(clipping, 6) AS clipping, round(r, 6) AS range_db,
               early IS NULL AND coalesce(fine, false) AS reliable,
               coalesce(early, CASE WHEN fine THEN 'reliable' WHEN snr < 6 THEN 'low_snr' WHEN clipping >= 0.03 THEN 'clipping' WHEN r < 12 THEN 'low_dr' ELSE 'short_duration' END) AS status FROM h""",
    "interrupt_full_outer": OVERLAPS + """
        , a AS (SELECT file_id, speaker, b.interruptions, m.n AS m, b.overlap_ms FROM byspk b FULL JOIN made m USING (file_id, speaker))
        SELECT file_id, speaker, coalesce(interruptions, m, 0) AS made, coalesce(g.n, 0) AS received, CAST(coalesce(overlap_ms, 0) AS BIGINT) AS overlap_ms FROM a FULL JOIN got g USING (file_id, speaker)""",
    "segment_event_join": COVER + "SELECT file_id, ord, label, overlap_ms, round(weight, 6) AS weight FROM sev",
    "segment_event_top3": COVER + "SELECT file_id, ord, place, label, CAST(overlap_ms AS BIGINT) AS overlap_ms, round(score + 1e-9, 6) AS score FROM top3",
    "segment_event_snr": COVER + "SELECT file_id, ord, round(snr_db, 6) AS snr_db FROM snr",
    "turns_left_events": COVER + """
        , l AS (SELECT file_id, ord, string_agg(label, ',' ORDER BY place) AS labels FROM top3 GROUP BY ALL)
        SELECT file_id, ord, coalesce(labels, '') AS labels, round(snr_db, 6) AS snr_db FROM seg LEFT JOIN l USING (file_id, ord) LEFT JOIN snr USING (file_id, ord)""",
    "sed_hysteresis_a": SWITCH + "SELECT file_id, label, start_ms, end_ms, round(score, 6) AS score FROM eva",
    "sed_hysteresis_b": SWITCH + "SELECT file_id, label, first_frame, end_frame, start_ms, end_ms, round(score, 6) AS score FROM runb",
    "sed_min_dur_merge": SWITCH + """
        , k AS (SELECT * FROM eva WHERE end_ms - start_ms >= CASE WHEN label = 'error' THEN 2500 ELSE 2000 END),
        a AS (SELECT *, CASE WHEN lag(label) OVER w IS DISTINCT FROM label THEN 1 ELSE 0 END AS c FROM k WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, end_ms, label)),
        b AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms, label) AS g FROM a),
        d AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id, g ORDER BY start_ms, end_ms, label ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM b),
        e AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, g ORDER BY start_ms, end_ms, label) AS i FROM d)
        SELECT file_id, any_value(label) AS label, min(start_ms) AS start_ms, max(end_ms) AS end_ms, round(max(score), 6) AS score, count(*) AS n_events FROM e GROUP BY file_id, g, i""",
    "sed_merge_then_filter": SWITCH + """
        , d AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id, label ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM runb),
        e AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 200 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id, label ORDER BY start_ms, end_ms) AS i FROM d)
        SELECT file_id, label, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans, round(max(score), 6) AS score FROM e GROUP BY file_id, label, i HAVING max(end_ms) - min(start_ms) >= 1500""",
    "sed_median_filter": FRAMES + """
        , z AS (SELECT *, list(score) OVER (PARTITION BY file_id, label ORDER BY frame ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS l FROM frm)
        SELECT file_id, label, frame, round(list_sort(list_concat(l, list_transform(range(5 - len(l)), lambda x: 0.0)))[3], 6) AS smooth FROM z""",
    "sed_label_collapse": FRAMES + "SELECT file_id, frame, CASE label WHEN 'click' THEN 'browse' WHEN 'view' THEN 'browse' WHEN 'purchase' THEN 'account' WHEN 'signup' THEN 'account' ELSE label END AS label, round(max(score), 6) AS score FROM frm GROUP BY ALL",
    "sed_frame_topk": FRAMES + "SELECT file_id, frame, place, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY file_id, frame ORDER BY score DESC, label) AS place FROM frm) WHERE place <= 3",
    "noise_score_snr": """
        WITH t AS (SELECT user_id AS file_id, CASE event_type WHEN 'click' THEN 'Typing on keyboard' WHEN 'error' THEN 'Wind noise' ELSE 'Speech' END AS label, value / 10000 AS score FROM events),
        n AS (SELECT file_id, coalesce(sum(score) FILTER (regexp_matches(lower(label), 'music|noise|typing|keyboard|applause|traffic|engine|vehicle|crowd|siren|wind|rain|tv')), 0) AS s FROM t GROUP BY file_id)
        SELECT file_id, round(s, 6) AS noise_score, round(CASE WHEN s <= 0 THEN 35 ELSE greatest(-5.0, least(35.0, 35 - 20 * log10(1 + 10 * s))) END, 6) AS snr_db FROM n""",
    "regions_merge_gap": SEG + """
        , d AS (SELECT *, max(end_ms) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM seg),
        e AS (SELECT *, sum(CASE WHEN reach IS NULL OR start_ms - reach > 300 THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY start_ms, end_ms ROWS UNBOUNDED PRECEDING) AS i FROM d)
        SELECT file_id, min(start_ms) AS start_ms, max(end_ms) AS end_ms, count(*) AS n_spans FROM e GROUP BY file_id, i""",
    "regions_rle": FRAMES + """
        , a AS (SELECT *, score >= 0.5 AS loud FROM frm),
        b AS (SELECT *, CASE WHEN lag(loud) OVER (PARTITION BY file_id, label ORDER BY frame) IS DISTINCT FROM loud THEN 1 ELSE 0 END AS c FROM a),
        d AS (SELECT *, sum(c) OVER (PARTITION BY file_id, label ORDER BY frame) AS i FROM b)
        SELECT file_id, label, any_value(loud) AS loud, min(frame) AS first, max(frame) AS last, count(*) AS n_rows FROM d GROUP BY file_id, label, i""",
    "same_speaker_merge": SEG + """
        , a AS (SELECT *, CASE WHEN lag(speaker) OVER w IS DISTINCT FROM speaker OR start_ms - lag(end_ms) OVER w > 1000 THEN 1 ELSE 0 END AS c FROM seg WINDOW w AS (PARTITION BY file_id ORDER BY start_ms, ord)),
        b AS (SELECT *, sum(c) OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS i FROM a)
        SELECT file_id, any_value(speaker) AS speaker, min(start_ms) AS start_ms, arg_max(end_ms, (start_ms, ord)) AS end_ms, count(*) AS n_spans FROM b GROUP BY file_id, i""",
    "span_vote": SEG + """
        , r AS (SELECT file_id, unnest(range(0, max(end_ms) // 20000 + 1)) AS region FROM seg GROUP BY file_id),
        rr AS (SELECT file_id, region, region * 20000 AS rs, region * 20000 + 20000 AS re FROM r),
        p AS (SELECT rr.*, speaker, start_ms, end_ms FROM rr JOIN seg ON rr.file_id = seg.file_id AND rs < end_ms AND start_ms < re),
        t AS (SELECT DISTINCT file_id, region, unnest([greatest(rs, start_ms), least(re, end_ms), rs, re]) AS t FROM p),
        c AS (SELECT file_id, region, t AS a, lead(t) OVER (PARTITION BY file_id, region ORDER BY t) AS b FROM t),
        v AS (SELECT c.file_id, region, a, b, speaker, sum(least(b, end_ms) - greatest(a, start_ms)) AS v FROM c JOIN seg ON c.file_id = seg.file_id AND a < end_ms AND start_ms < b WHERE b > a GROUP BY ALL)
        SELECT file_id, region, a AS start_ms, b AS end_ms, speaker, CAST(v AS BIGINT) AS vote_ms FROM (SELECT *, row_number() OVER (PARTITION BY file_id, region, a ORDER BY v DESC, speaker) AS n FROM v) WHERE n = 1""",
    "sliding_windows": SEG + """
        , w AS (SELECT file_id, ord, start_ms, end_ms, unnest(range(0, greatest(CAST(ceil(dur / 750) AS BIGINT), 1))) AS k FROM seg)
        SELECT file_id, ord, k AS "window", start_ms + k * 750 AS win_start_ms, least(start_ms + k * 750 + 1500, end_ms) AS win_end_ms FROM w WHERE least(start_ms + k * 750 + 1500, end_ms) - (start_ms + k * 750) >= 600""",
    "chunk_plan": SEG + """
        , f AS (SELECT file_id, max(end_ms) AS t FROM seg GROUP BY file_id), g AS (SELECT *, CASE WHEN t >= 60000 THEN 20000 ELSE greatest(t, 1) END AS s FROM f),
        h AS (SELECT *, unnest(range(0, greatest(CAST(ceil(t / s) AS BIGINT), 1))) AS chunk FROM g)
        SELECT file_id, chunk, chunk * s AS start_ms, least((chunk + 1) * s, t) AS end_ms, greatest(chunk * s - 3000, 0) AS lap_start_ms, least(least((chunk + 1) * s, t) + 3000, t) AS lap_end_ms FROM h""",
    "word_tokenize": TOKENS + "SELECT conv_id, turn, len(w) AS n_tokens, len(list_distinct(w)) AS n_distinct, array_to_string(w, ' ') AS joined FROM tk",
    "filler_count": TOKENS + f"SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN {FILLERS} + len(list_filter(w, lambda x: x IN {SINGLE})) ELSE 0 END AS fillers FROM tk",
    "repetition_count": TOKENS + f"""
        SELECT conv_id, turn,
            len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2 AND w[i] NOT IN ('the','a','an','to','of','in','on','at','by')))
            + len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 2] AND length(w[i]) > 3 AND (w[i + 1] IN {SINGLE} OR length(w[i + 1]) <= 2))) AS repetitions FROM tk""",
    "false_start_count": TOKENS + f"""
        SELECT conv_id, turn, CASE WHEN len(w) > 0 THEN {MARKS}
            + len(list_filter(range(1, len(w) - 2), lambda i: length(w[i]) > 2 AND length(w[i + 2]) > 2 AND w[i] <> w[i + 2] AND w[i + 1] IN ('um','uh','er'))) ELSE 0 END AS false_starts FROM tk""",
    "syllable_estimate": TOKENS + r"""
        , u AS (SELECT conv_id, turn, unnest(w) AS x FROM tk),
        v AS (SELECT *, len(regexp_extract_all(x, '[aeiouy]+')) AS c FROM u)
        SELECT conv_id, turn, CAST(sum(CASE WHEN length(x) <= 1 THEN 1 ELSE greatest(1, c - CASE WHEN x LIKE '%e' AND length(x) > 2 AND c > 1 THEN 1 ELSE 0 END
            + CASE WHEN regexp_matches(x, '(tion|sion|cial|tial|ious|eous)$') THEN 1 ELSE 0 END) END) AS BIGINT) AS syllables FROM v GROUP BY ALL""",
    "backchannel": TOKENS.replace("role, text,", "role, place, text,").replace("FROM conversations", "FROM (SELECT conv_id, turn, role, unnest(string_split(text, ' ')) AS text, CAST(unnest(range(0, len(string_split(text, ' ')))) AS INTEGER) AS place FROM conversations)") + """
        , s AS (SELECT conv_id, turn, place, array_to_string(w, ' ') AS j, len(w) AS n, 400 * len(regexp_extract_all(text, '\\S+')) AS d FROM tk),
        b AS (SELECT *, CASE WHEN n <= 3 AND j IN ('mm','mmm','mhmm','uh-huh','yeah','yep','yes','okay','ok','right','sure','exactly','absolutely','definitely','totally','i see','oh','wow','really','interesting','hmm') THEN 1.0
            WHEN n = 1 AND regexp_matches(j, 'mm|oh|ah|um') THEN 0.7 END AS c FROM s WHERE d <= 1200)
        SELECT conv_id, turn, place, c AS confidence_text, c / 2 AS confidence_combined FROM b WHERE c IS NOT NULL""",
    "action_items": "SELECT conv_id, turn, role, text FROM conversations WHERE role = 'system' OR contains(lower(text), 'let''s ') OR contains(lower(text), 'we will')",
    "key_moments": SEG + "SELECT file_id, ord, place FROM (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY dur DESC, start_ms, ord) AS place FROM seg) WHERE place <= 5 AND dur > 20000",
    "cosine_nearest": UNIT + "SELECT vec_id, name, round(s, 5) AS similarity FROM best",
    "registry_threshold_bands": UNIT + "SELECT vec_id, s >= 0.7 AS assigned, s >= 0.6 AND s < 0.7 AS needs_review FROM best",
    "centroid_pool": UNIT + ", n AS (SELECT label, count(*) AS c FROM embeddings GROUP BY ALL) SELECT 'speaker_' || c.label AS name, n.c AS samples, c.i - 1 AS place, round(c.x, 6) AS x FROM cen c JOIN n ON c.label = n.label",
    "softmax_norm": SHARES + ", e AS (SELECT user_id, event_type, exp(p - max(p) OVER (PARTITION BY user_id)) AS e FROM sh) SELECT user_id, event_type, round(e / sum(e) OVER (PARTITION BY user_id), 6) AS p FROM e",
    "entropy_confidence": SHARES + """
        , a AS (SELECT user_id, list(p ORDER BY p DESC) AS l, -sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END) AS e, count(*) FILTER (p > 0) AS n FROM sh GROUP BY user_id),
        b AS (SELECT user_id, e, CASE WHEN n > 1 THEN e / ln(n) ELSE 0 END AS ne, CASE WHEN len(l) = 1 THEN l[1] ELSE l[1] - l[2] END AS m, l[1] AS t FROM a)
        SELECT user_id, round(e, 6) AS entropy, round(ne, 6) AS normal_entropy, round(m, 6) AS margin, t < 0.55 OR m < 0.18 OR ne > 0.85 AS low_confidence FROM b""",
    "affect_hint": """
        WITH a AS (SELECT event_id, (event_id % 201 - 100) / 100.0 AS v, (event_id % 97) / 96.0 AS a, event_type AS i FROM events)
        SELECT event_id, CASE WHEN a > 0.55 AND v < 0 THEN 'agitated-negative' WHEN a < 0.30 AND v > 0.25 THEN 'calm-positive' WHEN v > 0.5 THEN 'bright-' || i WHEN v < -0.35 THEN 'low-' || i ELSE 'neutral-' || i END AS hint FROM a""",
    "anomaly_flags": """
        WITH f AS (SELECT event_id, value AS wpm, (event_id % 21) * 1.0 AS d, (event_id % 11) / 16.0 AS p FROM events),
        s AS (SELECT *, (CASE WHEN wpm < 80 OR wpm > 300 THEN 1.0 ELSE 0 END) + (CASE WHEN d > 15 THEN 1.5 WHEN d > 8 THEN 0.5 ELSE 0 END) + (CASE WHEN p > 0.5 THEN 1.0 WHEN p < 0.05 THEN 0.5 ELSE 0 END) AS s FROM f)
        SELECT event_id, concat_ws(',', CASE WHEN wpm < 80 THEN 'very_slow_speech' WHEN wpm > 300 THEN 'very_fast_speech' END, CASE WHEN d > 15 THEN 'high_disfluency' WHEN d > 8 THEN 'elevated_disfluency' END,
            CASE WHEN p > 0.5 THEN 'excessive_pausing' WHEN p < 0.05 THEN 'minimal_pausing' END) AS flags, CAST(s AS DOUBLE) AS severity, CASE WHEN s >= 3 THEN 'high' WHEN s >= 1.5 THEN 'moderate' WHEN s >= 0.5 THEN 'mild' ELSE 'normal' END AS word FROM s""",
    "pattern_stats": PROPS + """
        , l AS (SELECT user_id, 'value' AS feature, value AS v FROM ev UNION ALL SELECT user_id, 'k', k FROM ev)
        SELECT user_id, feature, count(*) AS n, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std, round(median(v), 6) AS median, round(min(v), 6) AS min, round(max(v), 6) AS max FROM l WHERE v <> 0 GROUP BY ALL""",
    "percentile_iqr": """
        WITH b AS (SELECT user_id, quantile_cont(value, 0.25) AS a, quantile_cont(value, 0.75) AS b FROM events GROUP BY ALL),
        i AS (SELECT e.user_id, value, CASE WHEN value BETWEEN a - 1.5 * (b - a) AND b + 1.5 * (b - a) THEN value END AS v FROM events e JOIN b USING (user_id))
        SELECT user_id, count(value) AS n, count(v) AS kept, round(CASE WHEN count(v) * 2 > count(value) THEN median(v) ELSE median(value) END, 6) AS median,
            round(CASE WHEN count(v) * 2 > count(value) THEN quantile_cont(v, 0.75) - quantile_cont(v, 0.25) ELSE quantile_cont(value, 0.75) - quantile_cont(value, 0.25) END, 6) AS iqr FROM i GROUP BY ALL""",
    "tuner_rules": """
        WITH h AS (SELECT event_id, (event_id % 34) * 1.0 AS snr, (event_id % 101) / 100.0 AS sil, 6.0 + event_id % 13 AS dyn, event_id % 7 = 0 AS clip FROM events)
        SELECT event_id,
            round(CASE WHEN snr < 6 THEN greatest(0.12, 0.3 - 0.12) WHEN snr < 12 THEN greatest(0.12, 0.3 - 0.08) WHEN snr > 26 THEN least(0.38, greatest(0.3, 0.30)) ELSE 0.3 END, 6) AS vad_threshold,
            round(CASE WHEN dyn < 12 THEN greatest(0.28, least(0.8, 0.40)) WHEN snr < 6 THEN greatest(0.30, least(0.8, 0.45)) ELSE 0.8 END, 6) AS vad_min_speech_sec,
            round(CASE WHEN sil > 0.65 THEN least(1.2, greatest(0.4, 0.6)) WHEN sil < 0.25 THEN greatest(0.35, least(0.4, 0.55)) ELSE 0.4 END, 6) AS vad_min_silence_sec,
            round(CASE WHEN clip THEN least(0.28, greatest(0.1, 0.20)) WHEN snr < 6 THEN least(0.30, greatest(0.1, 0.22)) WHEN snr < 12 THEN least(0.24, greatest(0.1, 0.18)) ELSE 0.1 END, 6) AS speech_pad_sec,
            CASE WHEN snr < 10 THEN 2 WHEN sil > 0.7 THEN 1 ELSE 1 END AS beam_size,
            round(CASE WHEN clip THEN greatest(0.32, least(0.5, 0.52)) WHEN snr < 10 THEN greatest(0.32, least(0.5 - 0.1, 0.65)) WHEN sil > 0.7 THEN least(0.65, greatest(0.5, 0.55)) ELSE 0.5 END, 6) AS no_speech_threshold
        FROM h""",
    "schema_completion": SEG + "SELECT CAST(file_id AS VARCHAR) AS file_id, start_ms / 1000 AS start, end_ms / 1000 AS \"end\", speaker AS speaker_id, '[]' AS events_top3_json, false AS low_confidence_ser, false AS vad_unstable, '' AS error_flags, 34 AS missing FROM seg",
    "proportional_words": ALLOC + "SELECT file_id, ord, CASE WHEN len(w[gone + 1 : gone + n]) = 0 THEN '[silence]' ELSE array_to_string(w[gone + 1 : gone + n], ' ') END AS text FROM al2",
    "latest_checkpoint": "SELECT user_id, event_type, event_id, place FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS place FROM events) WHERE place <= 2",
    "cache_left_anti": "SELECT conv_id, turn FROM conversations WHERE text NOT IN (SELECT text FROM conversations WHERE turn = 0 AND text IS NOT NULL)",
    "qc_summary": SEG + "SELECT file_id, count(*) AS segments, count(DISTINCT speaker) AS speakers, count(*) FILTER (dur > 60000) AS flagged, round(avg(CASE WHEN ord % 2 = 0 THEN ord / 7.0 END), 6) AS vq_jitter_pct_mean FROM seg GROUP BY file_id",
    "json_props_extract": PROPS + "SELECT event_id, CAST(k AS BIGINT) AS k, k IS NULL AS broken FROM ev",
    "top_speakers_semi": SEG + """
        , u AS (SELECT file_id, speaker, sum(dur) AS d FROM seg GROUP BY ALL), s AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY d DESC, speaker) AS r FROM u)
        SELECT seg.file_id, seg.ord, seg.speaker FROM seg SEMI JOIN (SELECT * FROM s WHERE r <= 1) k ON seg.file_id = k.file_id AND seg.speaker = k.speaker""",
    "stream_tumbling": "SELECT time_bucket(INTERVAL '1 hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "stream_sliding": """
        WITH w AS (SELECT time_bucket(INTERVAL '15 minutes', ts) - unnest([INTERVAL '0 minutes', INTERVAL '15 minutes', INTERVAL '30 minutes', INTERVAL '45 minutes']) AS window_start, event_type, value FROM events)
        SELECT window_start, event_type, count(*) AS n, round(avg(value), 6) AS mean FROM w GROUP BY ALL""",
    "stream_session": """
        WITH a AS (SELECT user_id, ts, CASE WHEN lag(ts) OVER w IS NULL OR ts - lag(ts) OVER w > INTERVAL '30 minutes' THEN 1 ELSE 0 END AS c FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
        b AS (SELECT *, sum(c) OVER (PARTITION BY user_id ORDER BY ts) AS i FROM a)
        SELECT user_id, min(ts) AS session_start, max(ts) + INTERVAL '30 minutes' AS session_end, count(*) AS n FROM b GROUP BY user_id, i""",
    "stream_hysteresis": """
        WITH s1 AS (SELECT *, CASE WHEN value >= 50 THEN 1 WHEN value <= 35 THEN 0 END AS sw FROM events),
        s2 AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM s1),
        s3 AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id), 0) AS was FROM s2),
        s4 AS (SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS ev FROM s3)
        SELECT user_id, event_type, min(ts) FILTER (st = 1) AS opened_at, max(ts) FILTER (st = 0) AS closed_at, round(max(value), 6) AS peak
        FROM s4 WHERE st = 1 OR was = 1 GROUP BY user_id, event_type, ev HAVING count(*) FILTER (st = 0) > 0""",
}

SQL["tail_windows"] = SEG + """
    , b AS (SELECT *, CASE WHEN dur <= 1000 THEN 1 ELSE (dur - 1000) // 500 + 1 END AS n, greatest(end_ms - 1000, start_ms) AS tail FROM seg),
    w AS (
        SELECT file_id, ord, unnest(range(0, n)) AS k, start_ms, end_ms, NULL AS tail FROM b
        UNION ALL SELECT file_id, ord, n, start_ms, end_ms, tail FROM b WHERE NOT ((tail - start_ms) % 500 = 0 AND (tail - start_ms) // 500 < n)
    )
    SELECT file_id, ord, k AS "window", coalesce(tail, start_ms + k * 500) AS win_start_ms, least(coalesce(tail, start_ms + k * 500) + 1000, end_ms) AS win_end_ms FROM w"""
SQL["flow_metrics"] = f"""
    SELECT p.*, b.speakers, b.balance, c.coherence, l.avg_sec, l.median_sec, l.count AS latencies
    FROM ({SQL["flow_silence_pace"]}) p JOIN ({SQL["flow_balance_entropy"]}) b USING (file_id) JOIN ({SQL["flow_topic_coherence"]}) c USING (file_id) JOIN ({SQL["flow_latency"]}) l USING (file_id)"""
SQL["speaker_table"] = f"""
    SELECT c.*, coalesce(m.made, 0) AS made, coalesce(m.received, 0) AS received, round(m.overlap_ms / greatest(c.duration_ms, 1), 6) AS overlap_ratio
    FROM ({SQL["speaker_rollup_core"]}) c LEFT JOIN ({SQL["interrupt_full_outer"]}) m USING (file_id, speaker)"""
SQL["midpoint_overlap_split"] = SEG.replace("WITH wc", "WITH RECURSIVE wc") + """
    , own AS (SELECT file_id, ord, start_ms AS s, end_ms AS e, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, ord, end_ms) AS i FROM seg WHERE end_ms - start_ms >= 50),
    fold AS (
        SELECT file_id, i, [{'ord': ord, 's': s, 'e': e}] AS done FROM own WHERE i = 1
        UNION ALL
        SELECT o.file_id, o.i,
            CASE WHEN o.e - CASE WHEN o.s < f.done[-1].e THEN (f.done[-1].e + o.s) // 2 ELSE o.s END >= 50 THEN list_append(
                CASE WHEN o.s < f.done[-1].e THEN list_append(f.done[:-2], {'ord': f.done[-1].ord, 's': f.done[-1].s, 'e': (f.done[-1].e + o.s) // 2}) ELSE f.done END,
                {'ord': o.ord, 's': CASE WHEN o.s < f.done[-1].e THEN (f.done[-1].e + o.s) // 2 ELSE o.s END, 'e': o.e})
            ELSE CASE WHEN o.s < f.done[-1].e THEN list_append(f.done[:-2], {'ord': f.done[-1].ord, 's': f.done[-1].s, 'e': (f.done[-1].e + o.s) // 2}) ELSE f.done END END
        FROM fold f JOIN own o ON o.file_id = f.file_id AND o.i = f.i + 1
    ),
    last AS (SELECT file_id, unnest(arg_max(done, i)) AS d FROM fold GROUP BY file_id)
    SELECT file_id, d.ord AS ord, d.s AS start_ms, d.e AS end_ms FROM last"""
SQL["batch_packing"] = SEG.replace("WITH wc", "WITH RECURSIVE wc") + """
    , own AS (SELECT file_id, ord, dur AS d, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, ord) AS i FROM seg),
    fold AS (
        SELECT file_id, i, ord, CAST(0 AS BIGINT) AS batch, d AS ms, CAST(1 AS BIGINT) AS n FROM own WHERE i = 1
        UNION ALL
        SELECT o.file_id, o.i, o.ord, CASE WHEN f.ms + o.d > 60000 OR f.n >= 4 THEN f.batch + 1 ELSE f.batch END,
            CASE WHEN f.ms + o.d > 60000 OR f.n >= 4 THEN 0 ELSE f.ms END + o.d, CASE WHEN f.ms + o.d > 60000 OR f.n >= 4 THEN 0 ELSE f.n END + 1
        FROM fold f JOIN own o ON o.file_id = f.file_id AND o.i = f.i + 1
    )
    SELECT file_id, ord, batch FROM fold"""

SQL["words_to_spans"] = SEG + r"""
    , own AS (
        SELECT *, ord // 4 AS batch, CAST(coalesce(sum(dur) OVER (PARTITION BY file_id, ord // 4 ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS a FROM seg
    ),
    said AS (SELECT file_id, batch, ord AS o, a, regexp_extract_all(coalesce(text, ''), '\S+') AS l FROM own),
    word AS (SELECT file_id, batch, o, i, l[i] AS word, a + (i - 1) * 400 + 150 AS s FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM said))
    SELECT own.file_id, own.batch, own.ord, coalesce(string_agg(word, ' ' ORDER BY s, o, i), '[silence]') AS text, count(word) AS n_words,
           min(s) + any_value(start_ms) - any_value(a) AS first_ms, max(s) + 400 + any_value(start_ms) - any_value(a) AS last_ms
    FROM own LEFT JOIN word ON own.file_id = word.file_id AND own.batch = word.batch AND s < own.a + own.dur AND s + 400 > own.a
    GROUP BY own.file_id, own.batch, own.ord"""
LAPPING = SEG + """
    , lap AS (SELECT *, unnest(range(0, CAST(ceil(dur / 2600.0) AS BIGINT))) AS k FROM seg WHERE dur > 0)"""
SQL["asr_window_plan"] = LAPPING + """
    SELECT file_id, ord, CAST(k AS INTEGER) AS "window", start_ms + CASE WHEN k = 0 THEN 0 ELSE greatest(0, k * 2600 - 400) END AS win_start_ms, start_ms + least(dur, k * 2600 + 3000) AS win_end_ms FROM lap"""
SQL["asr_window_text"] = LAPPING + """
    , t AS (SELECT file_id, ord, k, trim(concat(' ', substr(text, 1, 12), ' ', k)) AS said, CASE WHEN k % 2 = 0 THEN -0.1 * (k + 1) END AS lp FROM lap WHERE k % 3 <> 1 AND text IS NOT NULL)
    SELECT file_id, ord, string_agg(said, ' ' ORDER BY k) AS text, count(*) AS n_windows, round(CAST(avg(lp) AS DOUBLE), 6) AS logprob,
           round(coalesce(exp(CAST(avg(lp) AS DOUBLE)), 1), 6) AS confidence, concat('l', min(k)) AS language
    FROM t GROUP BY file_id, ord"""
SQL["whole_windows"] = SEG + """
    , w AS (SELECT *, unnest(range(0, CASE WHEN dur <= 1000 THEN 1 ELSE (dur - 1000) // 320 + 1 END)) AS k FROM seg WHERE dur > 0)
    SELECT file_id, ord, CAST(k AS INTEGER) AS "window", start_ms + k * 320 AS win_start_ms, start_ms + k * 320 + 1000 AS win_end_ms FROM w"""
SQL["chunk_laps_dropped"] = SEG + """
    , f AS (SELECT file_id, max(end_ms) AS d FROM seg GROUP BY file_id HAVING max(end_ms) > 0),
    g AS (SELECT *, CASE WHEN d >= 10000 THEN 4000 ELSE d END AS size FROM f),
    c AS (SELECT *, unnest(range(0, CAST(ceil(d / CAST(size AS DOUBLE)) AS BIGINT))) AS chunk FROM g),
    l AS (SELECT *, greatest(chunk * size - 700, 0) // 100 AS a, least(least((chunk + 1) * size, d) + 700, d) // 100 AS b, (chunk * size - greatest(chunk * size - 700, 0)) // 100 AS lead FROM c),
    p AS (SELECT *, CASE WHEN chunk = 0 OR lead >= b - a + 1 THEN a ELSE a + lead END AS s FROM l)
    SELECT file_id, chunk, b - s + 1 AS n, CAST(s AS DOUBLE) AS first, CAST(b AS DOUBLE) AS last FROM p"""
SQL["chunk_energy_gate"] = """
    WITH d AS (SELECT vec_id, 20 * log10(sqrt(list_sum(list_transform(embedding, lambda x: (CAST(x AS DOUBLE) / pow(10.0, vec_id % 6)) ** 2)) / len(embedding)) + 1e-10) AS db FROM embeddings WHERE len(embedding) > 0)
    SELECT vec_id, round(db, 6) AS rms_db FROM d WHERE db >= -60"""
SQL["chunk_speaker_merge"] = SEG.replace("WITH wc", "WITH RECURSIVE wc") + """
    , own AS (
        SELECT file_id, greatest(start_ms - 500, 0) AS s, end_ms AS e, CASE WHEN ord % 4 = 3 THEN 'b' ELSE 'a' END AS sp, CASE WHEN ord % 3 > 0 THEN CAST(ord AS DOUBLE) END AS v FROM seg
    ),
    num AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY s, e, sp) AS i FROM own),
    fold AS (
        SELECT file_id, i, 1 AS g, s, e, sp, v, CAST(1 AS BIGINT) AS n FROM num WHERE i = 1
        UNION ALL
        SELECT o.file_id, o.i, CASE WHEN o.sp = f.sp AND o.s <= f.e THEN f.g ELSE f.g + 1 END, CASE WHEN o.sp = f.sp AND o.s <= f.e THEN f.s ELSE o.s END,
            CASE WHEN o.sp = f.sp AND o.s <= f.e THEN greatest(f.e, o.e) ELSE o.e END, o.sp,
            CASE WHEN o.sp = f.sp AND o.s <= f.e THEN coalesce((f.v + o.v) / 2, f.v, o.v) ELSE o.v END, CASE WHEN o.sp = f.sp AND o.s <= f.e THEN f.n + 1 ELSE 1 END
        FROM fold f JOIN num o ON o.file_id = f.file_id AND o.i = f.i + 1
    )
    SELECT file_id, arg_max(s, i) AS start_ms, arg_max(e, i) AS end_ms, arg_max(sp, i) AS speaker, max(n) AS n_spans, round(arg_max({'v': v}, i).v, 6) AS x FROM fold GROUP BY file_id, g"""
SQL["vad_flips"] = """
    WITH f AS (SELECT user_id AS file_id, count(*) FILTER (event_type <> 'view' AND event_id % 3 = 0) AS flips, max(event_id) * 40 AS d FROM events GROUP BY user_id)
    SELECT file_id, flips, flips / CAST(greatest(1, d // 60000) AS DOUBLE) > 0.5 AS vad_unstable FROM f"""
SQL["silence_mask"] = FRAMES + """
    , r AS (
        SELECT file_id, label, frame, score < 0.4 AS silent FROM frm
        UNION ALL SELECT -1, label, row_number() OVER (PARTITION BY label ORDER BY file_id, frame), score < 0.4 FROM frm
    ),
    n AS (SELECT *, count(*) OVER (PARTITION BY file_id, label) AS n, row_number() OVER (PARTITION BY file_id, label ORDER BY frame) - 1 AS p FROM r),
    b AS (SELECT *, CASE WHEN n > 1000 THEN p // 500 ELSE 0 END AS blk, least(7, greatest(3, n // 20)) // 2 AS half FROM n),
    v AS (
        SELECT *, list(CAST(silent AS INTEGER)) OVER (PARTITION BY file_id, label, blk ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS l, least(3, row_number() OVER (PARTITION BY file_id, label, blk ORDER BY p) - 1) AS c FROM b
    )
    SELECT file_id, label, frame, silent, CASE WHEN n <= 7 THEN silent ELSE coalesce(list_sum(l[greatest(c + 1 - half, 1) : c + 1 + half]), 0) > half END AS smooth_mask FROM v"""
SQL["hann_smoothing"] = FRAMES + """
    , e AS (SELECT *, min(frame) OVER w AS a, max(frame) OVER w AS b FROM frm WINDOW w AS (PARTITION BY file_id, label)),
    t AS (SELECT *, unnest([-1, 0, 1]) AS o FROM e)
    SELECT t.file_id, t.label, t.frame, round(sum(x.score * CASE o WHEN 0 THEN 1.0 ELSE 0.5 END) / (2 + 1e-12), 6) AS score_hann
    FROM t JOIN frm x ON x.file_id = t.file_id AND x.label = t.label AND x.frame = greatest(t.a, least(t.b, t.frame + o)) GROUP BY t.file_id, t.label, t.frame"""
SCORED = SEG + ", sc AS (SELECT *, (ord * 7 + file_id) % 10 / 10.0 AS arousal, (ord % 2 * 2 - 1) * (file_id % 5) / 10.0 AS valence FROM seg)"
SQL["moments_in_order"] = SCORED + """
    , r AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY arousal DESC, start_ms, ord) AS place FROM sc)
    SELECT file_id, row_number() OVER (PARTITION BY file_id ORDER BY start_ms, place) AS moment, start_ms, speaker, substr(coalesce(text, ''), 1, 180) AS description FROM r WHERE place <= 3"""
SQL["quick_take"] = SCORED + """
    , p AS (SELECT file_id, speaker, sum(dur) AS ms, avg(valence) AS v, max(end_ms) AS e FROM sc GROUP BY ALL),
    l AS (SELECT *, row_number() OVER (PARTITION BY file_id ORDER BY ms DESC, speaker) AS r, count(*) OVER (PARTITION BY file_id) AS n, max(e) OVER (PARTITION BY file_id) AS whole FROM p)
    SELECT file_id, concat(n, ' speakers over ', whole // 60000, ' min; most-active tone ', CASE WHEN v > 0.2 THEN 'positive' WHEN v < -0.2 THEN 'negative' ELSE 'neutral' END, '.') AS quick_take FROM l WHERE r = 1"""
SQL["tuner_notes"] = """
    WITH h AS (SELECT event_id, event_id % 34 AS snr, event_id % 101 AS sil, 6 + event_id % 13 AS dyn, event_id % 7 = 0 AS clip FROM events),
    n AS (
        SELECT event_id, concat_ws(',', CASE WHEN clip THEN 'clipping_detected' END, CASE WHEN snr < 6 THEN 'snr<6_lower_vad' END, CASE WHEN snr < 6 THEN 'shorten_min_speech_low_snr' END,
            CASE WHEN snr BETWEEN 6 AND 11 THEN 'snr<12_lower_vad' END, CASE WHEN sil > 65 THEN 'high_silence_extend_min_silence' END,
            CASE WHEN dyn < 12 THEN 'low_dynamic_range_shorter_min_speech' END, CASE WHEN snr < 10 THEN 'low_snr_raise_beam' END, CASE WHEN snr < 10 THEN 'low_snr_lower_no_speech' END,
            CASE WHEN snr >= 10 AND sil > 70 THEN 'high_silence_raise_no_speech' END) AS notes FROM h
    )
    SELECT event_id, CASE WHEN notes = '' THEN 'noop' ELSE notes END AS notes FROM n"""
SQL["clock_formats"] = """
    WITH m AS (SELECT event_id, greatest(0, (event_id * 7919317) % 100000000 - 1000) AS ms FROM events),
    c AS (SELECT event_id, ms // 3600000 AS h, printf('%02d:%02d', ms // 60000 % 60, ms // 1000 % 60) AS r, printf('.%03d', ms % 1000) AS f FROM m)
    SELECT event_id, CASE WHEN h > 0 THEN concat(h, ':', r) ELSE r END AS short, concat(CASE WHEN h > 0 THEN concat(h, ':', r) ELSE r END, f) AS fine, concat(printf('%02d', h), ':', r) AS whole FROM c"""

from . import sound_sql  # noqa: E402, F401  (adds the twins over sound, models and streams that end)
