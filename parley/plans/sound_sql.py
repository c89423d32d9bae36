"""SQL twins of the queries over sound, models and streams whose state ends: transforms as sums of sines, over whole files."""

from __future__ import annotations

from .sql import FILLERS, MARKS, SEG, SINGLE, SQL, TOKENS

#: Fifty vectors a file, played one after the other at 8 kHz; levels fall by 24 dB each ten vectors.
SOUND = """
WITH snd AS (
    SELECT vec_id // 50 AS file_id, (vec_id % 50) * 64 + i - 1 AS pos, embedding[i]::DOUBLE / (1 << (4 * (1 + (vec_id // 10) % 4))) AS x
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i)
),
len AS (SELECT file_id, max(pos) + 1 AS n FROM snd GROUP BY file_id)
"""


def _frames(size: int, hop: int, centred: bool) -> str:
    """Frames (file_id, k, i, x) with silence around a file."""
    last, back = (f"n // {hop}", size // 2) if centred else (f"(n - {size}) // {hop}", 0)
    return f"""
        k0 AS (SELECT file_id, unnest(range({last} + 1)) AS k FROM len),
        fr AS (SELECT k0.file_id, k, i, coalesce(x, 0) AS x FROM k0 CROSS JOIN (SELECT unnest(range({size})) AS i) LEFT JOIN snd ON snd.file_id = k0.file_id AND pos = k * {hop} + i - {back})"""


def _spectrum(size: int, weight: str) -> str:
    """Squared magnitudes (file_id, k, b, p)."""
    return f"""
        sp AS (
            SELECT file_id, k, b, pow(sum(x * {weight} * cos(2 * pi() * b * i / {size})), 2) + pow(sum(x * {weight} * sin(2 * pi() * b * i / {size})), 2) AS p
            FROM fr, (SELECT unnest(range({size // 2 + 1})) AS b) GROUP BY file_id, k, b
        )"""


SQL["audio_frames"] = SOUND + "," + _frames(200, 80, False) + "," + _spectrum(200, "(0.5 - 0.5 * cos(2 * pi() * i / 199))") + """
    , r AS (SELECT file_id, k, sqrt(avg(x * x)) AS rms, max(abs(x)) AS peak FROM fr GROUP BY file_id, k)
    SELECT file_id, k AS frame, 10 * k AS start_ms, round(any_value(rms), 6) AS rms, round(any_value(peak), 6) AS peak,
           round(sum((p + 1e-12) * b * 40) / sum(p + 1e-12), 6) AS centroid_hz, round(exp(avg(ln(p + 1e-12))) / avg(p + 1e-12), 6) AS flatness
    FROM sp JOIN r USING (file_id, k) GROUP BY file_id, k"""

SQL["audio_durations"] = SOUND + """
    SELECT file_id, 8000 AS rate, 1 AS channels, 2 AS width, n AS frames, n * 1000 // 8000 AS duration_ms, CAST(NULL AS VARCHAR) AS error FROM len"""

SQL["audio_decoded"] = SOUND + """
    SELECT file_id, pos // 400 AS chunk, count(*) AS n, round(sum(greatest(-32768, least(32767, round_even(x * 32768, 0))) / 32768), 6) AS total,
           round(max(abs(greatest(-32768, least(32767, round_even(x * 32768, 0))) / 32768)), 6) AS peak
    FROM snd GROUP BY file_id, pos // 400"""

#: Differences of a frame with itself up to 135 samples later, over their mean so far; the first dip below 0.1 or the lowest.
SQL["voice_pitch"] = SOUND + "," + _frames(272, 80, True) + """
    , f AS (SELECT file_id, k, list(x ORDER BY i) AS v FROM fr GROUP BY file_id, k),
    d AS (
        SELECT file_id, k, v, lag, list_sum(list_transform(list_zip(v[1:134], v[1 + lag : 134 + lag]), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d
        FROM f, (SELECT unnest(range(1, 136)) AS lag)
    ),
    m AS (SELECT *, avg(d) OVER (PARTITION BY file_id, k ORDER BY lag) AS mean FROM d),
    g AS (SELECT *, CASE WHEN mean > 0 THEN d / mean ELSE 1.0 END AS f FROM m),
    h AS (SELECT *, CASE WHEN lag = 1 THEN 1.0 ELSE lag(f) OVER w END AS l, lead(f) OVER w AS r FROM g WINDOW w AS (PARTITION BY file_id, k ORDER BY lag)),
    c AS (SELECT *, row_number() OVER (PARTITION BY file_id, k ORDER BY CASE WHEN f <= l AND f < r AND f < 0.1 THEN 0 ELSE 1 END, CASE WHEN f <= l AND f < r AND f < 0.1 THEN lag ELSE f END, lag) AS o FROM h WHERE lag BETWEEN 20 AND 134)
    SELECT file_id, k AS frame, round(CASE WHEN f < 0.45 AND list_max(list_transform(v, lambda x: abs(x))) > 1e-6
        THEN 8000 / (lag + CASE WHEN abs(l - 2 * f + r) > 1e-15 THEN greatest(-0.5, least(0.5, (l - r) / (2 * (l - 2 * f + r)))) ELSE 0 END) END, 4) AS hz, round(f, 6) AS aperiodicity
    FROM c WHERE o = 1"""

_STFT = SOUND + "," + _frames(256, 80, True) + "," + _spectrum(256, "(0.5 - 0.5 * cos(2 * pi() * i / 256))")
_LEVELS = _STFT + ", lv AS (SELECT file_id, k, 20 * log10(sqrt(avg(p) + 1e-12) + 1e-12) AS db FROM sp GROUP BY file_id, k)"

SQL["gain_curve"] = _LEVELS + """
    , g AS (SELECT *, CASE WHEN db > -45 AND db < -23 THEN least(-23 - db, 18) ELSE 0 END AS gain, max(k) OVER (PARTITION BY file_id) AS last FROM lv),
    w AS (SELECT j, (0.5 - 0.5 * cos(2 * pi() * (j + 12) / 24)) AS w FROM (SELECT unnest(range(-12, 13)) AS j)),
    s AS (SELECT g.file_id, g.k, sum(w.w * o.gain) / ((SELECT sum(w) FROM w) + 1e-12) AS smooth FROM g CROSS JOIN w JOIN g o ON o.file_id = g.file_id AND o.k = least(greatest(g.k + j, 0), g.last) GROUP BY g.file_id, g.k)
    SELECT file_id, k AS frame, round(db, 6) AS level_db, round(gain, 6) AS gain_db, round(smooth, 6) AS smooth_db FROM g JOIN s USING (file_id, k)"""

_HIT = "sqrt(p) - {over} * v <= {floor} * v"
_OVER, _FLOOR = 10 ** (3 / 20), 0.06


def _mask(over: float, floor: float) -> str:
    clean = f"greatest(sqrt(p) - {over!r} * v, {floor!r} * v)"
    return f"{clean} / ({clean} + {over!r} * v + 1e-12)"


SQL["denoise_energies"] = _LEVELS + f"""
    , gt AS (SELECT file_id, quantile_cont(db, 0.2) + 12 AS gate FROM lv GROUP BY file_id),
    q AS (SELECT file_id, any_value(gate) AS gate, count(*) FILTER (db <= gate) AS quiet FROM lv JOIN gt USING (file_id) GROUP BY file_id),
    ns AS (
        SELECT file_id, b, CASE WHEN any_value(quiet) >= 30 THEN quantile_cont(sqrt(p), 0.5) FILTER (db <= gate) ELSE quantile_cont(sqrt(p), 0.1) END AS v
        FROM sp JOIN lv USING (file_id, k) JOIN q USING (file_id) GROUP BY file_id, b
    ),
    ht AS (
        SELECT file_id, avg(CAST({_HIT.format(over=_OVER, floor=_FLOOR)} AS INTEGER)) AS firm, avg(CAST({_HIT.format(over=0.75 * _OVER, floor=1.25 * _FLOOR)} AS INTEGER)) AS soft
        FROM sp JOIN ns USING (file_id, b) GROUP BY file_id
    ),
    mk AS (SELECT file_id, k, b, p, CASE WHEN firm > 0.12 THEN {_mask(0.75 * _OVER, min(0.08, 1.25 * _FLOOR))} ELSE {_mask(_OVER, _FLOOR)} END AS m FROM sp JOIN ns USING (file_id, b) JOIN ht USING (file_id)),
    nb AS (SELECT *, coalesce(lag(m) OVER w, m) AS a, coalesce(lead(m) OVER w, m) AS c FROM mk WINDOW w AS (PARTITION BY file_id, b ORDER BY k)),
    sm AS (SELECT file_id, k, p, greatest(least(a, m), least(greatest(a, m), c)) AS m FROM nb)
    SELECT file_id, 0 AS stretch, count(DISTINCT k) AS frames, round(sum(p), 6) AS energy, round(sum(m * m * p), 6) AS residual,
           round(any_value(CASE WHEN firm > 0.12 THEN soft ELSE firm END), 6) AS floor_ratio, any_value(firm > 0.12) AS mild
    FROM sm JOIN ht USING (file_id) GROUP BY file_id"""

#: Windows of a segment's frames in order of time.
_W = "WINDOW w AS (PARTITION BY file_id, ord ORDER BY t)"

SQL["segment_features"] = SEG + TOKENS.replace("WITH tk", ", tk").replace("\nFROM conversations", "FROM conversations") + f"""
    , vf AS (
        SELECT user_id AS file_id, (row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1) * 200 AS t, value - 80 AS db, CASE WHEN event_type IN ('click', 'view') THEN 80 + 2 * value END AS hz,
               500 + (event_id % 97) * 10.0::DOUBLE AS ce, (event_id % 89) / 89.0::DOUBLE AS fl, (event_id % 7) / 100.0::DOUBLE AS ji, (event_id % 5) / 4.0::DOUBLE AS sh, (event_id % 31)::DOUBLE AS hn,
               (event_id % 17)::DOUBLE AS cp, 1 + (event_id % 3)::DOUBLE AS lo, 0.1::DOUBLE + (event_id % 4) / 10.0::DOUBLE AS hi
        FROM events
    ),
    ins AS (SELECT seg.file_id, seg.ord, vf.* EXCLUDE (file_id) FROM seg JOIN vf ON vf.file_id = seg.file_id AND t >= seg.start_ms AND t < seg.end_ms),
    st AS (
        SELECT file_id, ord, count(*) AS n, count(hz) AS nv, quantile_cont(db, [0.05, 0.5, 0.85, 0.95]) AS dq, max(db) AS top, quantile_cont(hz, [0.25, 0.5, 0.75]) AS hq, quantile_cont(ce, [0.25, 0.5, 0.75]) AS cq,
               quantile_cont(fl, 0.5) AS fq, 100 * avg(CASE WHEN hz IS NOT NULL THEN ji END) AS ji, avg(CASE WHEN hz IS NOT NULL THEN sh END) AS sh, avg(CASE WHEN hz IS NOT NULL THEN hn END) AS hn, avg(cp) AS cp, avg(lo) AS lo, avg(hi) AS hi
        FROM ins GROUP BY file_id, ord
    ),
    r AS (
        SELECT file_id, ord, t, db < dq[1] + 8 AS quiet, n, nv, hz, row_number() OVER w - 1 AS p, least(7, greatest(3, n // 20)) // 2 AS half,
               hz IS NOT NULL AND (hq[3] - hq[1] <= 0 OR hz BETWEEN hq[1] - 1.5 * (hq[3] - hq[1]) AND hq[3] + 1.5 * (hq[3] - hq[1])) AS fine
        FROM ins JOIN st USING (file_id, ord) {_W}
    ),
    b AS (SELECT *, CASE WHEN n > 1000 THEN p // 500 ELSE 0 END AS blk, count(*) FILTER (fine) OVER (PARTITION BY file_id, ord) AS nf FROM r),
    v AS (SELECT *, list(CAST(quiet AS INTEGER)) OVER x AS l, least(3, row_number() OVER y - 1) AS c FROM b WINDOW x AS (PARTITION BY file_id, ord, blk ORDER BY p ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), y AS (PARTITION BY file_id, ord, blk ORDER BY p)),
    sm AS (
        SELECT *, CASE WHEN n <= 7 THEN quiet ELSE coalesce(list_sum(l[greatest(c + 1 - half, 1) : c + 1 + half]), 0) > half END AS silent, CASE WHEN nf * 2 > nv THEN fine ELSE hz IS NOT NULL END AS used FROM v
    ),
    ch AS (SELECT *, lag(silent) OVER w IS DISTINCT FROM silent AS begins, count(*) FILTER (used) OVER (PARTITION BY file_id, ord) AS nu, count(*) FILTER (used) OVER w - 1 AS place FROM sm {_W}),
    rn AS (SELECT *, sum(CAST(begins AS INTEGER)) OVER w AS run FROM ch {_W}),
    ln AS (SELECT *, count(*) OVER (PARTITION BY file_id, ord, run) * 200 AS ms FROM rn),
    pt AS (SELECT file_id, ord, (hz - lag(hz) OVER w) * 1000 / (t - lag(t) OVER w) AS slope FROM (SELECT * FROM ln WHERE used AND place % greatest(nu // 10, 1) = 0) {_W}),
    sl AS (SELECT file_id, ord, median(slope) AS slope FROM pt GROUP BY file_id, ord),
    ag AS (
        SELECT file_id, ord, count(*) FILTER (begins AND silent AND ms >= 200) AS pc, count(*) FILTER (begins AND silent AND ms >= 600) AS pl, coalesce(sum(ms) FILTER (begins AND silent AND ms >= 200), 0) AS pm,
               quantile_cont(CASE WHEN used THEN hz END, [0.25, 0.5, 0.75]) AS uq, any_value(nu) AS nu
        FROM ln GROUP BY file_id, ord
    ),
    wd AS (
        SELECT conv_id AS file_id, turn AS ord, len(w) AS nw, len(regexp_extract_all(coalesce(text, ''), '\\S+')) AS words, CASE WHEN len(w) > 0 THEN {FILLERS} + len(list_filter(w, lambda x: x IN {SINGLE})) ELSE 0 END AS fi,
               len(list_filter(range(1, len(w)), lambda i: w[i] = w[i + 1] AND length(w[i]) > 2 AND w[i] NOT IN ('the','a','an','to','of','in','on','at','by')))
               + len(list_filter(range(1, len(w) - 2), lambda i: w[i] = w[i + 2] AND length(w[i]) > 3 AND (w[i + 1] IN {SINGLE} OR length(w[i + 1]) <= 2))) AS re,
               CASE WHEN len(w) > 0 THEN {MARKS} + len(list_filter(range(1, len(w) - 2), lambda i: length(w[i]) > 2 AND length(w[i + 2]) > 2 AND w[i] <> w[i + 2] AND w[i + 1] IN ('um','uh','er'))) ELSE 0 END AS fs,
               list_sum(list_transform(w, lambda x: CASE WHEN length(x) <= 1 THEN 1 ELSE greatest(1, len(regexp_extract_all(x, '[aeiouy]+')) - CASE WHEN x LIKE '%e' AND length(x) > 2 AND len(regexp_extract_all(x, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END
                   + CASE WHEN regexp_matches(x, '(tion|sion|cial|tial|ious|eous)$') THEN 1 ELSE 0 END) END)) AS sy
        FROM tk
    ),
    al AS (SELECT seg.file_id, seg.ord, dur, st.* EXCLUDE (file_id, ord), pc, pl, pm, uq, nu, slope, nw, words, fi, re, fs, sy FROM seg LEFT JOIN st USING (file_id, ord) LEFT JOIN ag USING (file_id, ord) LEFT JOIN sl USING (file_id, ord) LEFT JOIN wd USING (file_id, ord)),
    fl AS (SELECT *, dur < 600 AS short, nv >= 0.05 * n AND nv > 0 AS voice, coalesce(dur >= 600 AND dq[3] - dq[1] >= 10 AND top - dq[1] >= 12 AND nv * 1.0 / n >= 0.5, false) AS ok, dur < 600 OR n IS NULL AS none FROM al)
    SELECT file_id, ord, round(dur / 1000, 6) AS duration_s, words, round(CASE WHEN dur >= 500 THEN nw * 60000.0 / dur END, 6) AS wpm, round(CASE WHEN nw > 0 AND dur >= 500 THEN sy * 60000.0 / dur END, 6) AS sps,
        fi AS filler_count, re AS repetition_count, fs AS false_start_count, fi + re + fs AS disfluency_count, round(CASE WHEN nw > 0 THEN 100.0 * (fi + re + fs) / nw ELSE 0 END, 6) AS disfluency_rate,
        coalesce(n, 0) AS n_frames, coalesce(pc, 0) AS pause_count, coalesce(pc - pl, 0) AS pause_short_count, coalesce(pl, 0) AS pause_long_count, coalesce(pm, 0) / 1000 AS pause_time_s, round(coalesce(pm / (n * 200), 0), 6) AS pause_ratio,
        round(CASE WHEN voice THEN uq[2] END, 6) AS f0_mean_hz, round(CASE WHEN voice THEN uq[3] - uq[1] END, 6) AS f0_std_hz, round(CASE WHEN voice AND nu >= 10 THEN slope END, 6) AS pitch_slope_hzps,
        round(dq[2], 6) AS loudness_rms, round(dq[4] - dq[1], 6) AS loudness_dr_db, round(dq[2] - dq[1], 6) AS loudness_over_floor_db, round(cq[2], 6) AS spectral_centroid_med_hz,
        round(CASE WHEN n > 4 THEN cq[3] - cq[1] WHEN n IS NOT NULL THEN 0 END, 6) AS spectral_centroid_iqr_hz, round(fq, 6) AS spectral_flatness_med,
        round(CASE WHEN none THEN 0 ELSE least(25, coalesce(ji, 0)) END, 6) AS vq_jitter_pct, round(CASE WHEN none THEN 0 ELSE least(15, coalesce(sh, 0)) END, 6) AS vq_shimmer_db, round(CASE WHEN none THEN 0 ELSE least(40, coalesce(hn, 0)) END, 6) AS vq_hnr_db,
        round(CASE WHEN none THEN 0 ELSE least(35, coalesce(cp, 0)) END, 6) AS vq_cpps_db, round(CASE WHEN none THEN 0 ELSE nv * 1.0 / n END, 6) AS vq_voiced_ratio,
        round(CASE WHEN none THEN 0 ELSE greatest(-30, least(10, 20 * (log10(hi + 1e-12) - log10(lo + 1e-12)) / log10(4))) END, 6) AS vq_spectral_slope_db, round(dq[3] - dq[1], 6) AS snr_db, ok AS vq_reliable,
        CASE WHEN short THEN 'too_short' WHEN n IS NULL THEN 'no_audio' WHEN ok THEN 'reliable' WHEN dq[3] - dq[1] < 10 THEN 'low_snr' WHEN nv * 1.0 / n < 0.5 THEN 'unvoiced' ELSE 'low_dr' END AS vq_note
    FROM fl"""

#: A leaky mean of the power of each window and the 16 samples before it, by its weights instead of a state.
SQL["carried_scores"] = SOUND + """
    , w AS (SELECT file_id, unnest(range((n + 63) // 64)) AS k FROM len),
    p AS (SELECT w.file_id, k, coalesce(sum(x * x), 0) / 80 AS p FROM w LEFT JOIN snd ON snd.file_id = w.file_id AND pos >= k * 64 - 16 AND pos < k * 64 + 64 GROUP BY w.file_id, k),
    s AS (SELECT a.file_id, a.k, sum(0.1::DOUBLE * pow(0.9::DOUBLE, a.k - b.k) * b.p) AS s FROM p a JOIN p b ON a.file_id = b.file_id AND b.k <= a.k GROUP BY a.file_id, a.k)
    SELECT file_id, k AS "window", k * 8 AS start_ms, round(s / (s + 1e-4), 6) AS score FROM s"""

SQL["nearest_pruned"] = """
    WITH u AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), v AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) + 1e-9 AS n FROM u),
    s AS (SELECT a.vec_id, printf('v%010d', b.vec_id) AS name, list_dot_product(a.e, b.e) / (a.n * b.n) AS s FROM v a JOIN v b ON b.vec_id % 20 = 0)
    SELECT vec_id, name, round(s, 5) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, name) = 1"""

SQL["stage_counts"] = SEG + r"""
    , k AS (SELECT * FROM seg WHERE end_ms > start_ms),
    c AS (SELECT count(DISTINCT (file_id, speaker)) AS rows, CAST(sum(len(regexp_extract_all(text, '\S+'))) AS BIGINT) AS words FROM k)
    SELECT 'segments' AS stage, count(*) AS rows, 'ms' AS count, CAST(sum(dur) AS BIGINT) AS n FROM k UNION ALL SELECT 'segments', count(*), 'silent', count(*) FILTER (text = '') FROM k UNION ALL SELECT 'speakers', rows, 'words', words FROM c"""

SQL["stream_tumbling_closed"] = SQL["stream_tumbling"].replace("GROUP BY ALL", "WHERE time_bucket(INTERVAL '1 hour', ts) + INTERVAL '1 hour' <= (SELECT max(ts) FROM events) - INTERVAL '2 hours' GROUP BY ALL")
SQL["stream_session_closed"] = f"WITH s AS ({SQL['stream_session']}) SELECT * FROM s WHERE session_end <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'"
SQL["stream_moving_centroids"] = SQL["ema_centroid"]

#: A gap of more than three days in a series ends what is on.
SQL["stream_switch_timed"] = """
    WITH o AS (SELECT *, lag(ts) OVER w AS prev FROM events WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id)),
    p AS (SELECT *, sum(CASE WHEN prev IS NULL OR ts - prev > INTERVAL '3 days' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS part FROM o),
    q AS (SELECT *, CASE WHEN value >= 50 THEN 1 WHEN value <= 35 THEN 0 END AS sw, max(ts) OVER (PARTITION BY user_id, event_type, part) AS last, part < max(part) OVER (PARTITION BY user_id, event_type) AS more FROM p),
    s2 AS (SELECT *, coalesce(last_value(sw IGNORE NULLS) OVER (PARTITION BY user_id, event_type, part ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 0) AS st FROM q),
    s3 AS (SELECT *, coalesce(lag(st) OVER (PARTITION BY user_id, event_type, part ORDER BY ts, event_id), 0) AS was FROM s2),
    s4 AS (SELECT *, sum(CASE WHEN st = 1 AND was = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, event_type, part ORDER BY ts, event_id) AS ev FROM s3),
    f AS (SELECT user_id, event_type, min(ts) FILTER (st = 1) AS opened_at, max(ts) FILTER (st = 0) AS off, max(value) FILTER (st = 1) AS peak, any_value(last) + INTERVAL '3 days' AS ends, any_value(more) AS more FROM s4 WHERE st = 1 OR was = 1 GROUP BY user_id, event_type, part, ev)
    SELECT user_id, event_type, opened_at, coalesce(off, ends) AS closed_at, round(peak, 6) AS peak, off IS NULL AS timed_out FROM f
    WHERE off IS NOT NULL OR more OR ends <= (SELECT max(ts) FROM events) - INTERVAL '2 hours'"""
