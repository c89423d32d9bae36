"""Distributions, confidence and signal figures as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def number(value: Column) -> Column:
    """A finite double, else null (also of text that is none)."""
    d = value.try_cast("double")
    return F.when(~F.isnan(d) & (F.abs(d) < float("inf")), d)


def positive(value: Column) -> Column:
    d = number(value)
    return F.when(d >= 0, d)


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, x: s + x)


def softmax(values: Column) -> Column:
    top = F.array_max(values)
    raised = F.transform(values, lambda x: F.exp(x - top))
    return F.transform(raised, lambda x: x / total(raised))


def sigmoid(x: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-x))


def entropy(p: Column) -> Column:
    """Natural entropy of the positive entries."""
    return F.aggregate(p, F.lit(0.0), lambda s, x: s - F.when(x > 0, x * F.ln(x)).otherwise(0.0))


def normal_entropy(p: Column) -> Column:
    """Entropy over its maximum for the positive entries; 0 for one or none."""
    n = F.size(F.filter(p, lambda x: x > 0))
    return F.when(n > 1, entropy(p) / F.ln(n.cast("double"))).otherwise(0.0)


def top_margin(p: Column) -> Column:
    """Largest less second largest entry; a single entry itself, none 0."""
    s = F.reverse(F.array_sort(p))
    return F.when(F.size(p) == 0, 0.0).when(F.size(p) == 1, F.get(s, F.lit(0))).otherwise(F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def low_confidence(p: Column) -> Column:
    return (F.size(p) == 0) | (F.array_max(p) < 0.55) | (top_margin(p) < 0.18) | (normal_entropy(p) > 0.85)


def shares(scores: Column, labels: list[str]) -> Column:
    """Scores of a map as shares of the known labels, in their order, matched without case.

    Negative and odd scores are dropped, unknown labels count as the first one, and so does a map without mass.
    """
    low = [x.lower() for x in labels]
    entries = F.filter(F.map_entries(scores), lambda e: (e["value"] >= 0) & ~F.isnan(e["value"]) & (e["value"] < float("inf")))
    place = lambda e: F.when(F.array_position(F.lit(low), F.lower(e["key"])) > 0, F.array_position(F.lit(low), F.lower(e["key"]))).otherwise(1)
    # Of several scores of one label the last one counts.
    raw = F.transform(F.sequence(F.lit(1), F.lit(len(labels))), lambda i: F.coalesce(F.element_at(F.filter(F.concat(F.array(F.struct(F.lit("").alias("key"), F.lit(0.0).alias("value"))), entries), lambda e: (e["key"] == "") | (place(e) == i)), -1)["value"], F.lit(0.0)))
    mass = total(raw)
    return F.when(mass > 0, F.transform(raw, lambda x: x / mass)).otherwise(F.lit([1.0] + [0.0] * (len(labels) - 1)))


def top_k(scores: Column, k: int) -> Column:
    """The ``k`` largest finite entries of a map as (label, score); equal scores by label."""
    fine = F.filter(F.map_entries(scores), lambda e: ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf")))
    ordered = F.array_sort(F.transform(fine, lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("label"))))
    return F.transform(F.slice(ordered, 1, k), lambda e: F.struct(e["label"].alias("label"), (-e["n"]).alias("score")))


def affect_hint(valence: Column, arousal: Column, intent: Column) -> Column:
    """A word for valence and arousal, with the intent where these say little."""
    fine = ~F.isnan(valence) & ~F.isnan(arousal)
    with_intent = lambda word: F.concat(F.lit(f"{word}-"), intent)
    return (
        F.when(~F.coalesce(fine, F.lit(False)), with_intent("neutral")).when((arousal > 0.55) & (valence < 0), "agitated-negative")
        .when((arousal < 0.30) & (valence > 0.25), "calm-positive").when(valence > 0.5, with_intent("bright")).when(valence < -0.35, with_intent("low")).otherwise(with_intent("neutral"))
    )


def anomalies(wpm: Column, disfluency: Column, pause_ratio: Column, jitter: Column | None = None, shimmer: Column | None = None, hnr: Column | None = None, reliable: Column | None = None, pitch: Column | None = None) -> tuple[Column, Column, Column]:
    """Flags, severity score and severity word of a segment's figures; null figures raise no flag."""
    rules = [
        (wpm < 80, "very_slow_speech", 1.0), (wpm > 300, "very_fast_speech", 1.0),
        (disfluency > 15, "high_disfluency", 1.5), ((disfluency > 8) & (disfluency <= 15), "elevated_disfluency", 0.5),
        (pause_ratio > 0.5, "excessive_pausing", 1.0), (pause_ratio < 0.05, "minimal_pausing", 0.5),
    ]
    if reliable is not None:
        rules += [(reliable & (jitter > 1.5), "high_jitter", 0.8), (reliable & (shimmer > 1.0), "high_shimmer", 0.8), (reliable & (hnr < 10.0), "low_hnr", 0.6)]
    if pitch is not None:
        rules += [((pitch < 100) | (pitch > 350), "unusual_pitch_range", 0.5)]
    flags = F.array_compact(F.array(*[F.when(c, name) for c, name, _ in rules]))
    score = sum((F.when(c, weight).otherwise(0.0) for c, _, weight in rules), F.lit(0.0))
    word = F.when(score >= 3, "high").when(score >= 1.5, "moderate").when(score >= 0.5, "mild").otherwise("normal")
    return flags, score, word


def decibels(x: Column, floor: float = 1e-6) -> Column:
    return 20.0 * F.log10(F.greatest(x, F.lit(floor)))


def speed_rating(ratio: Column) -> Column:
    """A word for processing time over real time."""
    return F.when(ratio < 0.1, "excellent").when(ratio < 0.2, "good").when(ratio < 0.5, "acceptable").when(ratio < 1.0, "slow").otherwise("very slow")


def tune(snr: Column, silence: Column, dynamic: Column, clipping: Column, vad: Column, min_speech: Column, min_silence: Column, pad: Column, beam: Column, no_speech: Column) -> dict[str, Column]:
    """Recommended parameters for a recording's health; each stays as it is where no rule holds.

    Rules run in order, a later one starts from what it is given, not from an earlier one's result.
    """
    at_least, at_most = (lambda x, v: F.greatest(x, F.lit(v))), (lambda x, v: F.least(x, F.lit(v)))
    very_low, low, high = snr < 6, (snr >= 6) & (snr < 12), snr > 26
    speech = F.when(dynamic < 12, at_least(at_most(min_speech, 0.40), 0.28)).when(very_low, at_least(at_most(min_speech, 0.45), 0.30)).otherwise(min_speech)
    padding = F.when(clipping, at_most(at_least(pad, 0.20), 0.28)).when(very_low, at_most(at_least(pad, 0.22), 0.30)).when(low, at_most(at_least(pad, 0.18), 0.24)).otherwise(pad)
    quiet = F.when(snr < 10, at_least(at_most(no_speech - 0.1, 0.65), 0.32)).when(silence > 0.7, at_most(at_least(no_speech, 0.55), 0.65)).otherwise(no_speech)
    return {
        "vad_threshold": F.when(very_low, at_least(vad - 0.12, 0.12)).when(low, at_least(vad - 0.08, 0.12)).when(high, at_most(at_least(vad, 0.30), 0.38)).otherwise(vad),
        "vad_min_speech_sec": speech,
        "vad_min_silence_sec": F.when(silence > 0.65, at_most(at_least(min_silence, 0.6), 1.2)).when(silence < 0.25, at_least(at_most(min_silence, 0.55), 0.35)).otherwise(min_silence),
        "speech_pad_sec": padding,
        "beam_size": F.when((snr < 10) & (beam < 2), 2).when((snr > 28) & (silence <= 0.7) & (beam > 1), 1).otherwise(beam),
        "no_speech_threshold": F.when(clipping, at_least(at_most(no_speech, 0.52), 0.32)).otherwise(quiet),
    }


def tune_notes(snr: Column, silence: Column, dynamic: Column, clipping: Column, vad: Column, min_speech: Column, min_silence: Column, pad: Column, beam: Column, no_speech: Column) -> Column:
    """Names of the rules that changed a parameter by more than 0.001 in ``tune``, in order; "noop" where none has a name."""
    found = tune(snr, silence, dynamic, clipping, vad, min_speech, min_silence, pad, beam, no_speech)
    other = lambda before, after: F.abs(before - after) > 1e-3
    speech = lambda least, most: other(min_speech, F.greatest(F.lit(least), F.least(min_speech, F.lit(most))))
    lower, raised = F.greatest(F.lit(0.32), F.least(no_speech - 0.1, F.lit(0.65))), F.least(F.lit(0.65), F.greatest(no_speech, F.lit(0.55)))
    new_vad, new_silence = other(vad, found["vad_threshold"]), other(min_silence, found["vad_min_silence_sec"])
    rules = [
        (clipping, "clipping_detected"),
        ((snr < 6) & new_vad, "snr<6_lower_vad"),
        ((snr < 6) & speech(0.30, 0.45), "shorten_min_speech_low_snr"),
        ((snr >= 6) & (snr < 12) & new_vad, "snr<12_lower_vad"),
        ((snr > 26) & new_vad, "snr>26_raise_vad"),
        ((silence > 0.65) & new_silence, "high_silence_extend_min_silence"),
        ((silence < 0.25) & new_silence, "dense_speech_shorten_min_silence"),
        ((dynamic < 12) & speech(0.28, 0.40), "low_dynamic_range_shorter_min_speech"),
        ((snr < 10) & (beam < 2), "low_snr_raise_beam"),
        ((snr < 10) & other(no_speech, lower), "low_snr_lower_no_speech"),
        (~F.coalesce(snr < 10, F.lit(False)) & (silence > 0.7) & other(no_speech, raised), "high_silence_raise_no_speech"),
        ((snr > 28) & ~F.coalesce(silence > 0.7, F.lit(False)) & (beam > 1), "high_snr_restore_beam"),
        (clipping & other(no_speech, F.greatest(F.lit(0.32), F.least(no_speech, F.lit(0.52)))), "clipping_guard_no_speech"),
    ]
    notes = F.array_compact(F.array(*[F.when(rule, name) for rule, name in rules]))
    return F.when(F.size(notes) == 0, F.array(F.lit("noop"))).otherwise(notes)
