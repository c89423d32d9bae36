"""Text features of utterances as JVM expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Word lists, phrases and patterns that the results depend on.
FILLER_PHRASES = ("you know", "i mean", "sort of", "kind of", "let me see", "let's see")
FILLER_WORDS = (
    "um", "uh", "erm", "er", "mm", "hmm", "like", "kinda", "right", "okay", "ok", "so", "well", "uhh", "umm", "basically",
    "literally", "actually", "totally", "absolutely", "definitely", "anyway",
)
NOT_REPEATED = ("the", "a", "an", "to", "of", "in", "on", "at", "by")
DASHES = (" - ", "—", " -- ", "... ", " … ")
RESTARTS = (" i - i ", " we - we ", " they - they ", " you - you ", " he - he ", " she - she ", " it - it ")
HESITATIONS = ("um", "uh", "er")
BACKCHANNELS = (
    "mm", "mmm", "mhmm", "uh-huh", "yeah", "yep", "yes", "okay", "ok", "right", "sure", "exactly", "absolutely", "definitely",
    "totally", "i see", "oh", "wow", "really", "interesting", "hmm",
)
BACKCHANNEL_PARTS = ("mm", "oh", "ah", "um")
SYLLABLE_ENDINGS = ("tion", "sion", "cial", "tial", "ious", "eous")
ACTION_INTENTS = ("command", "instruction", "request", "suggestion")
ACTION_PHRASES = ("let's ", "we will")
NOISE_WORDS = ("music", "noise", "typing", "keyboard", "applause", "traffic", "engine", "vehicle", "crowd", "siren", "wind", "rain", "tv")


def word_count(text: Column) -> Column:
    """Words as runs of non-blanks; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(r"\S+")), F.lit(0)).cast("long")


def tokens(text: Column) -> Column:
    """Lower-cased words: letters and digits, apostrophes and hyphens inside; single characters only i and a."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}][\p{L}\p{N}'-]*"), F.lit(0))
    return F.filter(found, lambda w: (F.length(w) > 1) | w.isin("i", "a"))


def _count(text: Column, part: str) -> Column:
    """Occurrences of ``part`` that do not overlap."""
    return ((F.length(text) - F.length(F.replace(text, F.lit(part)))) / len(part)).cast("long")


def _padded(text: Column) -> Column:
    return F.concat(F.lit(" "), F.lower(F.coalesce(text, F.lit(""))), F.lit(" "))


def _places(words: Column, ahead: int, test) -> Column:
    """Number of places i with i + ``ahead`` inside the words for which ``test(word_at)`` holds."""
    last = F.size(words) - ahead
    hits = F.filter(F.sequence(F.lit(1), last), lambda i: test(lambda k: F.get(words, i - 1 + k)))
    return F.when(last >= 1, F.size(hits)).otherwise(0).cast("long")


def fillers(text: Column, words: Column) -> Column:
    """Filler phrases between blanks plus single filler words; none without words."""
    padded = _padded(text)
    phrases = sum((_count(padded, f" {p} ") for p in FILLER_PHRASES), F.lit(0))
    return F.when(F.size(words) > 0, phrases + F.size(F.filter(words, lambda w: w.isin(*FILLER_WORDS)))).otherwise(0).cast("long")


def repetitions(words: Column) -> Column:
    """Words said twice in a row, and words that come back after one filler or short word."""
    twice = _places(words, 1, lambda at: (at(0) == at(1)) & (F.length(at(0)) > 2) & ~at(0).isin(*NOT_REPEATED))
    repair = _places(words, 3, lambda at: (at(0) == at(2)) & (F.length(at(0)) > 3) & (at(1).isin(*FILLER_WORDS) | (F.length(at(1)) <= 2)))
    return twice + repair


def false_starts(text: Column, words: Column) -> Column:
    """Dashes and ellipses, pronouns taken up again, and words broken off with a hesitation."""
    padded = _padded(text)
    marks = sum((_count(padded, d) for d in (*DASHES, *RESTARTS)), F.lit(0))
    broken = _places(words, 3, lambda at: (F.length(at(0)) > 2) & (F.length(at(2)) > 2) & (at(0) != at(2)) & at(1).isin(*HESITATIONS))
    return F.when(F.size(words) > 0, marks + broken).otherwise(0).cast("long")


def syllables(word: Column) -> Column:
    """Estimated syllables of a word: runs of vowels, a silent e less, some endings more, one at least."""
    w = F.regexp_replace(F.lower(word), r"^[.,!?;:]+|[.,!?;:]+$", "")
    count = F.regexp_count(w, F.lit("[aeiouy]+"))
    count = count - F.when(w.endswith("e") & (F.length(w) > 2) & (count > 1), 1).otherwise(0)
    ending = F.lit(False)
    for e in SYLLABLE_ENDINGS:
        ending = ending | w.endswith(e)
    return F.when(F.length(w) <= 1, 1).otherwise(F.greatest(F.lit(1), count + F.when(ending, 1).otherwise(0))).cast("long")


def per_minute(count: Column, duration_ms: Column) -> Column:
    """Rate per minute; null for less than half a second."""
    return F.when(duration_ms >= 500, count * 60000.0 / duration_ms)


def disfluency_rate(count: Column, words: Column) -> Column:
    return F.when(words > 0, 100.0 * count / words).otherwise(0.0)


def backchannel(text: Column, duration_ms: Column, most_ms: int = 300) -> Column:
    """Confidence that a short utterance is a backchannel: 1 for a known one, 0.7 for a sound in it, else null."""
    words = tokens(text)
    said = F.array_join(words, " ")
    part = F.lit(False)
    for p in BACKCHANNEL_PARTS:
        part = part | said.contains(p)
    sure = (F.size(words) <= 3) & said.isin(*BACKCHANNELS)
    return F.when((duration_ms <= most_ms) & sure, 1.0).when((duration_ms <= most_ms) & (F.size(words) == 1) & part, 0.7)


def is_action(text: Column, intent: Column) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.coalesce(intent.isin(*ACTION_INTENTS), F.lit(False)) | low.contains(ACTION_PHRASES[0]) | low.contains(ACTION_PHRASES[1])


def clock(ms: Column, rounded: bool = False) -> Column:
    """h:mm:ss of milliseconds, cut or rounded to seconds."""
    s = F.floor((ms + (500 if rounded else 0)) / 1000)
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def short_clock(ms: Column) -> Column:
    """h:mm:ss of milliseconds cut to seconds, mm:ss within the first hour; what is negative counts as 0."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return _hours(s, F.format_string("%02d:%02d", F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60))))


def fine_clock(ms: Column) -> Column:
    """As ``short_clock``, with milliseconds behind a point."""
    return F.concat(short_clock(ms), F.format_string(".%03d", F.pmod(F.greatest(ms, F.lit(0)), F.lit(1000))))


def full_clock(ms: Column) -> Column:
    """HH:MM:SS, cut to seconds, zero for what is negative."""
    s = F.floor(F.greatest(ms, F.lit(0)) / 1000)
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.pmod(F.floor(s / 60), F.lit(60)), F.pmod(s, F.lit(60)))


def _hours(seconds: Column, rest: Column) -> Column:
    hours = F.floor(seconds / 3600)
    return F.when(hours > 0, F.concat(hours.cast("string"), F.lit(":"), rest)).otherwise(rest)


def issues(items: Column) -> Column:
    """Each issue once, in order; nulls are left out."""
    return F.array_sort(F.array_distinct(F.array_compact(items)))


def preview(text: Column, most: int = 100) -> Column:
    return F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)


def display_name(name: Column, ident: Column) -> Column:
    return F.coalesce(F.nullif(F.trim(name), F.lit("")), F.concat(F.lit("Speaker "), ident.cast("string")))


def intent_label(label: Column) -> Column:
    """Lower-cased with hyphens; the status update is called status."""
    low = F.replace(F.lower(F.trim(F.coalesce(F.nullif(label, F.lit("")), F.lit("status_update")))), F.lit(" "), F.lit("_"))
    low = F.replace(F.when(low == "status_update", "status").otherwise(low), F.lit("_"), F.lit("-"))
    return F.when(low == "", "status").otherwise(low)


def duration_map(text: Column) -> Column:
    """Map of label to seconds from JSON or from ``label=seconds`` items between commas; bad numbers are null."""
    json = F.from_json(text, "map<string,double>")
    pairs = F.str_to_map(F.regexp_replace(text, r"\s", ""), F.lit(","), F.lit("="))
    plain = F.transform_values(F.transform_keys(pairs, lambda k, _: F.lower(k)), lambda _, v: v.try_cast("double"))
    return F.when(F.ltrim(text).startswith("{"), json).otherwise(plain)
