"""Settings and the further signal operators."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.config import Settings
from parley.operators import audio, voice

CHUNK = "file_id string, chunk long, start_ms long, rate int, samples array<float>, error string"


def test_settings_are_validated():
    assert Settings().with_overrides({"enter": 0.6, "leave": None}).leave == 0.35
    for bad in ({"enter": 2.0}, {"nope": 1}, {"leave": 0.9}, {"chunk_ms": 1.5}, {"timeline": "maybe"}, {"onset_ms": -1}, {"enter": float("nan")}):
        with pytest.raises(ValueError):
            Settings().with_overrides(bad)
    assert Settings().as_dict()["enter"] == 0.5


@pytest.fixture(scope="module")
def tone(spark):
    rate = 8_000
    t = np.arange(rate) / rate
    x = (0.5 * np.sin(2 * np.pi * 200 * t) + 0.3 * np.sin(2 * np.pi * 20 * t)).astype(float)
    return spark.createDataFrame([("f", 0, 0, rate, x.tolist(), None), ("none", 0, 0, 0, [], "broken")], CHUNK)


def test_pitch_and_filter(tone):
    clean = audio.high_pass(tone)
    found = voice.pitch(clean.where("rate > 0"))
    assert found.agg(F.median("hz")).first()[0] == pytest.approx(200, rel=0.02)
    assert abs(audio.pitch_slope(found).first()["slope"]) < 1
    assert clean.count() == 2
    mel = audio.mel_energies(tone).collect()
    assert len(mel[0]["mel"]) == 40 and len(mel) == 98


def test_level_and_rate(tone):
    half = audio.resample(tone.where("rate > 0"), 4_000).first()
    assert half["rate"] == 4_000 and len(half["samples"]) == 4_000
    loud = audio.loudness(audio.frame_energies(tone))
    before = loud.first()["loudness_db"]
    after = audio.loudness(audio.frame_energies(audio.level(tone, loud))).first()["loudness_db"]
    assert before > -12 and after == pytest.approx(-20, abs=0.5)
