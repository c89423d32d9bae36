"""Sound files as a source, blocks with a halo, and the voice figures of known signals."""

from __future__ import annotations

import struct
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from parley.operators import audio, blocks, voice
from parley.sources import sound

CHUNK = "file_id string, start_ms long, rate int, samples array<float>"


def wav(path, samples: np.ndarray, rate: int = 8_000, channels: int = 1) -> None:
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(samples.astype("<i2").tobytes())


def test_byte_ranges_give_every_chunk_once(spark, tmp_path):
    rng = np.random.default_rng(2)
    x = rng.integers(-30_000, 30_000, 8_000 * 23 + 17)
    wav(tmp_path / "long.wav", x)
    wav(tmp_path / "two.WAV", np.repeat(x[:12_000], 2), channels=2)
    wav(tmp_path / "none.wav", np.zeros(0))
    (tmp_path / "broken.wav").write_bytes(b"RIFF....WAVEfmt ")
    (tmp_path / "text.wav").write_bytes(b"hello")
    (tmp_path / "empty.wav").write_bytes(b"")
    (tmp_path / "other.txt").write_bytes(b"not read")
    for split in (1_000, 16_044, 16_000 * 3, 1 << 30):
        read = sound.read(spark, str(tmp_path), chunk_s=2, split_bytes=split)
        assert split > 1_000 or read.rdd.getNumPartitions() > 100
        rows = read.collect()
        by = lambda name: sorted((r for r in rows if r.file_id.endswith(name)), key=lambda r: r.chunk)
        long = by("long.wav")
        assert [r.chunk for r in long] == list(range(12)) and [r.start_ms for r in long] == list(range(0, 24_000, 2_000))
        assert np.array_equal(np.rint(np.concatenate([r.samples for r in long]) * 32768), x)
        assert np.array_equal(np.rint(np.array(by("two.WAV")[0].samples) * 32768), x[:12_000])
        assert [(r.rate, len(r.samples), r.error) for r in by("none.wav")] == [(8_000, 0, None)]
        assert all(len(by(n)) == 1 and by(n)[0].error and not by(n)[0].samples for n in ("broken.wav", "text.wav", "empty.wav"))
        assert not by("other.txt")


def test_headers_tell_durations_without_samples(spark, tmp_path):
    wav(tmp_path / "a.wav", np.zeros(12_000))
    # A file whose samples are a hole: nothing of it can be read in memory at once, its header can.
    with open(tmp_path / "huge.wav", "wb") as f:
        f.write(sound.wave_header(16_000, 1_600_000_000))
        f.truncate(44 + 3_200_000_000)
    with open(tmp_path / "wide.wav", "wb") as f:
        f.write(sound.wave_header(48_000, 3_000_000_000))
        f.truncate(80 + 6_000_000_000)
    with open(tmp_path / "cut.wav", "wb") as f:  # says more than it has
        f.write(sound.wave_header(8_000, 8_000) + bytes(8_001))
    (tmp_path / "bad.wav").write_bytes(b"RIFF\0\0\0\0WAVEfmt \x10\0\0\0" + struct.pack("<HHIIHH", 85, 1, 8_000, 0, 0, 16) + b"data\0\0\0\0")
    rows = {r.file_id.rsplit("/", 1)[1]: r for r in sound.durations(spark, str(tmp_path)).collect()}
    assert rows["a.wav"].duration_ms == 1_500 and rows["huge.wav"].duration_ms == 100_000_000 and rows["cut.wav"].frames == 4_000
    assert (rows["wide.wav"].frames, rows["wide.wav"].duration_ms) == (3_000_000_000, 62_500_000)
    assert rows["bad.wav"].duration_ms is None and "85" in rows["bad.wav"].error
    parts = sound._Reader({"path": str(tmp_path / "huge.wav"), "splitbytes": str(64 << 20)}).partitions()
    assert len(parts) == 48 and all(high - low <= 64 << 20 for p in parts for _, _, low, high in p.ranges)
    # The last range of the huge file alone, in a task that holds one chunk.
    last = list(sound._Reader({"path": str(tmp_path / "huge.wav"), "splitbytes": str(64 << 20)}).read(parts[-1]))
    assert last[-1].column("chunk")[0].as_py() == 3_333 and max(len(b.column("samples")[0]) for b in last) == 480_000


def test_files_are_whole_if_the_join_turns_into_a_broadcast(spark, tmp_path):
    """Rows of a file that come from several tasks meet in one, also where the plan changes while it runs."""
    rows = [(f"f{k}", ms, 8_000, [float(k + 1) / 64] * 80) for ms in range(0, 200, 10) for k in range(6)]
    spark.createDataFrame(rows, CHUNK).repartition(5).write.parquet(str(tmp_path / "chunks"))
    settings = {"spark.sql.autoBroadcastJoinThreshold": "1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "8k", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        sound.write(spark.read.parquet(str(tmp_path / "chunks")), str(tmp_path / "out"))
    finally:
        for key in settings:
            spark.conf.unset(key)
    found = {r.file_id.rsplit("/", 1)[1]: r.frames for r in sound.durations(spark, str(tmp_path / "out")).collect()}
    assert found == {f"f{k}.wav": 1_600 for k in range(6)}


def test_other_codings(spark, tmp_path):
    x = np.array([0.0, 0.5, -0.5, 0.25])
    fmt = lambda tag, bits: struct.pack("<4sIHHIIHH", b"fmt ", 16, tag, 1, 8_000, 8_000 * bits // 8, bits // 8, bits)

    def riff(name: str, tag: int, bits: int, raw: bytes, extra: bytes = b"") -> None:
        body = b"WAVE" + fmt(tag, bits) + extra + struct.pack("<4sI", b"data", len(raw)) + raw
        (tmp_path / name).write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)

    riff("u8.wav", 1, 8, (x * 128 + 128).astype(np.uint8).tobytes(), extra=b"LIST\x03\0\0\0abc\0")
    riff("i24.wav", 1, 24, b"".join(int(v * (1 << 23)).to_bytes(3, "little", signed=True) for v in x))
    riff("i32.wav", 1, 32, (x * (1 << 31)).astype("<i4").tobytes())
    riff("f32.wav", 3, 32, x.astype("<f4").tobytes())
    riff("f64.wav", 3, 64, x.astype("<f8").tobytes())
    rate = struct.pack(">HQ", 16383 + 12, 8_000 << 51)
    body = b"AIFF" + struct.pack(">4sIHIH", b"COMM", 18, 1, 4, 16) + rate + struct.pack(">4sIII", b"SSND", 16, 0, 0) + (x * 32768).astype(">i2").tobytes()
    (tmp_path / "a.aiff").write_bytes(b"FORM" + struct.pack(">I", len(body)) + body)
    rows = sound.read(spark, str(tmp_path)).collect()
    assert len(rows) == 6 and all(r.rate == 8_000 and r.error is None and np.allclose(r.samples, x, atol=1e-6) for r in rows)
    with pytest.raises(Exception):
        sound.durations(spark, str(tmp_path / "nowhere")).collect()


def test_written_files_come_back(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = {f"f{k}": rng.uniform(-1, 1, 1_000 + 333 * k) for k in range(5)}
    rows = [(f, a // 8, 8_000, v[a : a + 200].tolist()) for f, v in x.items() for a in range(0, len(v), 200)]
    done = sound.write(spark.createDataFrame(rows, CHUNK).repartition(7), str(tmp_path / "out")).collect()
    assert sorted((r.file_id, r.frames) for r in done) == sorted((f, len(v)) for f, v in x.items())
    for r in sound.read(spark, str(tmp_path / "out")).collect():
        own = x[r.file_id.rsplit("/", 1)[1][:-4]]
        assert np.allclose(r.samples, own, atol=1 / 32768)


def cut(spark, x: np.ndarray, rate: int, ms: int, file: str = "f"):
    n = rate * ms // 1000
    return spark.createDataFrame([(file, a * 1000 // rate, rate, x[a : a + n].tolist()) for a in range(0, len(x), n)], CHUNK).repartition(3)


def speech(rate: int, seconds: float, hz: float = 120.0) -> np.ndarray:
    t = np.arange(int(rate * seconds)) / rate
    x = sum(np.sin(2 * np.pi * hz * h * t) / h for h in range(1, 8)) * 0.2
    return x * ((t % 1.7) < 1.2) + np.random.default_rng(1).normal(0, 0.003, len(t))


def test_frames_do_not_depend_on_chunks_or_blocks(spark):
    x, rate = speech(2_000, 31.37), 2_000
    size, hop = 50, 20
    plain = [(k, np.sqrt(np.mean(x[a : a + size] ** 2)), np.abs(x[a : a + size]).max()) for k, a in enumerate(range(0, len(x) - size + 1, hop))]
    frames = lambda ms, block: audio.frame_energies(cut(spark, x.astype(np.float32), rate, ms), block_ms=block).orderBy("frame").collect()
    first = frames(1_000, 10_000)
    assert [r.frame for r in first] == [k for k, *_ in plain]
    assert np.allclose([(r.rms, r.peak) for r in first], [p[1:] for p in plain], atol=1e-6)
    for ms, block in ((7, 10_000), (7_000, 10_000), (31_370, 10_000), (1_000, 70), (30_000, 1_330)):
        again = frames(ms, block)
        assert [r.frame for r in again] == [r.frame for r in first]
        assert np.allclose([r[2:] for r in again], [r[2:] for r in first], rtol=1e-9, atol=1e-9)
    mel = [audio.mel_energies(cut(spark, x.astype(np.float32), rate, ms)).orderBy("frame").collect() for ms in (1_000, 7_000)]
    assert len(mel[0]) == len(first) and all(np.allclose(a.mel, b.mel, atol=1e-4) for a, b in zip(*mel))
    voices = [voice.voice_frames(cut(spark, x.astype(np.float32), rate, ms), block_ms=b).orderBy("frame").collect() for ms, b in ((500, 10_000), (31_370, 730))]
    assert len(voices[0]) == len(x) // 20 + 1
    for a, b in zip(*voices):
        assert a[:3] == b[:3] and all((p is None) == (q is None) and (p is None or p == pytest.approx(q, rel=1e-6, abs=1e-6)) for p, q in zip(a[3:], b[3:]))


def test_blocks_with_gaps_and_odd_rows(spark):
    rows = [("a", 0, 1_000, [1.0] * 30), ("a", 50, 1_000, [2.0] * 30), ("none", 0, 0, [1.0]), ("empty", 0, 1_000, []), ("null", 0, 1_000, None), (None, 0, 1_000, [3.0] * 5)]
    held = blocks.blocks(spark.createDataFrame(rows, CHUNK), F.lit(10), F.lit(7), 20)
    found = {(b.row.file_id, b.row.block): b for b in blocks.laid(iter([held.toPandas()]), lambda rate: 7)}
    assert set(found) == {("a", 0), ("a", 1), ("a", 2), ("a", 3), ("a", 4), (None, 0)}
    assert found["a", 2].x.tolist() == [0.0] * 10 + [2.0] * 17 or found["a", 2].first == 50
    assert found["a", 1].first == 10 and found["a", 1].x.tolist() == [1.0] * 20 and found["a", 3].ended and not found["a", 0].ended
    assert blocks.blocks(spark.createDataFrame([], CHUNK), F.lit(0), F.lit(0)).count() == 0


def plain_yin(frame: np.ndarray, rate: int, low: float, high: float) -> float:
    """The difference function in plain loops."""
    least, most = max(2, int(rate / high)), max(3, int(np.ceil(rate / low)))
    d = [sum((frame[i] - frame[i + lag]) ** 2 for i in range(most)) for lag in range(most + 2)]
    f = [1.0] + [d[lag] / (sum(d[1 : lag + 1]) / lag) for lag in range(1, most + 2)]
    dips = [lag for lag in range(least, most + 1) if f[lag] <= f[lag - 1] and f[lag] < f[lag + 1] and f[lag] < voice.DIP]
    best = dips[0] if dips else min(range(least, most + 1), key=lambda lag: f[lag])
    bend = f[best - 1] - 2 * f[best] + f[best + 1]
    return rate / (best + max(-0.5, min(0.5, (f[best - 1] - f[best + 1]) / (2 * bend))))


def test_pitch_equals_plain_loops(spark):
    rng = np.random.default_rng(3)
    frames = rng.normal(0, 0.1, (12, 2 * (34 + 2))) + np.sin(2 * np.pi * np.outer(rng.uniform(65, 390, 12), np.arange(72) / 2_000))
    period, _ = voice.periods(frames, 2_000)
    assert np.allclose(2_000 / period, [plain_yin(f, 2_000, 60, 400) for f in frames])


def test_no_octave_errors_with_weak_fundamentals(spark):
    rate, t = 8_000, np.arange(8_000) / 8_000
    for hz in (90.0, 130.0, 190.0, 310.0):
        x = 0.03 * np.sin(2 * np.pi * hz * t) + 0.4 * np.sin(2 * np.pi * 2 * hz * t + 1) + 0.3 * np.sin(2 * np.pi * 3 * hz * t + 2)
        found = voice.pitch(cut(spark, x, rate, 250)).where("frame between 10 and 90").collect()
        assert all(r.hz == pytest.approx(hz, rel=0.01) for r in found) and len(found) == 81
    quiet = voice.pitch(cut(spark, np.random.default_rng(5).normal(0, 0.2, 8_000), rate, 250)).collect()
    assert sum(r.hz is not None for r in quiet) < 0.1 * len(quiet)
    assert all(r.hz is None for r in voice.pitch(cut(spark, np.zeros(4_000), rate, 250)).collect())


def pulses(rate: int, period: float, jitter: float, shimmer_db: float, n: int = 90) -> np.ndarray:
    """Bell-shaped pulses whose periods and levels alternate around their means by known shares."""
    x, at = np.zeros(int(rate * (n + 2) * period / rate) + rate // 10), 0.02 * rate
    for k in range(n):
        level = 0.5 * 10 ** (shimmer_db * (-1) ** k / 40)
        i = np.arange(max(0, int(at - period)), min(len(x), int(at + period)))
        x[i] += level * np.exp(-(((i - at) / 18.0) ** 2))
        at += period * (1 + jitter * (-1) ** k / 2)
    return x


def test_known_voices_give_known_figures(spark):
    rate, period = 16_000, 128.0
    middle = lambda x: voice.voice_frames(cut(spark, x, rate, 300)).where("start_ms between 100 and 500 and hz is not null").agg(*[F.avg(c).alias(c) for c in ("hz", "jitter", "shimmer_db", "hnr_db", "cpp_db")], F.count("hz").alias("n")).first()
    even = middle(pulses(rate, period, 0.0, 0.0))
    assert even.n == 41 and even.hz == pytest.approx(125, rel=0.01) and even.jitter < 0.002 and even.shimmer_db < 0.05 and even.hnr_db > 25
    rough = middle(pulses(rate, period, 0.02, 0.0))
    assert rough.jitter == pytest.approx(0.02, rel=0.15)
    loud = middle(pulses(rate, period, 0.0, 1.0))
    assert loud.shimmer_db == pytest.approx(1.0, rel=0.15)
    noisy = middle(pulses(rate, period, 0.0, 0.0) + np.random.default_rng(1).normal(0, 0.06, len(pulses(rate, period, 0.0, 0.0))))
    assert noisy.hnr_db < even.hnr_db - 10 and noisy.cpp_db < even.cpp_db
    t = np.arange(2 * rate) / rate
    tone, noise = 0.5 * np.sin(2 * np.pi * 150 * t), np.random.default_rng(2).normal(0, 0.5 / np.sqrt(2) / 10 ** (12 / 20), 2 * rate)
    mixed = voice.voice_frames(cut(spark, tone + noise, rate, 300)).where("start_ms between 100 and 1900").agg(F.avg("hnr_db")).first()[0]
    assert mixed == pytest.approx(12, abs=1.5)  # a tone 12 dB above its noise
