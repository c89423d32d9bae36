"""Sound files as a Spark data source: byte ranges of PCM files as partitions, headers alone, and a sink that writes WAVE files."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import materialise

#: Seconds of a chunk row, bytes of a file that one task reads, and what opening a file counts as when files share a task.
CHUNK_S, SPLIT_BYTES, OPEN_BYTES = 30, 64 << 20, 1 << 20
#: Bytes read at a time.
READ_BYTES = 8 << 20
ENDINGS = (".wav", ".wave", ".aif", ".aiff", ".aifc")
SAMPLES = "file_id string, chunk long, start_ms long, rate int, samples array<float>, error string"
HEADERS = "file_id string, rate int, channels int, width int, frames long, duration_ms long, error string"


@dataclass(frozen=True)
class Header:
    """Where a file's samples lie and how they are coded; ``width`` in bytes, ``code`` i (signed), u (from 0 on) or f."""

    rate: int
    channels: int
    width: int
    code: str
    order: str
    start: int
    frames: int

    @property
    def frame_bytes(self) -> int:
        return self.channels * self.width

    def decoded(self, raw: bytes) -> np.ndarray:
        """Mono samples in -1..1 of whole frames."""
        if self.code == "f":
            data = np.frombuffer(raw, f"{self.order}f{self.width}").astype(np.float32)
        elif self.width == 3:
            b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
            low, high = (0, 2) if self.order == "<" else (2, 0)
            data = ((b[:, low] << 8 | b[:, 1] << 16 | b[:, high] << 24) >> 8).astype(np.float32) / (1 << 23)
        elif self.code == "u":
            data = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
        else:
            data = np.frombuffer(raw, f"{self.order}i{self.width}").astype(np.float32) / (1 << (8 * self.width - 1))
        return data.reshape(-1, self.channels).mean(axis=1, dtype=np.float32)


def _exact(file, n: int) -> bytes:
    raw = file.read(n)
    if len(raw) < n:
        raise ValueError("the header ends early")
    return raw


def _extended(raw: bytes) -> int:
    """Whole part of an 80-bit extended float."""
    power, digits = struct.unpack(">HQ", raw)
    return digits >> max(0, 16446 - power) if power < 16447 else 0


def _checked(rate: int, channels: int, width: int, code: str, order: str, start: int, said: int, size: int) -> Header:
    if not rate or not channels or width not in ((4, 8) if code == "f" else (1, 2, 3, 4)):
        raise ValueError(f"no PCM of {channels} channels, {8 * width} bits at {rate} Hz")
    return Header(rate, channels, width, code, order, start, max(0, min(said, size - start)) // (channels * width))


def read_header(file, size: int) -> Header:
    """Header of a RIFF, RF64 or AIFF file of ``size`` bytes; ValueError for anything else. Sample data is not read.

    A data part that is said to be longer than the file (streams, broken copies) ends with the file.
    """
    file.seek(0)
    form = _exact(file, 12)
    if form[:4] in (b"RIFF", b"RF64") and form[8:] == b"WAVE":
        order, wide = "<", None
    elif form[:4] == b"FORM" and form[8:] in (b"AIFF", b"AIFC"):
        order, wide = ">", None
    else:
        raise ValueError("neither a WAVE nor an AIFF file")
    place, coded, data = 12, None, None
    while place + 8 <= size and (coded is None or data is None):
        file.seek(place)
        name, length = struct.unpack(f"{order}4sI", _exact(file, 8))
        if name == b"ds64":
            wide = struct.unpack("<QQ", _exact(file, 16))[1]
        elif name == b"fmt ":
            tag, channels, rate, _, _, bits = struct.unpack("<HHIIHH", _exact(file, 16))
            if tag == 0xFFFE and length >= 26:  # extensible: the tag stands later
                _exact(file, 8)
                tag = struct.unpack("<H", _exact(file, 2))[0]
            if tag not in (1, 3):
                raise ValueError(f"samples are coded in format {tag}, not PCM")
            coded = rate, channels, -(-bits // 8), "f" if tag == 3 else "u" if bits <= 8 else "i", "<"
        elif name == b"COMM":
            channels, _, bits = struct.unpack(">HIH", _exact(file, 8))
            rate = _extended(_exact(file, 10))
            kind = _exact(file, 4) if form[8:] == b"AIFC" else b"NONE"
            if kind not in (b"NONE", b"twos", b"sowt", b"fl32", b"FL32"):
                raise ValueError(f"samples are coded as {kind!r}, not PCM")
            coded = rate, channels, -(-bits // 8), "f" if kind.lower() == b"fl32" else "i", "<" if kind == b"sowt" else ">"
        elif name == b"data":
            data = place + 8, wide if wide is not None and length == 0xFFFFFFFF else length
        elif name == b"SSND":
            data = place + 16 + struct.unpack(">I", _exact(file, 4))[0], length - 8
        place += 8 + length + length % 2
    if coded is None or data is None:
        raise ValueError("no sample data" if coded else "no format")
    return _checked(*coded, *data, size)


@dataclass
class Part(InputPartition):
    """Byte ranges of files: (path, size, from, to)."""

    ranges: list[tuple[str, int, int, int]]


def _listed(path: str) -> tuple[fs.FileSystem, list[fs.FileInfo]]:
    store, base = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(base, recursive=True))
    files = [f for f in found if f.type == fs.FileType.File and f.path.lower().endswith(ENDINGS)]
    return store, sorted(files, key=lambda f: f.path)


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.chunk_s = options["path"], int(options.get("chunkseconds", CHUNK_S))
        self.split, self.only_headers = int(options.get("splitbytes", SPLIT_BYTES)), options.get("headers", "false") == "true"
        if self.chunk_s < 1 or self.split < 1:
            raise ValueError("chunkSeconds and splitBytes must be 1 at least")

    def partitions(self) -> list[Part]:
        """Long files are cut by bytes, short ones share a partition; the driver reads no file."""
        parts, held, weight = [], [], 0
        for f in _listed(self.path)[1]:
            cuts = [0] if self.only_headers else range(0, max(f.size, 1), self.split)
            for low in cuts:
                cost = OPEN_BYTES + (0 if self.only_headers else min(self.split, f.size - low))
                if held and weight + cost > self.split:
                    parts.append(Part(held))
                    held, weight = [], 0
                held.append((f.path, f.size, low, f.size if low + self.split >= f.size or self.only_headers else low + self.split))
                weight += cost
        return [*parts, Part(held)] if held else parts or [Part([])]

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        store = fs.FileSystem.from_uri(self.path)[0] if "://" in self.path else fs.LocalFileSystem()
        rows = self._headers if self.only_headers else self._chunks
        for path, size, low, high in partition.ranges:
            with store.open_input_file(path) as file:
                yield from rows(file, path, size, low, high)

    def _headers(self, file, path: str, size: int, *_: int) -> Iterator[pa.RecordBatch]:
        try:
            h = read_header(file, size)
            row = path, h.rate, h.channels, h.width, h.frames, h.frames * 1000 // h.rate, None
        except (ValueError, struct.error) as e:
            row = path, None, None, None, None, None, str(e)
        kinds = pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()
        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], names=["file_id", "rate", "channels", "width", "frames", "duration_ms", "error"])

    def _chunks(self, file, path: str, size: int, low: int, high: int) -> Iterator[pa.RecordBatch]:
        try:
            h = read_header(file, size)
        except (ValueError, struct.error) as e:
            if low == 0:
                yield _chunk_row(path, 0, 0, 0, np.zeros(0, np.float32), str(e))
            return
        step = self.chunk_s * h.rate
        if not h.frames and low == 0:
            yield _chunk_row(path, 0, 0, h.rate, np.zeros(0, np.float32), None)
        # A range has the chunks whose first byte lies in it; the header's bytes belong to the first chunk.
        first = 0 if low == 0 else max(0, -(-(low - h.start) // (step * h.frame_bytes)))
        for chunk in range(first, -(-h.frames // step)):
            at = h.start + chunk * step * h.frame_bytes
            if chunk and at >= high:
                return
            if chunk == 0 and low > 0:
                continue
            file.seek(at)
            left, parts = min(step, h.frames - chunk * step) * h.frame_bytes, []
            while left > 0 and (raw := file.read(min(left, READ_BYTES // h.frame_bytes * h.frame_bytes))):
                parts.append(h.decoded(raw[: len(raw) // h.frame_bytes * h.frame_bytes]))
                left -= len(raw)
            yield _chunk_row(path, chunk, chunk * self.chunk_s * 1000, h.rate, np.concatenate(parts) if parts else np.zeros(0, np.float32), None)


def _chunk_row(path: str, chunk: int, start_ms: int, rate: int, samples: np.ndarray, error: str | None) -> pa.RecordBatch:
    held = pa.ListArray.from_arrays(pa.array([0, len(samples)], pa.int32()), pa.array(samples, pa.float32()))
    columns = [pa.array([path]), pa.array([chunk]), pa.array([start_ms]), pa.array([rate], pa.int32()), held, pa.array([error], pa.string())]
    return pa.RecordBatch.from_arrays(columns, names=["file_id", "chunk", "start_ms", "rate", "samples", "error"])


class SoundSource(DataSource):
    """``spark.read.format("sound").load(folder)``: chunk rows of PCM files, or with ``headers`` = true a row a file.

    Options: path (a file or folder, searched through), chunkSeconds, splitBytes, headers.
    """

    @classmethod
    def name(cls) -> str:
        return "sound"

    def schema(self) -> str:
        return HEADERS if self.options.get("headers", "false") == "true" else SAMPLES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(dict(self.options))


def read(spark: SparkSession, path: str, chunk_s: int = CHUNK_S, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """PCM files (WAVE, RF64, AIFF) as chunk rows: (file_id, chunk, start_ms, rate, samples array<float>, error).

    Samples are mono, in -1..1. A file is read in ranges of ``split_bytes`` by different tasks; a task holds one chunk. A file
    that cannot be decoded gives one row with the error and no samples, one without samples a row without error.
    """
    spark.dataSource.register(SoundSource)
    return spark.read.format("sound").option("chunkSeconds", chunk_s).option("splitBytes", split_bytes).load(path)


def durations(spark: SparkSession, path: str) -> DataFrame:
    """Facts of files from their headers alone: (file_id, rate, channels, width, frames, duration_ms, error)."""
    spark.dataSource.register(SoundSource)
    return spark.read.format("sound").option("headers", "true").load(path)


def write(chunks: DataFrame, path: str) -> DataFrame:
    """Write chunk rows as WAVE files of 16 bits, ``<file_id>.wav`` each, and give (file_id, path, frames) back.

    ``chunks`` has file_id, start_ms, rate, samples, without laps. A file's rows meet sorted in one task, which streams them
    into a file of its own name and then renames it, so a task that is run again does no harm. Files longer than 4 GB get
    an RF64 header.
    """
    rows = chunks.select("file_id", "start_ms", "rate", "samples")
    length = rows.groupBy(F.col("file_id").alias("_f")).agg(F.sum(F.size("samples")).cast("long").alias("frames"))
    sorted_ = rows.join(length, rows["file_id"] == length["_f"]).select("file_id", "start_ms", "rate", "frames", "samples")
    # By a hash: the join deals rows out by file_id too, so a plain repartition would be left out of the plan, and the join may then
    # be turned into a broadcast while it runs, which leaves rows where they were.
    sorted_ = sorted_.repartition(F.xxhash64("file_id")).sortWithinPartitions("file_id", "start_ms")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from uuid import uuid4

        store, base = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
        store.create_dir(base)
        now, out, places, done = None, None, None, []

        def close() -> None:
            if out is not None:
                out.close()
                store.move(places[0], places[1])

        for batch in batches:
            for file_id, rate, frames, samples in zip(*(batch.column(c) for c in ("file_id", "rate", "frames", "samples"))):
                if file_id.as_py() != now:
                    close()
                    now = file_id.as_py()
                    places = f"{base}/_{uuid4().hex}", f"{base}/{str(now).replace('/', '_')}.wav"
                    out = store.open_output_stream(places[0])
                    out.write(wave_header(rate.as_py(), frames.as_py()))
                    done.append((now, places[1], frames.as_py()))
                x = samples.values.to_numpy(zero_copy_only=False) if samples.is_valid else np.zeros(0)
                out.write(np.clip(np.rint(x.astype(float) * 32768), -32768, 32767).astype("<i2").tobytes())
        close()
        if done:
            yield pa.RecordBatch.from_pylist([dict(zip(("file_id", "path", "frames"), d)) for d in done], pa.schema([("file_id", batch.schema.field("file_id").type), ("path", pa.string()), ("frames", pa.int64())]))

    kind = dict(rows.dtypes)["file_id"]
    return materialise(sorted_.mapInArrow(run, f"file_id {kind}, path string, frames long"), "sounds")


def wave_header(rate: int, frames: int) -> bytes:
    """Header of a mono file of 16 bits."""
    size = 2 * frames
    coded = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, 2 * rate, 2, 16)
    if size + 36 < 1 << 32:
        return struct.pack("<4sI4s", b"RIFF", size + 36, b"WAVE") + coded + struct.pack("<4sI", b"data", size)
    wide = struct.pack("<4sIQQQI", b"ds64", 28, size + 72, size, frames, 0)
    return struct.pack("<4sI4s", b"RF64", 0xFFFFFFFF, b"WAVE") + wide + coded + struct.pack("<4sI", b"data", 0xFFFFFFFF)
