"""Media columns: audio features.

A column of 16-bit little-endian mono PCM with its sampling rate is resampled to RATE by a polyphase windowed-sinc filter, framed with overlap (WINDOW samples every HOP), and turned into log-mel energies. They are stored in tensors of the fixed shape FRAMES x MELS (32-bit floats, row-major, the last one filled up with the floor), one a row with its time span and the number of frames that are real; `tensors` gives an Arrow column of fixed_shape_tensor without copying, and `saved` stores the table with that type: Spark itself has no such type, so each task writes its rows as a Parquet file by Arrow, which any reader of Arrow gets back as tensors. Speech is segmented by hysteresis: a segment opens at a frame with energy within OPEN dB of the clip's loudest and lasts while frames stay within CLOSE dB; its time spans come with each tensor they touch.

Defined cases. Null or empty PCM, or a null or non-positive rate: one row with no tensor, no span and no frames. An odd last byte is left out. A clip shorter than a window is one frame, filled up with silence. A silent clip has features at the floor and no speech. Rows are never merged: repeated rows are each returned, under whatever key columns are named, nulls included; a result column whose name is a key's gets underscores. Other columns are ignored. Clips of any length are covered whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codexa.llm._base import fresh, prepare

RATE, WINDOW, HOP, FFT, MELS, FRAMES = 16_000, 400, 160, 512, 40, 64
OPEN, CLOSE, SHORTEST = 25.0, 35.0, 3
FLOOR = math.log(1e-10)
TAPS = 16


@cache
def polyphase(up: int, down: int) -> np.ndarray:
    """The filter's phases, up x taps: phase p holds every up-th tap of a Kaiser-windowed sinc cut off at the lower of both rates."""
    ratio = max(up, down)
    half = TAPS * ratio // 2
    n = np.arange(-half, half + 1)
    taps = np.sinc(n / ratio) * np.kaiser(len(n), 8.0) * up / ratio
    size = -(-len(taps) // up)
    padded = np.zeros(size * up)
    padded[: len(taps)] = taps
    return np.ascontiguousarray(padded.reshape(size, up).T.astype(np.float32))


def resample(x: np.ndarray, rate: int, to: int = RATE) -> np.ndarray:
    """x at another rate: ceil(len(x) * to / rate) samples, each phase of the filter applied only where its outputs fall."""
    g = math.gcd(rate, to)
    up, down = to // g, rate // g
    if up == down or not len(x):
        return x.astype(np.float32)
    phases = polyphase(up, down)
    half = TAPS * max(up, down) // 2
    n = -(-len(x) * up // down)
    out = np.zeros(n, np.float32)
    # output k is at k * down + half on the filter's fine grid: its phase, and the newest input it takes
    for first in range(min(up, n)):
        at = (first * down + half) % up
        newest = (np.arange(first, n, up, dtype=np.int64) * down + half) // up
        if down == 1:
            y = np.convolve(x, phases[at])
            out[first::up] = y[np.minimum(newest, len(y) - 1)] * (newest < len(y))
        else:
            taken = newest[:, None] - np.arange(phases.shape[1])
            inside = (taken >= 0) & (taken < len(x))
            out[first::up] = (x[np.clip(taken, 0, len(x) - 1)] * inside) @ phases[at]
    return out


@cache
def mel_bank(rate: int = RATE, fft: int = FFT, mels: int = MELS) -> np.ndarray:
    """Triangular filters, (fft / 2 + 1) x mels, evenly spaced in mel from 0 to half the rate."""
    top = 2595 * math.log10(1 + rate / 2 / 700)
    edges = 700 * (10 ** (np.linspace(0, top, mels + 2) / 2595) - 1)
    f = np.arange(fft // 2 + 1) * rate / fft
    rise = (f[:, None] - edges[:-2]) / (edges[1:-1] - edges[:-2])
    fall = (edges[2:] - f[:, None]) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(rise, fall)).astype(np.float32)


def log_mel(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(frames x MELS log energies, each frame's energy in dB) of a clip at RATE."""
    n = 1 + max(0, -(-(len(x) - WINDOW) // HOP))
    padded = np.zeros((n - 1) * HOP + WINDOW, np.float32)
    padded[: len(x)] = x
    frames = np.lib.stride_tricks.sliding_window_view(padded, WINDOW)[::HOP]
    window = np.hanning(WINDOW + 1)[:-1].astype(np.float32)
    mel, energy = np.empty((n, MELS), np.float32), np.empty(n, np.float32)
    for lo in range(0, n, 1024):
        part = frames[lo : lo + 1024]
        power = np.abs(np.fft.rfft(part * window, FFT)).astype(np.float32)
        power *= power
        mel[lo : lo + 1024] = np.log(np.maximum(power @ mel_bank(), 1e-10))
        energy[lo : lo + 1024] = 10 * np.log10(np.maximum((part * part).mean(axis=1), 1e-10))
    return mel, energy


def speech(energy: np.ndarray, open_db: float = OPEN, close_db: float = CLOSE, shortest: int = SHORTEST) -> list[tuple[int, int]]:
    """Frames [a, b) of the segments: they open within open_db of the loudest frame, last while within close_db, and have `shortest` frames or more."""
    if not len(energy) or energy.max() <= -99:
        return []
    alive, loud = energy >= energy.max() - close_db, energy >= energy.max() - open_db
    edge = np.diff(np.concatenate([[0], alive.view(np.int8), [0]]))
    runs = zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)
    out = []
    for a, b in runs:
        hits = np.flatnonzero(loud[a:b])
        if len(hits) and b - (a + hits[0]) >= shortest:
            out.append((int(a + hits[0]), int(b)))
    return out


_FIELDS = [
    T.StructField("chunk", T.IntegerType()), T.StructField("tensor", T.BinaryType()), T.StructField("frames", T.IntegerType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType()),
    T.StructField("speech", T.ArrayType(T.StructType([T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())]))),
]
_SPEECH = pa.list_(pa.struct([("start_s", pa.float64()), ("end_s", pa.float64())]))


def clip(pcm: bytes | None, rate: int | None) -> list[tuple]:
    """(chunk, tensor, frames, start_s, end_s, speech) rows of one clip."""
    if not pcm or len(pcm) < 2 or not rate or rate <= 0:
        return [(0, None, 0, None, None, [])]
    x = np.frombuffer(pcm, "<i2", len(pcm) // 2).astype(np.float32) / 32768
    mel, energy = log_mel(resample(x, int(rate)))
    length, step = len(x) / rate, HOP / RATE
    spans = [(a * step, min(length, (b - 1) * step + WINDOW / RATE)) for a, b in speech(energy)]
    out = []
    for k in range(-(-len(mel) // FRAMES)):
        part = mel[k * FRAMES : (k + 1) * FRAMES]
        full = np.full((FRAMES, MELS), FLOOR, np.float32)
        full[: len(part)] = part
        a, b = k * FRAMES * step, min(length, (k * FRAMES + len(part) - 1) * step + WINDOW / RATE)
        out.append((k, full.tobytes(), len(part), a, b, [{"start_s": s, "end_s": e} for s, e in spans if s < b and e > a]))
    return out


_NAMES = ("chunk", "tensor", "frames", "start_s", "end_s", "speech")


def _featured(keys: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                rows, at = [], []
                for i, (pcm, rate) in enumerate(zip(part.column(keys).to_pylist(), part.column(keys + 1).to_pylist(), strict=True)):
                    found = clip(pcm, rate)
                    rows += found
                    at += [i] * len(found)
                cols = list(zip(*rows, strict=True))
                types = [pa.int32(), pa.binary(), pa.int32(), pa.float64(), pa.float64(), _SPEECH]
                made = [pa.array(c, t) for c, t in zip(cols, types, strict=True)]
                yield pa.RecordBatch.from_arrays([*[part.column(k).take(pa.array(at)) for k in range(keys)], *made], names=names)

    return run


def features(clips: DataFrame, keys: list[str], pcm: str = "pcm", rate: str = "rate") -> DataFrame:
    """The key columns and (chunk, tensor, frames, start_s, end_s, speech) of every clip."""
    prepare(clips.sparkSession)
    made: list[str] = []
    for name in _NAMES:
        made.append(fresh([*keys, *made], name))
    schema = T.StructType([*[clips.schema[k] for k in keys], *[T.StructField(n, f.dataType) for n, f in zip(made, _FIELDS, strict=True)]])
    taken = clips.select(*keys, F.col(pcm).alias(fresh(keys, "_pcm")), F.col(rate).cast("int").alias(fresh(keys, "_rate")))
    return taken.mapInArrow(_featured(len(keys), [*keys, *made]), schema)


def tensors(table: pa.Table) -> pa.FixedShapeTensorArray:
    """The tensor column as Arrow's fixed-shape tensors of FRAMES x MELS, sharing the bytes; rows without a tensor must be filtered out first."""
    return _shaped(table.column("tensor"))


def _shaped(column: pa.ChunkedArray) -> pa.FixedShapeTensorArray:
    column = column.combine_chunks()
    _, at, data = column.buffers()
    first = np.frombuffer(at, np.int32)[column.offset]
    values = pa.Array.from_buffers(pa.float32(), len(column) * FRAMES * MELS, [None, data.slice(int(first))])
    return pa.ExtensionArray.from_storage(pa.fixed_shape_tensor(pa.float32(), [FRAMES, MELS]), pa.FixedSizeListArray.from_arrays(values, FRAMES * MELS))


def _saving(folder: str, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.fs
        import pyarrow.parquet as pq
        from pyspark import TaskContext

        system, base = pyarrow.fs.FileSystem.from_uri(folder)
        context = TaskContext.get()
        name, part, out, rows = f"part-{context.partitionId():05d}.parquet", f"{base}/_part-{context.taskAttemptId()}", None, 0
        for batch in batches:
            held = pa.Table.from_batches([batch])
            real = held.filter(held.column(at).is_valid())
            if real.num_rows:
                table = real.set_column(at, held.schema.names[at], _shaped(real.column(at)))
                out = out or pq.ParquetWriter(part, table.schema, filesystem=system)
                out.write_table(table)
                rows += table.num_rows
        if out is not None:
            out.close()
            system.move(part, f"{base}/{name}")  # a repeated task writes the same file again
            yield pa.record_batch([pa.array([name]), pa.array([rows])], names=["file", "rows"])

    return run


def saved(featured: DataFrame, folder: str, tensor: str = "tensor") -> DataFrame:
    """Stores the rows that have a tensor below the folder (a URI that all executors share), with the tensors as Arrow's fixed-shape type; (file, rows) of what was written."""
    import pyarrow.fs

    system, base = pyarrow.fs.FileSystem.from_uri(folder)
    system.create_dir(base, recursive=True)
    done = featured.mapInArrow(_saving(folder, featured.columns.index(tensor)), "file string, rows long").toArrow()  # a row a task
    return featured.sparkSession.createDataFrame(done)


# The tables hold no sound. The query reads each turn of a conversation aloud: a tone for every byte of text, pauses at sentence and line ends.
VOICE_RATE = 8000
_PITCH = np.array([150 + 12 * (b % 128) for b in range(256)]) / VOICE_RATE
_LOUD = np.array([0.0 if b < 48 else 0.2 + 0.3 * ((b * 37) % 64) / 64 for b in range(256)])
_LENGTH = np.array([1600 if b == 10 else 800 if b in b".!?" else 8 for b in range(256)])


def voice(text: str) -> bytes:
    """16-bit PCM at VOICE_RATE."""
    b = np.frombuffer(text.encode(), np.uint8)
    each = _LENGTH[b]
    wave = np.sin(2 * np.pi * np.cumsum(np.repeat(_PITCH[b], each))) * np.repeat(_LOUD[b], each)
    return (wave * 32767).astype("<i2").tobytes()


def _voiced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 32):
            part = batch.slice(lo, 32)
            pcm = [None if t is None else voice(t) for t in part.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(pcm, pa.binary()), pa.array([VOICE_RATE] * len(pcm), pa.int32())], names=["conv_id", "turn", "pcm", "rate"])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "text")
    return features(turns.mapInArrow(_voiced, "conv_id long, turn long, pcm binary, rate int"), ["conv_id", "turn"])
