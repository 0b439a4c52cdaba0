"""WAV audio as tables: headers, and mono samples at a common rate."""

from __future__ import annotations

import functools
import io
import math
import wave

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Half length of the resampling filter in zero crossings, and its Kaiser window's shape.
HALF_CROSSINGS, KAISER_BETA = 10, 5.0
#: Products of taps and samples that are held at once.
NUMBERS_AT_ONCE = 1_000_000


def decode_wav(content: bytes) -> tuple[np.ndarray, dict]:
    """(float32 samples by channel, header facts) of PCM data of 8, 16, 24 or 32 bits."""
    with wave.open(io.BytesIO(content)) as w:
        rate, n, channels, width = w.getframerate(), w.getnframes(), w.getnchannels(), w.getsampwidth()
        raw = w.readframes(n)
    if width == 1:
        x = (np.frombuffer(raw, np.uint8).astype(np.float32) - 128) / 128
    elif width == 3:
        b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
        x = ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8).astype(np.float32) / 2**23
    else:
        x = np.frombuffer(raw, {2: "<i2", 4: "<i4"}[width]).astype(np.float32) / 2 ** (8 * width - 1)
    x = x.reshape(-1, channels) if channels else x.reshape(0, 1)
    return x, {"sample_rate": rate, "n_samples": n, "channels": channels, "duration_seconds": n / rate if rate else 0.0, "format": "WAV", "subtype": f"PCM_{8 * width}"}


@functools.lru_cache(maxsize=16)
def _phases(up: int, down: int) -> tuple[np.ndarray, int]:
    """Taps of each output phase, from the newest input sample back, and the filter's half length; zeros where a phase has a tap less."""
    m = max(up, down)
    half = HALF_CROSSINGS * m
    t = np.arange(-half, half + 1)
    h = np.sinc(t / m) * np.kaiser(2 * half + 1, KAISER_BETA)
    h *= up / h.sum()
    return np.append(h, np.zeros(-len(h) % up)).reshape(-1, up).T.copy(), half


def resample(x: np.ndarray, up: int, down: int) -> np.ndarray:
    """Polyphase resampling by up / down with a windowed sinc filter. The filter is made once; all phases are taken together, a block of outputs at a time."""
    g = math.gcd(up, down)
    up, down = up // g, down // g
    if up == down or not len(x):
        return x
    phases, half = _phases(up, down)
    n, width = -(-len(x) * up // down), phases.shape[1]
    padded = np.concatenate([np.zeros(width), x, np.zeros(width + half // up)])
    out = np.empty(n)
    step = max(1, NUMBERS_AT_ONCE // width)
    for s in range(0, n, step):
        newest, phase = np.divmod(np.arange(s, min(s + step, n)) * down + half, up)
        out[s : s + step] = (padded[newest[:, None] + width - np.arange(width)] * phases[phase]).sum(axis=1)
    return out


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.[wW][aA][vV]").load(path)
    return files.select(F.regexp_extract("path", r"([^/]+)\.[^./]+$", 1).alias("recording_id"), "path", "content")


def inspect_audio(spark: SparkSession, path: str) -> DataFrame:
    """inspected() of the files under a path."""
    return inspected(_files(spark, path))


def inspected(files: DataFrame) -> DataFrame:
    """(recording_id, path, sample_rate, n_samples, channels, duration_seconds, format, subtype, error) of files (recording_id, path, content)."""

    def run(batches):
        for b in batches:
            out = []
            for i, p, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                try:
                    out.append({"recording_id": i, "path": p, **decode_wav(c)[1], "error": None})
                except (wave.Error, EOFError, KeyError, ValueError) as e:
                    out.append({"recording_id": i, "path": p, "error": str(e) or type(e).__name__})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("recording_id", pa.string()), ("path", pa.string()), ("sample_rate", pa.int32()), ("n_samples", pa.int64()), ("channels", pa.int32()), ("duration_seconds", pa.float64()), ("format", pa.string()), ("subtype", pa.string()), ("error", pa.string())]))

    return files.select("recording_id", "path", "content").mapInArrow(run, "recording_id string, path string, sample_rate int, n_samples bigint, channels int, duration_seconds double, format string, subtype string, error string")


def load_standardised(spark: SparkSession, path: str, rate: int) -> DataFrame:
    """standardised() of the files under a path."""
    return standardised(_files(spark, path), rate)


def standardised(files: DataFrame, rate: int) -> DataFrame:
    """AUDIO rows of files (recording_id, path, content): channels averaged, resampled to rate; actions tells what was done."""

    def run(batches):
        for b in batches:
            out = []
            for i, c in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                x, meta = decode_wav(c)
                actions = ["averaged_channels"] if meta["channels"] > 1 else []
                mono = x.mean(axis=1)
                if meta["sample_rate"] != rate:
                    mono = resample(mono, rate, meta["sample_rate"])
                    actions.append(f"resampled_{meta['sample_rate']}_to_{rate}")
                out.append({"recording_id": i, "sample_rate": rate, "n_samples": len(mono), "duration_seconds": meta["duration_seconds"], "samples": mono.astype(np.float32), "actions": actions})
            yield pa.RecordBatch.from_pylist(out, schema=pa.schema([("recording_id", pa.string()), ("sample_rate", pa.int32()), ("n_samples", pa.int64()), ("duration_seconds", pa.float64()), ("samples", pa.list_(pa.float32())), ("actions", pa.list_(pa.string()))]))

    return files.select("recording_id", "path", "content").mapInArrow(run, "recording_id string, sample_rate int, n_samples bigint, duration_seconds double, samples array<float>, actions array<string>")
