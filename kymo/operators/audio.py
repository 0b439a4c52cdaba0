"""Acoustic and linguistic features of recordings on the frame grid.

The transforms are NumPy in Arrow batches, one recording's samples at a time, as Spark has no Fourier transform;
interval features are DataFrame operations on the grid.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.functions.scalars import frame_count, is_blank, nearest_frame
from kymo.schema import PHONE_TIERS, WORD_TIERS

#: Window, mel bands, F0 range, YIN's window and threshold, roll-off share, floor of power and range of decibels.
WINDOW, BANDS, F0_RANGE, YIN_WINDOW, YIN_THRESHOLD, ROLL_OFF, POWER_FLOOR, TOP_DB = 400, 40, (60.0, 500.0), 2048, 0.1, 0.85, 1e-10, 80.0
RICH_RATE = 50.0
DESCRIPTORS = ("spectral_flux", "spectral_centroid", "spectral_bandwidth", "spectral_rolloff", "zero_crossing_rate")


def interpolated(values: np.ndarray, source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Columns linearly interpolated, ends held; zeros without a source."""
    values = np.asarray(values, float).reshape(len(values), -1)
    if not len(source):
        return np.zeros((len(target), values.shape[1]))
    if (np.diff(source) <= 0).any():
        raise ValueError("source times must increase")
    return np.stack([np.interp(target, source, c) for c in values.T], axis=1)


def mel_filters(rate: int, window: int, bands: int) -> np.ndarray:
    """Area-normalised triangles, linear below 1 kHz and logarithmic above."""
    step, knee, log_step = 200 / 3, 1000.0, np.log(6.4) / 27

    def to_mel(f):
        return np.where(f < knee, f / step, knee / step + np.log(np.maximum(f, 1e-12) / knee) / log_step)

    def to_hz(m):
        return np.where(m < knee / step, m * step, knee * np.exp(log_step * (m - knee / step)))

    edges = to_hz(np.linspace(0, to_mel(np.array(rate / 2)), bands + 2))
    bins = np.fft.rfftfreq(window, 1 / rate)
    up = (bins[None] - edges[:-2, None]) / np.diff(edges)[:-1, None]
    down = (edges[2:, None] - bins[None]) / np.diff(edges)[1:, None]
    return np.maximum(0, np.minimum(up, down)) * (2 / (edges[2:] - edges[:-2]))[:, None]


def framed(x: np.ndarray, size: int, hop: int, centred: bool = False) -> np.ndarray:
    if centred:
        x = np.pad(x, size // 2)
    if len(x) < size:
        return np.zeros((0, size))
    return np.lib.stride_tricks.sliding_window_view(x, size)[::hop]


def power_spectra(x: np.ndarray, window: int, hop: int) -> np.ndarray:
    return np.abs(np.fft.rfft(framed(x, window, hop) * np.hanning(window + 1)[:-1], axis=1)) ** 2


def decibels(power: np.ndarray) -> np.ndarray:
    db = 10 * np.log10(np.maximum(power, POWER_FLOOR))
    return np.maximum(db, db.max() - TOP_DB) if db.size else db


def envelope(x: np.ndarray) -> np.ndarray:
    """Magnitude of the analytic signal."""
    n = len(x)
    if not n:
        return np.zeros(0)
    h = np.zeros(n)
    h[0] = 1
    h[1 : (n + 1) // 2] = 2
    if n % 2 == 0:
        h[n // 2] = 1
    return np.abs(np.fft.ifft(np.fft.fft(x) * h))


def fundamental(x: np.ndarray, rate: int, hop: int, low: float = F0_RANGE[0], high: float = F0_RANGE[1]) -> np.ndarray:
    """F0 of centred frames by the cumulative mean normalised difference."""
    size = YIN_WINDOW
    half = size // 2
    shortest, longest = max(1, int(rate / high)), min(half - 1, int(np.ceil(rate / low)))
    out = []
    for f in framed(x, size, hop, centred=True):
        spectrum = np.fft.rfft(f, 2 * size)
        head = np.fft.rfft(f[:half][::-1], 2 * size)
        correlation = np.fft.irfft(spectrum * head)[half - 1 : half + longest + 1]
        energy = np.concatenate([[0], np.cumsum(f**2)])
        energy = energy[half : half + longest + 2] - energy[: longest + 2]
        d = energy[0] + energy[: longest + 2] - 2 * correlation[: longest + 2]
        d = np.maximum(d, 0)
        normal = np.ones_like(d)
        total = np.cumsum(d[1:])
        normal[1:] = d[1:] * np.arange(1, len(d)) / np.maximum(total, 1e-300)
        part = normal[shortest : longest + 1]
        dips = np.flatnonzero((part[1:-1] < part[:-2]) & (part[1:-1] <= part[2:])) + 1
        good = dips[part[dips] < YIN_THRESHOLD]
        k = int(good[0]) if len(good) else int(dips[np.argmin(part[dips])]) if len(dips) else int(np.argmin(part))
        lag = k + shortest
        a, b, c = normal[lag - 1], normal[lag], normal[min(lag + 1, len(normal) - 1)]
        bend = a - 2 * b + c
        shift = 0.5 * (a - c) / bend if abs(bend) > 1e-12 and abs(a - c) < 2 * abs(bend) else 0.0
        out.append(rate / (lag + shift))
    return np.array(out)


def gradients(values: np.ndarray, step: float) -> tuple[np.ndarray, np.ndarray]:
    if len(values) < 2:
        return np.zeros_like(values), np.zeros_like(values)
    first = np.gradient(values, step, axis=0)
    return first, np.gradient(first, step, axis=0)


def acoustic(x: np.ndarray, rate: int, times: np.ndarray, grid_rate: float, rich: bool = False) -> tuple[np.ndarray, list[str], list[str]]:
    """(matrix on the grid, names, families) of the signal's features."""
    if rich and grid_rate != RICH_RATE:
        raise ValueError(f"rich features need a grid of {RICH_RATE:g} frames a second")
    hop = max(1, round(rate / grid_rate))
    power = power_spectra(x, WINDOW, hop)
    mel = decibels(power @ mel_filters(rate, WINDOW, BANDS).T)
    centres = (np.arange(len(mel)) * hop + WINDOW / 2) / rate
    blocks = [interpolated(mel, centres, times), interpolated(envelope(x)[:, None], np.arange(len(x)) / rate, times)]
    names = [f"logmel_{i:02d}" for i in range(BANDS)] + ["broadband_envelope"]
    families = ["acoustic"] * (BANDS + 1)
    if rich:
        d1, d2 = gradients(mel, hop / rate)
        change = np.maximum(np.diff(mel, axis=0, prepend=mel[:1]), 0)
        magnitude, bins = np.sqrt(power), np.fft.rfftfreq(WINDOW, 1 / rate)
        weight = magnitude / np.maximum(magnitude.sum(axis=1, keepdims=True), 1e-12)
        centroid = weight @ bins
        width = np.sqrt((weight * (bins[None] - centroid[:, None]) ** 2).sum(axis=1))
        roll = bins[np.argmax(np.cumsum(magnitude, axis=1) >= ROLL_OFF * magnitude.sum(axis=1, keepdims=True), axis=1)]
        signs = np.signbit(framed(x, WINDOW, hop))
        crossings = (signs[:, 1:] != signs[:, :-1]).sum(axis=1) / WINDOW
        native = np.column_stack([d1, d2, np.sqrt((change**2).mean(axis=1)), centroid, width, roll, crossings])
        blocks.append(interpolated(np.nan_to_num(native, nan=0.0, posinf=0.0, neginf=0.0), centres, times))
        names += [f"logmel_delta_{i:02d}" for i in range(BANDS)] + [f"logmel_delta2_{i:02d}" for i in range(BANDS)] + list(DESCRIPTORS)
        families += ["acoustic"] * (2 * BANDS + len(DESCRIPTORS))
    pitch = fundamental(x, rate, hop)
    size = max(2 * hop, 256)
    rms = np.sqrt((framed(x, size, hop, centred=True) ** 2).mean(axis=1))
    n = min(len(pitch), len(rms))
    voiced = (rms[:n] > np.median(rms[:n])).astype(float) if n else np.zeros(0)
    blocks.append(interpolated(np.column_stack([np.nan_to_num(pitch[:n]), voiced, rms[:n]]), np.arange(n) * hop / rate, times))
    names += ["f0_hz", "voicing", "rms_intensity"]
    families += ["prosodic"] * 3
    onset = np.zeros((len(times), 1))
    onset[:1] = 1
    return np.concatenate([*blocks, onset], axis=1), [*names, "recording_onset"], [*families, "onset"]


def signal_schema(rich: bool = False) -> tuple[list[str], list[str]]:
    _, names, families = acoustic(np.zeros(YIN_WINDOW), 16_000, np.zeros(1), RICH_RATE, rich)
    return names, families


def interval_schema(categories: list[str]) -> tuple[list[str], list[str]]:
    return ["phone_onset", *[f"phone_category:{c}" for c in categories], "word_onset", "word_boundary", "word_duration"], ["phonetic"] * (1 + len(categories)) + ["word"] * 3


def phone_categories(intervals: DataFrame) -> list[str]:
    """All labels of phone tiers, sorted: one schema for all recordings."""
    rows = intervals.where(F.lower("tier").isin(*PHONE_TIERS) & ~is_blank("label")).select("label").distinct().orderBy("label")
    return [r.label for r in rows.collect()]  # the phone inventory


def interval_features(intervals: DataFrame, recordings: DataFrame, categories: list[str], rate: float = 50.0) -> DataFrame:
    """(recording_id, frame, events map<int,double>): counts and durations of phones and words at their nearest frames."""
    n = recordings.select("recording_id", frame_count(F.col("duration_seconds"), rate).alias("n")).where("n > 0")
    rows = intervals.where(~is_blank("label")).join(n, "recording_id")
    phone, word = F.lower("tier").isin(*PHONE_TIERS), F.lower("tier").isin(*WORD_TIERS)
    column = F.nullif(F.array_position(F.array(*[F.lit(c) for c in categories]).cast("array<string>"), F.col("label")).cast("int"), F.lit(0))  # null: no such category
    first = len(categories) + 1
    cell = lambda t, i, w: F.struct(nearest_frame(t, rate, F.col("n")).alias("frame"), i.alias("i"), w.cast("double").alias("w"))
    cells = F.when(phone, F.array(cell(F.col("start"), F.lit(0), F.lit(1)), cell(F.col("start"), column, F.lit(1)))).when(
        word, F.array(cell(F.col("start"), F.lit(first), F.lit(1)), cell(F.col("end"), F.lit(first + 1), F.lit(1)), cell(F.col("start"), F.lit(first + 2), F.col("end") - F.col("start")))
    )
    long = rows.select("recording_id", F.explode(cells).alias("c")).where("c.i is not null").select("recording_id", "c.*")
    long = long.groupBy("recording_id", "frame", "i").agg(F.sum("w").alias("w"))
    return long.groupBy("recording_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct("i", "w"))).alias("events"))


def extract_features(audio: DataFrame, intervals: DataFrame, rate: float = 50.0, categories: list[str] | None = None, rich: bool = False) -> tuple[DataFrame, list[str], list[str]]:
    """(frames (recording_id, frame, t, x), names, families) of recordings (recording_id, sample_rate, duration_seconds, samples).

    Columns: the signal's, its onset, then phones and words. Values are rounded to single precision.
    """
    categories = phone_categories(intervals) if categories is None else categories

    def run(batches):
        for b in batches:
            for i, sr, d, s in zip(*(b.column(c) for c in ("recording_id", "sample_rate", "duration_seconds", "samples")), strict=True):
                times = np.arange(int(np.floor(d.as_py() * rate + 1e-9))) / rate
                x, _, _ = acoustic(np.asarray(s.values, dtype=float), sr.as_py(), times, rate, rich)
                n = len(times)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * n, pa.string()), pa.array(np.arange(n), pa.int32()), pa.array(times), pa.array(list(x), pa.list_(pa.float64()))], ["recording_id", "frame", "t", "signal"])

    signal = audio.select("recording_id", "sample_rate", "duration_seconds", "samples").mapInArrow(run, "recording_id string, frame int, t double, signal array<double>")
    names, families = signal_schema(rich)
    more, more_families = interval_schema(categories)
    events = interval_features(intervals, audio.select("recording_id", "duration_seconds"), categories, rate)
    joined = signal.join(events, ["recording_id", "frame"], "left")
    linguistic = F.transform(F.sequence(F.lit(0), F.lit(len(more) - 1)), lambda i: F.coalesce(F.try_element_at("events", i), F.lit(0.0)))
    x = F.transform(F.concat("signal", linguistic), lambda v: v.cast("float").cast("double"))
    return joined.select("recording_id", "frame", "t", x.alias("x")), names + more, families + more_families
