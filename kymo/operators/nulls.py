"""Null ensembles by moments: circularly shifted fits without moving a frame.

A null draw rolls each shifted family's columns around a recording, and the fit then needs the moments of the lagged columns, zeros beyond the
ends, beside the targets. Rolling changes a product sum only through the distance of its two columns, so the sums at all distances,
one Fourier product for each pair of columns, hold those of every draw; what the zeros beyond the ends change are
the first and last rows, as many as the longest lag, which are recomputed for each draw. One pass over a recording's frames gives the moments of a whole ensemble.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.functions.streams import matrix_of, spread
from kymo.operators.lags import shift_of
from kymo.operators.moments import Moments, Plan
from kymo.schema import SUBSTANTIVE

#: Numbers of the draws' moments that are filled at once.
NUMBERS_AT_ONCE = 16_000_000
_LIST = pa.list_(pa.float64())


def shifted_moments(x: np.ndarray, y: np.ndarray, shifts: np.ndarray, lags: list[int]) -> Iterator[Moments]:
    """Moments of [lagged columns | y] for each row of shifts: column c of x rolled by its shift, then lagged, zeros beyond the ends.

    x (frames, columns), y (frames, targets), shifts (draws, columns) and lags in frames. The same as rolling, lagging and summing for each draw.
    """
    n, columns = x.shape
    mean_x, mean_y = x.mean(axis=0), y.mean(axis=0)
    z = np.concatenate([x - mean_x, y - mean_y], axis=1)
    spectrum = np.fft.rfft(z, axis=0)
    k = np.array(lags)
    width, longest = len(k) * columns, int(np.abs(k).max(initial=0))
    edge = np.unique(np.concatenate([np.arange(min(longest, n)), np.arange(max(n - longest, 0), n)]))  # rows at which a lag may look beyond an end
    inside = (edge[:, None] - k >= 0) & (edge[:, None] - k < n)
    mean = np.concatenate([np.tile(mean_x, len(k)), mean_y])
    step = max(1, NUMBERS_AT_ONCE // (width + y.shape[1]) ** 2)
    at = np.arange(columns)
    for begin in range(0, len(shifts), step):
        s = shifts[begin : begin + step]
        cross = np.empty((len(s), width + y.shape[1], width + y.shape[1]))
        by_lag = cross[:, :width, :width].reshape(len(s), len(k), columns, len(k), columns)
        for c in range(columns):
            sums = np.fft.irfft(np.conj(spectrum[:, c, None]) * spectrum, n=n, axis=0)  # at distance d: sum of z[t - d, c] z[t, :]
            own = s[:, c, None] + k
            by_lag[:, :, c] = sums[(own[:, :, None, None] - s[:, None, None, :] - k[:, None]) % n, at]
            cross[:, c : width : columns, width:] = sums[own % n, columns:]
        cross[:, width:, :width] = cross[:, :width, width:].transpose(0, 2, 1)
        cross[:, width:, width:] = z[:, columns:].T @ z[:, columns:]
        for d, own in enumerate(s):
            rolled = z[(edge[:, None, None] - k[:, None] - own) % n, at]
            zeroed = np.where(inside[:, :, None], rolled, -mean_x)
            a, b = (np.concatenate([m.reshape(len(edge), width), z[edge, columns:]], axis=1) for m in (rolled, zeroed))
            off = (b.sum(axis=0) - a.sum(axis=0)) / n
            yield Moments(n, mean + off, cross[d] - a.T @ a + b.T @ b - n * np.outer(off, off))


def null_moments(frames: DataFrame, offsets: DataFrame, plan: Plan, unit: list[str], shifted: tuple[str, ...] = SUBSTANTIVE) -> DataFrame:
    """Moments of each (unit, null_index, recording) of frames (unit columns, recording_id, frame, x, y) under offsets (null_index, recording_id, family, offset_frames).

    Offsets come as a row beside a recording's frames, which are shuffled once; no draw moves any. A task holds one recording and one
    block of draws' moments. Frames may be a row for each recording, without the column frame, x and y being arrays of its frames' arrays: then they are not sorted either.
    """
    moving = [f for f in shifted if f in plan.families]
    draws = offsets.groupBy(F.col("recording_id").cast("string").alias("recording_id"), "null_index").agg(F.map_from_entries(F.collect_list(F.struct("family", "offset_frames"))).alias("by"))
    listed = draws.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct(F.col("null_index").cast("int").alias("null_index"), F.array(*[F.element_at("by", F.lit(f)).cast("int") for f in moving]).alias("by")))).alias("draws"))
    keys = [*unit, "recording_id"]
    family = [moving.index(f) if f in moving else len(moving) for f in plan.families]
    lags = [shift_of(lag, plan.rate) for lag in plan.lags]

    names = [*keys, "null_index", "n", "mean", "cross", "raw_n", "raw_mean", "raw_cross"]
    schema = "".join(f"{k} string, " for k in keys) + "null_index int, n bigint, mean array<double>, cross array<double>, raw_n bigint, raw_mean array<double>, raw_cross array<double>"

    def moments_of(x: np.ndarray, y: np.ndarray, draws: np.ndarray, shifts: np.ndarray, key: list[pa.Scalar]) -> Iterator[pa.RecordBatch]:
        by = np.append(shifts.reshape(len(draws), len(moving)), np.zeros((len(draws), 1), dtype=np.int64), axis=1)[:, family].astype(np.int64)
        raw = shifted_moments(x, y[:, :0], by, [0]) if plan.capacity else iter(())
        for draw, m in zip(draws, shifted_moments(x, y, by, lags), strict=True):
            r = next(raw, Moments(0, np.zeros(0), np.zeros((0, 0))))
            moments = [pa.array([v], kind) for v, kind in ((m.n, pa.int64()), (m.mean, _LIST), (m.cross.ravel(), _LIST), (r.n, pa.int64()), (r.mean, _LIST), (r.cross.ravel(), _LIST))]
            yield pa.RecordBatch.from_arrays([*(pa.array([k.as_py()], pa.string()) for k in key), pa.array([draw], pa.int32()), *moments], names)

    def of_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda c: c.values.to_numpy(zero_copy_only=False)
        for b in batches:
            for i in range(b.num_rows):
                yield from moments_of(matrix_of(b["x"][i]), matrix_of(b["y"][i]), whole(b["draws"][i]), whole(b["by"][i]), [b[k][i] for k in keys])

    def of(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = pa.Table.from_batches(batches).sort_by("frame")
        matrix = lambda c: rows[c].combine_chunks().drop_null().flatten().to_numpy(zero_copy_only=False)
        draws = matrix("draws")
        n = len(rows) - rows["x"].null_count
        if not n or not len(draws):
            return
        x, y = matrix("x").reshape(n, -1), matrix("y").reshape(n, -1)
        yield from moments_of(x, y, draws, matrix("by"), list(key))

    offered = lambda rows, *more: rows.join(spread(listed, "recording_id").hint("shuffle_hash"), "recording_id").select(*keys, *more, F.col("draws.null_index").alias("draws"), F.flatten("draws.by").alias("by"))
    many = "array<double>" if "frame" in frames.columns else "array<array<double>>"
    typed = frames.select(*[F.col(k).cast("string").alias(k) for k in keys], *[F.col("frame").cast("int").alias("frame")] * ("frame" in frames.columns), F.col("x").cast(many).alias("x"), F.col("y").cast(many).alias("y"))
    if "frame" in frames.columns:
        first = offered(typed.groupBy(*keys).agg(F.min("frame").alias("frame")), "frame")
        done = spread(typed.unionByName(first, allowMissingColumns=True), *keys).groupBy(*keys).applyInArrow(of, schema)
    else:
        done = offered(typed.where(F.size("x") > 0), "x", "y").mapInArrow(of_rows, schema)
    return done.select(*unit, F.col("null_index").cast("string").alias("null_index"), *[c for c in done.columns if c not in (*unit, "null_index")])
