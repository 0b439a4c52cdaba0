"""Lagged designs, family masks and circular shifts."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.schema import SUBSTANTIVE

#: Ensemble sizes: production draws exactly PRODUCTION_NULLS, a dry run at least DRY_NULLS.
PRODUCTION_NULLS, DRY_NULLS = 100, 20
#: Draws for which a task holds a recording's rolled frames.
DRAWS_AT_ONCE = 8
#: Least circular distance of a shift, in seconds.
LEAST_SHIFT_SECONDS = 2.0
#: First part of the text from which a shift's seed is derived. Ensembles drawn under another tag need that tag.
SEED_TAG = "kymo-null-v1"


def shift_of(lag_seconds: float, rate: float) -> int:
    """Frames of a lag, halves to even; positive lags look into the past."""
    return round(lag_seconds * rate)


def lagged(frames: DataFrame, lags: list[float], rate: float, array: str = "x") -> DataFrame:
    """The array of each lag side by side, lag after lag; rows beyond a recording's ends are zeros."""
    w = Window.partitionBy("recording_id").orderBy("frame")
    zeros = F.transform(array, lambda _: F.lit(0.0))
    blocks = []
    for lag in lags:
        k = shift_of(lag, rate)
        moved = F.col(array) if k == 0 else (F.lag(array, k) if k > 0 else F.lead(array, -k)).over(w)
        blocks.append(F.coalesce(moved, zeros))
    return frames.withColumn(array, F.flatten(F.array(*blocks)))


def lagged_value(frames: DataFrame, value: str, lags: list[int]) -> DataFrame:
    """Long form for one column: (…, lag, value_at_lag), zero beyond a recording's ends; lags in frames."""
    w = Window.partitionBy("recording_id").orderBy("frame")
    moved = [F.struct(F.lit(k).alias("lag"), F.coalesce(F.lag(value, k).over(w) if k > 0 else F.lead(value, -k).over(w) if k < 0 else F.col(value), F.lit(0.0)).alias("value_at_lag")) for k in lags]
    return frames.withColumn("_lags", F.array(*moved)).select("*", F.inline("_lags")).drop("_lags")


def lagged_families(families: list[str], lags: list[float]) -> list[str]:
    return [f for _ in lags for f in families]


def kept_columns(families: list[str], omitted: str | None) -> list[int]:
    """Positions of the columns that stay when a family is left out."""
    return [i for i, f in enumerate(families) if f != omitted]


def picked(array: Column | str, positions: list[int]) -> Column:
    """The elements of an array at positions, in that order."""
    at = F.array(*[F.lit(i) for i in positions]) if positions else F.array().cast("array<int>")
    return F.transform(at, lambda i: F.get(array, i))


def least_shift(rate: float, zero_seconds: float, longest_lag: float) -> int:
    """The least permitted offset: at least zero_seconds, and strictly beyond the longest lag."""
    return max(1, math.ceil(zero_seconds * rate), math.floor(longest_lag * rate) + 1)


def check_null_count(n: int, dry_run: bool = False) -> int:
    if isinstance(n, bool) or not isinstance(n, int):
        raise TypeError("the number of nulls must be an integer")
    if dry_run and n < DRY_NULLS:
        raise ValueError(f"a dry run needs at least {DRY_NULLS} nulls")
    if not dry_run and n != PRODUCTION_NULLS:
        raise ValueError(f"production needs exactly {PRODUCTION_NULLS} nulls")
    return n


def derived_seed(seed: int, null_index: int, recording_id: str, family: str, tag: str = SEED_TAG) -> int:
    """The first eight bytes, little-endian, of the SHA-256 of the NUL-separated parts."""
    payload = "\0".join([tag, str(seed), str(null_index), recording_id, family])
    return int.from_bytes(hashlib.sha256(payload.encode()).digest()[:8], "little")


def drawn_offset(seed: int, least: int, frames: int) -> int:
    """NumPy's default generator's integer in [least, frames - least]."""
    return int(np.random.default_rng(seed).integers(least, frames - least + 1))


class ShortRecordingError(ValueError):
    """Recordings that no offset fits; diagnostics has a row for each."""

    def __init__(self, diagnostics: list[dict]):
        super().__init__("too short for a shift outside the excluded zone: " + ", ".join(d["recording_id"] for d in diagnostics))
        self.diagnostics = diagnostics


def shift_manifest(
    recordings: DataFrame, null_indices: list[int], *, seed: int = 0, rate: float = 50.0, lags: tuple[float, ...] = (0.0,), longest_lag: float | None = None,
    zero_seconds: float = LEAST_SHIFT_SECONDS, families: tuple[str, ...] = SUBSTANTIVE, tag: str = SEED_TAG,
) -> DataFrame:
    """Offsets of every (null_index, recording, family) for recordings (recording_id, frames).

    Raises ShortRecordingError if a recording is too short; the offsets are drawn in Arrow batches by
    NumPy's generator, as Spark has none that draws the same.
    """
    if not (math.isfinite(rate) and rate > 0):
        raise ValueError("rate must be finite and positive")
    if not (math.isfinite(zero_seconds) and zero_seconds >= LEAST_SHIFT_SECONDS):
        raise ValueError(f"zero_seconds must be finite and at least {LEAST_SHIFT_SECONDS}")
    if not lags or not all(map(math.isfinite, lags)):
        raise ValueError("lags must be a non-empty finite sequence")
    if longest_lag is not None and not (math.isfinite(longest_lag) and longest_lag >= 0):
        raise ValueError("longest_lag must be finite and non-negative")
    if any(isinstance(n, bool) or not isinstance(n, int) or n < 0 for n in null_indices):
        raise ValueError("null indices must be non-negative integers")
    least = least_shift(rate, zero_seconds, max([longest_lag or 0.0, *map(abs, lags)]))
    short = recordings.where(F.col("frames") < 2 * least).orderBy("recording_id").collect()
    if short:
        raise ShortRecordingError([
            {"recording_id": str(r.recording_id), "frames": r.frames, "duration_seconds": r.frames / rate, "minimum_offset_frames": least, "required_minimum_frames": 2 * least, "required_minimum_seconds": 2 * least / rate, "reason": "no_offset_outside_zero_lag_exclusion"} for r in short
        ])
    cells = recordings.select(F.col("recording_id").cast("string").alias("recording_id"), F.col("frames").cast("int").alias("frames"))
    cells = cells.withColumn("null_index", F.explode(F.array(*[F.lit(n) for n in null_indices]))).withColumn("family", F.explode(F.array(*[F.lit(f) for f in families])))

    def draw(batches):
        for b in batches:
            rows = list(zip(*(b.column(c).to_pylist() for c in ("null_index", "recording_id", "family", "frames")), strict=True))
            seeds = [derived_seed(seed, n, r, f, tag) for n, r, f, _ in rows]
            offsets = [drawn_offset(s, least, t) for s, (*_, t) in zip(seeds, rows, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column("null_index"), b.column("recording_id"), b.column("family"), b.column("frames"), pa.array(offsets, pa.int32()), pa.array(map(str, seeds), pa.string())], ["null_index", "recording_id", "family", "frames", "offset_frames", "derived_seed"])

    drawn = cells.select("null_index", "recording_id", "family", "frames").mapInArrow(draw, "null_index int, recording_id string, family string, frames int, offset_frames int, derived_seed string")
    distance = F.least(F.col("offset_frames"), F.col("frames") - F.col("offset_frames"))
    return drawn.select("*", (F.col("offset_frames") / rate).alias("offset_seconds"), distance.alias("distance_frames"), (distance / rate).alias("distance_seconds"), F.lit(least).alias("least_offset_frames"), (F.col("frames") - least).alias("most_offset_frames"))


def circular_shift(frames: DataFrame, offsets: DataFrame, column_families: list[str], array: str = "x", shifted: tuple[str, ...] = SUBSTANTIVE) -> DataFrame:
    """frames (recording_id, frame, t, array) with each shifted family's columns rolled by its offset as one block.

    offsets: (null_index, recording_id, family, frames, offset_frames). A recording and DRAWS_AT_ONCE of its draws are one group, whose matrix
    is rolled block by block; frames are copied once for each such group. Fits need no shifted frames: see nulls.null_moments().
    """
    group = (F.col("null_index") / DRAWS_AT_ONCE).cast("int").alias("_group")
    draws = offsets.where(F.col("family").isin(*shifted)).select("recording_id", group, F.col("null_index").cast("int").alias("null_index"), "family", F.col("offset_frames").cast("int").alias("offset_frames"))
    every = offsets.select("recording_id", group, F.col("null_index").cast("int").alias("null_index"), F.lit(None).cast("string").alias("family"), F.lit(0).alias("offset_frames")).distinct()
    copies = frames.select("recording_id", F.col("frame").cast("int").alias("frame"), F.col("t").cast("double").alias("t"), F.col(array).cast("array<double>").alias("x")).join(every.select("recording_id", "_group").distinct(), "recording_id")
    at = {f: [i for i, c in enumerate(column_families) if c == f] for f in shifted}
    kind = frames.schema["recording_id"].dataType.simpleString()

    def roll(rows: pa.Table, moves: pa.Table) -> pa.Table:
        rows = rows.sort_by("frame").combine_chunks()
        n, width = rows.num_rows, len(column_families)
        schema = pa.schema([("null_index", pa.int32()), moves.schema.field("recording_id"), ("frame", pa.int32()), ("t", pa.float64()), (array, pa.list_(pa.float64()))])
        if not n or not moves.num_rows:
            return schema.empty_table()
        x = rows["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(n, width)
        by: dict[int, dict[str, int]] = {}
        for number, family, offset in zip(*(moves[c].to_pylist() for c in ("null_index", "family", "offset_frames")), strict=True):
            by.setdefault(number, {})[family] = offset
        out = np.repeat(x[None], len(by), axis=0)
        for done, own in zip(out, by.values(), strict=True):
            for family, offset in own.items():
                if family is not None and at[family]:
                    done[:, at[family]] = np.roll(x[:, at[family]], offset, axis=0)
        same = lambda c: pa.concat_arrays([rows[c].combine_chunks()] * len(by))
        lists = pa.ListArray.from_arrays(np.arange(0, out.size + 1, width, dtype=np.int32), pa.array(out.ravel()))
        return pa.Table.from_arrays([pa.array(np.repeat(list(by), n), pa.int32()), *map(same, ("recording_id", "frame", "t")), lists], schema=schema)

    keys = ["recording_id", "_group"]
    return copies.groupBy(*keys).cogroup(draws.unionByName(every).groupBy(*keys)).applyInArrow(roll, f"null_index int, recording_id {kind}, frame int, t double, {array} array<double>")


def circular_shift_sparse(cells: DataFrame, offsets: DataFrame, shifted: tuple[str, ...] = SUBSTANTIVE) -> DataFrame:
    """The same for long form (recording_id, frame, feature_idx, family, value): only the frame number changes."""
    moves = offsets.select("null_index", "recording_id", "family", "frames", "offset_frames")
    draws = moves.select("null_index", "recording_id").distinct()
    rows = cells.join(draws, "recording_id").join(moves.where(F.col("family").isin(*shifted)), ["null_index", "recording_id", "family"], "left")
    return rows.select("null_index", "recording_id", F.coalesce(F.pmod(F.col("frame") + F.col("offset_frames"), F.col("frames")), F.col("frame")).alias("frame"), "feature_idx", "family", "value")
