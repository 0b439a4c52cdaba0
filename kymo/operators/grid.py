"""Time grids: rasterising events, interpolating samples, holding states, differences and chunks.

Window functions are partitioned by recording; a recording is the unit that the reference processes
as one array, so its frames fit one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.functions.scalars import frame_count, is_blank, nearest_frame
from kymo.schema import WORD_TIERS

#: Characters that end a sentence.
SENTENCE_ENDS = ".!?。！？；;"


def frame_counts(recordings: DataFrame, rate: float = 50.0, keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """(keys, n): frames of recordings (keys, duration_seconds) that have any."""
    if rate <= 0:
        raise ValueError("rate must be positive")
    n = frame_count(F.col("duration_seconds"), rate)
    checked = F.when(F.col("duration_seconds") < 0, F.raise_error(F.lit("duration must not be negative")).cast("int")).otherwise(n)
    return recordings.select(*keys, checked.alias("n")).where("n > 0")


def time_grid(recordings: DataFrame, rate: float = 50.0) -> DataFrame:
    """(recording_id, frame, t) of recordings (recording_id, duration_seconds); a recording shorter than a frame has none."""
    rows = frame_counts(recordings, rate)
    return rows.select("recording_id", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("frame")).select("recording_id", "frame", (F.col("frame") / F.lit(float(rate))).alias("t"))


def events_to_grid(events: DataFrame, recordings: DataFrame, rate: float = 50.0, weight: Column | None = None, name: str = "value") -> DataFrame:
    """Sums of weight (or counts) at the frame nearest to each event, zero elsewhere: (recording_id, frame, t, name)."""
    n = recordings.select("recording_id", frame_count(F.col("duration_seconds"), rate).alias("n")).where("n > 0")
    # events are summed by frame before they meet the grid
    placed = events.join(n, "recording_id").groupBy("recording_id", nearest_frame(F.col("t"), rate, F.col("n")).alias("frame")).agg(F.sum(F.lit(1.0) if weight is None else weight).alias(name))
    return time_grid(recordings, rate).join(placed, ["recording_id", "frame"], "left").select("recording_id", "frame", "t", F.coalesce(name, F.lit(0.0)).alias(name))


def _drawn(samples: DataFrame, value: str) -> Column:
    """The value at t on the line from sample a to its next b, structs (st, sv); that of the only one of them, zero (an array empty) without either."""
    many = isinstance(samples.schema[value].dataType, T.ArrayType)
    kind = "array<double>" if many else "double"
    before, after = F.col("a.sv").cast(kind), F.col("b.sv").cast(kind)
    slope = lambda x, y: (y - x) / (F.col("b.st") - F.col("a.st"))
    line = lambda x, y: x + (F.col("t") - F.col("a.st")) * slope(x, y)
    between = F.zip_with(before, after, line) if many else line(before, after)
    none = F.array().cast(kind) if many else F.lit(0.0)
    out = F.when(F.col("a").isNull() & F.col("b").isNull(), none).when(F.col("a").isNull(), after).when(F.col("b").isNull() | (F.col("a.st") == F.col("t")), before).otherwise(between)
    return out.alias(value)


def _timed(samples: DataFrame, value: str, keys: tuple[str, ...]) -> DataFrame:
    """Samples that have a time: (keys, t, a), a struct of time and value."""
    return samples.where("t is not null").select(*keys, F.col("t").cast("double").alias("t"), F.struct(F.col("t").cast("double").alias("st"), F.col(value).alias("sv")).alias("a"))


def resample_linear(samples: DataFrame, targets: DataFrame, value: str = "value", keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """Linear interpolation of samples (keys, t, value) at targets (keys, frame, t); value is a number or an array of them.

    Beyond the first and last sample their values are held; a series without samples is zero (an array of it empty). Samples without
    a time are passed over. Each sample knows its next before targets are sorted among them, once: the last one seen is the as-of join.
    """
    order = Window.partitionBy(*keys).orderBy("t")
    pairs = _timed(samples, value, keys).select(*keys, "t", "a", F.lead("a").over(order).alias("b"), F.lag("t").over(order).isNull().alias("first"))
    near = F.struct("t", "a", "b")
    ahead = F.struct(F.lit(None).cast("double").alias("t"), F.when(F.lit(False), F.col("a")).alias("a"), F.col("a").alias("b"))  # what lies before the first sample
    pairs = pairs.select(*keys, F.explode(F.when(F.col("first"), F.array(ahead, near)).otherwise(F.array(near))).alias("near"))
    rows = pairs.select(*keys, "near.t", F.struct("near.a", "near.b").alias("near"), F.lit(None).cast("int").alias("frame"))
    both = rows.unionByName(targets.select(*keys, F.col("t").cast("double").alias("t"), F.lit(None).cast(rows.schema["near"].dataType).alias("near"), F.col("frame").cast("int").alias("frame")))
    # at equal times samples come first, so that they are neighbours behind
    seen = F.last("near", ignorenulls=True).over(Window.partitionBy(*keys).orderBy("t", F.col("frame").isNotNull()).rowsBetween(Window.unboundedPreceding, 0))
    found = both.select(*keys, "frame", "t", seen.alias("near")).where("frame is not null")
    return found.select(*keys, "frame", "t", F.col("near.a").alias("a"), F.col("near.b").alias("b")).select(*keys, "frame", "t", _drawn(samples, value))


def resample_on_grid(samples: DataFrame, recordings: DataFrame, rate: float = 50.0, value: str = "value", keys: tuple[str, ...] = ("recording_id",)) -> DataFrame:
    """resample_linear() at the time grid of recordings (keys, duration_seconds), of which a recording has one row: (keys, frame, t, value).

    Only samples are shuffled and sorted; the frames of a gap are made from the two samples around it.
    """
    counts = frame_counts(recordings, rate, keys).groupBy(*keys).agg(F.max("n").alias("n"))
    timed = _timed(samples, value, keys).withColumn("n", F.lit(None).cast("int"))
    # a recording's own row sorts before its samples: the gap that ends at the first one
    both = timed.unionByName(counts.select(*keys, F.lit(None).cast("double").alias("t"), F.lit(None).cast(timed.schema["a"].dataType).alias("a"), F.col("n").cast("int").alias("n")))
    order = Window.partitionBy(*keys).orderBy("t")
    size = F.last("n", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    gaps = both.select(*keys, "a", F.lead("a").over(order).alias("b"), size.alias("n")).where("n is not null")
    edge = lambda x: F.ceil(F.least(F.greatest(x, F.lit(0.0)), F.col("n").cast("double"))).cast("int")
    first = F.when(F.col("a").isNull(), 0).otherwise(edge(F.col("a.st") * rate - 1e-6))
    last = F.when(F.col("b").isNull(), F.col("n")).otherwise(edge(F.col("b.st") * rate + 1e-6))
    rows = gaps.select(*keys, "a", "b", "n", F.explode(F.sequence(first, last)).alias("frame")).withColumn("t", F.col("frame") / F.lit(float(rate)))
    inside = (F.col("frame") < F.col("n")) & (F.col("a").isNull() | (F.col("t") >= F.col("a.st"))) & (F.col("b").isNull() | (F.col("t") < F.col("b.st")))
    return rows.where(inside).select(*keys, "frame", "t", _drawn(samples, value))


def held_frames(intervals: DataFrame, rate: float) -> DataFrame:
    """Each interval's grid frames, start <= frame / rate < end, as an equi-join key: no range join is left."""
    first, last = F.greatest(F.ceil(F.col("start") * rate - 1e-6), F.lit(0)), F.ceil(F.col("end") * rate + 1e-6)
    frames = intervals.where(F.col("end") > F.col("start")).select("*", F.explode(F.sequence(first.cast("int"), F.greatest(last, first).cast("int"))).alias("frame"))
    t = F.col("frame") / F.lit(float(rate))
    return frames.where((t >= F.col("start")) & (t < F.col("end")))


def hold_on_grid(intervals: DataFrame, grid: DataFrame, rate: float, state: str, outside=0.0) -> DataFrame:
    """The state of the interval that covers each frame, the later of overlapping ones; outside elsewhere: (…, state, covered)."""
    held = held_frames(intervals, rate).groupBy("recording_id", "frame").agg(F.max_by(state, "interval_idx").alias(state))
    joined = grid.join(held.withColumn("hit", F.lit(True)), ["recording_id", "frame"], "left")
    return joined.select("recording_id", "frame", "t", F.when(F.col("hit"), F.col(state)).otherwise(F.lit(outside)).alias(state), F.coalesce("hit", F.lit(False)).alias("covered"))


def hold_coverage(held: DataFrame) -> DataFrame:
    """Share of covered frames of each recording."""
    return held.groupBy("recording_id").agg(F.avg(F.col("covered").cast("double")).alias("coverage"))


def segment_words(words: DataFrame, gap: float = 0.5) -> DataFrame:
    """words (recording_id, interval_idx, start, end, label) with a sentence number from 0.

    A sentence starts at a pause of gap seconds or more, and after a word whose last character ends one.
    """
    order = Window.partitionBy("recording_id").orderBy("start", "interval_idx")
    before_end, before_label = F.lag("end").over(order), F.lag("label").over(order)
    closed = F.coalesce(F.lit(SENTENCE_ENDS).contains(F.right(before_label, F.lit(1))) & (before_label != ""), F.lit(False))
    starts = before_end.isNotNull() & ((F.col("start") - before_end >= gap) | closed)
    return words.withColumn("starts", starts.cast("int")).withColumn("sentence", F.sum("starts").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("starts")


def words_of(intervals: DataFrame, tiers: tuple[str, ...] = WORD_TIERS) -> DataFrame:
    """Labelled intervals of the named tiers; the tier's letter case doesn't matter."""
    return intervals.where(F.lower("tier").isin(*tiers) & ~is_blank("label"))


def gradient(frames: DataFrame, value: str, step: float, order: int = 1) -> DataFrame:
    """Central differences over frames of a recording, one-sided at its ends, zero for a single frame; order times over."""
    w = Window.partitionBy("recording_id").orderBy("frame")
    out = frames
    for _ in range(order):
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        d = (
            F.when(before.isNull() & after.isNull(), F.lit(0.0))
            .when(before.isNull(), (after - F.col(value)) / step)
            .when(after.isNull(), (F.col(value) - before) / step)
            .otherwise((after - before) / (2 * step))
        )
        out = out.withColumn(value, d)
    return out


def positive_flux(frames: DataFrame, array: str = "x", name: str = "flux") -> DataFrame:
    """Root mean square of the positive changes of an array from frame to frame; zero at the first."""
    w = Window.partitionBy("recording_id").orderBy("frame")
    out = frames.withColumn("_before", F.coalesce(F.lag(array).over(w), F.col(array)))
    squares = F.zip_with(array, "_before", lambda a, b: F.pow(F.greatest(a - b, F.lit(0.0)), F.lit(2.0)))
    return out.withColumn(name, F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x) / F.size(array))).drop("_before")


def chunk_windows(recordings: DataFrame, batch_seconds: float, overlap_seconds: float, stride: int) -> DataFrame:
    """Overlapping windows of recordings (recording_id, n_samples, sample_rate): core and context sample ranges of each chunk.

    Cores are whole strides and tile the recording; a context reaches overlap_seconds to both sides.
    """
    if batch_seconds <= 0 or not 0 <= overlap_seconds < batch_seconds:
        raise ValueError("batch_seconds must be positive and overlap_seconds in [0, batch_seconds)")
    core = F.greatest(F.lit(stride), F.rint(F.lit(batch_seconds) * F.col("sample_rate") / stride).cast("long") * stride)
    overlap = F.rint(F.lit(overlap_seconds) * F.col("sample_rate") / stride).cast("long") * stride
    rows = recordings.where("n_samples > 0").select("*", core.alias("core"), overlap.alias("overlap"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(0), F.ceil(F.col("n_samples") / F.col("core")).cast("int") - 1)).alias("chunk"))
    start = F.col("chunk") * F.col("core")
    end = F.least(F.col("n_samples"), start + F.col("core"))
    return rows.select("recording_id", "chunk", start.alias("core_start"), end.alias("core_end"), F.greatest(F.lit(0), start - F.col("overlap")).alias("context_start"), F.least(F.col("n_samples"), end + F.col("overlap")).alias("context_end"))


def stitched(chunk_frames: DataFrame) -> DataFrame:
    """Frames (…, core_start, core_end, n_samples, centre) whose centre lies in their chunk's core: each frame once."""
    return chunk_frames.where((F.col("centre") >= F.col("core_start")) & (F.col("centre") < F.col("core_end")) & (F.col("centre") < F.col("n_samples")))


def frame_centres(recordings: DataFrame) -> DataFrame:
    """Evenly spaced frame centres of recordings (recording_id, duration_seconds, frames)."""
    rows = recordings.where("frames > 0").select("*", F.explode(F.sequence(F.lit(0), F.col("frames") - 1)).alias("frame"))
    return rows.select("recording_id", "frame", ((F.col("frame") + 0.5) * F.col("duration_seconds") / F.col("frames")).alias("t"))


def frame_timing(kernels: list[int], strides: list[int]) -> tuple[int, float]:
    """Stride and receptive-field centre, in samples, of stacked convolutions."""
    if len(kernels) != len(strides):
        raise ValueError("as many kernels as strides are needed")
    jump, field = 1, 1
    for kernel, stride in zip(kernels, strides, strict=True):
        field += (kernel - 1) * jump
        jump *= stride
    return jump, (field - 1) / 2
