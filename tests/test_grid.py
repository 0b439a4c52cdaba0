import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import grid


def one(spark, duration, name="r"):
    return spark.createDataFrame([(name, float(duration))], "recording_id string, duration_seconds double")


def test_grid_and_interpolation(spark):
    rows = grid.time_grid(one(spark, 1.0), 50).orderBy("frame").collect()
    assert len(rows) == 50 and rows[-1].t == pytest.approx(0.98)
    samples = spark.createDataFrame([("r", 0.0, 0.0), ("r", 1.0, 1.0)], "recording_id string, t double, value double")
    got = {r.frame: r.value for r in grid.resample_linear(samples, grid.time_grid(one(spark, 1.0), 50)).collect()}
    assert got[25] == pytest.approx(0.5)


def test_grid_edges(spark):
    assert grid.time_grid(one(spark, 0.0)).collect() == [] and grid.time_grid(one(spark, 0.019)).collect() == []
    assert grid.time_grid(one(spark, 0.1 + 0.2), 10).count() == 3
    with pytest.raises(Exception, match="negative"):
        grid.time_grid(one(spark, -1.0)).collect()
    with pytest.raises(ValueError):
        grid.time_grid(one(spark, 1.0), 0)


def test_events_pile_up(spark):
    e = spark.createDataFrame([("r", t, 2.0) for t in (0.1, 0.101, -5.0, 99.0, 0.03)], "recording_id string, t double, w double")
    got = {r.frame: r.value for r in grid.events_to_grid(e, one(spark, 1.0), 50).collect()}
    assert len(got) == 50 and got[5] == 2 and got[0] == 1 and got[49] == 1 and got[2] == 1 and sum(got.values()) == 5
    assert sum(r.value for r in grid.events_to_grid(e, one(spark, 1.0), 50, F.col("w")).collect()) == 10


def test_interpolation_equals_numpy(spark):
    rng = np.random.default_rng(0)
    src, v, dst = np.sort(rng.uniform(0, 9, 40)), rng.normal(size=40), np.linspace(-1, 10, 90)
    samples = spark.createDataFrame([("r", float(a), float(b)) for a, b in zip(src, v)], "recording_id string, t double, value double")
    targets = spark.createDataFrame([(r, i, float(t)) for r in ("r", "empty") for i, t in enumerate(dst)], "recording_id string, frame int, t double")
    got = {(r.recording_id, r.frame): r.value for r in grid.resample_linear(samples, targets).collect()}
    assert np.allclose([got["r", i] for i in range(90)], np.interp(dst, src, v)) and all(got["empty", i] == 0 for i in range(90))


def test_hold(spark):
    words = spark.createDataFrame([("r", 0, 0.2, 0.6, 1.0), ("r", 1, 1.0, 1.4, 2.0)], "recording_id string, interval_idx int, start double, end double, v double")
    held = grid.hold_on_grid(words, grid.time_grid(one(spark, 2.0), 10), 10, "v")
    got = {r.frame: r.v for r in held.collect()}
    assert [f for f in range(20) if got[f]] == [2, 3, 4, 5, 10, 11, 12, 13] and got[12] == 2
    assert grid.hold_coverage(held).first().coverage == pytest.approx(0.4)
    later = words.unionByName(spark.createDataFrame([("r", 2, 0.3, 0.5, 9.0)], words.schema))
    assert {r.frame: r.v for r in grid.hold_on_grid(later, grid.time_grid(one(spark, 2.0), 10), 10, "v").collect()}[3] == 9


def test_sentences(spark):
    rows = [("r", i, s, e, w) for i, (s, e, w) in enumerate([(0.0, 0.4, "a"), (0.5, 0.8, "b."), (0.8, 1.0, "c"), (1.6, 2.0, "d"), (2.1, 2.2, "")])]
    got = grid.segment_words(spark.createDataFrame(rows, "recording_id string, interval_idx int, start double, end double, label string")).orderBy("interval_idx").collect()
    assert [r.sentence for r in got] == [0, 0, 1, 2, 2]


def test_gradients_equal_numpy(spark):
    v = np.random.default_rng(1).normal(size=12)
    df = spark.createDataFrame([("r", i, float(x)) for i, x in enumerate(v)] + [("s", 0, 5.0)], "recording_id string, frame int, v double")
    first, second = np.gradient(v, 0.02), np.gradient(np.gradient(v, 0.02), 0.02)
    for order, want in ((1, first), (2, second)):
        got = {(r.recording_id, r.frame): r.v for r in grid.gradient(df, "v", 0.02, order).collect()}
        assert np.allclose([got["r", i] for i in range(12)], want) and got["s", 0] == 0


def test_chunks_tile_and_stitch(spark):
    r = spark.createDataFrame([("r", 100, 10)], "recording_id string, n_samples long, sample_rate int")
    rows = grid.chunk_windows(r, 4.0, 1.0, 2).orderBy("chunk").collect()
    assert [(x.core_start, x.core_end) for x in rows] == [(0, 40), (40, 80), (80, 100)] and (rows[1].context_start, rows[1].context_end) == (30, 90)
    frames = [(x.core_start, x.core_end, 100, float(c)) for x in rows for c in range(x.context_start, x.context_end, 2)]
    got = grid.stitched(spark.createDataFrame(frames, "core_start long, core_end long, n_samples long, centre double")).collect()
    assert sorted(x.centre for x in got) == list(range(0, 100, 2))


def test_timing():
    assert grid.frame_timing([10, 3, 3, 3, 3, 2, 2], [5, 2, 2, 2, 2, 2, 2]) == (320, 199.5)
    with pytest.raises(ValueError):
        grid.frame_timing([1], [1, 2])


def test_interpolation_grows_with_the_length_only(spark):
    """Eight times the samples take nowhere near the sixty-four times that a window over the rest of the series would."""
    import time

    def seconds(n):
        samples = spark.range(n).select(F.lit("r").alias("recording_id"), (F.col("id") * 1.0).alias("t"), F.col("id").cast("double").alias("value"))
        targets = spark.range(n).select(F.lit("r").alias("recording_id"), F.col("id").cast("int").alias("frame"), (F.col("id") + 0.25).alias("t"))
        start = time.perf_counter()
        worst = grid.resample_linear(samples, targets).select(F.max(F.abs(F.col("value") - F.least(F.col("t"), F.lit(n - 1.0))))).first()[0]
        assert worst < 1e-9
        return time.perf_counter() - start

    seconds(2_000)
    assert seconds(64_000) < 20 * max(seconds(8_000), 0.25)


def test_frames_are_made_from_gaps(spark):
    """Equals the general operator and NumPy, for samples off the grid, outside it, without a time or a series, and series without samples."""
    schema = "recording_id string, t double, value double"
    rng = np.random.default_rng(2)
    rows = [("r", float(t), float(v)) for t, v in zip(np.sort(rng.uniform(-1, 4, 30)), rng.normal(size=30))]
    rows += [("s", 0.5, 7.0), ("far", -1e300, 1.0), ("far", 1e300, 3.0), ("on", 0.1, 1.0), ("on", 0.3, 2.0), (None, 0.2, 4.0), ("short", 0.0, 9.0), ("unknown", 0.0, 9.0)]
    rows += [("r", None, 99.0), ("s", None, 99.0), ("untimed", None, 99.0)]
    names = ["r", "s", "far", "on", "empty", "untimed", None]
    series = spark.createDataFrame([(n, 3.0) for n in names] + [("short", 0.01)], "recording_id string, duration_seconds double")
    samples = spark.createDataFrame(rows, schema)
    got = grid.resample_on_grid(samples, series, 10).collect()
    plain = {(r.recording_id, r.frame): (r.t, r.value) for r in grid.resample_linear(samples, grid.time_grid(series, 10)).collect()}
    assert len(got) == len(plain) == 30 * len(names) and {(r.recording_id, r.frame): (r.t, r.value) for r in got} == plain
    for name in names:
        at = sorted((t, v) for i, t, v in rows if i == name and t is not None)
        want = np.interp(np.arange(30) / 10, *zip(*at)) if at and name != "far" else np.full(30, plain["far", 0][1] if name == "far" else 0.0)
        assert np.allclose([plain[name, i][1] for i in range(30)], want)
    arrays = samples.select("recording_id", "t", F.array("value", F.lit(1.0)).cast("array<float>").alias("value"))
    many = {(r.recording_id, r.frame): r.value for r in grid.resample_on_grid(arrays, series, 10).collect()}
    assert many["empty", 3] == [] and many["on", 2] == pytest.approx([1.5, 1.0]) and many["s", 0] == [7.0, 1.0]


def test_no_frame_of_the_query_is_sorted(spark, capsys):
    from kymo.plans import catalogue

    catalogue.QUERIES["resample_linear"](spark, "/root/testdata/sf0.001").explain()
    plan = capsys.readouterr().out.splitlines()
    at = lambda node: [i for i, line in enumerate(plan) if node in line]
    assert len(at("Generate ")) == 1 and at("Generate ")[0] < min(at("Sort ") + at("Exchange "))


def test_targets_are_sorted_once(spark, capsys):
    samples = spark.createDataFrame([("r", 0.0, 0.0), ("r", 1.0, 1.0)], "recording_id string, t double, value double")
    grid.resample_linear(samples, grid.time_grid(one(spark, 1.0), 50)).explain()
    plan = capsys.readouterr().out.splitlines()
    union = next(i for i, line in enumerate(plan) if "Union" in line)
    assert sum("Sort " in line for line in plan[:union]) == 1
