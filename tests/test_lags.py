import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import encode, lags


def frames(spark, groups):
    return spark.createDataFrame([(g, i, i / 50, [float(v), float(-v)]) for g, values in groups.items() for i, v in enumerate(values)], "recording_id string, frame int, t double, x array<double>")


def test_lags_stay_inside_recordings(spark):
    df = frames(spark, {"a": [1, 2, 3, 4], "b": [5, 6, 7, 8]})
    got = {(r.recording_id, r.frame): r.x for r in lags.lagged(df, [1.0], 1.0).collect()}
    assert got["b", 0] == [0, 0] and got["b", 1] == [5, -5]


def test_impulse_and_order(spark):
    df = frames(spark, {"a": [0, 0, 0, 1, 0, 0, 0]})
    got = np.array([r.x for r in lags.lagged(df, [-1.0, 0.0, 1.0], 1.0).orderBy("frame").collect()])
    assert [np.flatnonzero(got[:, 2 * k]).tolist() for k in range(3)] == [[2], [3], [4]]
    x = np.array([r.x for r in df.orderBy("frame").collect()])
    assert np.array_equal(got, encode.lag_rows(x, [-1.0, 0.0, 1.0], 1.0))


def test_masks(spark):
    assert lags.kept_columns(["a", "b", "a"], "a") == [1] and lags.lagged_families(["a", "b"], [0, 1]) == ["a", "b", "a", "b"]
    df = frames(spark, {"a": [3]})
    assert df.select(lags.picked("x", [1, 0]).alias("y")).first().y == [-3.0, 3.0]


def test_least_shift_and_counts():
    assert lags.least_shift(50, 2.0, 2.4) == 121 and lags.least_shift(50, 2.0, 0.5) == 100
    assert lags.check_null_count(100) == 100 and lags.check_null_count(20, dry_run=True) == 20
    for bad, error in ((99, ValueError), (True, TypeError)):
        with pytest.raises(error):
            lags.check_null_count(bad)


FAMILIES = ["onset", "prosodic", "prosodic", "phonetic", "phonetic", "word", "word", "acoustic"]


def null_frames(spark, n=600):
    rng = np.random.default_rng(0)
    rows = []
    for r in ("r0", "r1"):
        x = rng.normal(size=(n, 8))
        x[:, 2], x[:, 4], x[:, 6] = 3 * x[:, 1], 5 + 2 * x[:, 3], 100 + x[:, 5]
        rows += [(r, i, i / 50, x[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "recording_id string, frame int, t double, x array<double>")


def test_shift_is_a_block_roll_with_the_drawn_offset(spark):
    df = null_frames(spark)
    sizes = df.groupBy("recording_id").agg(F.count("*").cast("int").alias("frames"))
    manifest = lags.shift_manifest(sizes, [0, 1], seed=7, lags=(-2.4, 0.0, 2.4))
    rows = manifest.collect()
    assert len(rows) == 12 and all(121 <= r.offset_frames <= 479 and r.distance_frames == min(r.offset_frames, 600 - r.offset_frames) for r in rows)
    r = rows[0]
    seed = int.from_bytes(hashlib.sha256(f"{lags.SEED_TAG}\0{7}\0{r.null_index}\0{r.recording_id}\0{r.family}".encode()).digest()[:8], "little")
    assert r.derived_seed == str(seed) and r.offset_frames == np.random.default_rng(seed).integers(121, 480)
    offset = {(r.null_index, r.recording_id, r.family): r.offset_frames for r in rows}
    before = {k: np.array([r.x for r in df.where(F.col("recording_id") == k).orderBy("frame").collect()]) for k in ("r0", "r1")}
    done = lags.circular_shift(df, manifest, FAMILIES)
    for n in (0, 1):
        for k in ("r0", "r1"):
            got = np.array([r.x for r in done.where((F.col("null_index") == n) & (F.col("recording_id") == k)).orderBy("frame").collect()])
            want = before[k].copy()
            for f in ("prosodic", "phonetic", "word"):
                c = [i for i, g in enumerate(FAMILIES) if g == f]
                want[:, c] = np.roll(want[:, c], offset[n, k, f], axis=0)
            assert np.array_equal(got, want) and np.allclose(got[:, 2], 3 * got[:, 1])


def test_sparse_shift_equals_dense(spark):
    df = null_frames(spark)
    sizes = df.groupBy("recording_id").agg(F.count("*").cast("int").alias("frames"))
    manifest = lags.shift_manifest(sizes, [3], seed=1)
    long = lambda d, *k: d.select(*k, "recording_id", "frame", F.posexplode("x").alias("feature_idx", "value"))
    family = F.get(F.array(*[F.lit(f) for f in FAMILIES]), F.col("feature_idx"))
    sparse = lags.circular_shift_sparse(long(df).withColumn("family", family), manifest).select("recording_id", "frame", "feature_idx", "value")
    dense = long(lags.circular_shift(df, manifest, FAMILIES))
    assert sparse.exceptAll(dense).isEmpty() and sparse.count() == dense.count()


def test_short_recordings_are_diagnosed(spark):
    sizes = spark.createDataFrame([("short", 199), ("long", 999)], "recording_id string, frames int")
    with pytest.raises(lags.ShortRecordingError) as e:
        lags.shift_manifest(sizes, [0])
    assert [(d["recording_id"], d["required_minimum_frames"]) for d in e.value.diagnostics] == [("short", 200)]
    with pytest.raises(ValueError):
        lags.shift_manifest(sizes, [-1])
