import os
import shutil

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import encode, lags
from kymo.operators.moments import Moments
from kymo.operators.nulls import null_moments, shifted_moments
from kymo.plans import jobs
from kymo.sources import publish

COLUMNS = ["acoustic", "prosodic", "prosodic", "phonetic", "word", "onset"]


def rolled(x, shifts):
    return np.stack([np.roll(x[:, c], s) for c, s in enumerate(shifts)], axis=1)


@pytest.mark.parametrize(("n", "k"), [(40, [0]), (40, [-3, 0, 5]), (9, [-8, 0, 8]), (5, [7, -9]), (1, [0, 1])])
def test_moments_equal_rolled_frames(n, k, monkeypatch):
    rng = np.random.default_rng(n)
    x, y = 100 + 3 * rng.normal(size=(n, 4)), rng.normal(size=(n, 3)) - 7
    shifts = rng.integers(0, n, (6, 4))
    for at_once in (16_000_000, 1):
        monkeypatch.setattr("kymo.operators.nulls.NUMBERS_AT_ONCE", at_once)
        found = list(shifted_moments(x, y, shifts, k))
        assert len(found) == 6
        for s, m in zip(shifts, found, strict=True):
            want = Moments.of(np.concatenate([encode.lag_rows(rolled(x, s), k, 1.0), y], axis=1))
            assert m.n == n and np.allclose(m.mean, want.mean, atol=1e-9) and np.allclose(m.cross, want.cross, atol=1e-9 * max(1.0, np.abs(want.cross).max()))
    assert [m.mean.shape for m in shifted_moments(x, y[:, :0], shifts[:0], k)] == []


@pytest.fixture(scope="module")
def recordings(spark):
    rng = np.random.default_rng(1)
    rows = [("m", layer, f"r{r}", i, rng.normal(size=6).tolist(), rng.normal(size=2).tolist()) for layer in ("a", "b") for r in range(4) for i in range(30 + r)]
    df = spark.createDataFrame(rows, "model string, layer string, recording_id string, frame int, x array<double>, y array<double>").withColumn("t", F.col("frame") / 5.0)
    x = df.where("layer = 'a'").select("recording_id", "frame", "x")  # all layers have the features of the first
    return df.drop("x").join(x, ["recording_id", "frame"]).persist()


def test_ensemble_equals_shifted_frames(spark, recordings):
    """Moments, and the scores fitted on them, of an ensemble against frames that were moved."""
    plan = encode.Plan(COLUMNS, lags=(-0.2, 0.0, 0.4), rate=5.0, inner_folds=2, capacity=True, omitted=("prosodic", "word"))
    sizes = recordings.groupBy("recording_id").agg(F.count_distinct("frame").cast("int").alias("frames"))
    manifest = lags.shift_manifest(sizes, [0, 3, 11], seed=2, rate=5.0, lags=plan.lags).persist()
    moved = lags.circular_shift(recordings.where("layer = 'a'").select("recording_id", "frame", "t", "x"), manifest, COLUMNS)
    frames = recordings.drop("x", "t").join(moved.drop("t"), ["recording_id", "frame"])
    unit = ["model", "layer", "null_index"]
    want = {(r.layer, r.null_index, r.recording_id): r for r in encode.recording_moments(frames, plan, unit).collect()}
    moments = null_moments(recordings, manifest, plan, jobs.UNIT).persist()
    rows = moments.collect()
    assert len(rows) == len(want) == 2 * 3 * 4
    for r in rows:
        w = want[r.layer, r.null_index, r.recording_id]
        for c in ("n", "mean", "cross", "raw_n", "raw_mean", "raw_cross"):
            assert r[c] == pytest.approx(w[c], abs=1e-9), c
    score = lambda m: {(r.layer, r.null_index, r.outer_fold, r.family): (r.full_alpha, r.full_r2, r.delta_r2) for r in encode.fit_scores(m, plan, unit).collect()}
    a, b = score(moments), score(encode.recording_moments(frames, plan, unit).persist())
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-9) for k in a)
    # a recording without offsets has no null moments
    assert null_moments(recordings, manifest.where("recording_id <> 'r1'"), plan, jobs.UNIT).where("recording_id = 'r1'").isEmpty()


def test_each_draw_is_a_unit_of_its_own(spark, recordings, tmp_path):
    plan = encode.Plan(COLUMNS, rate=5.0, inner_folds=2)
    root = str(tmp_path)
    assert jobs.fit_nulls(recordings, plan, root, {}, [0, 1, 2], draws_at_once=2) == "computed"
    path = lambda layer, n: publish.unit_path(root, variant="null", model="m", layer=layer, null_index=n)
    kept = {(layer, n): os.stat(f"{path(layer, n)}/status.json").st_mtime_ns for layer in "ab" for n in range(3)}
    scores = sorted(map(tuple, jobs.table_of(spark, root, "null", "scores").select("layer", "null_index", "recording_id", "family", "delta_r2").collect()))
    assert len(scores) == 2 * 3 * 4 * 3
    assert jobs.table_of(spark, root, "null", "shifts").where("layer = 'b' and null_index = 2").count() == 4 * 3
    # a lost unit and more draws: only those are made
    shutil.rmtree(path("b", 1))
    assert jobs.fit_nulls(recordings, plan, root, {}, [0, 1, 2, 3]) == "computed"
    assert all(os.stat(f"{path(*k)}/status.json").st_mtime_ns == at for k, at in kept.items() if k != ("b", 1)) and os.path.isdir(path("a", 3))
    again = sorted(map(tuple, jobs.table_of(spark, root, "null", "scores").where("null_index < 3").select("layer", "null_index", "recording_id", "family", "delta_r2").collect()))
    assert [r[:4] for r in again] == [r[:4] for r in scores] and [r[4] for r in again] == pytest.approx([r[4] for r in scores])
    assert jobs.fit_nulls(recordings, plan, root, {}, [0, 1, 2, 3]) == "resumed"
    (tmp_path / "variant=null/model=m/layer=a/null_index=0/status.json").write_text("{}")
    assert jobs.fit_nulls(recordings, plan, root, {}, [0, 1, 2, 3]) == "repaired"


def test_whole_recordings_give_the_same_as_their_frames(spark):
    """Null moments and held-out predictions of rows of whole recordings, against those of a row for each frame."""
    from pyspark.sql import functions as F

    from kymo.operators import encode, nulls
    from kymo.schema import SUBSTANTIVE

    rng = np.random.default_rng(7)
    data = [("m", "l", f"r{i}", rng.normal(size=(12 + i, 2)).tolist(), rng.normal(size=(12 + i, 1)).tolist()) for i in range(4)]
    whole = spark.createDataFrame(data, "model string, layer string, recording_id string, x array<array<double>>, y array<array<double>>")
    frames = whole.select("model", "layer", "recording_id", F.posexplode(F.arrays_zip("x", "y")).alias("frame", "z")).select("model", "layer", "recording_id", "frame", "z.x", "z.y")
    plan, unit = encode.Plan(list(SUBSTANTIVE[:2]), lags=(-1.0, 0.0), rate=1.0, alphas=(1.0, 10.0), inner_folds=2), ["model", "layer"]
    offsets = spark.createDataFrame([(d, f"r{i}", f, 1 + i + d) for d in range(2) for i in range(4) for f in SUBSTANTIVE[:2]], "null_index int, recording_id string, family string, offset_frames int")
    a, b = ({(r.recording_id, r.null_index): r for r in nulls.null_moments(df, offsets, plan, unit).collect()} for df in (whole, frames))
    assert set(a) == set(b) and len(a) == 8
    for k in a:
        np.testing.assert_allclose(a[k].cross, b[k].cross, atol=1e-9)
    a, b = ({(r.recording_id, r.frame, r.kind): r.v for r in encode.predictions(df, encode.recording_moments(df, plan, unit).persist(), plan, unit).collect()} for df in (whole, frames))
    assert set(a) == set(b) and len(a) == 2 * sum(12 + i for i in range(4))
    for k in a:
        np.testing.assert_allclose(a[k], b[k], atol=1e-9)
