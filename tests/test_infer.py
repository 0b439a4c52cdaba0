import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import infer, summary
from kymo.schema import FAMILIES


def arrays(spark, values, weights=None):
    return spark.createDataFrame([("k", [float(v) for v in values], [float(w) for w in (weights or [1] * len(values))])], "k string, v array<double>, w array<double>")


def test_sign_flips(spark):
    r = infer.sign_flip(arrays(spark, [1, 2]), ["k"]).first()
    assert (r.effect, r.extreme, r.assignments, r.p_value) == (1.5, 2, 4, 0.5)
    r = infer.sign_flip(arrays(spark, [2, -1, 0]), ["k"]).first()
    assert (r.n_positive, r.n_negative, r.n_zero, r.assignments) == (1, 1, 1, 8)
    v = np.random.default_rng(0).normal(size=10)
    r = infer.sign_flip(arrays(spark, v), ["k"]).first()
    signs = np.array(np.meshgrid(*[[-1, 1]] * 10)).reshape(10, -1).T
    assert r.p_value == pytest.approx((np.abs(signs @ v) >= abs(v.sum()) - 1e-12).mean()) and r.p_value > 0


def test_paired_differences(spark):
    observed = spark.createDataFrame([("a", 3.0), ("b", 5.0)], "recording_id string, value double")
    nulls = spark.createDataFrame([("a", 1.0), ("b", 3.0), ("a", 2.0 + 1), ("b", 5.0)], "recording_id string, value double")
    got = {r.recording_id: r.difference for r in infer.paired_differences(observed, nulls).collect()}
    assert got == {"a": 1.0, "b": 1.0}


def test_bootstrap_equals_numpy(spark):
    r = infer.bootstrap_interval(arrays(spark, [1, 2, 8]), ["k"], 3, seed=91).first()
    assert (r.ci_low, r.ci_high) == (1.0, 8.0)
    v, w = np.random.default_rng(1).normal(size=6), np.arange(1, 7)
    g = np.random.default_rng(5)
    at = np.concatenate([g.integers(0, 6, size=(min(4096, 10_000 - s), 6)) for s in range(0, 10_000, 4096)])
    r = infer.bootstrap_interval(arrays(spark, v, w.tolist()), ["k"], 6, seed=5, weighted=True).first()
    assert [r.ci_low, r.ci_high] == pytest.approx(np.quantile((v[at] * w[at]).sum(1) / w[at].sum(1), [0.025, 0.975]).tolist())
    with pytest.raises(ValueError):
        infer.resample_table(spark, 3, 9_999, 0)


def test_adjusted_p(spark):
    df = spark.createDataFrame([(i, "m", p) for i, p in enumerate([0.01, 0.04, 0.03, 0.002, 0.5])], "i int, model string, p_value double")
    got = [r.q_value for r in infer.benjamini_hochberg(df, ["model"]).orderBy("i").collect()]
    assert got == pytest.approx([0.025, 0.05, 0.05, 0.01, 0.5])


def effects(spark, families=FAMILIES, drop=None):
    rows = [("m", f"l{k}", f"r{i}", f, e + d, w) for f in families for i, (e, w) in enumerate(((1.0, 1.0), (2.0, 1.0), (3.0, 4.0))) for k, d in enumerate((-0.5, 0.5)) if (f, i) != drop]
    return spark.createDataFrame(rows, "model string, layer string, recording_id string, family string, effect double, duration_seconds double")


def test_analysis(spark):
    rows = infer.analyse(effects(spark), 3).collect()
    assert len(rows) == 5
    for r in rows:
        assert (r.effect, r.weighted_effect, r.p_value, r.q_value, r.complete) == (2.0, 2.5, 0.25, 0.25, True)
    assert summary.aggregate_effects(effects(spark)).count() == 15


def test_incomplete_cells_are_told_and_wrong_families_refused(spark):
    rows = {r.family: r for r in infer.analyse(effects(spark, drop=("word", 1)), 3).collect()}
    assert not rows["word"].complete and rows["word"].p_value is None and rows["onset"].complete
    with pytest.raises(ValueError):
        infer.analyse(effects(spark, FAMILIES[:2]), 3)
    bad = effects(spark).withColumn("duration_seconds", F.col("duration_seconds") + (F.col("layer") == "l1").cast("int"))
    with pytest.raises(Exception, match="duration"):
        summary.aggregate_effects(bad).collect()


def test_conclusions(spark):
    t = "model string, family string, effect double, q_value double"
    a = spark.createDataFrame([("m", "x", 1.0, 0.01), ("m", "y", 1.0, 0.01), ("m", "z", 1.0, 0.2)], t)
    b = spark.createDataFrame([("m", "x", 2.0, 0.04), ("m", "y", -1.0, 0.01), ("m", "z", 1.0, 0.01)], t)
    got = {r.family: (r.sign_changed, r.significance_changed, r.stable) for r in infer.conclusion_flags(a, b, ["model", "family"]).collect()}
    assert got == {"x": (False, False, True), "y": (True, False, False), "z": (False, True, False)}


def listed(values):
    """The extreme assignments by listing all of them, in whole numbers or floats added from left to right."""
    from itertools import product

    observed = abs(sum(values))
    return sum(abs(sum(s * v for s, v in zip(signs, values, strict=True))) >= observed for signs in product((1, -1), repeat=len(values)))


def test_halves_equal_the_list(monkeypatch):
    rng = np.random.default_rng(4)
    for n in (1, 2, 3, 7, 12):
        for values in (rng.integers(-9, 10, n), rng.integers(0, 2, n), np.zeros(n), rng.integers(-3, 3, n) * 0.25, np.full(n, 3)):
            values = values.astype(float)
            want = listed(values.tolist())
            assert infer.extreme_assignments(values) == want
            monkeypatch.setattr(infer, "MOST_ENUMERATED", 0)
            if n > 1:
                assert infer.extreme_assignments(values) == want
            monkeypatch.undo()
    values = rng.normal(size=16)
    want = infer.extreme_assignments(values)
    monkeypatch.setattr(infer, "MOST_ENUMERATED", 0)
    assert infer.extreme_assignments(values) == want == listed(values.tolist())


def test_forty_recordings_are_exact(spark):
    """Of 40 equal values the extreme assignments are the two equal ones; of one large value among zeros all are; the rest by a binomial tail."""
    from math import comb

    assert infer.extreme_assignments(np.ones(40)) == 2 and infer.extreme_assignments(np.array([5.0] + [0.0] * 39)) == 2**40
    values = np.array([1.0] * 30 + [-1.0] * 10)  # the sum is 20: at least 30 signs agree
    r = infer.sign_flip(arrays(spark, values), ["k"]).first()
    assert r.extreme == 2 * sum(comb(40, k) for k in range(30, 41)) and r.assignments == 2**40 and r.p_value == r.extreme / 2**40
    with pytest.raises(Exception, match="recordings are needed"):
        infer.sign_flip(arrays(spark, [1.0] * 45), ["k"]).collect()


def test_draws_do_not_depend_on_blocks(monkeypatch):
    whole = np.concatenate([np.stack([np.bincount(r, minlength=7) for r in infer.drawn_slots(7, 10_000, 3)])])
    for size in (4_000_000, 7 * 1000, 1):
        monkeypatch.setattr(infer, "COUNTS_AT_ONCE", size)
        assert np.array_equal(np.concatenate(list(infer.Resampling(seed=3).counts(7))), whole)


def test_cells_of_many_sizes_in_one_pass(spark):
    rng = np.random.default_rng(8)
    cells = {f"k{i}": (rng.normal(size=n), rng.uniform(1, 2, n)) for i, n in enumerate((1, 2, 5, 5, 9, 20, 5))}
    df = spark.createDataFrame([(k, v.tolist(), w.tolist()) for k, (v, w) in cells.items()], "k string, v array<double>, w array<double>")
    draws = rng.integers(0, 10**9, (10_000, 20))
    for given in (None, draws):
        for weighted in (False, True):
            got = {r.k: (r.ci_low, r.ci_high) for r in infer.bootstrap_interval(df, ["k"], seed=6, weighted=weighted, draws=given).collect()}
            for k, (v, w) in cells.items():
                at = infer.drawn_slots(len(v), 10_000, 6) if given is None else given[:, : len(v)] % len(v)
                means = (v[at] * w[at]).sum(1) / w[at].sum(1) if weighted else v[at].mean(1)
                assert got[k] == pytest.approx(np.quantile(means, [0.025, 0.975]).tolist(), abs=1e-12)
    with pytest.raises(ValueError):
        list(infer.Resampling(given=draws[:, :3]).counts(4))
    for bad in ({"resamples": 9_999}, {"confidence": 1.0}):
        with pytest.raises(ValueError):
            infer.Resampling(**bad)


def test_resampled_means_are_held_once():
    import tracemalloc

    values = np.random.default_rng(2).normal(size=(512, 12))
    plan = infer.Resampling(seed=17)
    tracemalloc.start()
    found = plan.intervals(values)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2 * 8 * plan.resamples * len(values)
    want = np.quantile(np.concatenate([c @ values.T / 12 for c in plan.counts(12)]), [0.025, 0.975], axis=0).T
    np.testing.assert_allclose(found, want, atol=1e-12)
