import numpy as np
import pytest

from kymo.operators import encode
from kymo.schema import FAMILIES

SIX = ["acoustic", "acoustic", "prosodic", "phonetic", "word", "onset"]


def data(lengths=(12, 12, 12, 12), targets=4, seed=42):
    rng = np.random.default_rng(seed)
    c = rng.normal(size=(6, targets))
    out = {}
    for i, n in enumerate(lengths):
        x = rng.normal(size=(n, 6))
        out[f"r{i}"] = x, x @ c + 0.05 * rng.normal(size=(n, targets))
    return out


def frames(spark, recordings):
    rows = [("m", "l", k, i, x[i].tolist(), y[i].tolist()) for k, (x, y) in recordings.items() for i in range(len(x))]
    return spark.createDataFrame(rows, "model string, layer string, recording_id string, frame int, x array<double>, y array<double>")


def unit(recordings, **options):
    plan = encode.Plan(SIX, **options)
    moments = {k: encode.Moments.of(np.concatenate([encode.lag_rows(x, plan.lags, plan.rate), y], axis=1)) for k, (x, y) in recordings.items()}
    return encode.Unit(plan, moments, {k: encode.Moments.of(x) for k, (x, _) in recordings.items()})


def direct(recordings, train, test, keep, alpha, lags=(0.0,), rate=50.0, components=None):
    """The same by rows: standardise, ridge, project, score."""
    z = {k: encode.lag_rows(x, lags, rate)[:, keep] for k, (x, _) in recordings.items()}
    x, y = np.vstack([z[k] for k in train]), np.vstack([recordings[k][1] for k in train])
    mean, scale, basis = x.mean(0), x.std(0), np.eye(y.shape[1])
    scale = np.where(scale > 0, scale, 1)
    centre = np.zeros(y.shape[1])
    if components:
        centre = y.mean(0)
        basis = np.linalg.svd(y - centre, full_matrices=False)[2][:components].T
    s, t = (x - mean) / scale, (y - centre) @ basis
    w = np.linalg.solve(s.T @ s + alpha * np.eye(s.shape[1]), s.T @ (t - t.mean(0)))
    out = {}
    for k in test:
        got, want = (z[k] - mean) / scale @ w + t.mean(0), (recordings[k][1] - centre) @ basis
        out[k] = 1 - ((want - got) ** 2).sum() / ((want - want.mean(0)) ** 2).sum()
    return out


@pytest.mark.parametrize("components", [None, 2])
def test_moments_equal_rows(components):
    d = data((30, 20, 25, 40))
    lags = (-0.02, 0.0, 0.04)
    u = unit(d, lags=lags, components=components)
    train, test = ["r0", "r1", "r2"], ["r3"]
    total, tests, names, _ = u.prepared(train, test)
    for omitted in (None, "acoustic"):
        keep = np.array([k for k, n in enumerate(names) if n != omitted])
        w, b = encode.ridge(total, len(names), keep, [10.0])[10.0]
        want = direct(d, train, test, keep, 10.0, lags, 50.0, components)["r3"]
        assert encode.r2(tests["r3"], len(names), keep, w, b) == pytest.approx(want, abs=1e-9)


def test_fit_rows(spark):
    plan = encode.Plan(SIX, sensitivity_folds=4, components=2)
    f = frames(spark, data())
    moments = encode.recording_moments(f, plan, ["model", "layer"])
    rows = encode.fit_scores(moments, plan, ["model", "layer"]).collect()
    assert len([r for r in rows if r.split_kind == "primary"]) == len([r for r in rows if r.split_kind == "sensitivity"]) == 20
    for r in rows:
        assert r.frames == 12 and r.duration_seconds == pytest.approx(0.24) and r.delta_r2 == r.full_r2 - r.reduced_r2
        assert r.recording_id in r.test_recording_ids and not set(r.train_recording_ids) & set(r.test_recording_ids) and set(r.full_inner_cv_scores) == set(plan.alphas)
    assert np.mean([r.full_r2 for r in rows]) > 0.5
    reports = encode.fit_reports(moments, plan, ["model", "layer"]).collect()
    assert len(reports) == 8 and all(r.components == 2 and 0 < r.coverage <= 1 for r in reports)
    pooled = encode.pooled_results(moments, plan, ["model", "layer"], 4).collect()
    assert len(pooled) == 4 * 6 and sum(r.feature_family == "full" and np.isnan(r.conditional_delta_r2) for r in pooled) == 4


def test_held_out_recordings_do_not_leak():
    d = data()
    extreme = {**d, "r3": (d["r3"][0] * 1e12, d["r3"][1] * 1e12)}
    for options in ({}, {"components": 2}, {"capacity": True}):
        a, b = (unit(x, **options).prepared(["r0", "r1", "r2"], ["r3"]) for x in (d, extreme))
        assert np.array_equal(a[0].cross, b[0].cross) and a[3] == b[3]
        assert unit(d, **options).choose(["r0", "r1", "r2"], None) == unit(extreme, **options).choose(["r0", "r1", "r2"], None)


def test_coverage_is_of_the_training_rows():
    d = data(targets=5)
    d["r3"] = d["r3"][0], d["r3"][1] * 1e9
    _, _, _, report = unit(d, components=2).prepared(["r0", "r1", "r2"], ["r3"])
    y = np.vstack([d[k][1] for k in ("r0", "r1", "r2")])
    s = np.linalg.svd(y - y.mean(0), compute_uv=False) ** 2
    assert report["coverage"] == pytest.approx(s[:2].sum() / s.sum())


def test_capacity_control():
    _, tests, names, report = unit(data(), capacity=True).prepared(["r0", "r1", "r2"], ["r3"])
    assert report["capacity"]["rank"] == 1 and names == ["acoustic", "prosodic", "phonetic", "word", "onset"] and tests["r3"].cross.shape[0] == 9


def test_folds():
    fold = encode.group_folds({"a": 5, "b": 4, "c": 3, "d": 3, "e": 1}, 2)
    assert sorted(sum({"a": 5, "b": 4, "c": 3, "d": 3, "e": 1}[k] for k in fold if fold[k] == f) for f in (0, 1)) == [8, 8]
    splits = encode.outer_splits({"r0": 9, "r1": 9, "r2": 9, "r3": 9}, 4, {"r0": "a", "r1": "a", "r2": "b", "r3": "b"})
    assert len([s for s in splits if s[0] == "primary"]) == 4 and sorted(s[3] for s in splits if s[0] == "sensitivity") == [["r0", "r1"], ["r2", "r3"]]
    with pytest.raises(ValueError):
        encode.group_folds({"a": 1}, 2)
    with pytest.raises(ValueError):
        encode.Plan(SIX, alphas=(-1.0,))


def test_r2_bounds():
    y = np.random.default_rng(0).normal(size=(20, 2))
    m = encode.Moments.of(np.concatenate([y, y], axis=1))
    keep = np.arange(2)
    assert encode.r2(m, 2, keep, np.eye(2), np.zeros(2)) == pytest.approx(1.0)
    assert encode.r2(m, 2, keep, np.zeros((2, 2)), y.mean(0)) == pytest.approx(0.0)


def test_merged_moments():
    z = np.random.default_rng(3).normal(size=(50, 4)) + 1e6
    a, b = encode.merged([encode.Moments.of(z[:7]), encode.Moments.of(z[7:30]), encode.Moments.of(z[30:])]), encode.Moments.of(z)
    assert a.n == 50 and np.allclose(a.mean, b.mean) and np.allclose(a.cross, b.cross)


def test_fixed_penalties_and_predictions(spark):
    f = frames(spark, data())
    plan = encode.Plan(SIX, sensitivity_folds=4, kinds=("sensitivity",), fixed_alphas={k: dict.fromkeys(("full", *FAMILIES), 3.1) for k in range(4)})
    rows = encode.fit_scores(encode.recording_moments(f, plan, ["model", "layer"]), plan, ["model", "layer"]).collect()
    assert len(rows) == 20 and all(r.full_alpha == r.reduced_alpha == 3.1 and r.full_inner_cv_scores == {} for r in rows)
    plan = encode.Plan(SIX)
    moments = encode.recording_moments(f, plan, ["model", "layer"])
    scores = {r.recording_id: r.full_r2 for r in encode.fit_scores(moments, plan, ["model", "layer"]).collect()}
    p = encode.predictions(f, moments, plan, ["model", "layer"]).toPandas()
    for k, g in p.groupby("recording_id"):
        t, y = (np.stack(g[g.kind == kind].sort_values("frame").v.to_numpy()) for kind in ("target", "full"))
        assert 1 - ((t - y) ** 2).sum() / ((t - t.mean(0)) ** 2).sum() == pytest.approx(scores[k])


def test_splits_shared_among_tasks_give_the_same_scores(spark):
    from kymo.plans import jobs

    rows, families = jobs.synthetic_recordings(spark, 4, 2.0)
    plan = encode.Plan(families, components=2, inner_folds=2, sensitivity_folds=2)
    moments = encode.recording_moments(rows, plan, jobs.UNIT).persist()
    columns = ["split_kind", "outer_fold", "recording_id", "family", "full_alpha", "full_r2", "delta_r2"]
    one, many = (sorted(map(tuple, encode.fit_scores(moments, plan, jobs.UNIT, n).select(columns).collect())) for n in (1, 3))
    assert one == many and len(one) == 4 * 5 * 2
    assert len(encode.fit_scores(moments, plan, jobs.UNIT, 9).select(columns).collect()) == len(one)  # more tasks than splits


def tree_nodes(chosen, levels):
    from kymo.operators.moments import cover

    chosen = np.array(chosen, dtype=bool)
    nodes = cover(chosen, levels)
    held = [i for level, node in nodes for i in range(node << level, min((node + 1) << level, len(chosen)))]
    assert sorted(held) == np.flatnonzero(chosen).tolist()  # each position once
    return nodes


def test_cover_of_positions():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 5, 8, 9, 64, 500):
        for share in (0.0, 0.3, 0.9, 1.0):
            tree_nodes(rng.random(n) < share, 9)
    assert tree_nodes([True] * 500, 9) == [(9, 0)] and tree_nodes([True] * 5 + [False], 9) == [(0, 4), (2, 0)]
    for a, b in ((3, 490), (0, 499), (1, 500), (250, 251)):
        assert len(tree_nodes([a <= i < b for i in range(500)], 9)) <= 18


@pytest.mark.parametrize("options", [{"components": 2, "sensitivity_folds": 3}, {"capacity": True, "lags": (0.0, 0.02)}, {"omitted": ("word",), "groups": {f"r{i}": f"g{i % 7}" for i in range(70)}, "sensitivity_folds": 3}])
def test_large_units_equal_fits_in_memory(spark, options):
    """Scores, penalties and reports of 70 recordings of different lengths against the same algebra on one dictionary of moments."""
    rng = np.random.default_rng(7)
    d = data(tuple(rng.integers(8, 30, 70).tolist()))
    plan = encode.Plan(SIX, alphas=(10.0, 0.1, 3.0), **options)
    moments = encode.recording_moments(frames(spark, d), plan, ["model", "layer"]).persist()
    rows = encode.fit_scores(moments, plan, ["model", "layer"]).collect()
    u = unit(d, alphas=plan.alphas, **options)
    splits = {(kind, fold): (train, test) for kind, fold, train, test in encode.outer_splits({k: len(x) for k, (x, _) in d.items()}, plan.sensitivity_folds, plan.groups)}
    assert len(rows) == sum(len(test) for _, test in splits.values()) * len(plan.omitted)
    checked = 0
    for r in rows:
        if r.split_kind == "sensitivity" or r.outer_fold % 17 == 3:
            train, test = splits[r.split_kind, r.outer_fold]
            assert r.train_recording_ids == train and r.test_recording_ids == test and r.frames == len(d[r.recording_id][0])
            total, tests, names, _ = u.prepared(train, [r.recording_id])
            for omitted, alpha, inner, score in ((None, r.full_alpha, r.full_inner_cv_scores, r.full_r2), (r.family, r.reduced_alpha, r.reduced_inner_cv_scores, r.reduced_r2)):
                if checked < 60:
                    best, means = u.choose(train, omitted)
                    assert best == alpha and means == pytest.approx(inner)
                    keep = np.array([k for k, n in enumerate(names) if n != omitted])
                    w, b = encode.ridge(total, len(names), keep, [alpha])[alpha]
                    assert encode.r2(tests[r.recording_id], len(names), keep, w, b) == pytest.approx(score, abs=1e-9)
            checked += 1
    assert checked >= 20
    for r in encode.fit_reports(moments, plan, ["model", "layer"]).collect():
        if r.outer_fold % 9 == 0:
            want = u.prepared(splits[r.split_kind, r.outer_fold][0], [])[3]
            assert r.coverage == pytest.approx(want["coverage"]) and r.capacity_rank == (want["capacity"] or {}).get("rank")
    moments.unpersist()


def test_dealing_by_weights_equals_dealing_one_by_one(spark):
    from kymo.operators.moments import Dealing

    rng = np.random.default_rng(3)
    for k in (2, 3, 5):
        for weight in (0, 1, 4, 50):
            loads = rng.integers(0, 60, k)
            one, want = loads.copy(), []
            for _ in range(70):
                f = int(np.argmin(one))
                one[f] += weight
                want.append(f)
            d = Dealing(weight, loads)
            assert d.fold(np.arange(70)).tolist() == want and d.after(70).tolist() == one.tolist() and d.after(0).tolist() == loads.tolist()
    for n, weights in ((2, [5]), (40, [3]), (200, range(20)), (150, range(1000))):
        sizes = {f"r{i:03d}" if i % 2 else f"x{i}": int(rng.choice(list(weights))) for i in range(n)}
        df = spark.createDataFrame(list(sizes.items()), "recording_id string, weight long")
        assert {r.recording_id: r.fold for r in encode.dealt_folds(df, 4).collect()} == encode.group_folds(sizes, 4)
    with pytest.raises(ValueError):
        encode.dealt_folds(spark.createDataFrame([("a", 1)], "recording_id string, weight long"), 3)
