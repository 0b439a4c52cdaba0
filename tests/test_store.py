import json
import os
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import adapters, audio, encode
from kymo.plans import contract, jobs, scope
from kymo.sources import publish, tables
from kymo.sources.audio import inspect_audio, load_standardised, resample
from kymo.streaming.events import framed_events, sessions


def tone(path, seconds=2.0, rate=16_000, hz=180.0, channels=1):
    x = (0.5 * np.sin(2 * np.pi * hz * np.arange(int(seconds * rate)) / rate) * 32767).astype("<i2")
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(rate)
        w.writeframes(np.repeat(x, channels).tobytes())


GRID = 'File type = "ooTextFile"\nitem [1]:\nclass = "IntervalTier"\nname = "words"\nintervals [1]:\nxmin = 0.1\nxmax = 0.6\ntext = "hi"\nitem [2]:\nclass = "IntervalTier"\nname = "phones"\nintervals [1]:\nxmin = 0.1\nxmax = 0.3\ntext = "a"\nintervals [2]:\nxmin = 0.3\nxmax = 0.6\ntext = "z"\n'


@pytest.fixture
def corpus(tmp_path):
    for d in ("wav", "grid"):
        (tmp_path / d).mkdir()
    for name, hz in (("one", 180.0), ("two", 240.0)):
        tone(tmp_path / "wav" / f"{name}.wav", hz=hz, channels=2)
        (tmp_path / "grid" / f"{name}.TextGrid").write_text(GRID, encoding="utf-8")
    return str(tmp_path / "wav"), str(tmp_path / "grid"), str(tmp_path)


def test_audio_to_features(spark, corpus):
    wav, grid, root = corpus
    r = inspect_audio(spark, wav).orderBy("recording_id").first()
    assert (r.recording_id, r.sample_rate, r.channels, r.duration_seconds, r.subtype) == ("one", 16_000, 2, 2.0, "PCM_16")
    r = load_standardised(spark, wav, 8_000).where("recording_id = 'one'").first()
    assert r.n_samples == 16_000 and r.actions == ["averaged_channels", "resampled_16000_to_8000"] and max(r.samples) == pytest.approx(0.5, abs=0.02)
    valid, found = jobs.validate_inputs(spark, wav, grid)
    assert valid and found["manifest"].count() == 2
    out = os.path.join(root, "features")
    assert jobs.extract_features(spark, wav, grid, out) == "computed" and jobs.extract_features(spark, wav, grid, out) == "resumed"
    frames, names, families = tables.read_features(spark, out)
    assert names[41:46] == ["f0_hz", "voicing", "rms_intensity", "recording_onset", "phone_onset"] and len(names) == 49 + 2 and set(families) == {"acoustic", "prosodic", "onset", "phonetic", "word"}
    x = np.array([r.x for r in frames.where("recording_id = 'one'").orderBy("frame").collect()])
    assert x.shape == (100, 51) and np.isfinite(x).all() and x[0, 44] == 1 and x[1:, 44].sum() == 0
    assert np.median(x[10:90, 41]) == pytest.approx(180, rel=0.02)
    assert x[5, names.index("phone_category:a")] == 1 and x[15, names.index("phone_category:z")] == 1 and x[5, names.index("word_duration")] == pytest.approx(0.5) and x[30, names.index("word_boundary")] == 1
    _, rich, _ = audio.acoustic(np.zeros(4_000), 16_000, np.arange(10) / 50, 50.0, rich=True)
    assert len(rich) == 45 + 85 and rich[41] == "logmel_delta_00"
    qc = jobs.quality_report(spark, wav, grid)
    assert [r.status for r in qc["recording_annotation_qc"].collect()] == ["PASS", "PASS"] and qc["annotation_totals"].first().phone_categories == 2


def test_envelope_and_resampling():
    t = np.arange(4_000) / 4_000
    assert np.allclose(audio.envelope(np.cos(2 * np.pi * 100 * t)), 1)
    y = resample(np.sin(2 * np.pi * 50 * t), 1, 2)
    assert len(y) == 2_000 and np.abs(y[100:-100] - np.sin(2 * np.pi * 50 * t[::2])[100:-100]).max() < 0.01


def test_units_resume_and_repair(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return {"scores": spark.range(3)}, {"report": {"a": 1}}

    at = publish.unit_path(str(tmp_path), variant="v", model="a/b")
    assert at.endswith("variant=v/model=a%2Fb")
    args = (at, {"v": 1}, {"in": "x"}, {"c": 1}, make)
    assert [publish.run_unit(*args), publish.run_unit(*args)] == ["computed", "resumed"] and len(calls) == 1
    part = next(os.path.join(at, "scores", n) for n in os.listdir(os.path.join(at, "scores")) if n.startswith("part"))
    with open(part, "ab") as f:
        f.write(b"x")
    assert publish.unit_problem(at, {"v": 1}, {"in": "x"}, {"c": 1}) == "artifact_hash_mismatch" and publish.unit_problem(at, {"v": 2}, {"in": "x"}, {"c": 1}) == "identity_mismatch"
    assert publish.run_unit(*args) == "repaired"
    aside = next(d for d in os.listdir(os.path.dirname(at)) if ".corrupt-" in d)
    assert json.load(open(os.path.join(os.path.dirname(at), aside, "diagnosis.json")))["reason"] == "artifact_hash_mismatch"


def test_delivery(spark, tmp_path):
    d = str(tmp_path / "out")
    assert jobs.hand_off(spark, {"t": spark.createDataFrame([(1, [1, 2])], "a int, b array<int>")}, d, {"x": {"y": 1}}) == "COMPLETE"
    with open(os.path.join(d, "status.json"), "a") as f:
        f.write(" ")
    with open(os.path.join(d, "extra.bin"), "w") as f:
        f.write("x")
    assert {(r.path, r.problem) for r in publish.verify_delivery(spark, d).collect()} == {("status.json", "altered"), ("extra.bin", "unlisted")}


def test_tables(spark, tmp_path):
    p = tmp_path / "t.tsv"
    p.write_bytes(b"a\tb\n1\tx\n")
    assert tables.read_tsv(spark, str(p), ["a", "b"]).first().b == "x"
    p.write_bytes(b"a\tb\r\n1\tx\r\n")
    with pytest.raises(ValueError):
        tables.read_tsv(spark, str(p), ["a", "b"])
    c = tmp_path / "t.csv"
    c.write_text("k,v,w\na,1.5,z\nb,nan,z\n")
    rows = tables.read_csv(spark, str(c), "k string, v double", ["k"]).orderBy("k").collect()
    assert rows[0].v == 1.5 and rows[1].v != rows[1].v
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(c), "k string, q double", ["q"])
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "a.json").write_text('{"a": 1}')
    (tmp_path / "j" / "b.json").write_text("[1]")
    (tmp_path / "j" / "c.json").write_text("{")
    assert sorted(str(r.problem) for r in tables.read_json_objects(spark, str(tmp_path / "j"), strict=False).collect()) == ["None", "not_an_object", "unreadable"]


def test_fit_summarise_and_nulls(spark, tmp_path):
    rows, families = jobs.synthetic_recordings(spark)
    rows = rows.persist()
    plan = encode.Plan(families, lags=(-0.04, 0.0, 0.04), components=4, sensitivity_folds=4, inner_folds=2)
    root = str(tmp_path)
    for v in ("original", "capacity", "zero_lag"):
        assert jobs.fit(rows, plan, v, root, {}) == "computed"
    assert jobs.fit(rows, plan, "original", root, {}) == "resumed"
    short = encode.Plan(families, lags=(0.0,), inner_folds=2)
    assert jobs.fit_nulls(rows, short, root, {}, [0, 1]) == "computed"
    scores = jobs.scores_of(spark, root, "original")
    assert scores.agg(F.avg("full_r2")).first()[0] >= 0.5
    out = jobs.summarise(spark, root, 4, ("original", "capacity", "zero_lag"), nulls=2, seed=17)
    assert {"primary_original", "zero_vs_longer_lag", "null_observed_minus_mean", "sensitivity_conclusions", "capacity_coverage_by_outer_fold"} <= set(out)
    assert out["primary_original"].count() == 5 and out["null_observed_minus_mean"].count() == 3 and out["null_completeness"].first().complete
    assert out["zero_vs_longer_lag"].where("direction = 'longer lags higher'").count() >= 1
    expected = spark.createDataFrame([("synthetic", "layer_01"), ("synthetic", "layer_02")], "model string, layer string")
    assert [r.layer for r in jobs.missing_units(spark, root, expected, ("original",)).collect()] == ["layer_02"]


class Ramp:
    def timing(self):
        return 2, 0.0

    def states(self, x):
        return {"layer_00_input": x[::2, None]}


def test_chunks_and_canonical_states(spark):
    states, t = adapters.chunked_states(Ramp(), np.arange(100.0), 10, 4.0, 1.0)
    assert states["layer_00_input"][:, 0].tolist() == list(range(0, 100, 2)) and np.allclose(t, np.arange(50) / 5)
    wave_rows = spark.createDataFrame([("r", 10, [float(i) for i in range(100)], 10.0)], "recording_id string, sample_rate int, samples array<float>, duration_seconds double")
    native = adapters.extract(wave_rows, Ramp, "m", batch_seconds=4.0, overlap_seconds=1.0)
    done = adapters.canonicalise(native, wave_rows.select("recording_id", "duration_seconds"), 10.0).orderBy("frame").collect()
    assert len(done) == 100 and [r.y[0] for r in done[:99]] == pytest.approx(list(range(99)))
    with pytest.raises(KeyError):
        adapters.selected_layers({"a": np.zeros(1)}, ["b"])


def test_text_states(spark):
    iv = spark.createDataFrame([("r", 0, "words", 0.2, 0.6, "a"), ("r", 1, "Words", 1.0, 1.4, "b"), ("r", 2, "phones", 0.0, 1.0, "p")], "recording_id string, interval_idx int, tier string, start double, end double, label string")
    rec = spark.createDataFrame([("r", 2.0)], "recording_id string, duration_seconds double")
    out, coverage = adapters.text_states(iv, rec, lambda words: np.array([[ord(w), 1.0] for w in words]), 2, rate=10.0)
    got = {r.frame: r.y for r in out.collect()}
    assert got[3] == [97, 1] and got[11] == [98, 1] and got[8] == [0, 0] and coverage.first().coverage == pytest.approx(0.4)


def test_registry():
    good = {"model_id": "x", "revision": "r", "family": "f", "input_modality": "audio", "sample_rate_hz": 16_000, "adapter": "generic_speech", "loading_class": "c", "layers": "all", "enabled": True, "license_notes": "", "limitations": ""}
    config = {"default_model": "a", "runtime_defaults": {"batch_seconds": 20}, "models": {"a": good}}
    assert adapters.registry_problems(config) == [] and adapters.registry_entry(config, "a")["batch_seconds"] == 20
    bad = {"default_model": "q", "models": {"A b": {**good, "adapter": "other", "sample_rate_hz": None}, "c": {}}}
    assert len(adapters.registry_problems(bad)) == 5
    with pytest.raises(KeyError):
        adapters.registry_entry(config, "z")


def test_tasks(spark, tmp_path):
    layers = spark.createDataFrame([(m, f"layer_{i:02d}" if i else "layer_00_input", i) for m in scope.ALL for i in range(13)], "model string, layer string, layer_idx int")
    made = {"primary": scope.primary_tasks(layers), "controls": scope.control_tasks(layers), "nulls": scope.null_tasks(layers)}
    assert {k: v.count() for k, v in made.items()} == {"primary": 8, "controls": 21, "nulls": 80}
    assert all(scope.tasks_unchanged(v, layers, k) for k, v in made.items()) and not scope.tasks_unchanged(made["nulls"].limit(79), layers, "nulls")
    at = str(tmp_path / "tasks")
    assert [scope.publish_tasks(made["primary"], at), scope.publish_tasks(made["primary"], at)] == ["written", "unchanged"]
    with pytest.raises(ValueError):
        scope.publish_tasks(made["primary"].limit(2), at)
    assert scope.publish_tasks(made["primary"].limit(2), at, replace=True) == "written"
    (tmp_path / "log").mkdir()
    (tmp_path / "log" / "a.log").write_text("fine\nWARNING: low\nValueError: no\nTraceback (most recent)\n")
    assert [(r.line, r.severity) for r in tables.log_findings(spark, str(tmp_path / "log")).orderBy("line").collect()] == [(2, "warning"), (4, "error")]
    folds = spark.createDataFrame([(f, k, 0.1 + f) for f in range(5) for k in ("full", "word")], "outer_fold int, feature_family string, alpha double")
    assert scope.fixed_alphas(folds)[3]["full"] == pytest.approx(3.1)
    with pytest.raises(ValueError):
        scope.fixed_alphas(folds.where("not (outer_fold = 1 and feature_family = 'word')"))


def test_contract(spark):
    f = spark.createDataFrame([("r", 0, 0.0, [1.0]), ("r", 1, 0.02, [2.0])], "recording_id string, frame int, t double, x array<double>")
    analysis = {"analysis_rate_hz": 50, "analysis": {"target_mode": "pca", "n_components": 2, "lags_seconds": [0], "outer_folds": 2, "inner_folds": 2, "alphas": [1]}}
    a = contract.build_contract(f, ["x"], ["acoustic"], {}, analysis, {0: ["r"]})
    assert set(a) == set(contract.FIELDS)
    b = {**a, "outer_test_groups": {0: ["s"]}}
    same, diff = contract.compare(spark, a, b)
    assert not same and [r.field for r in diff.where("not matches").collect()] == ["outer_test_groups"] and contract.compare(spark, a, dict(a))[0]
    act = f.select(F.lit("l").alias("layer"), "recording_id", "frame", "t", F.col("x").alias("y"))
    res = spark.createDataFrame([("l", 0, "word", 0.5, 0.4, 0.1, float("nan"))], "layer string, outer_fold int, feature_family string, full_r2 double, reduced_r2 double, conditional_delta_r2 double, conditional_proportion double")
    near = {"activations": act.withColumn("y", F.transform("y", lambda v: v + 1e-4)), "results": res.withColumn("conditional_delta_r2", F.col("conditional_delta_r2") + 1e-6)}
    assert all(r.close for r in contract.compare_runs({"activations": act, "results": res}, near).collect())
    far = {"activations": act.where("frame = 0"), "results": res.withColumn("full_r2", F.lit(0.9))}
    assert not any(r.close for r in contract.compare_runs({"activations": act, "results": res}, far).where("part <> 'times'").collect())


def test_activation_store(spark, tmp_path):
    rows = spark.createDataFrame([("m", "l", "r", "native", 0, 0.0, [1.0])], "model string, layer string, recording_id string, grid string, frame int, t double, y array<float>")
    root = str(tmp_path / "s")
    assert [publish.save_activations(rows, root, "sig"), publish.save_activations(rows, root, "sig")] == ["written", "skipped"]
    with pytest.raises(ValueError):
        publish.save_activations(rows, root, "other")
    assert publish.save_activations(rows, root, "other", overwrite=True) == "written" and tables.read_activations(spark, root, "m", "l", "native").count() == 1


def test_streams(spark, tmp_path):
    rows = [("u", f"2024-01-01 0{h}:{m:02d}:00", 1.5) for h, m in ((0, 5), (0, 50), (1, 10), (5, 0))] + [("v", "2024-01-01 00:20:00", 2.0)]
    src = str(tmp_path / "in")
    schema = "recording_id string, ts timestamp, value double"
    spark.createDataFrame(rows, "recording_id string, ts string, value double").select("recording_id", F.to_timestamp("ts").alias("ts"), "value").write.parquet(src)
    for name, make, count in (("frames", framed_events, 4), ("runs", lambda d: sessions(d, "45 minutes"), 5 - 1)):
        q = make(spark.readStream.schema(schema).parquet(src)).writeStream.outputMode("complete" if name == "frames" else "append").format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name)).start()
        try:
            q.processAllAvailable()
            got = spark.table(name).collect()
        finally:
            q.stop()
        if name == "frames":
            assert len(got) == count and sum(r.n for r in got) == 5


def test_contract_digests_and_wording(spark):
    """Digests of the raw bytes, folds of whole recordings, and the wording that published contracts share."""
    import hashlib

    rows = [(r, i, i / 50, [float(i), float(n)]) for n, r in enumerate(("b", "a", "c")) for i in range(4 + n)]
    f = spark.createDataFrame(rows, "recording_id string, frame int, t double, x array<double>").repartition(5)
    analysis = {"analysis_rate_hz": 50, "analysis": {"target_mode": "pca", "n_components": 2, "lags_seconds": [0.0], "outer_folds": 3, "inner_folds": 2, "alphas": [1.0]}}
    got = contract.build_contract(f, ["x", "y"], ["word", "acoustic"], {"a": 1}, analysis)
    for n, r in enumerate(("b", "a", "c")):
        t, x = np.arange(4 + n) / 50, np.array([[i, n] for i in range(4 + n)], dtype=np.float32)
        assert got["canonical_grid_sha256"][r] == hashlib.sha256(t.tobytes()).hexdigest()
        assert got["feature_matrix_sha256"][r] == hashlib.sha256(x.tobytes()).hexdigest()
    assert got["stimulus_ids"] == ["a", "b", "c"] and sorted(map(tuple, got["outer_test_groups"])) == [("a",), ("b",), ("c",)]
    assert got["cross_validation"] == {"outer_folds": 3, "inner_folds": 2, "alphas": [1.0], "splitter": "GroupKFold"}
    assert got["feature_preprocessing"] == {"definition": {"a": 1}, "regression_scaling": "StandardScaler fitted on each training fold only"}
    assert got["reduced_model_specifications"] == [{"omitted_family": x, "comparison": "full_minus_reduced"} for x in ("acoustic", "word")]
    assert len(got["result_schema"]) == 8 and len(contract.FIELDS) == 18 and set(got) == set(contract.FIELDS)


def test_registry_rules_one_by_one(spark):
    good = {"model_id": "x", "revision": "r", "family": "f", "input_modality": "audio", "sample_rate_hz": 16_000, "adapter": "generic_speech", "loading_class": "c", "layers": "all", "enabled": True, "license_notes": "", "limitations": ""}
    text = {**good, "input_modality": "text", "sample_rate_hz": None, "adapter": "bert_text", **dict.fromkeys(adapters.TEXT_FIELDS, "x")}
    for change, base, word in (
        ({"input_modality": "video"}, good, "audio or text"), ({"sample_rate_hz": None}, good, "needs a sample rate"), ({"sample_rate_hz": 8000}, text, "no sample rate"), ({"adapter": "x"}, good, "unknown"),
        ({"locked_reference": True}, good, "output folder"), ({"adapter": "whisper_encoder"}, good, "30 seconds"), ({"layers": 3}, good, "all or a list"),
    ):
        config = {"default_model": "m", "runtime_defaults": {"batch_seconds": 40}, "models": {"m": {**base, **change}}}
        assert [word in p for p in adapters.registry_problems(config)] == [True], (change, adapters.registry_problems(config))
    lacking = {k: v for k, v in text.items() if k != "context_policy"}
    assert "context_policy" in adapters.registry_problems({"default_model": "m", "models": {"m": lacking}})[0]
    assert adapters.registry_problems({"default_model": "m", "models": {"m": text}}) == []


def test_canonical_states_of_several_layers(spark):
    """Whole arrays, of different widths by layer, between samples and held beyond them."""
    rows = [("m", layer, "r", t, [t * (k + 1) for k in range(width)]) for layer, width in (("a", 2), ("b", 3)) for t in (0.1, 0.3, 0.7)]
    native = spark.createDataFrame(rows, "model string, layer string, recording_id string, t double, y array<float>")
    done = adapters.canonicalise(native, spark.createDataFrame([("r", 1.0)], "recording_id string, duration_seconds double"), 10.0).collect()
    assert len(done) == 20
    for r in done:
        at = min(max(r.t, 0.1), 0.7)
        assert r.y == pytest.approx([at * (k + 1) for k in range(2 if r.layer == "a" else 3)], abs=1e-6)


def test_published_tables_are_sorted(spark, tmp_path):
    rows = spark.createDataFrame([("m", f"l{i % 3}", f"r{i}", i) for i in range(50)], "model string, layer string, recording_id string, n int").repartition(7, "n")
    at = str(tmp_path / "t")
    publish.write_table(rows, at)
    names = sorted(n for n in os.listdir(at) if n.startswith("part"))
    got = [line.split(",")[:3] for n in names for line in open(os.path.join(at, n), encoding="utf-8").read().splitlines()[1:]]
    assert got == sorted(got) and len(got) == 50
