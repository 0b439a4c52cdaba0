import json
import os
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from kymo.operators import encode, quality
from kymo.plans import cli, contract, handoff, jobs, scope
from kymo.schema import FAMILIES, SUBSTANTIVE
from kymo.sources import publish

IDS = ["r1", "r2", "r3", "r4"]
SCORES = "model string, layer string, recording_id string, family string, delta_r2 double, full_r2 double, duration_seconds double"


def scores(spark, models=("hubert_base", "other"), layers=("layer_01",), families=FAMILIES, ids=IDS, shift=0.0, seed=1):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(m, x, i, f, float(rng.normal(0.1 + shift, 0.05)), 0.5, 10.0 + n) for m, x, (n, i), f in product(models, layers, enumerate(ids), families)], SCORES)


def test_all_tables_of_a_delivery(spark):
    primary, loro = scores(spark), scores(spark, models=("hubert_base",), seed=2)
    controls = scores(spark, seed=3).withColumn("variant", F.explode(F.array(*map(F.lit, handoff.CONTROLS)))).withColumn("depth", F.lit("middle"))
    controls = controls.where("not (variant = 'rich' and recording_id = 'r4' and model = 'other' and family = 'word')")
    nulls = scores(spark, models=("hubert_base",), families=SUBSTANTIVE, seed=4, shift=-0.1).withColumn("null_index", F.explode(F.sequence(F.lit(0), F.lit(2))))
    reports = spark.createDataFrame([("original", "hubert_base", "layer_01", "primary", f, 2, 0.8 + f / 10, None, None) for f in range(2)] + [("capacity", "hubert_base", "layer_01", "primary", 0, 2, 0.5, 3, {"word": 0.9})], "variant string, model string, layer string, split_kind string, outer_fold int, components int, coverage double, capacity_rank int, capacity_coverage map<string,double>")
    unit = "component string, variant string, model string, layer string, null_index int"
    expected = spark.createDataFrame([("fit", "original", "hubert_base", "layer_01", None), ("fit", "rich", "other", "layer_01", None), ("null", None, "hubert_base", "layer_01", 0), ("null", None, "hubert_base", "layer_01", 1)], unit)
    units = spark.createDataFrame([("fit", "original", "hubert_base", "layer_01", None, "complete", 3.0, 100, "/a"), ("null", None, "hubert_base", "layer_01", 0, "artifact_hash_mismatch", 1.0, 50, "/b")], f"{unit}, state string, runtime_seconds double, peak_kib long, path string")
    logs = spark.createDataFrame([("a.log", 2, "warning", "w"), ("a.log", 4, "error", "e")], "path string, line int, severity string, text string")
    predictions = spark.createDataFrame([("p.npz", 10, "00")], "path string, length long, sha256 string")
    shifts = spark.createDataFrame([(0, "r1", "word", 60)], "null_index int, recording_id string, family string, offset_frames int")
    out = handoff.delivery(spark, primary, loro, controls, nulls, shifts, reports, expected, units, logs, predictions, {"a": {"b": [1, 2]}}, 4, 3, seed=17)
    assert list(out) == list(handoff.TABLES) and len(out) == 37
    assert out["primary_inference"].count() == 10 and out["hubert_base_split_conclusion_changes"].count() == 5
    effect = {(r.model, r.family): r.effect for r in out["primary_inference"].collect()}
    by_hand = {(r.model, r.family): r.e for r in primary.groupBy("model", "family").agg(F.avg("delta_r2").alias("e")).collect()}
    assert effect == pytest.approx(by_hand)
    gaps = out["incomplete_inference_cells"].collect()
    assert {(r.table, r.model, r.family, r.recordings) for r in gaps} == {("rich_inference", "other", "word", 3), ("rich_vs_original_inference", "other", "word", 3)}
    assert out["rich_inference"].count() == 9 and out["zero_lag_vs_original_inference"].count() == 10
    difference = {(r.model, r.family): r.effect for r in out["zero_lag_vs_original_inference"].collect()}
    zero = {(r.model, r.family): r.e for r in controls.where("variant = 'zero_lag'").groupBy("model", "family").agg(F.avg("delta_r2").alias("e")).collect()}
    assert difference == pytest.approx({k: zero[k] - by_hand[k] for k in zero})
    assert {(r.component, r.variant, r.null_index, r.reason) for r in out["missing_incomplete_units"].collect()} == {("fit", "rich", None, "missing"), ("null", None, 0, "artifact_hash_mismatch"), ("null", None, 1, "missing")}
    assert out["structured_null_inference"].count() == 3 and {r.state for r in out["structured_null_unit_status"].collect()} == {"artifact_hash_mismatch", "missing"}
    assert out["capacity_predictor_coverage"].first().coverage == 0.9 and out["slurm_log_inventory"].first().errors == 1
    assert {(r.variant, r.model): r.family_order.count(">") for r in out["control_family_ordering"].collect()}[("zero_lag", "other")] == 4


def test_models_that_are_not_comparable_are_refused(spark):
    fields = dict.fromkeys(contract.FIELDS, 1)
    results = spark.createDataFrame([(f"layer_{i}", i, f, k, 0.4 + i / 10, 0.1) for i in range(2) for f in range(2) for k in FAMILIES], "layer string, layer_idx int, outer_fold int, feature_family string, full_r2 double, conditional_delta_r2 double")
    out = handoff.summarise_models(spark, dict.fromkeys(("a", "b", "c"), results), {"a": fields, "b": dict(fields), "c": {**fields, "metrics": 2}}, "a")
    assert {r.model for r in out["models"].collect()} == {"a", "b"} and [(r.model, r.field) for r in out["not_comparable"].collect()] == [("c", "metrics")]


def test_frozen_reference(spark):
    rows = spark.createDataFrame([("l", 0)], "layer string, outer_fold int")
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "recording_id string")
    assert handoff.frozen_reference_problems(rows, ("layer", "outer_fold"), ids("a", "b"), ids("a", "b")).isEmpty()
    found = handoff.frozen_reference_problems(rows, ("outer_fold", "layer"), ids("a", "a", "c"), ids("a", "b")).collect()
    assert {(r.problem, r.name) for r in found} == {("columns_differ", "layer,outer_fold"), ("duplicate_recording", "a"), ("missing_recording", "b"), ("unexpected_recording", "c")}


def test_model_quality_from_saved_metadata_only(spark):
    good = {"model": {"key": "m1"}, "model_id": "org/m1", "revision": "abc", "processor_identity": "p", "config_sha256": "c", "bidirectional": True, "future_context": True, "receptive_field_samples": 400, "native_frame_rate_hz": 50.0, "chunk_length_seconds": 20}
    documents = spark.createDataFrame([("one", json.dumps(good)), ("one", json.dumps({"sample_rate_hz": 16000})), ("two", json.dumps({"model_key": "other", "model_id": "x"})), ("two", json.dumps({"model_id": "y"}))], "model string, document string")
    models = spark.createDataFrame([("one", "m1", "org/m1"), ("two", "m2", None)], "model string, expected_key string, registered_id string")
    ids = spark.createDataFrame([("a",), ("b",)], "recording_id string")
    extracted = spark.createDataFrame([("one", "a"), ("one", "b"), ("two", "a"), ("two", "a")], "model string, recording_id string")
    layers = spark.createDataFrame([("one", "a", ["l0", "l1"]), ("one", "b", ["l0", "l1"]), ("two", "a", ["l0"]), ("two", "b", ["l1"])], "model string, recording_id string, layers array<string>")
    out = quality.model_quality(documents, models, extracted, ids, layers)
    rows = {r.model: r for r in out["provenance_qc"].collect()}
    assert rows["one"].status == "PASS" and rows["one"].reasons == [] and rows["one"].layer_count == 2 and rows["one"].sample_rate_hz == "16000"
    codes = {r.code for r in rows["two"].reasons}
    assert rows["two"].status == "FAIL" and codes == {"model_identity_mismatch", "registered_hf_model_id_unresolved", "checkpoint_id_unresolved", "revision_or_fingerprint_unresolved", "processor_identity_unresolved", "config_identity_unresolved", "extraction_manifest_recordings_mismatch", "layer_definitions_mismatch"}
    context = {r.model: r for r in out["temporal_context"].collect()}
    assert context["one"].status == "PASS" and context["one"].context_audit_support == "supported" and context["two"].receptive_field == "unknown" and context["two"].status == "WARN"
    assert quality.overall_status(*out.values()) == "FAIL"


def test_summary_status(spark):
    files = spark.createDataFrame([("x/a.csv", "1"), ("x/b.csv", "2")], "path string, sha256 string")
    status = {"state": "complete", "artifacts": {"a": {"path": "/out/a.csv", "sha256": "1"}, "b": {"path": "/out/b.csv", "sha256": "3"}, "d": {"path": "d.csv", "sha256": "4"}}}
    got = {(r.name, r.problem) for r in quality.summary_problems(spark, status, files, ("a.csv", "b.csv", "c.csv", "d.csv")).collect()}
    assert got == {("b.csv", "hash_differs"), ("c.csv", "absent_from_status"), ("d.csv", "missing_file")}
    assert ("", "not_complete") in {(r.name, r.problem) for r in quality.summary_problems(spark, {"state": "partial"}, files, ()).collect()}


def test_penalties_of_published_results(spark):
    rows = [("l1", f, k, 0.1 * (f + 1) + n) for f in range(5) for n, k in enumerate(("full", *FAMILIES))]
    results = spark.createDataFrame([*rows, ("l2", 0, "full", 1.0)], "layer string, outer_fold int, feature_family string, alpha double")
    got = scope.legacy_alphas(results, "l1")
    assert set(got) == set(range(5)) and got[2]["full"] == pytest.approx(0.3) and set(got[0]) == {"full", *FAMILIES}
    for bad in (results.where("not (outer_fold = 3 and feature_family = 'full')"), results.union(results.limit(1)), results.withColumn("feature_family", F.when(F.col("feature_family") == "word", "words").otherwise(F.col("feature_family")))):
        with pytest.raises(ValueError):
            scope.legacy_alphas(bad, "l1")
    reports = spark.createDataFrame([("sensitivity", f, 1.0 + f, dict.fromkeys(FAMILIES, 2.0)) for f in range(5)] + [("primary", 7, 9.0, {})], "split_kind string, outer_fold int, full_alpha double, reduced_alphas map<string,double>")
    assert scope.grouped_alphas(reports, SUBSTANTIVE)[4] == {"full": 5.0, **dict.fromkeys(SUBSTANTIVE, 2.0)}
    with pytest.raises(ValueError):
        scope.grouped_alphas(reports.where("outer_fold <> 1"), SUBSTANTIVE)
    assert scope.alpha_source_problems(spark, dict.fromkeys(contract.FIELDS, 1), {**dict.fromkeys(contract.FIELDS, 1), "metrics": 2}) == ["metrics"]


def test_units_by_layer_resume_alone_and_a_bad_one_holds_up_no_other(spark, tmp_path):
    rows, families = jobs.synthetic_recordings(spark, 4, 2.0)
    rows = rows.unionByName(rows.withColumn("layer", F.lit("layer 2/b"))).persist()
    plan = encode.Plan(families, components=2, inner_folds=2, sensitivity_folds=2)
    root = str(tmp_path / "fits")
    assert jobs.fit(rows, plan, "original", root, {}) == "computed" and jobs.fit(rows, plan, "original", root, {}) == "resumed"
    assert {r.layer for r in jobs.scores_of(spark, root, "original").select("layer").distinct().collect()} == {"layer_01", "layer 2/b"}
    one = publish.unit_path(root, variant="original", model="synthetic", layer="layer_01")
    kept = os.stat(publish.unit_path(root, variant="original", model="synthetic", layer="layer 2/b") + "/status.json").st_mtime_ns
    with open(os.path.join(one, "status.json"), "w") as f:
        f.write("{}")
    assert jobs.fit(rows, plan, "original", root, {}) == "repaired"
    assert os.stat(publish.unit_path(root, variant="original", model="synthetic", layer="layer 2/b") + "/status.json").st_mtime_ns == kept
    bad = rows.withColumn("y", F.when((F.col("layer") == "layer_01") & (F.col("frame") == 3), F.array(F.lit(1.0))).otherwise(F.col("y")))
    with pytest.raises(RuntimeError, match="layer_01"):
        jobs.fit(bad, plan, "zero_lag", root, {})
    assert {r.layer for r in jobs.scores_of(spark, root, "zero_lag").select("layer").distinct().collect()} == {"layer 2/b"}
    # refits and null draws under the penalties that the grouped folds chose
    published = scope.alphas_of_scores(jobs.scores_of(spark, root, "original", "sensitivity")).where("layer = 'layer_01'")
    alphas = scope.legacy_alphas(published, "layer_01", 2)
    assert jobs.fast_refit(rows, plan, {"layer_01": alphas}, root, {}) == ["computed"]
    again = {(r.recording_id, r.family): r.full_r2 for r in jobs.scores_of(spark, root, "primary_fast_refits", "sensitivity").collect()}
    first = {(r.recording_id, r.family): r.full_r2 for r in jobs.scores_of(spark, root, "original", "sensitivity").where("layer = 'layer_01'").collect()}
    assert again == pytest.approx(first)
    assert jobs.fit_nulls(rows.where("layer = 'layer_01'"), encode.Plan(families, inner_folds=2, rate=5.0), root, {}, [0], alphas=alphas) == "computed"


def test_pilot_and_scope_commands(spark, tmp_path):
    rows, families = jobs.synthetic_recordings(spark, 4, 2.0)
    plan = encode.Plan(families, components=2, inner_folds=2, sensitivity_folds=2)
    root = str(tmp_path / "fits")
    for v in ("original", "capacity", "zero_lag"):
        jobs.fit(rows, encode.Plan(families, components=2, inner_folds=2, sensitivity_folds=2 if v == "original" else None), v, root, {})
    (tmp_path / "layers.csv").write_text("model,layer,layer_idx\nsynthetic,layer_01,1\n")
    (tmp_path / "ids.csv").write_text("recording_id\nr0\nr1\nr2\nr3\n")
    args = ["--fits", root, "--layers", str(tmp_path / "layers.csv"), "--manifest", str(tmp_path / "ids.csv")]
    assert cli.main(["pilot", *args, "--out", str(tmp_path / "p1"), "--nulls", "1"]) == 2
    found = {tuple(r) for r in spark.read.csv(str(tmp_path / "p1" / "pilot_findings"), header=True).collect()}
    assert found == {("rich", "layer_01", None, "missing"), ("original", "layer_01", "0", "missing")}
    jobs.fit(rows, encode.Plan(families, components=2, inner_folds=2), "rich", root, {})
    assert cli.main(["pilot", *args, "--out", str(tmp_path / "p2"), "--nulls", "0"]) == 0
    assert cli.main(["scope-summary", "--fits", root, "--out", str(tmp_path / "s"), "--recordings", "4"]) == 0
    assert sorted(os.listdir(tmp_path / "s")) == ["hubert_base_loro_sensitivity", "primary_equal_and_duration_weighted", "primary_pca_coverage_by_fold", "primary_recording_level_results"]
    every = "".join(f"{m},layer_{i:02d},{i}\n" if i else f"{m},layer_00_input,0\n" for m in scope.ALL for i in range(13))
    (tmp_path / "all.csv").write_text("model,layer,layer_idx\n" + every)
    assert cli.main(["scope", "--layers", str(tmp_path / "all.csv"), "--out", str(tmp_path / "tasks")]) == 0
    assert cli.main(["check-scope", "--layers", str(tmp_path / "all.csv"), "--tasks", str(tmp_path / "tasks")]) == 0
    (tmp_path / "fewer.csv").write_text("model,layer,layer_idx\n" + "\n".join(every.split("\n")[:-2]) + "\n")
    assert cli.main(["check-scope", "--layers", str(tmp_path / "fewer.csv"), "--tasks", str(tmp_path / "tasks")]) == 2
    assert plan.components == 2


def test_a_delivery_from_units_by_one_command(spark, tmp_path):
    """All tables from published units; afterwards only what a changed variant feeds is made again."""
    import shutil

    from kymo.plans import deliver

    rows, families = jobs.synthetic_recordings(spark, 4, 2.0)
    rows = rows.persist()
    root, out = str(tmp_path / "fits"), str(tmp_path / "out")
    plan = encode.Plan(families, components=2, inner_folds=2, sensitivity_folds=2, alphas=(1.0, 10.0))
    loro = encode.Plan(families, components=2, inner_folds=2, alphas=(1.0, 10.0))
    jobs.fit(rows, plan, "original", root, {})
    for v in handoff.CONTROLS:
        jobs.fit(rows, loro, v, root, {})
    jobs.fit_nulls(rows, encode.Plan(families, inner_folds=2, rate=5.0, alphas=(1.0, 10.0)), root, {}, [0, 1], zero_seconds=2.0)
    (tmp_path / "layers.csv").write_text("model,layer,layer_idx\nsynthetic,layer_01,1\n")
    (tmp_path / "features.json").write_text('{"bands": [1, 2]}')
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "a.log").write_text("fine\nan error here\n")
    args = ["deliver", "--fits", root, "--layers", str(tmp_path / "layers.csv"), "--feature-settings", str(tmp_path / "features.json"), "--out", out, "--logs", str(tmp_path / "logs"), "--recordings", "4", "--reference", "synthetic", "--primary", "original", "--null-variant", "null"]
    assert cli.main([*args, "--nulls", "2"]) == 0
    table = lambda name: deliver.delivered(spark, out, name)
    assert table("primary_inference").count() == 5 and table("structured_null_inference").count() == 3 and table("warnings_errors").first().line == 2
    assert {(r.variant, r.state) for r in deliver.unit_states(spark, root).select("variant", "state").distinct().collect()} == {(v, "complete") for v in (None, "original", *handoff.CONTROLS)}
    layers = spark.createDataFrame([("synthetic", "layer_01")], "model string, layer string")
    again = lambda draws: deliver.deliver(spark, root, out, layers, {"bands": [1, 2]}, 4, draws, "synthetic", ("original", "sensitivity"), nulls="null", logs=str(tmp_path / "logs"), seed=17, resamples=10_000)
    assert set(again(2).values()) == {"resumed"} and len(again(2)) == 37
    # one lost table, and one variant fitted anew
    shutil.rmtree(tmp_path / "out" / "table=primary_inference")
    assert [n for n, state in again(2).items() if state != "resumed"] == ["primary_inference"]
    shutil.rmtree(tmp_path / "fits" / "variant=zero_lag")
    jobs.fit(rows, loro, "zero_lag", root, {})
    done = again(2)
    assert {n for n, state in done.items() if state == "resumed"} == {n for n in handoff.TABLES if deliver.made_from(n, "original", "original", "null") is not None and not n.startswith("zero_lag")}
    # a draw more than there is
    assert again(3)["missing_incomplete_units"] == "repaired" and [(r.component, r.null_index, r.reason) for r in table("missing_incomplete_units").collect()] == [("null", 2, "missing")]
