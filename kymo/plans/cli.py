"""Command line of the jobs: python -m kymo.plans.cli COMMAND …; exit code 2 means that a check found errors."""

from __future__ import annotations

import argparse
import json
import os
import sys
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import json_sha256
from kymo.operators import adapters, encode, quality, summary
from kymo.operators.grid import resample_linear
from kymo.plans import contract, deliver, handoff, jobs, pins, scope
from kymo.sources import publish, tables


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kymo")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, *arguments: str, **options: Any) -> argparse.ArgumentParser:
        s = sub.add_parser(name)
        for a in arguments:
            s.add_argument(a, required=a.startswith("--"))
        for a, default in options.items():
            flag = f"--{a.replace('_', '-')}"
            if isinstance(default, bool):
                s.add_argument(flag, action="store_true")
            else:
                s.add_argument(flag, type=type(default) if default is not None else str, default=default)
        return s

    command("validate", "--audio", "--alignments", "--out", tolerance=0.03)
    command("extract-features", "--audio", "--alignments", "--out", sample_rate=16_000, rate=50.0, rich=False)
    command("quality", "--audio", "--alignments", "--out")
    command("fit", "--features", "--activations", "--settings", "--out", model=None, variant="original")
    command("null", "--features", "--activations", "--settings", "--out", model=None, count=100, dry_run=False, seed=17)
    command("summarise", "--fits", "--out", recordings=12, nulls=0, variants="original,rich,capacity,zero_lag", seed=17, resamples=10_000)
    command("audit", "--features", "--activations", "--durations", "--out")
    command("compare", "--reference", "--candidate")
    command("registry", "--registry")
    command("verify", "--delivery")
    command("smoke-test")
    command("run-model", "--features", "--activations", "--durations", "--feature-settings", "--settings", "--out", model=None, variant="original")
    command("fit-layer", "--features", "--activations", "--settings", "--layer", "--out", model=None, folds=5)
    command("freeze-reference", "--results", "--ids", "--contract", "--manifest", "--out")
    command("compare-models", "--root", "--reference", "--out")
    command("scope", "--layers", "--out", replace=False)
    command("check-scope", "--layers", "--tasks")
    command("scope-summary", "--fits", "--out", recordings=12, variant="original")
    command("pilot", "--fits", "--layers", "--manifest", "--out", nulls=20)
    command("check-settings", "--settings")
    command("deliver", "--fits", "--layers", "--feature-settings", "--out", logs=None, recordings=12, nulls=100, reference="hubert_base", primary="primary_fast_refits", null_variant="null_fixed_alpha", seed=17, resamples=10_000)
    command("model-quality", "--documents", "--models", "--extracted", "--manifest", "--activations", "--out")
    command("refit", "--features", "--activations", "--settings", "--results", "--source-contract", "--contract", "--out", model=None)
    return p


def plan_of(settings: dict, families: list[str]) -> encode.Plan:
    a = settings["analysis"]
    return encode.Plan(families, tuple(a["lags_seconds"]), float(settings["analysis_rate_hz"]), tuple(a["alphas"]), int(a["inner_folds"]), a.get("n_components") if a.get("target_mode") == "pca" else None, sensitivity_folds=a.get("outer_folds"))


def write_all(found: dict, out: str) -> None:
    for name, df in found.items():
        publish.write_table(df, os.path.join(out, name))


def loaded(spark: SparkSession, args: argparse.Namespace):
    """(recordings with model and layer, families, source hashes) of a feature and an activation store."""
    frames, names, families = tables.read_features(spark, args.features)
    activations = tables.read_activations(spark, args.activations, args.model)
    rows = frames.join(activations.select("model", "layer", "recording_id", "frame", "y"), ["recording_id", "frame"])
    return rows.select("model", "layer", "recording_id", "frame", "x", "y"), families, {"features": args.features, "activations": args.activations, "columns": json_sha256(names)}


def _json(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


def _layers(spark: SparkSession, path: str):
    return tables.read_csv(spark, path, "model string, layer string, layer_idx int", ["model", "layer", "layer_idx"])


def _ids(spark: SparkSession, path: str):
    return tables.read_csv(spark, path, "recording_id string", ["recording_id"]).select("recording_id")


def run_model(spark: SparkSession, args: argparse.Namespace) -> int:
    """Audit, fit and contract of one model; a finding of the audit ends it."""
    frames, names, families = tables.read_features(spark, args.features)
    durations = tables.read_csv(spark, args.durations, "recording_id string, duration_seconds double", ["recording_id", "duration_seconds"])
    activations = tables.read_activations(spark, args.activations, grid=None)
    found = jobs.audit(frames, names, activations if args.model is None else activations.where(F.col("model") == args.model), durations.select("recording_id").distinct(), durations)
    if any(not found[k].where("reason <> 'ok'").isEmpty() for k in ("features", "activations")) or any(not found[k].isEmpty() for k in ("times", "durations")):
        write_all(found, os.path.join(args.out, "audit"))
        return 2
    settings, feature_settings = tables.load_settings(args.settings), tables.load_settings(args.feature_settings)
    rows, families, sources = loaded(spark, args)
    print(jobs.fit(rows, plan_of(settings, families), args.variant, args.out, sources))
    made = contract.build_contract(frames, names, families, feature_settings, settings, None, publish.file_sha256(args.feature_settings), publish.file_sha256(args.settings))
    publish.write_json(os.path.join(args.out, "comparability_contract.json"), made)
    return 0


def fit_layer(spark: SparkSession, args: argparse.Namespace) -> int:
    """One layer's native activations, interpolated at the features' own times, fitted over pooled recordings."""
    frames, _, families = tables.read_features(spark, args.features)
    native = tables.read_activations(spark, args.activations, args.model, "native").where(F.col("layer") == args.layer).select("model", "layer", "recording_id", "t", "y")
    times = native.select("model", "layer", "recording_id").distinct().join(frames.select("recording_id", "frame", "t"), "recording_id")
    rows = resample_linear(native, times, "y", ("model", "layer", "recording_id")).join(frames.select("recording_id", "frame", "x"), ["recording_id", "frame"])
    plan = plan_of(tables.load_settings(args.settings), families)
    done = encode.pooled_results(encode.recording_moments(rows.select("model", "layer", "recording_id", "frame", "x", "y"), plan, jobs.UNIT), plan, jobs.UNIT, args.folds)
    publish.write_table(done, os.path.join(args.out, "results"))
    return 0


def freeze_reference(spark: SparkSession, args: argparse.Namespace) -> int:
    """Locks a finished run as the reference: its columns, recordings, contract and the digests of its files."""
    results = spark.read.csv(args.results, header=True)
    problems = handoff.frozen_reference_problems(results, tuple(_json(args.contract)["result_schema"]), _ids(spark, args.ids), _ids(spark, args.manifest)).collect()
    for r in problems:
        print(r.problem, r.name)
    if problems:
        return 2
    digests = {r.path: r.sha256 for r in publish.tree_hashes(spark, os.path.abspath(args.results)).collect()}  # as many as files
    publish.write_json(os.path.join(args.out, "locked_reference.json"), {"locked_reference": True, "contract": _json(args.contract), "results_sha256": digests, "provenance": publish.provenance()})
    return 0


def compare_models(spark: SparkSession, args: argparse.Namespace) -> int:
    """Comparison tables of every finished model under a root (NAME/comparability_contract.json and NAME/results)."""
    names = sorted(n for n in os.listdir(args.root) if os.path.isfile(os.path.join(args.root, n, "comparability_contract.json")) and os.path.isdir(os.path.join(args.root, n, "results")))
    if args.reference not in names:
        print(f"{args.reference} is not among the finished models {names}")
        return 2
    kind = "layer string, layer_idx int, outer_fold int, feature_family string, full_r2 double, conditional_delta_r2 double"
    results = {n: tables.read_csv(spark, os.path.join(args.root, n, "results"), kind, [c.split()[0] for c in kind.split(", ")]) for n in names}
    write_all(handoff.summarise_models(spark, results, {n: _json(os.path.join(args.root, n, "comparability_contract.json")) for n in names}, args.reference), args.out)
    return 0


def _task_tables(layers) -> dict:
    return {"primary_fast_refits": scope.primary_tasks(layers), "selected_depth_controls": scope.control_tasks(layers), "structured_nulls": scope.null_tasks(layers)}


def resolve_scope(spark: SparkSession, args: argparse.Namespace) -> int:
    for name, rows in _task_tables(_layers(spark, args.layers)).items():
        print(name, scope.publish_tasks(rows, os.path.join(args.out, name), args.replace))
    return 0


def check_scope(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether the task tables on disk are those that the layers give now."""
    layers, bad = _layers(spark, args.layers), []
    for name, kind in (("primary_fast_refits", "primary"), ("selected_depth_controls", "controls"), ("structured_nulls", "nulls")):
        at = os.path.join(args.tasks, name)
        if not os.path.exists(at) or not scope.tasks_unchanged(spark.read.csv(at, sep="\t", header=True), layers, kind):
            bad.append(name)
    print("\n".join(f"{n}: not the tasks of these layers" for n in bad) or "ok")
    return 2 if bad else 0


def scope_summary(spark: SparkSession, args: argparse.Namespace) -> int:
    """Recording-level results, equal and duration-weighted means, held-out sensitivity and coverage by fold of a variant."""
    primary, reports = jobs.scores_of(spark, args.fits, args.variant), jobs.table_of(spark, args.fits, args.variant, "reports")
    flat = primary.drop("full_inner_cv_scores", "reduced_inner_cv_scores", "train_recording_ids", "test_recording_ids")
    write_all({
        "primary_recording_level_results": flat, "primary_equal_and_duration_weighted": summary.equal_and_weighted(primary, args.recordings),
        "hubert_base_loro_sensitivity": jobs.scores_of(spark, args.fits, args.variant, "sensitivity").groupBy("model", "layer", "family").agg(F.avg("delta_r2").alias("mean_delta_r2"), F.count_distinct("recording_id").alias("recordings")),
        "primary_pca_coverage_by_fold": reports.select("variant", "model", "layer", "split_kind", "outer_fold", "components", "coverage"),
    }, args.out)
    return 0


def pilot(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether a pilot's units are all there with exactly the expected recordings, families and splits."""
    layers, wanted = _layers(spark, args.layers), None
    reports = None
    for v in quality.PILOT_VARIANTS:
        if not os.path.isdir(publish.unit_path(args.fits, variant=v)):
            continue
        s = jobs.table_of(spark, args.fits, v, "scores").select("variant", "layer", F.lit(None).cast("int").alias("null_index"), "recording_id", "family", "split_kind")
        r = jobs.table_of(spark, args.fits, v, "reports").select("variant", "layer", "split_kind", "coverage")
        wanted, reports = s if wanted is None else wanted.unionByName(s), r if reports is None else reports.unionByName(r)
    if wanted is None:
        print("no unit is there")
        return 2
    if os.path.isdir(publish.unit_path(args.fits, variant="null")):
        drawn = jobs.table_of(spark, args.fits, "null", "scores")
        wanted = wanted.unionByName(drawn.select(F.lit("original").alias("variant"), "layer", "null_index", "recording_id", "family", "split_kind"))
    found = quality.pilot_findings(quality.pilot_units(layers, args.nulls), wanted, reports, _ids(spark, args.manifest))
    write_all({"pilot_findings": found, "recording_level_results": wanted, "pca_coverage_by_fold": reports}, args.out)
    return 0 if found.isEmpty() else 2


def check_settings(spark: SparkSession, args: argparse.Namespace) -> int:
    """Whether settings are the pinned ones of the revision."""
    found = list(pins.settings_problems(tables.load_settings(args.settings)))
    print("\n".join(f"{where}: {found!r} instead of {wanted!r}" for where, wanted, found in found) or "ok")
    return 2 if found else 0


def make_delivery(spark: SparkSession, args: argparse.Namespace) -> int:
    """All tables of a delivery from the units under fits; only those whose units or settings changed are made."""
    done = deliver.deliver(
        spark, args.fits, args.out, _layers(spark, args.layers), tables.load_settings(args.feature_settings), args.recordings, args.nulls, args.reference, (args.primary, "sensitivity"), nulls=args.null_variant, logs=args.logs, seed=args.seed, resamples=args.resamples
    )
    print("\n".join(f"{name} {state}" for name, state in done.items()))
    return 0 if deliver.delivered(spark, args.out, "missing_incomplete_units").isEmpty() else 2


def model_quality(spark: SparkSession, args: argparse.Namespace) -> int:
    """Provenance and temporal context of models from their saved metadata (documents: JSON lines of model and document)."""
    documents = spark.read.schema("model string, document string").json(args.documents)
    models = tables.read_csv(spark, args.models, "model string, expected_key string, registered_id string", ["model", "expected_key"])
    layers = tables.read_activations(spark, args.activations, grid="native").groupBy("model", "recording_id").agg(F.array_sort(F.collect_set("layer")).alias("layers"))
    extracted = tables.read_csv(spark, args.extracted, "model string, recording_id string", ["model", "recording_id"])
    found = quality.model_quality(documents, models, extracted, _ids(spark, args.manifest), layers)
    write_all(found, args.out)
    return 2 if quality.overall_status(*found.values()) == "FAIL" else 0


def refit(spark: SparkSession, args: argparse.Namespace) -> int:
    """Grouped refits under published penalties, allowed only if their contract equals the current one."""
    problems = scope.alpha_source_problems(spark, _json(args.source_contract), _json(args.contract))
    if problems:
        print("the penalties' source differs in", ", ".join(problems))
        return 2
    results = tables.read_csv(spark, args.results, "layer string, outer_fold int, feature_family string, alpha double", ["layer", "outer_fold", "feature_family", "alpha"])
    rows, families, sources = loaded(spark, args)
    layers = [r.layer for r in rows.select("layer").distinct().collect()]  # some tens
    print(jobs.fast_refit(rows, plan_of(tables.load_settings(args.settings), families), {x: scope.legacy_alphas(results, x) for x in layers}, args.out, {**sources, "results": publish.file_sha256(args.results)}))
    return 0


MORE = {
    "run-model": run_model, "fit-layer": fit_layer, "freeze-reference": freeze_reference, "compare-models": compare_models, "scope": resolve_scope, "check-scope": check_scope, "scope-summary": scope_summary,
    "pilot": pilot, "deliver": make_delivery, "check-settings": check_settings, "model-quality": model_quality, "refit": refit,
}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.command == "registry":
        problems = adapters.registry_problems(tables.load_settings(args.registry))
        print("\n".join(problems) or "ok")
        return 2 if problems else 0
    spark = SparkSession.builder.appName(f"kymo {args.command}").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    if args.command == "validate":
        valid, found = jobs.validate_inputs(spark, args.audio, args.alignments, overhang_tolerance=args.tolerance)
        write_all(found, args.out)
        return 0 if valid else 2
    if args.command == "extract-features":
        if not jobs.validate_inputs(spark, args.audio, args.alignments)[0]:
            return 2
        print(jobs.extract_features(spark, args.audio, args.alignments, args.out, args.sample_rate, args.rate, args.rich))
    elif args.command == "quality":
        write_all(jobs.quality_report(spark, args.audio, args.alignments), args.out)
    elif args.command in ("fit", "null"):
        rows, families, sources = loaded(spark, args)
        plan = plan_of(tables.load_settings(args.settings), families)
        if args.command == "fit":
            print(jobs.fit(rows, plan, args.variant, args.out, sources))
        else:
            from kymo.operators.lags import check_null_count

            print(jobs.fit_nulls(rows, plan, args.out, sources, list(range(check_null_count(args.count, args.dry_run))), args.seed))
    elif args.command == "summarise":
        found = jobs.summarise(spark, args.fits, args.recordings, tuple(args.variants.split(",")), args.nulls or None, seed=args.seed, resamples=args.resamples)
        print(jobs.hand_off(spark, found, args.out, vars(args)))
    elif args.command == "audit":
        frames, names, _ = tables.read_features(spark, args.features)
        durations = tables.read_csv(spark, args.durations, "recording_id string, duration_seconds double", ["recording_id", "duration_seconds"])
        found = jobs.audit(frames, names, tables.read_activations(spark, args.activations, grid=None), durations.select("recording_id").distinct(), durations)
        write_all(found, args.out)
        bad = not found["features"].where("reason <> 'ok'").isEmpty() or not found["activations"].where("reason <> 'ok'").isEmpty() or not found["times"].isEmpty() or not found["durations"].isEmpty()
        return 1 if bad else 0
    elif args.command == "compare":
        same, diff = contract.compare(spark, *(json.load(open(p, encoding="utf-8")) for p in (args.reference, args.candidate)))
        diff.where("not matches").show(truncate=False)
        return 0 if same else 2
    elif args.command == "verify":
        problems = publish.verify_delivery(spark, os.path.abspath(args.delivery))
        problems.show(truncate=False)
        return 0 if problems.isEmpty() else 2
    elif args.command in MORE:
        return MORE[args.command](spark, args)
    elif args.command == "smoke-test":
        rows, families = jobs.synthetic_recordings(spark)
        plan = encode.Plan(families, (-0.04, 0.0, 0.04), components=4, inner_folds=2)
        score = encode.fit_scores(encode.recording_moments(rows, plan, jobs.UNIT), plan, jobs.UNIT).agg({"full_r2": "avg"}).first()[0]
        print(json.dumps({"mean_held_out_r2": score}))
        return 0 if score >= 0.5 else 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
