"""Jobs: whole computations from stores to published tables, resumable by unit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import flattened, json_sha256
from kymo.operators import audio as audio_features
from kymo.operators import checks, encode, infer, lags, relate, summary
from kymo.operators.nulls import null_moments
from kymo.schema import FAMILIES, SUBSTANTIVE
from kymo.sources import audio, publish, tables, textgrid

VARIANTS = ("original", "rich", "capacity", "zero_lag")
UNIT = ["model", "layer"]


def validate_inputs(spark: SparkSession, audio_root: str, alignment_root: str, ids: list[str] | None = None, overhang_tolerance: float = 0.03) -> tuple[bool, dict[str, DataFrame]]:
    """Whether a corpus is fit for extraction, with its manifest, audio headers and findings."""
    manifest = tables.build_manifest(spark, audio_root, alignment_root, ids)
    headers = audio.inspect_audio(spark, audio_root)
    readable = headers.where("error is null")
    intervals = textgrid.read_textgrids(spark, alignment_root)
    findings = checks.validate_manifest(manifest, readable, checks.validate_intervals(intervals, readable, overhang_tolerance))
    return checks.manifest_report(findings).first().valid, {"manifest": manifest, "audio": headers, "findings": findings}


def extract_features(spark: SparkSession, audio_root: str, alignment_root: str, out: str, sample_rate: int = 16_000, rate: float = 50.0, rich: bool = False) -> str:
    """Features of all recordings as one store; skipped if a store of the same inputs and settings is there."""
    inputs = {r.path: r.sha256 for root in (audio_root, alignment_root) for r in publish.tree_hashes(spark, root).collect()}
    config = {"sample_rate": sample_rate, "rate": rate, "rich": rich}
    identity = {"kind": "features", "rich": rich}

    def make():
        waves, intervals = audio.load_standardised(spark, audio_root, sample_rate), textgrid.read_textgrids(spark, alignment_root)
        frames, names, families = audio_features.extract_features(waves, intervals, rate, rich=rich)
        schema = spark.createDataFrame([(i, n, f) for i, (n, f) in enumerate(zip(names, families, strict=True))], "feature_idx int, name string, family string").coalesce(1)
        return {"frames": frames, "schema": schema}, {}

    return publish.run_unit(out, identity, inputs, config, make)


def variant_plan(plan: encode.Plan, variant: str) -> encode.Plan:
    """The plan of a variant; rich differs in its features only."""
    if variant not in VARIANTS:
        raise ValueError(f"the variant is one of {VARIANTS}")
    return replace(plan, capacity=variant == "capacity", lags=(0.0,) if variant == "zero_lag" else plan.lags)


def _published(root: str, name: str, unit: list[str], found: list[tuple], sources: dict[str, str], config: dict[str, Any], compute: Callable[[list[tuple]], None]) -> str:
    """Computes those of the found units that are not there and valid: together, and one by one if that fails; a failure is then raised."""
    identity = lambda u: {"variant": name, **dict(zip(unit, u, strict=True))}

    def state(u: tuple) -> str:
        return publish.unit_problem(publish.unit_path(root, **identity(u)), identity(u), sources, config)

    states = {u: state(u) for u in found}
    open_units = [u for u, s in states.items() if s != "ok"]
    for u in open_units:
        if states[u] != "missing":
            publish.preserve(publish.unit_path(root, **identity(u)), states[u])
    failures: dict[tuple, Exception] = {}
    if open_units:
        try:
            compute(open_units)
        except Exception as all_failed:
            if len(open_units) == 1:
                raise
            for u in open_units:
                if state(u) == "ok":  # published before the failure
                    continue
                try:
                    compute([u])
                except Exception as e:
                    failures[u] = e
            if failures:
                raise RuntimeError(f"units that can't be fitted: {sorted(failures)}") from all_failed
    return "resumed" if not open_units else "computed" if all(states[u] == "missing" for u in open_units) else "repaired"


def _units_of(recordings: DataFrame) -> list[tuple[str, str]]:
    return [(r.model, r.layer) for r in recordings.select(*UNIT).distinct().orderBy(*UNIT).collect()]  # models x layers


def _chosen(recordings: DataFrame, units: list[tuple[str, str]]) -> DataFrame:
    return recordings.join(F.broadcast(recordings.sparkSession.createDataFrame(sorted(set(units)), "model string, layer string")), UNIT)  # models x layers


def fit(recordings: DataFrame, plan: encode.Plan, variant: str, root: str, sources: dict[str, str], namespace: str | None = None) -> str:
    """Scores and reports of every (model, layer) of recordings (model, layer, recording_id, frame, x, y), each a published unit of its own.

    Units that are there and valid stay; the others are computed together, in one pass for the moments and a task for each
    split. If that fails they are tried one by one, so that a unit that can't be fitted holds up no other; the failure is then raised.
    """
    p = variant_plan(plan, variant)
    config = {k: v for k, v in vars(p).items() if k != "reports"}
    name = namespace or variant

    def compute(units: list[tuple]) -> None:
        moments = encode.recording_moments(_chosen(recordings, units), p, UNIT).persist()
        try:
            tables = {"moments": moments, "scores": encode.fit_scores(moments, p, UNIT), "reports": encode.fit_reports(moments, p, UNIT)}
            publish.publish_units(root, {"variant": name}, UNIT, units, tables, sources, config)
        finally:
            moments.unpersist()

    return _published(root, name, UNIT, _units_of(recordings), sources, config, compute)


def fast_refit(recordings: DataFrame, plan: encode.Plan, alphas: dict[str, dict[int, dict[str, float]]], root: str, sources: dict[str, str]) -> list[str]:
    """Grouped refits with given penalties, layer by layer (layer -> fold -> family -> penalty): no inner search. Units under primary_fast_refits."""
    out = []
    for layer, fixed in sorted(alphas.items()):  # some tens of layers
        p = replace(plan, kinds=("sensitivity",), sensitivity_folds=len(fixed), fixed_alphas=fixed)
        out.append(fit(recordings.where(F.col("layer") == layer), p, "original", root, {**sources, "alphas": json_sha256(fixed)}, "primary_fast_refits"))
    return out


def fit_nulls(
    recordings: DataFrame, plan: encode.Plan, root: str, sources: dict[str, str], indices: list[int], seed: int = 0, zero_seconds: float = lags.LEAST_SHIFT_SECONDS, tag: str = lags.SEED_TAG,
    alphas: dict[int, dict[str, float]] | None = None, draws_at_once: int = lags.PRODUCTION_NULLS,
) -> str:
    """Scores of every null draw for the three shifted families, each (model, layer, null_index) a published unit of its own.

    Each recording is held out once, without grouped folds; or, with given penalties (fold -> family -> penalty), grouped folds are refitted under them.
    The moments of so many draws are made in one pass over the frames; a run that was broken off goes on with the units that are missing.
    """
    p = replace(plan, sensitivity_folds=None, omitted=SUBSTANTIVE, kinds=("primary",)) if alphas is None else replace(plan, sensitivity_folds=len(alphas), omitted=SUBSTANTIVE, kinds=("sensitivity",), fixed_alphas=alphas)
    name = "null" if alphas is None else "null_fixed_alpha"
    config = {k: v for k, v in vars(p).items() if k != "reports"} | {"seed": seed, "tag": tag, "zero_seconds": zero_seconds}
    unit = [*UNIT, "null_index"]
    sizes = recordings.groupBy("recording_id").agg(F.count_distinct("frame").alias("frames")).persist()

    def compute(units: list[tuple]) -> None:
        drawn = sorted({int(u[2]) for u in units})
        for begin in range(0, len(drawn), draws_at_once):
            part = [u for u in units if int(u[2]) in drawn[begin : begin + draws_at_once]]
            manifest = lags.shift_manifest(sizes, drawn[begin : begin + draws_at_once], seed=seed, rate=p.rate, lags=tuple(p.lags), zero_seconds=zero_seconds, tag=tag).persist()
            wanted = F.broadcast(recordings.sparkSession.createDataFrame(part, "model string, layer string, null_index string"))  # models x layers x draws
            moments = null_moments(_chosen(recordings, [u[:2] for u in part]), manifest, p, UNIT).join(wanted, unit).persist()
            try:
                tables = {"shifts": manifest.withColumn("null_index", F.col("null_index").cast("string")).join(wanted, "null_index"), "scores": encode.fit_scores(moments, p, unit)}
                publish.publish_units(root, {"variant": name}, unit, part, tables, sources, config)
            finally:
                moments.unpersist()
                manifest.unpersist()

    try:
        return _published(root, name, unit, [(*u, str(n)) for u in _units_of(recordings) for n in indices], sources, config, compute)
    finally:
        sizes.unpersist()


def table_of(spark: SparkSession, root: str, variant: str, table: str) -> DataFrame:
    """One table of all of a variant's units."""
    units = "/model=*/layer=*" + "/null_index=*" * variant.startswith("null")
    rows = spark.read.option("basePath", root).parquet(f"{publish.unit_path(root, variant=variant)}{units}/{table}")
    return rows.select(*[F.col(c).cast("string").alias(c) if c in ("variant", *UNIT) else F.col(c).cast("int").alias(c) if c == "null_index" else F.col(c) for c in rows.columns])


def scores_of(spark: SparkSession, root: str, variant: str, split_kind: str = "primary") -> DataFrame:
    return table_of(spark, root, variant, "scores").where(F.col("split_kind") == split_kind)


def effects_of(scores: DataFrame) -> DataFrame:
    return scores.select("model", "layer", "recording_id", "family", F.col("delta_r2").alias("effect"), "duration_seconds")


def missing_units(spark: SparkSession, root: str, expected: DataFrame, variants: tuple[str, ...]) -> DataFrame:
    """Expected (model, layer, variant) without scores."""
    found = None
    for v in variants:
        rows = scores_of(spark, root, v).select("model", "layer", "variant").distinct()
        found = rows if found is None else found.unionByName(rows)
    return relate.missing_of(expected.crossJoin(spark.createDataFrame([(v,) for v in variants], "variant string")), found, ["model", "layer", "variant"])


def summarise(spark: SparkSession, root: str, recordings: int, variants: tuple[str, ...] = VARIANTS, nulls: int | None = None, **options: Any) -> dict[str, DataFrame]:
    """The published tables of fitted variants, by name."""
    out: dict[str, DataFrame] = {}
    scores = {v: scores_of(spark, root, v) for v in variants}
    for v, s in scores.items():
        out[f"primary_{v}"] = infer.analyse(effects_of(s), recordings, **options)
    every = None
    for s in scores.values():
        every = s if every is None else every.unionByName(s)
    out["full_model_r2_by_recording"] = every.select("variant", "model", "layer", "recording_id", "full_r2").distinct()
    out["full_model_r2_diagnostic"] = summary.full_r2_diagnostic(every)
    out["primary_equal_and_duration_weighted"] = summary.equal_and_weighted(scores[variants[0]], recordings)
    grouped = scores_of(spark, root, variants[0], "sensitivity")
    if not grouped.isEmpty():
        sensitivity = infer.analyse(effects_of(grouped), recordings, **options)
        wide = [s.groupBy("model", "family").agg(F.avg("delta_r2").alias(n)) for s, n in ((scores[variants[0]], "primary"), (grouped, "sensitivity"))]
        out["sensitivity_grouped_vs_loro"] = wide[0].join(wide[1], ["model", "family"])
        out["sensitivity_conclusions"] = infer.conclusion_flags(out[f"primary_{variants[0]}"], sensitivity, ["model", "family"])
    reports = None
    for v in variants:
        r = table_of(spark, root, v, "reports")
        reports = r if reports is None else reports.unionByName(r)
    out["pca_coverage_by_outer_fold"] = reports.select("variant", "model", "layer", "split_kind", "outer_fold", "components", "coverage")
    out["pca_coverage"] = summary.coverage_summary(reports)
    out["capacity_coverage_by_outer_fold"] = reports.where("capacity_rank is not null").select("model", "layer", "split_kind", "outer_fold", "capacity_rank", F.explode("capacity_coverage").alias("family", "coverage"))
    out["control_family_ordering"] = summary.family_order(out[f"primary_{variants[0]}"].select("model", "family", "effect"))
    for v in variants[1:]:
        out[f"{v}_vs_{variants[0]}"] = infer.paired_control(scores[v], scores[variants[0]], recordings, **options)
    if "zero_lag" in variants:
        a, b = (summary.aggregate_effects(effects_of(scores[v])) for v in (variants[0], "zero_lag"))
        out["zero_vs_longer_lag"] = infer.lag_contrast(a, b, recordings, **options)
    if nulls:
        drawn = table_of(spark, root, "null", "scores")
        observed = scores[variants[0]].where(F.col("family").isin(*SUBSTANTIVE))
        out["null_completeness"] = summary.null_completeness(drawn, nulls)
        out["null_observed_minus_mean"] = infer.summarise_nulls(observed, drawn, nulls, recordings, **options)
    return out


def quality_report(spark: SparkSession, audio_root: str, alignment_root: str, blank_tolerance: float = 0.03) -> dict[str, DataFrame]:
    """Annotation quality by recording and over all, and the phones' distribution."""
    intervals = textgrid.read_textgrids(spark, alignment_root)
    qc = checks.annotation_qc(intervals, audio.inspect_audio(spark, audio_root).where("error is null"), blank_tolerance)
    return {"recording_annotation_qc": qc, "annotation_totals": checks.annotation_totals(qc, intervals), "phone_categories": checks.category_counts(intervals)}


def audit(features: DataFrame, names: list[str], activations: DataFrame, expected: DataFrame, durations: DataFrame, tolerance: float = 1e-6) -> dict[str, DataFrame]:
    """Everything that would keep a fit from running, as tables; nothing is raised."""
    canonical = activations.where("grid = 'canonical'")
    layers = canonical.groupBy("model", "layer", "recording_id").agg(F.count("*").alias("n"), F.bool_and(F.forall("y", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))).alias("finite"))
    grid = expected.select("recording_id").crossJoin(canonical.select("model", "layer").distinct())
    times = checks.timestamp_mismatch(features, canonical.select("recording_id", "frame", "t").distinct(), ["recording_id"], tolerance)
    return {
        "features": checks.archive_audit(features, len(names), expected),
        "activations": grid.join(layers, ["model", "layer", "recording_id"], "left").select("model", "layer", "recording_id", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("n").isNull(), "missing").when(~F.col("finite"), "nonfinite").otherwise("ok").alias("reason")),
        "times": times.where("not matches"),
        "durations": checks.duration_problems(durations),
    }


def hand_off(spark: SparkSession, results: dict[str, DataFrame], destination: str, config: dict, missing: DataFrame | None = None) -> str:
    """Writes all tables with their settings, status and hashes; COMPLETE, or PARTIAL if units are missing. The delivery is verified."""
    import os

    for name, df in results.items():
        publish.write_table(df, f"{destination}/tables/{name}")
    publish.write_table(spark.createDataFrame(list(flattened(config)), "path string, value string"), f"{destination}/tables/configuration")
    if missing is not None:
        publish.write_table(missing, f"{destination}/tables/missing_units")
    state = "COMPLETE" if missing is None or missing.isEmpty() else "PARTIAL"
    publish.write_json(f"{destination}/status.json", {"state": state, "tables": sorted(results), "config_sha256": json_sha256(config), "provenance": publish.provenance()})
    publish.write_sums(spark, os.path.abspath(destination))
    problems = publish.verify_delivery(spark, os.path.abspath(destination)).collect()
    if problems:
        raise RuntimeError(f"the delivery is not sound: {problems[:3]}")
    return state


def synthetic_recordings(spark: SparkSession, recordings: int = 4, seconds: float = 8.0, rate: float = 50.0, targets: int = 6, seed: int = 11) -> tuple[DataFrame, list[str]]:
    """(model, layer, recording_id, frame, x, y) of a linear system with known lags, and the columns' families: a smoke test."""
    import numpy as np

    rng = np.random.default_rng(seed)
    families = [f for f in FAMILIES for _ in range(2)]
    n = int(seconds * rate)
    weights = rng.normal(size=(2 * len(families), targets))
    rows = []
    for r in range(recordings):
        x = rng.normal(size=(n, len(families)))
        z = encode.lag_rows(x, (0.0, 0.04), rate)
        y = z @ weights + 0.3 * rng.normal(size=(n, targets))
        rows += [("synthetic", "layer_01", f"r{r}", i, x[i].tolist(), y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "model string, layer string, recording_id string, frame int, x array<double>, y array<double>"), families
