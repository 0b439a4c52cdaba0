"""The tables of a delivery, by name, from the scores and reports of a finished computation.

Everything here is a composition: effects by recording, inference over recordings within a model's layer, paired
differences to the original variant, coverage summaries, and what is missing. Only whole cells are tested; the others are listed.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import flattened
from kymo.operators import infer, relate, summary
from kymo.schema import SUBSTANTIVE

# Names of the delivered tables, and the variants that are compared with the original one.
CONTROLS = ("rich", "capacity", "zero_lag")
TABLES = (
    "primary_recording_level", "primary_inference", "hubert_base_loro_recording_level", "hubert_base_loro_inference", "hubert_base_split_comparison_recording", "hubert_base_split_comparison_inference",
    "hubert_base_split_conclusion_changes", *(f"{v}_{t}" for v in CONTROLS for t in ("recording_level", "inference", "vs_original_recording", "vs_original_inference")), "rich_acoustic_feature_inventory",
    "capacity_predictor_coverage", "control_family_ordering", "zero_lag_conclusion_stability", "pca_coverage_by_fold", "pca_coverage_summary", "structured_null_unit_status", "structured_null_shift_offsets",
    "structured_null_recording_results", "structured_null_observed_minus_null", "structured_null_inference", "slurm_job_completion", "slurm_log_inventory", "runtime_peak_memory", "warnings_errors", "prediction_inventory",
    "missing_incomplete_units", "incomplete_inference_cells",
)
CELL = ["model", "layer", "family"]
UNIT = ["component", "variant", "model", "layer", "null_index"]


def effects(scores: DataFrame) -> DataFrame:
    return scores.select("model", "layer", "recording_id", "family", F.col("delta_r2").alias("effect"), "duration_seconds")


def inferred(cells: DataFrame, recordings: int, **options: Any) -> DataFrame:
    """Inference by (model, layer, family), p adjusted within a layer; cells that lack recordings are left out."""
    return infer.infer(cells, CELL, CELL[:2], recordings, **options).where("complete").drop("complete").withColumn("survives_fdr", F.col("q_value") < infer.LEVEL)


def incomplete(cells: DataFrame, table: str, recordings: int) -> DataFrame:
    """(table, model, layer, family, recordings, expected) of the cells that inferred() leaves out."""
    found = cells.groupBy(*CELL).agg(F.count_distinct("recording_id").alias("recordings")).where(F.col("recordings") != recordings)
    return found.select(F.lit(table).alias("table"), *CELL, "recordings", F.lit(recordings).cast("long").alias("expected"))


def paired(a: DataFrame, b: DataFrame) -> DataFrame:
    """Recording by recording the difference a - b of cells that both have."""
    keys = [*CELL, "recording_id"]
    both = a.select(*keys, F.col("effect").alias("a"), "duration_seconds").join(b.select(*keys, F.col("effect").alias("b")), keys)
    return both.withColumn("effect", F.col("a") - F.col("b"))


def conclusion_changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whether the sign or the adjusted significance of a cell differs between two inferences."""
    return infer.conclusion_flags(a, b, CELL).withColumn("conclusion_changed", ~F.col("stable"))


def null_effects(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """Observed minus the mean over a cell's draws, recording by recording, as effects()."""
    keys = [*CELL, "recording_id"]
    means = nulls.groupBy(*keys).agg(F.avg("delta_r2").alias("mean_null"), F.count_distinct("null_index").alias("draws"))
    one = observed.where(F.col("family").isin(*SUBSTANTIVE)).select(*keys, "delta_r2", "duration_seconds")
    return one.join(means, keys).withColumn("effect", F.col("delta_r2") - F.col("mean_null"))


def missing_units(expected: DataFrame, units: DataFrame) -> DataFrame:
    """Expected units that are absent or not complete, with the reason; null keys are equal to each other."""
    on = [F.col(f"e.{k}").eqNullSafe(F.col(f"u.{k}")) for k in UNIT]
    both = expected.alias("e").join(units.alias("u"), on, "left")
    reason = F.when(F.col("u.state").isNull(), "missing").when(F.col("u.state") != "complete", F.col("u.state"))
    return both.select(*[F.col(f"e.{k}") for k in UNIT], reason.alias("reason")).where("reason is not null")


def delivery(
    spark: SparkSession, primary: DataFrame, loro: DataFrame, controls: DataFrame, nulls: DataFrame, shifts: DataFrame, reports: DataFrame, expected: DataFrame, units: DataFrame, logs: DataFrame, predictions: DataFrame, feature_config: dict,
    recordings: int, draws: int, reference: str = "hubert_base", **options: Any,
) -> dict[str, DataFrame]:
    """All TABLES.

    primary, loro, controls (variant, depth), nulls (null_index): score rows; shifts: their offsets; reports: projections by split (variant, model, layer);
    expected and units: UNIT columns, the latter with state, runtime_seconds, peak_kib and path; logs: findings (path, line, severity, text); predictions: (path, length, sha256).
    """
    whole = effects(primary)
    out: dict[str, DataFrame] = {"primary_recording_level": primary, "primary_inference": inferred(whole, recordings, **options)}
    gaps = [incomplete(whole, "primary_inference", recordings)]

    def contrast(name: str, recording_table: str, inference_table: str, a: DataFrame, b: DataFrame) -> None:
        out[recording_table] = paired(a, b).withColumn("comparison", F.lit(name))
        out[inference_table] = inferred(out[recording_table], recordings, **options)
        gaps.append(incomplete(out[recording_table], inference_table, recordings))

    held_out, grouped = effects(loro), whole.where(F.col("model") == reference)
    out["hubert_base_loro_recording_level"] = loro
    out["hubert_base_loro_inference"] = inferred(held_out, recordings, **options)
    gaps.append(incomplete(held_out, "hubert_base_loro_inference", recordings))
    contrast("loro_minus_grouped", "hubert_base_split_comparison_recording", "hubert_base_split_comparison_inference", held_out, grouped)
    out["hubert_base_split_conclusion_changes"] = conclusion_changes(out["hubert_base_loro_inference"], out["primary_inference"].where(F.col("model") == reference))
    for v in CONTROLS:
        rows = controls.where(F.col("variant") == v)
        cells = effects(rows)
        out[f"{v}_recording_level"], out[f"{v}_inference"] = rows, inferred(cells, recordings, **options)
        gaps.append(incomplete(cells, f"{v}_inference", recordings))
        contrast(f"{v}_minus_original", f"{v}_vs_original_recording", f"{v}_vs_original_inference", cells, whole)
    out["rich_acoustic_feature_inventory"] = spark.createDataFrame(list(flattened(feature_config)), "path string, value string")
    out["capacity_predictor_coverage"] = reports.where("variant = 'capacity' and capacity_rank is not null").select("model", "layer", "split_kind", "outer_fold", "capacity_rank", F.explode("capacity_coverage").alias("family", "coverage"))
    every = [out[f"{v}_inference"].withColumn("variant", F.lit(v)) for v in CONTROLS]
    ordered = out["primary_inference"].withColumn("variant", F.lit("original"))
    for e in every:
        ordered = ordered.unionByName(e)
    ordered = ordered.select(F.concat_ws("/", "variant", "model", "layer").alias("model"), "family", "effect")
    out["control_family_ordering"] = summary.family_order(ordered).select(*[F.split_part("model", F.lit("/"), F.lit(i + 1)).alias(k) for i, k in enumerate(("variant", "model", "layer"))], "family_order")
    out["zero_lag_conclusion_stability"] = conclusion_changes(out["zero_lag_inference"], out["primary_inference"])
    out["pca_coverage_by_fold"] = reports.select("variant", "model", "layer", "split_kind", "outer_fold", "components", "coverage")
    out["pca_coverage_summary"] = summary.coverage_summary(reports)
    out["structured_null_unit_status"] = expected.where("component = 'null'").join(units.where("component = 'null'").drop("component", "variant"), ["model", "layer", "null_index"], "left").withColumn("state", F.coalesce("state", F.lit("missing")))
    out["structured_null_shift_offsets"] = shifts
    out["structured_null_recording_results"] = nulls
    minus = null_effects(primary.unionByName(controls.where("variant = 'original'").select(*primary.columns)) if "variant" in controls.columns else primary, nulls)
    out["structured_null_observed_minus_null"] = minus
    out["structured_null_inference"] = inferred(minus.where(F.col("draws") == draws), recordings, **options)
    gaps.append(incomplete(minus.where(F.col("draws") == draws), "structured_null_inference", recordings))
    out["slurm_job_completion"] = units.groupBy("component", "variant", "model", "state").agg(F.count("*").alias("units"))
    out["slurm_log_inventory"] = logs.groupBy("path").agg(F.count("*").alias("findings"), F.sum((F.col("severity") == "error").cast("long")).alias("errors"))
    out["runtime_peak_memory"] = units.where("state = 'complete'").groupBy("component", "variant", "model").agg(F.count("*").alias("units"), F.sum("runtime_seconds").alias("runtime_seconds"), F.max("peak_kib").alias("peak_kib"))
    out["warnings_errors"] = logs
    out["prediction_inventory"] = predictions
    out["missing_incomplete_units"] = missing_units(expected, units)
    all_gaps = gaps[0]
    for g in gaps[1:]:
        all_gaps = all_gaps.unionByName(g)
    out["incomplete_inference_cells"] = all_gaps
    return {name: out[name] for name in TABLES}


def comparable(spark: SparkSession, reference: dict, candidates: dict[str, dict]) -> tuple[list[str], DataFrame]:
    """Candidates whose contract equals the reference's in every field, and the fields in which the others differ."""
    from kymo.plans.contract import contract_table

    wanted = contract_table(spark, reference).withColumnRenamed("value", "reference")
    given = None
    for name, c in candidates.items():
        rows = contract_table(spark, c).withColumn("model", F.lit(name))
        given = rows if given is None else given.unionByName(rows)
    if given is None:
        return [], spark.createDataFrame([], "model string, field string")
    differing = given.join(wanted, "field").where(~F.col("value").eqNullSafe(F.col("reference"))).select("model", "field")
    refused = {r.model for r in differing.select("model").distinct().collect()}  # as many as candidates
    return [c for c in candidates if c not in refused], differing


def summarise_models(spark: SparkSession, results: dict[str, DataFrame], contracts: dict[str, dict], reference: str) -> dict[str, DataFrame]:
    """The comparison tables of all models that are comparable with the reference; the others are listed, never summarised."""
    kept, refused = comparable(spark, contracts[reference], {k: v for k, v in contracts.items() if k != reference})
    rows = None
    for name in (reference, *kept):
        one = results[name].withColumn("model", F.lit(name))
        rows = one if rows is None else rows.unionByName(one, allowMissingColumns=True)
    return {**summary.model_summary(rows, reference), "not_comparable": refused}


def frozen_reference_problems(results: DataFrame, expected_columns: tuple[str, ...], ids: DataFrame, expected_ids: DataFrame) -> DataFrame:
    """(problem, name): columns out of place and recordings missing or unexpected in a run that is to be frozen as the reference."""
    spark = results.sparkSession
    columns = [("columns_differ", ",".join(results.columns))] if tuple(results.columns) != tuple(expected_columns) else []
    return spark.createDataFrame(columns, "problem string, name string").unionByName(relate.exact_set(expected_ids, ids, "recording_id").select(F.concat("problem", F.lit("_recording")).alias("problem"), F.col("recording_id").cast("string").alias("name")))
