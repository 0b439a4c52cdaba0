"""Quality of models' saved metadata, scope of a pilot's units, and states of published summaries: findings as tables, nothing is inferred or raised."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import json_entries
from kymo.functions.scalars import worst
from kymo.operators.checks import saved_fields
from kymo.schema import FAMILIES, SUBSTANTIVE

# What a lag means, and the keys under which saved metadata may hold each field, best first.
LAG_CONVENTION = "At activation time t, a positive lag tau uses predictor X(t - tau), so positive tau means the predictor precedes the activation; negative tau uses future predictor values relative to the activation."
FIELD_KEYS = {
    "model_key": ("model_key", "key"),
    "checkpoint_id": ("model_id", "checkpoint"),
    "requested_revision": ("requested_revision", "revision"),
    "resolved_revision": ("resolved_revision", "resolved_model_revision", "resolved_commit_hash"),
    "checkpoint_fingerprint": ("local_checkpoint_sha256", "checkpoint_fingerprint", "checkpoint_sha256", "fingerprint"),
    "processor_identity": ("processor_identity", "processor_name_or_path", "feature_extractor_identity", "tokenizer_identity"),
    "config_identity": ("config_identity", "model_config_sha256", "config_sha256"),
    "sample_rate_hz": ("input_sample_rate_hz", "sample_rate_hz", "processed_sample_rate"),
    "native_frame_rate_hz": ("native_frame_rate_hz", "native_rate_hz_from_runtime"),
    "canonical_frame_rate_hz": ("canonical_rate_hz", "canonical_frame_rate_hz"),
    "chunk_length_seconds": ("batch_seconds_effective", "batch_seconds_requested", "batch_seconds", "chunk_length_seconds"),
    "chunk_overlap_seconds": ("overlap_seconds_effective", "overlap_seconds_requested", "chunk_overlap_seconds", "overlap_seconds"),
    "retained_frame_rule": ("stitching", "retained_frame_rule", "edge_retention_rule"),
    "adapter": ("adapter",),
    "bidirectional_context": ("bidirectional", "is_bidirectional", "bidirectional_context"),
    "future_context": ("future_context", "uses_future_context", "future_context_seconds"),
    "receptive_field": ("receptive_field_seconds", "receptive_field_samples", "receptive_field"),
    "native_timing_rule": ("native_timing_rule",),
    "frame_stride_samples": ("frame_stride_samples",),
    "frame_center_offset_samples": ("frame_center_offset_samples",),
}
TEMPORAL = ("adapter", "bidirectional_context", "future_context", "receptive_field", "chunk_length_seconds", "chunk_overlap_seconds", "retained_frame_rule", "native_timing_rule", "native_frame_rate_hz", "frame_stride_samples", "frame_center_offset_samples")
#: Reasons for a model's status: a SQL condition over the columns of provenance (each field, and field_status), its severity and its code.
PROVENANCE_RULES = (
    ("model_key_status <> 'saved' or model_key <> concat('\"', expected_key, '\"')", "FAIL", "model_identity_mismatch"),
    ("registered_id is null", "WARN", "registered_hf_model_id_unresolved"),
    ("checkpoint_id_status <> 'saved'", "FAIL", "checkpoint_id_unresolved"),
    ("requested_revision_status <> 'saved' and resolved_revision_status <> 'saved' and checkpoint_fingerprint_status <> 'saved'", "FAIL", "revision_or_fingerprint_unresolved"),
    ("processor_identity_status <> 'saved'", "WARN", "processor_identity_unresolved"),
    ("config_identity_status <> 'saved'", "WARN", "config_identity_unresolved"),
    ("recording_problems > 0", "FAIL", "extraction_manifest_recordings_mismatch"),
    ("layer_lists > 1", "FAIL", "layer_definitions_mismatch"),
)
TEMPORAL_RULES = (
    ("bidirectional_context_status <> 'saved' or future_context_status <> 'saved'", "WARN", "unsupported_context_audit"),
    ("receptive_field_status <> 'saved'", "WARN", "receptive_field_unknown"),
    ("native_timing_rule_status <> 'saved' and native_frame_rate_hz_status <> 'saved' and frame_stride_samples_status <> 'saved' and frame_center_offset_samples_status <> 'saved'", "WARN", "native_resolution_unknown"),
)


def _judged(rows: DataFrame, rules: tuple[tuple[str, str, str], ...]) -> DataFrame:
    """rows with reasons (severity, code) of the rules that hold, and the worst severity as status."""
    each = [F.struct(F.expr(condition).alias("holds"), F.lit(severity).alias("severity"), F.lit(code).alias("code")) for condition, severity, code in rules]
    reasons = F.transform(F.filter(F.array(*each), lambda r: r["holds"]), lambda r: F.struct(r["severity"], r["code"]))
    status = lambda r: F.when(F.exists(r, lambda x: x["severity"] == "FAIL"), "FAIL").when(F.size(r) > 0, "WARN").otherwise("PASS")
    return rows.withColumn("reasons", reasons).withColumn("status", status(F.col("reasons")))


def model_fields(documents: DataFrame, models: DataFrame) -> DataFrame:
    """One row for each model: every field's saved value (JSON text) and its status, saved, missing or conflict. documents: (model, document) JSON objects."""
    entries = json_entries(documents, "model", "document")
    rows = saved_fields(entries, models.select(F.col("model").alias("id")).distinct(), FIELD_KEYS)
    wide = rows.groupBy("id").pivot("field", list(FIELD_KEYS)).agg(F.first("value_json").alias("value"), F.first("status").alias("status"))
    return wide.select(F.col("id").alias("model"), *[F.col(f"{f}_value").alias(f) for f in FIELD_KEYS], *[F.col(f"{f}_status") for f in FIELD_KEYS])


def model_quality(documents: DataFrame, models: DataFrame, extracted: DataFrame, recordings: DataFrame, layers: DataFrame) -> dict[str, DataFrame]:
    """provenance_qc and temporal_context, a row for each model with its status and reasons, from what was saved only.

    models: (model, expected_key, registered_id); extracted: (model, recording_id) of the extraction manifests; recordings:
    the expected recording_id; layers: (model, recording_id, layers array<string>) of the activation stores.
    """
    grid = models.select("model").crossJoin(recordings.select("recording_id"))  # models x recordings
    counted = extracted.groupBy("model", "recording_id").agg(F.count("*").alias("n"))
    wrong = grid.withColumn("wanted", F.lit(True)).join(counted, ["model", "recording_id"], "full_outer").where("wanted is null or n is null or n <> 1").groupBy("model").agg(F.count("*").alias("recording_problems"))
    named = layers.groupBy("model").agg(F.count_distinct("layers").alias("layer_lists"), F.min_by("layers", "recording_id").alias("layer_names"))
    rows = models.join(model_fields(documents, models), "model").join(wrong, "model", "left").join(named, "model", "left")
    rows = rows.fillna(0, ["recording_problems", "layer_lists"])
    provenance = _judged(rows, PROVENANCE_RULES).select("model", "expected_key", "registered_id", *[f for f in FIELD_KEYS if f not in TEMPORAL or f.startswith("chunk")], F.size("layer_names").alias("layer_count"), "layer_names", "status", "reasons")
    known = [F.coalesce(f, F.lit("unknown")).alias(f) for f in TEMPORAL]
    context = F.when((F.col("bidirectional_context_status") == "saved") & (F.col("future_context_status") == "saved"), "supported").otherwise("unsupported")
    temporal = _judged(rows, TEMPORAL_RULES).select("model", *known, context.alias("context_audit_support"), F.lit("saved_metadata_only_no_architecture_inference").alias("evidence_policy"), F.lit(LAG_CONVENTION).alias("lag_convention"), "status", "reasons")
    return {"provenance_qc": provenance, "temporal_context": temporal}


def overall_status(*tables: DataFrame) -> str:
    """The worst status of all rows; FAIL without any."""
    rows = reduce(DataFrame.unionByName, [t.select("status") for t in tables])
    return rows.agg(F.coalesce(worst("status"), F.lit("FAIL")).alias("s")).first().s


# --- a pilot's scope

PILOT_VARIANTS = {"original": ("primary", "sensitivity"), "rich": ("primary",), "capacity": ("primary",), "zero_lag": ("primary",)}
PILOT_UNIT = ["variant", "layer", "null_index"]


def pilot_units(layers: DataFrame, nulls: int) -> DataFrame:
    """(variant, layer, null_index, split_kinds, families) of every unit that a pilot needs, observed ones and null draws (null_index from 0)."""
    spark = layers.sparkSession
    kinds = spark.createDataFrame([(v, None, list(s), list(FAMILIES)) for v, s in PILOT_VARIANTS.items()] + [("original", n, ["primary"], list(SUBSTANTIVE)) for n in range(nulls)], "variant string, null_index int, split_kinds array<string>, families array<string>")
    return layers.select("layer").crossJoin(kinds)  # some hundred rows


def _same_set(observed: Column, expected: Column) -> Column:
    return F.coalesce(F.array_sort(observed) == F.array_sort(expected), F.lit(False))


def pilot_findings(units: DataFrame, scores: DataFrame, reports: DataFrame, recordings: DataFrame) -> DataFrame:
    """(variant, layer, null_index, reason) of units that are missing or whose rows are not exactly the expected recordings, families and splits.

    scores: (variant, layer, null_index, recording_id, family, split_kind); reports: (variant, layer, split_kind, coverage).
    """
    ids = recordings.agg(F.array_sort(F.collect_set(F.col("recording_id").cast("string"))).alias("ids"))  # one row of expected ids
    found = scores.groupBy(*[F.coalesce(F.col(k), F.lit(-1)).alias(k) if k == "null_index" else F.col(k) for k in PILOT_UNIT]).agg(F.collect_set(F.col("recording_id").cast("string")).alias("r"), F.collect_set("family").alias("f"), F.collect_set("split_kind").alias("s"))
    cover = reports.groupBy("variant", "layer").agg(F.sum((F.col("split_kind") == "primary").cast("int")).alias("splits"), F.bool_and(F.col("coverage").isNotNull()).alias("covered")).withColumn("null_index", F.lit(-1))
    every = units.fillna(-1, ["null_index"]).join(found, PILOT_UNIT, "left").join(cover, PILOT_UNIT, "left").crossJoin(ids)
    same = _same_set(F.col("r"), F.col("ids")) & _same_set(F.col("f"), F.col("families")) & _same_set(F.col("s"), F.col("split_kinds"))
    scope = F.when(F.col("null_index") < 0, "pilot_score_scope_mismatch").otherwise("null_score_scope_mismatch")
    whole = F.coalesce((F.col("splits") == F.size("ids")) & F.col("covered"), F.lit(False))
    reason = F.when(F.col("r").isNull(), "missing").when(~same, scope).when((F.col("null_index") < 0) & ~whole, "pca_coverage_scope_mismatch")
    return every.select("variant", "layer", F.when(F.col("null_index") >= 0, F.col("null_index")).alias("null_index"), reason.alias("reason")).where("reason is not null")


# --- published summaries


def summary_problems(spark: SparkSession, status: dict, files: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """(name, problem) of a summary's tables: the summary is not complete, or a table is unlisted, absent or has another digest.

    status: {"state", "artifacts": {key: {"path", "sha256"}}}; files: (path, sha256) as tree_hashes() gives them.
    """
    name = lambda path: F.element_at(F.split(path, "/"), -1)
    listed = spark.createDataFrame([(str(a.get("path", "")), str(a.get("sha256", ""))) for a in (status.get("artifacts") or {}).values()], "path string, listed string").select(name("path").alias("name"), "listed").dropDuplicates(["name"])
    found = files.select(name("path").alias("name"), "sha256").dropDuplicates(["name"])
    rows = spark.createDataFrame([(e,) for e in expected], "name string").join(listed, "name", "left").join(found, "name", "left")
    problem = F.when(F.col("listed").isNull(), "absent_from_status").when(F.col("sha256").isNull(), "missing_file").when(F.col("listed") != F.col("sha256"), "hash_differs")
    state = [] if status.get("state") == "complete" else [("", "not_complete")]
    return rows.select("name", problem.alias("problem")).where("problem is not null").unionByName(spark.createDataFrame(state, "name string, problem string"))
