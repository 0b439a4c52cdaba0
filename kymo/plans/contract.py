"""Comparability contracts: what two runs must share before their results are compared."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import canonical_json, json_sha256
from kymo.operators.encode import group_folds
from kymo.operators.relate import ACTIVATION, SUMMARY, TIME, all_close, contract_diff, regression

# The texts of a contract, by the path of the entry that holds each. Published contracts have them word for word.
WORDING = {
    "feature_preprocessing.regression_scaling": "StandardScaler fitted on each training fold only",
    "target_preprocessing.pca_scope": "fit on each training fold only",
    "cross_validation.splitter": "GroupKFold",
    "grouping_policy": "GroupKFold; recording_id/story_id frames remain together",
    "metrics.full": "held_out_variance_weighted_r2",
    "metrics.conditional_unique_contribution": "full_r2_minus_reduced_r2",
    "metrics.proportion_guard": "reported_only_when_full_r2_exceeds_configured_epsilon",
    "statistical_procedures.permutation": None,
    "statistical_procedures.bootstrap": None,
    "statistical_procedures.reliability": "outer_fold_distribution",
    "reduced_model_specifications.comparison": "full_minus_reduced",
    "result_schema": "layer outer_fold feature_family alpha full_r2 reduced_r2 conditional_delta_r2 conditional_proportion",
}
#: Entries that repeat a setting of the analysis, and the setting's own path.
SETTINGS = {
    "canonical_rate_hz": "analysis_rate_hz",
    "target_preprocessing.mode": "analysis.target_mode",
    "target_preprocessing.n_components": "analysis.n_components",
    "lag_grid_seconds": "analysis.lags_seconds",
    "cross_validation.outer_folds": "analysis.outer_folds",
    "cross_validation.inner_folds": "analysis.inner_folds",
    "cross_validation.alphas": "analysis.alphas",
}


@dataclass
class Run:
    """What a contract is made of. hashes has a row (recording_id, frames, grid_sha256, matrix_sha256) for each recording."""

    hashes: list
    names: list[str]
    families: list[str]
    features: dict
    analysis: dict
    test_groups: dict[int, list[str]] | None = None
    features_sha256: str | None = None
    analysis_sha256: str | None = None

    def held_out(self) -> list[list[str]] | dict[int, list[str]]:
        """The recordings of each outer fold: as given, or those of grouped folds over the frames."""
        if self.test_groups is not None:
            return self.test_groups
        fold = group_folds({r.recording_id: r.frames for r in self.hashes}, int(self.analysis["analysis"]["outer_folds"]))
        return [sorted(i for i, f in fold.items() if f == k) for k in range(max(fold.values()) + 1)]


#: Entries that are computed.
COMPUTED: dict[str, Callable[[Run], Any]] = {
    "stimulus_ids": lambda r: sorted(x.recording_id for x in r.hashes),
    "canonical_grid_sha256": lambda r: {x.recording_id: x.grid_sha256 for x in r.hashes},
    "feature_matrix_sha256": lambda r: {x.recording_id: x.matrix_sha256 for x in r.hashes},
    "feature_columns": lambda r: list(r.names),
    "feature_families": lambda r: list(r.families),
    "feature_config_sha256": lambda r: r.features_sha256 or json_sha256(r.features),
    "analysis_config_sha256": lambda r: r.analysis_sha256 or json_sha256(r.analysis),
    "feature_preprocessing.definition": lambda r: r.features,
    "outer_test_groups": Run.held_out,
    "reduced_model_specifications": lambda r: [{"omitted_family": f, "comparison": WORDING["reduced_model_specifications.comparison"]} for f in sorted(set(r.families))],
    "result_schema": lambda r: WORDING["result_schema"].split(),
}
#: The fields of a contract: the first parts of the paths of its entries.
FIELDS = tuple(dict.fromkeys(path.partition(".")[0] for path in (*COMPUTED, *SETTINGS, *WORDING)))


def frame_hashes(frames: DataFrame) -> DataFrame:
    """(recording_id, frames, grid_sha256, matrix_sha256) of frames (recording_id, frame, t, x): digests of a recording's times as 64-bit and of its rows of values as 32-bit
    little-endian floats. A recording's frames pass by in order; none is held."""

    def run(batches):
        held = None  # recording, frames, both digests

        def row(done):
            return pa.RecordBatch.from_arrays([pa.array([done[0]]), pa.array([done[1]], pa.int64()), pa.array([done[2].hexdigest()]), pa.array([done[3].hexdigest()])], ["recording_id", "frames", "grid_sha256", "matrix_sha256"])

        for batch in batches:
            ids = batch.column("recording_id").to_pylist()
            for at, (i, t) in enumerate(zip(ids, batch.column("t").to_pylist(), strict=True)):
                if held is None or held[0] != i:
                    if held is not None:
                        yield row(held)
                    held = [i, 0, hashlib.sha256(), hashlib.sha256()]
                held[1] += 1
                held[2].update(np.float64(t).astype("<f8").tobytes())
                held[3].update(np.asarray(batch.column("x")[at].as_py(), dtype="<f4").tobytes())
        if held is not None:
            yield row(held)

    ordered = frames.select(F.col("recording_id").cast("string").alias("recording_id"), "frame", "t", "x").repartition("recording_id").sortWithinPartitions("recording_id", "frame")
    return ordered.select("recording_id", "t", "x").mapInArrow(run, "recording_id string, frames long, grid_sha256 string, matrix_sha256 string")


def _put(tree: dict[str, Any], path: str, value: Any) -> None:
    *above, last = path.split(".")
    for part in above:
        tree = tree.setdefault(part, {})
    tree[last] = value


def _setting(tree: Any, path: str) -> Any:
    for part in path.split("."):
        tree = tree[part]
    return tree


def build_contract(frames: DataFrame, names: list[str], families: list[str], feature_config: dict, analysis: dict, test_groups: dict[int, list[str]] | None = None, feature_sha256: str | None = None, analysis_sha256: str | None = None) -> dict[str, Any]:
    """The contract of a run on features (recording_id, frame, t, x). The digests are those of the settings' files, where given."""
    run = Run(frame_hashes(frames).orderBy("recording_id").collect(), names, families, feature_config, analysis, test_groups, feature_sha256, analysis_sha256)  # a row for each recording
    out: dict[str, Any] = {}
    for path, text in WORDING.items():
        if path not in COMPUTED and path.partition(".")[0] not in COMPUTED:
            _put(out, path, text)
    for path, setting in SETTINGS.items():
        _put(out, path, _setting(analysis, setting))
    for path, value in COMPUTED.items():
        _put(out, path, value(run))
    return out


def contract_table(spark: SparkSession, contract: dict[str, Any]) -> DataFrame:
    return spark.createDataFrame([(f, canonical_json(contract[f]) if f in contract else None) for f in FIELDS], "field string, value string")


def compare(spark: SparkSession, reference: dict, candidate: dict) -> tuple[bool, DataFrame]:
    """Whether two contracts agree in every field, and the comparison."""
    diff = contract_diff(contract_table(spark, reference), contract_table(spark, candidate))
    return diff.where("not matches").isEmpty(), diff


def compare_runs(reference: dict[str, DataFrame], candidate: dict[str, DataFrame]) -> DataFrame:
    """(part, cells, close) of activations (model, layer, recording_id, frame, t, y), their times, and fold results."""
    keys = ["layer", "recording_id", "frame"]
    a, b = (r["activations"].select(*keys, "t", "y") for r in (reference, candidate))
    both = a.join(b.withColumnsRenamed({"t": "t2", "y": "y2"}), keys, "full_outer")
    same = F.coalesce(F.size("y") == F.size("y2"), F.lit(False)) & F.coalesce(F.forall(F.arrays_zip("y2", "y"), lambda p: all_close(p["y2"].cast("double"), p["y"].cast("double"), ACTIVATION)), F.lit(False))
    parts = both.select(same.alias("a"), F.coalesce(F.abs(F.col("t") - F.col("t2")) <= TIME, F.lit(False)).alias("t")).agg(F.count("*").alias("n"), F.coalesce(F.bool_and("a"), F.lit(True)).alias("a"), F.coalesce(F.bool_and("t"), F.lit(True)).alias("t"))
    rows = parts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("part"), F.col("n").alias("cells"), F.col(c).alias("close")) for n, c in (("activations", "a"), ("times", "t"))])))
    folds = regression(reference["results"], candidate["results"], ["layer", "outer_fold", "feature_family"], ["full_r2", "reduced_r2", "conditional_delta_r2", "conditional_proportion"], SUMMARY)
    return rows.unionByName(folds.agg(F.lit("results").alias("part"), F.count("*").alias("cells"), F.coalesce(F.bool_and("close"), F.lit(True)).alias("close")))
