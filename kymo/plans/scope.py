"""Task tables of a deadline-bound computation: which (model, variant, layer, shift) units a job array runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kymo.operators.relate import same_rows
from kymo.operators.summary import depth_layers
from kymo.schema import FAMILIES

# Models of the primary fits, of depth controls and of structured nulls; shifts of each null model.
PRIMARY = ("hubert_large_refactor_rerun", "wav2vec2_base", "wav2vec2_large", "wavlm_base_plus", "wavlm_large", "data2vec_audio_base", "xls_r_300m", "whisper_medium_encoder")
CONTROLS = ("hubert_base", "wav2vec2_large", "wavlm_large", "data2vec_audio_base", "xls_r_300m", "whisper_medium_encoder")
NULLS = ("hubert_base", "wav2vec2_large", "wavlm_large", "whisper_medium_encoder")
ALL = ("hubert_base", *PRIMARY)
SHIFTS = 20


def _models(spark: SparkSession, names: tuple[str, ...]) -> DataFrame:
    return spark.createDataFrame([(i, n) for i, n in enumerate(names)], "place int, model string")


def _numbered(rows: DataFrame, *order: str) -> DataFrame:
    """task_id from 0; task tables have some hundred rows."""
    return rows.withColumn("task_id", (F.row_number().over(Window.orderBy(*order)) - 1).cast("int"))


def primary_tasks(layers: DataFrame, models: tuple[str, ...] = PRIMARY) -> DataFrame:
    """(task_id, model, layers, layer_count) of layers (model, layer, layer_idx)."""
    ordered = layers.groupBy("model").agg(F.array_sort(F.collect_list(F.struct("layer_idx", "layer"))).alias("l"))
    rows = _models(layers.sparkSession, models).join(ordered, "model")
    rows = rows.select("place", "model", F.array_join(F.transform("l", lambda x: x["layer"]), ",").alias("layers"), F.size("l").alias("layer_count"))
    return _numbered(rows, "place").select("task_id", "model", "layers", "layer_count")


def control_tasks(layers: DataFrame, controls: tuple[str, ...] = CONTROLS, every: tuple[str, ...] = ALL) -> DataFrame:
    """(task_id, model, variant, input, middle, final): rich and capacity controls, then zero lag for every model."""
    spark = layers.sparkSession
    variants = spark.createDataFrame([(0, "rich"), (1, "capacity")], "v int, variant string")
    rows = _models(spark, controls).crossJoin(variants).withColumn("g", F.lit(0)).unionByName(_models(spark, every).select("place", "model", F.lit(0).alias("v"), F.lit("zero_lag").alias("variant"), F.lit(1).alias("g")))
    return _numbered(rows.join(depth_layers(layers), "model"), "g", "place", "v").select("task_id", "model", "variant", "input", "middle", "final")


def null_tasks(layers: DataFrame, models: tuple[str, ...] = NULLS, shifts: int = SHIFTS) -> DataFrame:
    """(task_id, model, shift, layer): every shift of each model's middle layer."""
    rows = _models(layers.sparkSession, models).crossJoin(layers.sparkSession.range(shifts).select(F.col("id").cast("int").alias("shift"))).join(depth_layers(layers), "model")
    return _numbered(rows, "place", "shift").select("task_id", "model", "shift", F.col("middle").alias("layer"))


def tasks_unchanged(persisted: DataFrame, layers: DataFrame, kind: str) -> bool:
    """Whether a persisted table holds exactly the rows that would be made now."""
    made = {"primary": primary_tasks, "controls": control_tasks, "nulls": null_tasks}[kind](layers)
    return same_rows(persisted.select(*[F.col(c).cast("string") for c in made.columns]), made.select(*[F.col(c).cast("string") for c in made.columns]))


def fixed_alphas(results: DataFrame, fold: str = "outer_fold", family: str = "feature_family", alpha: str = "alpha") -> dict[int, dict[str, float]]:
    """fold -> family -> penalty of published fold results; a cell that is missing or has several penalties fails."""
    cells = results.groupBy(fold, family).agg(F.count_distinct(alpha).alias("n"), F.min(alpha).alias("a")).collect()  # folds x families
    out: dict[int, dict[str, float]] = {}
    for r in cells:
        if r.n != 1 or r.a is None:
            raise ValueError(f"fold {r[fold]}, {r[family]}: exactly one penalty is needed")
        out.setdefault(int(r[fold]), {})[r[family]] = float(r.a)
    if len({frozenset(v) for v in out.values()}) > 1:
        raise ValueError("every fold needs the same families")
    return out


def legacy_alphas(results: DataFrame, layer: str, folds: int = 5, families: tuple[str, ...] = FAMILIES) -> dict[int, dict[str, float]]:
    """The penalties of one layer's published fold results: exactly the folds from 0 and, in each, 'full' and every family, once."""
    rows = results.where(F.col("layer") == layer)
    wanted = results.sparkSession.createDataFrame([(f, k) for f in range(folds) for k in ("full", *families)], "outer_fold int, feature_family string")
    counted = rows.groupBy(F.col("outer_fold").cast("int").alias("outer_fold"), "feature_family").agg(F.count("*").alias("n"))
    wrong = wanted.withColumn("w", F.lit(True)).join(counted, ["outer_fold", "feature_family"], "full_outer").where("w is null or n is null or n <> 1").orderBy("outer_fold", "feature_family").limit(3).collect()
    if wrong:
        raise ValueError(f"{layer}: penalties are missing, repeated or unexpected, first at {[(r.outer_fold, r.feature_family) for r in wrong]}")
    return fixed_alphas(rows)


def grouped_alphas(reports: DataFrame, families: tuple[str, ...], kinds: tuple[str, ...] = ("sensitivity", "primary_fast_grouped"), folds: int = 5) -> dict[int, dict[str, float]]:
    """The penalties of completed grouped splits from reports (split_kind, outer_fold, full_alpha, reduced_alphas map); every fold is needed."""
    rows = reports.where(F.col("split_kind").isin(*kinds)).groupBy(F.col("outer_fold").cast("int").alias("fold")).agg(F.map_concat(F.create_map(F.lit("full"), F.max("full_alpha")), F.max_by("reduced_alphas", "full_alpha")).alias("alphas"))
    found = {r.fold: {k: float(r.alphas[k]) for k in ("full", *families)} for r in rows.collect() if set(families) <= set(r.alphas)}  # a row for each fold
    if set(found) != set(range(folds)):
        raise ValueError(f"the grouped splits {sorted(found)} are not the {folds} folds")
    return found


def alphas_of_scores(scores: DataFrame) -> DataFrame:
    """(layer, outer_fold, feature_family, alpha) of score rows, as published fold results hold them."""
    full = scores.select("layer", "outer_fold", F.lit("full").alias("feature_family"), F.col("full_alpha").alias("alpha"))
    reduced = scores.select("layer", "outer_fold", F.col("family").alias("feature_family"), F.col("reduced_alpha").alias("alpha"))
    return full.unionByName(reduced).distinct()


def alpha_source_problems(spark: SparkSession, source: dict, current: dict) -> list[str]:
    """Contract fields in which a source of penalties differs from the current inputs; it may be used only if there are none."""
    from kymo.plans.contract import compare

    return [r.field for r in compare(spark, source, current)[1].where("not matches").orderBy("field").collect()]  # as many as fields


def publish_tasks(tasks: DataFrame, path: str, replace: bool = False) -> str:
    """Writes a task table as TSV: 'unchanged' if the same rows are there; other rows are refused, or set aside with replace."""
    import os

    from kymo.sources import publish

    if os.path.exists(path):
        names = tasks.columns
        old = tasks.sparkSession.read.csv(path, sep="\t", header=True, inferSchema=False)
        if old.columns == names and same_rows(old, tasks.select(*[F.col(c).cast("string") for c in names])):
            return "unchanged"
        if not replace:
            raise ValueError(f"{path} holds other tasks")
        publish.preserve(path, "stale")
    publish.write_table(tasks.coalesce(1), path, sep="\t")
    return "written"
