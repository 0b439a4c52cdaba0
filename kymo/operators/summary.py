"""Aggregations of fold results, effects, diagnostics and reports."""

from __future__ import annotations

import hashlib
import zlib

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.functions.scalars import is_finite, nan_to_null
from kymo.functions.streams import TASKS_A_CORE

#: Sorted rows of a manifest that are handed to its digest together.
ROWS_A_PACKAGE = 10_000


def layer_summary(results: DataFrame) -> DataFrame:
    """Mean full R2, mean and sample deviation of the contribution, and folds, by layer and family; NaN is skipped."""
    clean = results.withColumns({c: nan_to_null(c) for c in ("full_r2", "conditional_delta_r2")})
    return clean.groupBy("layer", "feature_family").agg(
        F.avg("full_r2").alias("mean_full_r2"), F.avg("conditional_delta_r2").alias("mean_delta_r2"), F.stddev_samp("conditional_delta_r2").alias("sd_delta_r2"), F.count_distinct("outer_fold").alias("outer_folds")
    )


def spread(value: str, name: str) -> list[Column]:
    """Mean, sample deviation, standard error and count of the values that are there."""
    return [F.avg(value).alias(f"mean_{name}"), F.stddev_samp(value).alias(f"sd_{name}"), (F.stddev_samp(value) / F.sqrt(F.count(value))).alias(f"sem_{name}"), F.count(value).alias(f"n_{name}")]


def relative_depth(layers: DataFrame) -> DataFrame:
    """Each layer's place, 0 to 1, among its model's; layer_idx is the place and never a row order."""
    last = F.max("layer_idx").over(Window.partitionBy("model"))
    return layers.withColumn("relative_depth", F.col("layer_idx") / F.greatest(last, F.lit(1)))


def peak_rows(rows: DataFrame, key: list[str], value: str, order: str) -> DataFrame:
    """The row with a key's largest value; the first in order wins ties."""
    rest = [c for c in rows.columns if c not in key]
    ranked = F.struct(F.col(value), -F.col(order))
    return rows.where(F.col(value).isNotNull()).groupBy(*key).agg(F.max_by(F.struct(*rest), ranked).alias("_r")).select(*key, "_r.*")


def model_summary(results: DataFrame, reference_model: str) -> dict[str, DataFrame]:
    """The four comparison tables of fold results (model, layer, layer_idx, outer_fold, feature_family, full_r2, conditional_delta_r2).

    layers: spread of R2 over folds by model and layer, with relative depth. models: over a model's layers, the best layer, and
    differences from the reference model. families: mean contribution, its peak layer and difference from the reference model.
    folds: paired differences between a model's and the reference's best layers. wide: a row for each model with a
    column for each family.
    """
    clean = results.withColumns({c: nan_to_null(c) for c in ("full_r2", "conditional_delta_r2")})
    per_fold = clean.groupBy("model", "layer", "layer_idx", "outer_fold").agg(F.max("full_r2").alias("full_r2"))
    layers = relative_depth(per_fold.groupBy("model", "layer", "layer_idx").agg(*spread("full_r2", "full_r2")))
    best = peak_rows(layers.select("model", "layer", "layer_idx", "mean_full_r2"), ["model"], "mean_full_r2", "layer_idx").select("model", F.col("layer").alias("best_layer"), F.col("mean_full_r2").alias("best_full_r2"))
    over = layers.groupBy("model").agg(F.avg("mean_full_r2").alias("mean_full_r2"), F.max("mean_full_r2").alias("max_full_r2"), F.stddev_samp("mean_full_r2").alias("sd_full_r2"), F.count_distinct("layer").alias("layers"))
    models = over.join(best, "model")
    ref = models.where(F.col("model") == reference_model).select(F.col("mean_full_r2").alias("_m"), F.col("best_full_r2").alias("_b"))
    models = models.crossJoin(F.broadcast(ref)).select(*models.columns, (F.col("mean_full_r2") - F.col("_m")).alias("mean_difference"), (F.col("best_full_r2") - F.col("_b")).alias("best_difference"))  # one row
    cells = clean.groupBy("model", "feature_family", "layer", "layer_idx").agg(F.avg("conditional_delta_r2").alias("delta"))
    peak = peak_rows(cells, ["model", "feature_family"], "delta", "layer_idx").select("model", "feature_family", F.col("layer").alias("peak_layer"), F.col("delta").alias("peak_delta_r2"))
    families = cells.groupBy("model", "feature_family").agg(F.avg("delta").alias("mean_delta_r2")).join(peak, ["model", "feature_family"], "left")
    ref = families.where(F.col("model") == reference_model).select("feature_family", F.col("mean_delta_r2").alias("_m"))
    families = families.join(F.broadcast(ref), "feature_family", "left").select("model", "feature_family", "mean_delta_r2", "peak_layer", "peak_delta_r2", (F.col("mean_delta_r2") - F.col("_m")).alias("difference"))  # a row for each family
    of_best = per_fold.join(best.select("model", F.col("best_layer").alias("layer")), ["model", "layer"]).select("model", "outer_fold", "full_r2")
    ref = of_best.where(F.col("model") == reference_model).select("outer_fold", F.col("full_r2").alias("reference_full_r2"))
    folds = of_best.where(F.col("model") != reference_model).join(ref, "outer_fold").withColumn("difference", F.col("full_r2") - F.col("reference_full_r2"))
    names = [r.feature_family for r in families.select("feature_family").distinct().orderBy("feature_family").collect()]  # five families
    wide = models.join(families.groupBy("model").pivot("feature_family", names).agg(F.first("mean_delta_r2")), "model", "left")
    return {"layers": layers, "models": models, "families": families, "folds": folds, "wide": wide}


def aggregate_effects(rows: DataFrame) -> DataFrame:
    """Mean effect over layers by (model, recording, family); effect is observed - mean_null where it isn't given.

    A value that isn't finite or a duration that varies within a cell fails the query.
    """
    if "effect" not in rows.columns:
        rows = rows.withColumn("effect", F.col("observed") - F.col("mean_null"))
    cells = rows.groupBy("model", "recording_id", "family").agg(
        F.avg("effect").alias("effect"), F.count("*").alias("layers"), F.min("duration_seconds").alias("duration_seconds"), F.max("duration_seconds").alias("_longest"), F.bool_and(is_finite("effect") & is_finite("duration_seconds")).alias("_finite")
    )
    checked = cells.withColumn("_ok", F.coalesce(F.assert_true(F.col("_finite"), F.lit("effects and durations must be finite")), F.assert_true(F.col("_longest") == F.col("duration_seconds"), F.lit("a recording's duration must not vary"))))
    return checked.where("_ok is null").select("model", "recording_id", "family", "effect", "duration_seconds", "layers")


def null_mean(nulls: DataFrame, keys: tuple[str, ...] = ("model", "layer", "recording_id", "family")) -> DataFrame:
    """Mean contribution over the null draws of each cell, and how many there are."""
    return nulls.groupBy(*keys).agg(F.avg("delta_r2").alias("mean_null"), F.count_distinct("null_index").alias("nulls"))


def null_contrast(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """Observed minus mean null by cell, then its mean over layers."""
    keys = ["model", "layer", "recording_id", "family"]
    cells = observed.join(null_mean(nulls), keys).withColumn("effect", F.col("delta_r2") - F.col("mean_null"))
    return cells.groupBy("model", "recording_id", "family").agg(F.avg("effect").alias("effect"), F.count("*").alias("layers"))


def null_completeness(units: DataFrame, expected: int) -> DataFrame:
    """(model, layer, nulls, complete): whether every draw 0..expected - 1 is there."""
    seen = units.groupBy("model", "layer").agg(F.count_distinct("null_index").alias("nulls"), F.min("null_index").alias("_low"), F.max("null_index").alias("_high"))
    return seen.select("model", "layer", "nulls", ((F.col("nulls") == expected) & (F.col("_low") == 0) & (F.col("_high") == expected - 1)).alias("complete"))


def weighted_mean(value: str, weight: str) -> Column:
    return F.sum(F.col(value) * F.col(weight)) / F.sum(weight)


def full_r2_diagnostic(scores: DataFrame) -> DataFrame:
    """Spread of the full model's R2 over recordings, each counted once, by variant, model and layer."""
    once = scores.dropDuplicates(["variant", "model", "layer", "recording_id"])
    return once.groupBy("variant", "model", "layer").agg(F.avg("full_r2").alias("mean"), F.stddev_samp("full_r2").alias("sd"), F.min("full_r2").alias("least"), F.max("full_r2").alias("most"), F.count_distinct("recording_id").alias("recordings"))


def coverage_summary(reports: DataFrame) -> DataFrame:
    """Components and coverage of target projections over folds, by model and layer."""
    return reports.groupBy("model", "layer").agg(F.min("components").alias("least_components"), F.max("components").alias("most_components"), F.avg("coverage").alias("mean_coverage"), F.stddev_samp("coverage").alias("sd_coverage"), F.min("coverage").alias("least_coverage"), F.max("coverage").alias("most_coverage"), F.count_distinct("outer_fold").alias("folds"))


def equal_and_weighted(scores: DataFrame, recordings: int) -> DataFrame:
    """Equal and duration-weighted means by (model, layer, family); each cell needs so many recordings."""
    cells = scores.groupBy("model", "layer", "family").agg(F.count_distinct("recording_id").alias("recordings"), F.avg("delta_r2").alias("equal_mean"), weighted_mean("delta_r2", "duration_seconds").alias("weighted_mean"))
    return cells.withColumn("_ok", F.assert_true(F.col("recordings") == recordings, F.lit("a cell lacks recordings"))).where("_ok is null").drop("_ok")


def storage_bytes(recordings: DataFrame, rate: float, layers: int, width: int, item_bytes: int) -> DataFrame:
    """Bytes that canonical states of all recordings take."""
    return recordings.agg(F.floor(F.sum("duration_seconds") * rate * layers * width * item_bytes).cast("long").alias("bytes"))


def manifest_sha256(manifest: DataFrame, columns: list[str]) -> DataFrame:
    """SHA-256 of the sorted rows' text, a row a line.

    A digest of this kind has one reader. Rows are sorted in ranges, many tasks at once, and packed there; the reader gets a row for each
    package, in order, and holds the packages of one batch. A null is an empty text; an empty table has the digest of nothing.
    """
    row = F.concat_ws(",", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    def pack(batches):
        at, part = 0, TaskContext.get().partitionId()
        for batch in batches:
            texts = batch.column(0).to_pylist()
            for s in range(0, len(texts), ROWS_A_PACKAGE):
                packed = zlib.compress("".join(t + "\n" for t in texts[s : s + ROWS_A_PACKAGE]).encode(), 1)
                yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([at], pa.int64()), pa.array([packed], pa.binary())], ["part", "at", "packed"])
                at += 1

    def digest(batches):
        done, end = hashlib.sha256(), b""
        for batch in batches:
            for packed in batch.column(0):
                text = zlib.decompress(packed.as_py())
                done.update(end + text[:-1])
                end = b"\n"
        yield pa.RecordBatch.from_arrays([pa.array([done.hexdigest()])], ["sha256"])

    tasks = TASKS_A_CORE * max(manifest.sparkSession.sparkContext.defaultParallelism, 2)
    packages = manifest.select(row.alias("row")).repartitionByRange(tasks, "row").sortWithinPartitions("row").mapInArrow(pack, "part int, at long, packed binary")
    done = packages.repartition(1).sortWithinPartitions("part", "at").select("packed").mapInArrow(digest, "sha256 string")
    return done.agg(F.coalesce(F.max("sha256"), F.lit(hashlib.sha256().hexdigest())).alias("sha256"))  # a table without rows may have no partition


def family_order(effects: DataFrame) -> DataFrame:
    """Each model's families by falling effect, joined by >."""
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("effect")).alias("e"), F.col("family").alias("f"))))
    return effects.groupBy("model").agg(F.array_join(F.transform(ordered, lambda x: x["f"]), ">").alias("family_order"))


def depth_layers(layers: DataFrame) -> DataFrame:
    """Input, middle and final layer of each model (model, layer, layer_idx); the middle is nearest to half the depth, the lower on ties."""
    is_input = F.lower("layer").contains("input")
    inputs = layers.where(is_input).groupBy("model").agg(F.count("*").alias("_n"), F.min("layer").alias("input"))
    inputs = inputs.withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit("exactly one input layer is needed"))).where("_ok is null").select("model", "input")
    w = Window.partitionBy("model").orderBy("layer_idx")
    encoder = layers.where(~is_input).withColumn("_i", F.row_number().over(w)).withColumn("_depth", F.count("*").over(Window.partitionBy("model")))
    picked = encoder.groupBy("model").agg(F.min_by("layer", F.struct(F.abs(2 * F.col("_i") - F.col("_depth")), F.col("_i"))).alias("middle"), F.max_by("layer", "_i").alias("final"))
    return inputs.join(picked, "model")


def in_preferred_order(rows: DataFrame, preferred: list[str]) -> DataFrame:
    """Rows of preferred models first, in that order, the others by name."""
    rank = F.coalesce(F.array_position(F.array(*[F.lit(m) for m in preferred]), F.col("model")), F.lit(0))
    return rows.orderBy(F.when(rank == 0, F.lit(len(preferred) + 1)).otherwise(rank), "model")


def resources(units: DataFrame) -> DataFrame:
    """Runtime and peak memory by model and variant, of units that recorded them."""
    return units.groupBy("model", "variant").agg(F.count("*").alias("units"), F.sum("fit_runtime_seconds").alias("runtime_seconds"), F.max("fit_runtime_seconds").alias("longest_seconds"), F.max("peak_rss_kib").alias("peak_rss_kib"))
