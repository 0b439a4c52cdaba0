"""A delivery made from published units by one command, each of its tables a unit of its own.

The status files of all units are read as a table; their digests, by variant, are the sources of the delivered tables. A table is
made again only if a variant that it is made from, or a setting, has changed, and a run that was broken off goes on where it ended.
"""

from __future__ import annotations

import os
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kymo.functions.canonical import json_sha256
from kymo.plans import handoff, jobs
from kymo.sources import publish, tables

UNIT = "component string, variant string, model string, layer string, null_index int, state string, runtime_seconds double, peak_kib long, path string, digest string, source string"


def unit_states(spark: SparkSession, root: str) -> DataFrame:
    """Every unit under root by its status file: UNIT columns; source is the variant's name, null draws have no variant of their own."""
    files = spark.read.option("pathGlobFilter", publish.STATUS).option("recursiveFileLookup", "true").text(root, wholetext=True).select(F.input_file_name().alias("path"), "value")
    files = files.where(~F.col("path").rlike(r"\.(staging|corrupt)-"))  # set aside or not finished
    get = lambda key: F.get_json_object("value", f"$.{key}")
    is_null = F.col("source").startswith("null")
    rows = files.select("path", F.sha2("value", 256).alias("digest"), get("identity.variant").alias("source"), get("identity.model").alias("model"), get("identity.layer").alias("layer"), get("identity.null_index").cast("int").alias("null_index"), F.coalesce(get("state"), F.lit("unreadable_status")).alias("state"))
    return rows.select(
        F.when(is_null, "null").otherwise("fit").alias("component"), F.when(~is_null, F.col("source")).alias("variant"), "model", "layer", "null_index", "state", F.lit(None).cast("double").alias("runtime_seconds"), F.lit(None).cast("long").alias("peak_kib"), "path", "digest", "source"
    )


def expected_units(layers: DataFrame, variants: tuple[str, ...], draws: int) -> DataFrame:
    """The units that a finished computation of layers (model, layer) has."""
    fits = layers.select(F.lit("fit").alias("component"), F.explode(F.array(*map(F.lit, variants))).alias("variant"), "model", "layer", F.lit(None).cast("int").alias("null_index"))
    nulls = layers.select(F.lit("null").alias("component"), F.lit(None).cast("string").alias("variant"), "model", "layer", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))).alias("null_index"))
    return fits.unionByName(nulls) if draws else fits


def predictions_of(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, sha256) of the files of units' predictions, the only ones that are read."""
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select(F.regexp_extract("path", r"^(.*/predictions)/", 1).alias("folder"))
    folders = sorted(r.folder for r in listed.where("folder <> ''").distinct().collect())  # as many as units
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folders) if folders else None
    return files.select("path", "length", F.sha2("content", 256).alias("sha256")) if folders else spark.createDataFrame([], "path string, length long, sha256 string")


def made_from(table: str, primary: str, loro: str, nulls: str) -> set[str] | None:
    """The variants whose units a table is made from; None for all."""
    for v in handoff.CONTROLS:
        if table.startswith(f"{v}_"):
            return {primary, v}
    if table.startswith("structured_null"):
        return {primary, nulls}
    if table.startswith("hubert_base"):
        return {primary, loro}
    return {primary} if table.startswith("primary") else None


def deliver(
    spark: SparkSession, root: str, out: str, layers: DataFrame, feature_config: dict, recordings: int, draws: int, reference: str = "hubert_base", primary: tuple[str, str] = ("primary_fast_refits", "sensitivity"),
    loro: tuple[str, str] = ("original", "primary"), controls_kind: str = "primary", nulls: str = "null_fixed_alpha", logs: str | None = None, **options: Any,
) -> dict[str, str]:
    """Makes all tables of a delivery from the units under root: what became of each, by name ('computed', 'resumed' or 'repaired').

    primary and loro: variant and kind of split of the primary scores and of those of the reference model with each recording held out.
    """
    units = unit_states(spark, root).persist()
    try:
        # as many rows as variants
        digests = {r.source: r.digest for r in units.groupBy("source").agg(F.sha2(F.concat_ws("\n", F.array_sort(F.collect_list("digest"))), 256).alias("digest")).collect()}
        found_logs = tables.log_findings(spark, logs) if logs else spark.createDataFrame([], "path string, line int, severity string, text string")
        log_digest = json_sha256(sorted((r.path, r.sha256) for r in publish.tree_hashes(spark, logs).collect())) if logs else ""  # as many rows as files
        fitted = [v for v in dict.fromkeys((primary[0], loro[0], *handoff.CONTROLS)) if v in digests]
        score = lambda variant, kind: jobs.scores_of(spark, root, variant, kind).drop("variant")
        controls = None
        for v in handoff.CONTROLS:
            rows = score(v, controls_kind).withColumn("variant", F.lit(v))
            controls = rows if controls is None else controls.unionByName(rows)
        reports = None
        for v in fitted:
            rows = jobs.table_of(spark, root, v, "reports")
            reports = rows if reports is None else reports.unionByName(rows)
        inventory = predictions_of(spark, root)
        drawn = jobs.table_of(spark, root, nulls, "scores").drop("variant")
        made = handoff.delivery(
            spark, score(*primary), score(*loro).where(F.col("model") == reference), controls, drawn, jobs.table_of(spark, root, nulls, "shifts").drop("variant"), reports, expected_units(layers, tuple(dict.fromkeys((loro[0], *handoff.CONTROLS))), draws),
            units.drop("digest", "source"), found_logs, inventory, feature_config, recordings, draws, reference, **options,
        )
        config = {"recordings": recordings, "draws": draws, "reference": reference, "primary": primary, "loro": loro, "controls_kind": controls_kind, "nulls": nulls, "features": json_sha256(feature_config), "options": options}
        done = {}
        for name, df in made.items():
            wanted = made_from(name, primary[0], loro[0], nulls)
            sources = {v: d for v, d in sorted(digests.items()) if wanted is None or v in wanted} | ({"logs": log_digest} if wanted is None else {})
            done[name] = publish.run_unit(publish.unit_path(out, table=name), {"table": name}, sources, config, lambda df=df: ({"rows": df}, {}))
        return done
    finally:
        units.unpersist()


def delivered(spark: SparkSession, out: str, table: str) -> DataFrame:
    """One table of a delivery."""
    return spark.read.parquet(os.path.join(publish.unit_path(out, table=table), "rows"))
