"""Tables and documents in files: manifests, CSV, strict and lax TSV, JSON, YAML settings, stores of features and activations."""

from __future__ import annotations

import json
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kymo.operators.relate import matched_files


def list_files(spark: SparkSession, path: str, glob: str) -> DataFrame:
    """(stem, path, filename) of files under path, without reading them."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(path).select("path")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.regexp_replace(name, r"\.[^.]+$", "").alias("stem"), "path", name.alias("filename"))


def build_manifest(spark: SparkSession, audio_root: str, alignment_root: str, ids: list[str] | None = None) -> DataFrame:
    """Recordings of two folders, matched on the file stem; only ids if they are given."""
    wanted = spark.createDataFrame([(i,) for i in ids], "recording_id string") if ids is not None else None
    return matched_files(list_files(spark, audio_root, "*.[wW][aA][vV]"), list_files(spark, alignment_root, "*.[tT]ext[gG]rid"), wanted)


def read_csv(spark: SparkSession, path: str, schema: str, required: list[str] | None = None) -> DataFrame:
    """CSV with an explicit schema (DDL); a header that lacks a required column fails."""
    header = spark.read.text(path).first()
    names = header.value.lstrip("﻿").split(",") if header else []
    missing = set(required or []) - set(names)
    if missing:
        raise ValueError(f"{path}: columns {sorted(missing)} are missing")
    fields = {f.name: f for f in T.StructType.fromDDL(schema)}
    typed = T.StructType([fields.get(n, T.StructField(n, T.StringType())) for n in names])
    return spark.read.csv(path, header=True, schema=typed, enforceSchema=False, nanValue="nan").select(*[n for n in fields if n in names])


def read_tsv(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """TSV of strings. With fields it is strict: LF line ends only, no NUL, exactly this header."""
    if fields is not None:
        raw = spark.read.format("binaryFile").load(path).select(F.decode("content", "utf-8").alias("text"))
        bad = raw.where(F.col("text").contains("\r") | F.col("text").contains("\0") | (F.substring_index("text", "\n", 1) != "\t".join(fields)))
        if not bad.isEmpty():
            raise ValueError(f"{path}: not plain LF text with the header {fields}")
    return spark.read.csv(path, sep="\t", header=True, quote="", inferSchema=False)


def read_json_objects(spark: SparkSession, path: str, strict: bool = True) -> DataFrame:
    """(path, json, problem) of each file; a lax reading reports what is wrong instead of failing."""
    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("json"))
    good = F.try_parse_json("json") if hasattr(F, "try_parse_json") else F.lit(None)
    kind = F.when(good.isNull(), "unreadable").when(~F.ltrim("json").startswith("{"), "not_an_object")
    out = files.withColumn("problem", kind)
    if strict:
        out = out.withColumn("_ok", F.assert_true(F.col("problem").isNull(), F.lit("a JSON object is needed"))).where("_ok is null").drop("_ok")
    return out


def load_settings(path: str) -> dict[str, Any]:
    """A YAML or JSON document of settings, on the driver."""
    with open(path, encoding="utf-8") as f:
        if path.endswith(".json"):
            return json.load(f)
        import yaml

        return yaml.safe_load(f)


def read_features(spark: SparkSession, path: str) -> tuple[DataFrame, list[str], list[str]]:
    """(frames, names, families) of a feature store: frames and schema folders of Parquet."""
    rows = spark.read.parquet(f"{path}/schema").orderBy("feature_idx").collect()  # as many rows as columns
    return spark.read.parquet(f"{path}/frames"), [r.name for r in rows], [r.family for r in rows]


def write_features(frames: DataFrame, names: list[str], families: list[str], path: str) -> None:
    if len(names) != len(families):
        raise ValueError("as many names as families are needed")
    frames.select("recording_id", "frame", "t", "x").write.parquet(f"{path}/frames")
    frames.sparkSession.createDataFrame([(i, n, f) for i, (n, f) in enumerate(zip(names, families, strict=True))], "feature_idx int, name string, family string").coalesce(1).write.parquet(f"{path}/schema")


def read_activations(spark: SparkSession, path: str, model: str | None = None, layer: str | None = None, grid: str = "canonical") -> DataFrame:
    """Activations of a store partitioned by model, layer and grid: other partitions are never read. Older stores without a grid count as native."""
    rows = spark.read.parquet(path)
    if "grid" not in rows.columns:
        rows = rows.withColumn("grid", F.lit("native"))
    if "t" not in rows.columns:
        rows = rows.withColumnRenamed("frame_time_seconds", "t")
    for column, value in (("model", model), ("layer", layer), ("grid", grid)):
        if value is not None:
            rows = rows.where(F.col(column) == value)
    return rows


def load_recordings(features: DataFrame, activations: DataFrame, tolerance: float = 1e-8) -> DataFrame:
    """(recording_id, frame, t, x, y) of frames that both have; grids that differ in length or time fail."""
    both = features.join(activations.select("recording_id", "frame", F.col("t").alias("_t"), "y"), ["recording_id", "frame"], "full_outer")
    same = F.coalesce(F.abs(F.col("t") - F.col("_t")) <= tolerance, F.lit(False))
    return both.withColumn("_ok", F.assert_true(same, F.lit("features and activations have different grids"))).where("_ok is null").select("recording_id", "frame", "t", "x", "y")


def log_findings(spark: SparkSession, path: str, pattern: str = r"(?i)\b(error|exception|traceback|warning|killed|out of memory)\b") -> DataFrame:
    """(path, line, severity, text) of the lines of all logs under path that tell of trouble."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True).select(F.input_file_name().alias("path"), F.posexplode(F.split("value", "\n")).alias("line", "text"))
    return files.where(F.col("text").rlike(pattern)).select("path", (F.col("line") + 1).alias("line"), F.when(F.col("text").rlike(r"(?i)warning"), "warning").otherwise("error").alias("severity"), "text")
