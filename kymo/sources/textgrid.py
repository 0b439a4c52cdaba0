"""Interval annotations in long text format, parsed by Spark's own string functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# The grammar of the long text format.
_TIER = r'(?s)class\s*=\s*"IntervalTier"\s*name\s*=\s*"((?:[^"]|"")*)"(.*?)(?=\bitem\s*\[\d+\]\s*:|\z)'
_INTERVAL = r'intervals\s*\[\d+\]\s*:?\s*xmin\s*=\s*([-+0-9.eE]+)\s*xmax\s*=\s*([-+0-9.eE]+)\s*text\s*=\s*"((?:[^"]|"")*)"'


def parse_intervals(texts: DataFrame, id_col: str = "recording_id", text_col: str = "text") -> DataFrame:
    """INTERVALS rows of every text, in file order; point tiers are left out, empty labels stay, doubled quotes become one.

    A text without an interval fails the query.
    """
    text = F.regexp_replace(F.col(text_col), "^﻿", "")
    tiers = texts.select(F.col(id_col).cast("string").alias("recording_id"), F.posexplode_outer(F.arrays_zip(F.regexp_extract_all(text, F.lit(_TIER), F.lit(1)).alias("tier"), F.regexp_extract_all(text, F.lit(_TIER), F.lit(2)).alias("body"))).alias("tier_no", "t"))
    part = lambda k, name: F.regexp_extract_all(F.col("t.body"), F.lit(_INTERVAL), F.lit(k)).alias(name)
    zipped = tiers.select("recording_id", "tier_no", F.col("t.tier").alias("tier"), F.arrays_zip(part(1, "start"), part(2, "end"), part(3, "label")).alias("rows"))
    found = zipped.groupBy("recording_id").agg(F.array_sort(F.collect_list(F.struct("tier_no", "tier", "rows"))).alias("tiers"))
    flat = F.flatten(F.transform("tiers", lambda t: F.transform(t["rows"], lambda r: F.struct(t["tier"].alias("tier"), r["start"].alias("start"), r["end"].alias("end"), r["label"].alias("label")))))
    checked = F.when(F.coalesce(F.size(flat), F.lit(0)) > 0, flat).otherwise(F.raise_error(F.concat(F.lit("no intervals in "), F.col("recording_id"))).cast("array<struct<tier:string,start:string,end:string,label:string>>"))
    rows = found.select("recording_id", F.posexplode(checked).alias("interval_idx", "r"))
    quoted = lambda c: F.replace(c, F.lit('""'), F.lit('"'))
    return rows.select("recording_id", "interval_idx", quoted(F.col("r.tier")).alias("tier"), F.col("r.start").cast("double").alias("start"), F.col("r.end").cast("double").alias("end"), quoted(F.col("r.label")).alias("label"))


def read_textgrids(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of every file under path; the recording is the file's stem."""
    files = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.[tT]ext[gG]rid")
    stem = F.regexp_extract(F.url_decode(F.replace(F.input_file_name(), F.lit("+"), F.lit("%2B"))), r"([^/]+)\.[^./]+$", 1)
    return parse_intervals(files.select(stem.alias("recording_id"), F.col("value").alias("text")))
