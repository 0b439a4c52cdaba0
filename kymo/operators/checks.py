"""Validation: interval and manifest findings, timestamp and archive audits, annotation quality."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kymo.functions.scalars import all_finite, first_failure, is_blank, is_finite, stripped, worst
from kymo.schema import FAMILIES, PHONE_TIERS, WORD_TIERS

#: Slack of comparisons with a recording's end, tolerated numerical overhang of an end, slack of bounds and overlaps; seconds.
END_SLACK, ENDPOINT_TOLERANCE, BOUND_SLACK = 1e-6, 1e-6, 1e-9


def validate_intervals(intervals: DataFrame, recordings: DataFrame, overhang_tolerance: float = 0.0) -> DataFrame:
    """Findings (recording_id, interval_idx, tier, code, severity) of intervals against recordings' durations.

    Reversed or negative spans; ends beyond the audio (a warning only for blank labels within the
    tolerance); starts before the start of the previous row of the same tier in file order.
    """
    earlier = F.lag("start").over(Window.partitionBy("recording_id", "tier").orderBy("interval_idx"))
    rows = intervals.withColumn("_before", earlier).join(recordings.select("recording_id", "duration_seconds"), "recording_id")
    tolerated = is_blank("label") & (F.col("end") <= F.col("duration_seconds") + overhang_tolerance)
    found = [
        F.when((F.col("start") < 0) | (F.col("end") < F.col("start")), F.struct(F.lit("invalid_interval").alias("code"), F.lit("error").alias("severity"))),
        F.when(
            F.col("end") > F.col("duration_seconds") + END_SLACK,
            F.when(tolerated, F.struct(F.lit("empty_trailing_interval_overhang").alias("code"), F.lit("warning").alias("severity"))).otherwise(F.struct(F.lit("outside_audio_duration").alias("code"), F.lit("error").alias("severity"))),
        ),
        F.when(F.col("start") < F.col("_before"), F.struct(F.lit("non_monotonic").alias("code"), F.lit("error").alias("severity"))),
    ]
    rows = rows.select("recording_id", "interval_idx", "tier", F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("f"))
    return rows.select("recording_id", "interval_idx", "tier", "f.code", "f.severity")


def validate_manifest(manifest: DataFrame, audio: DataFrame, findings: DataFrame) -> DataFrame:
    """Findings (recording_id, code, severity) of a manifest: repeated ids, match counts, unreadable audio, interval findings."""
    repeated = manifest.groupBy("recording_id").count().where("count > 1").select("recording_id", F.lit("duplicate_recording_id").alias("code"), F.lit("error").alias("severity"))
    matches = [manifest.where(f"{kind}_matches <> 1").select("recording_id", F.lit(f"{kind}_match_count").alias("code"), F.lit("error").alias("severity")) for kind in ("audio", "alignment")]
    unread = manifest.where("audio_path is not null").join(audio.select("recording_id"), "recording_id", "left_anti").select("recording_id", F.lit("unreadable_audio").alias("code"), F.lit("error").alias("severity"))
    out = repeated
    for more in (*matches, unread, findings.select("recording_id", "code", "severity")):
        out = out.unionByName(more)
    return out


def manifest_report(findings: DataFrame) -> DataFrame:
    """One row: valid, n_errors, n_warnings."""
    count = lambda s: F.coalesce(F.sum((F.col("severity") == s).cast("int")), F.lit(0)).cast("long")
    return findings.agg(count("error").alias("n_errors"), count("warning").alias("n_warnings")).select((F.col("n_errors") == 0).alias("valid"), "n_errors", "n_warnings")


def timestamp_summary(frames: DataFrame, key: list[str], order: str = "frame") -> DataFrame:
    """count, first, last, finite and strictly_increasing of each key's times."""
    before = F.lag("t").over(Window.partitionBy(*key).orderBy(order))
    rows = frames.withColumn("_up", before.isNull() | (F.col("t") > before))
    return rows.groupBy(*key).agg(
        F.count("*").alias("n"), F.min_by("t", order).alias("first_t"), F.max_by("t", order).alias("last_t"), F.bool_and(is_finite("t")).alias("finite"), F.bool_and(F.coalesce("_up", F.lit(False))).alias("strictly_increasing")
    )


def timestamp_mismatch(a: DataFrame, b: DataFrame, key: list[str], tolerance: float) -> DataFrame:
    """Keys whose times differ: counts of both, the largest difference, and whether they match within the tolerance."""
    joined = a.select(*key, "frame", F.col("t").alias("ta")).join(b.select(*key, "frame", F.col("t").alias("tb")), [*key, "frame"], "full_outer")
    out = joined.groupBy(*key).agg(F.count("ta").alias("n_a"), F.count("tb").alias("n_b"), F.max(F.abs(F.col("ta") - F.col("tb"))).alias("largest"))
    return out.withColumn("matches", (F.col("n_a") == F.col("n_b")) & F.coalesce(F.col("largest") <= tolerance, F.lit(False)))


def median_step(frames: DataFrame, key: str = "recording_id") -> DataFrame:
    """The median distance between a key's successive times, its last time plus that step as duration; 0 for up to one row."""
    step = F.col("t") - F.lag("t").over(Window.partitionBy(key).orderBy("t"))
    return frames.withColumn("_step", step).groupBy(key).agg(F.coalesce(F.percentile("_step", F.lit(0.5)), F.lit(0.0)).alias("step"), F.max("t").alias("last_t"), F.count("*").alias("n")).select(
        key, "step", F.when(F.col("n") > 1, F.col("last_t") + F.col("step")).otherwise(F.lit(0.0)).alias("duration_seconds")
    )


def overlap_counts(intervals: DataFrame) -> DataFrame:
    """Intervals that begin before the end of their neighbour, rows of a tier ordered by start and end; adjacent pairs only."""
    before = F.lag("end").over(Window.partitionBy("recording_id", "tier").orderBy("start", "end"))
    return intervals.withColumn("_over", F.coalesce((F.col("start") < before - BOUND_SLACK).cast("int"), F.lit(0))).groupBy("recording_id").agg(F.sum("_over").cast("long").alias("overlap_count"))


def annotation_qc(intervals: DataFrame, recordings: DataFrame, blank_tolerance: float = 0.03) -> DataFrame:
    """One row for each recording: counts, bounds, overlaps, endpoint mismatch and status. One pass over the intervals.

    Ends may overhang by ENDPOINT_TOLERANCE, blank intervals by blank_tolerance; other intervals out of bounds
    are fatal, tolerated ones and overlaps a warning.
    """
    tier, label = F.lower(stripped("tier")), ~is_blank("label")
    before = F.lag("end").over(Window.partitionBy("recording_id", "tier").orderBy("start", "end"))
    d = F.col("duration_seconds")
    within = lambda slack: (F.col("start") >= -BOUND_SLACK) & (F.col("start") <= d + (slack if slack > ENDPOINT_TOLERANCE else BOUND_SLACK)) & (F.col("end") >= -BOUND_SLACK) & (F.col("end") <= d + slack)
    out_of_bounds = ~((F.col("start") >= -BOUND_SLACK) & (F.col("start") <= d + BOUND_SLACK) & (F.col("end") >= -BOUND_SLACK) & (F.col("end") <= d + BOUND_SLACK))
    numerical = out_of_bounds & within(ENDPOINT_TOLERANCE)
    blank = out_of_bounds & ~label & within(blank_tolerance)
    rows = intervals.join(recordings.select("recording_id", "duration_seconds"), "recording_id").select(
        "recording_id", "tier", "end", "duration_seconds",
        (tier.isin(*PHONE_TIERS) & label).alias("phone"), (tier.isin(*WORD_TIERS) & label).alias("word"), (~label).alias("empty"), (F.col("end") < F.col("start")).alias("reversed"),
        out_of_bounds.alias("out"), numerical.alias("numerical"), (blank & ~numerical).alias("blank"), F.coalesce(F.col("start") < before - BOUND_SLACK, F.lit(False)).alias("overlap"),
    )
    n = lambda c: F.sum(F.col(c).cast("long"))
    tiers = rows.groupBy("recording_id", "tier").agg(F.max("end").alias("endpoint"), F.max("duration_seconds").alias("duration_seconds"), F.count("*").alias("interval_count"), *[n(c).alias(c) for c in ("phone", "word", "empty", "reversed", "out", "numerical", "blank", "overlap")])
    done = tiers.groupBy("recording_id").agg(
        F.max("duration_seconds").alias("duration_seconds"), F.sum("interval_count").alias("interval_count"), F.sum("phone").alias("phone_count"), F.sum("word").alias("word_count"), F.sum("empty").alias("empty_count"), F.sum("reversed").alias("reversed_count"),
        F.sum("out").alias("out_of_bounds_count"), F.sum("numerical").alias("numerical_overhang_count"), F.sum("blank").alias("blank_overhang_count"), F.sum("overlap").alias("overlap_count"), F.max("endpoint").alias("annotation_endpoint"), F.max(F.abs(F.col("endpoint") - F.col("duration_seconds"))).alias("endpoint_mismatch"),
    )
    fatal = F.col("out_of_bounds_count") - F.col("numerical_overhang_count") - F.col("blank_overhang_count")
    done = done.withColumn("fatal_out_of_bounds_count", fatal)
    status = F.when((F.col("reversed_count") > 0) | (F.col("fatal_out_of_bounds_count") > 0) | (F.col("phone_count") == 0) | (F.col("word_count") == 0), "FAIL").when((F.col("out_of_bounds_count") > 0) | (F.col("overlap_count") > 0), "WARN").otherwise("PASS")
    return done.withColumn("status", status)


def annotation_totals(qc: DataFrame, intervals: DataFrame) -> DataFrame:
    """One row over all recordings."""
    labels = intervals.where(F.lower(stripped("tier")).isin(*PHONE_TIERS) & ~is_blank("label")).agg(F.count_distinct("label").alias("phone_categories"))
    return qc.agg(F.count("*").alias("recordings"), F.sum("interval_count").alias("intervals"), F.sum("phone_count").alias("phones"), F.sum("word_count").alias("words"), F.max("endpoint_mismatch").alias("largest_endpoint_mismatch"), worst("status").alias("status")).crossJoin(labels)  # one row each


def category_counts(intervals: DataFrame) -> DataFrame:
    """Labels counted by recording and over all (recording_id null), in one pass."""
    rows = intervals.where(~is_blank("label"))
    return rows.groupingSets([["recording_id", "label"], ["label"]], "recording_id", "label").agg(F.count("*").alias("n"))


def archive_audit(frames: DataFrame, schema_width: int, expected: DataFrame) -> DataFrame:
    """(recording_id, n, reason): the first failing check of each expected archive, 'ok' if none."""
    times = timestamp_summary(frames, ["recording_id"])
    cells = frames.groupBy("recording_id").agg(F.bool_and(F.size("x") == schema_width).alias("width"), F.bool_and(all_finite("x")).alias("values_finite"))
    rows = expected.join(times.join(cells, "recording_id"), "recording_id", "left")
    reason = first_failure(
        (F.col("n").isNull(), "missing_archive"), (~F.col("width"), "schema_width_mismatch"), (~F.col("finite"), "nonfinite_times"), (~F.col("strictly_increasing"), "times_not_increasing"), (~F.col("values_finite"), "nonfinite_values"),
        (F.abs(F.col("first_t")) > 1e-8, "grid_does_not_start_at_zero"),
    )
    return rows.select("recording_id", F.coalesce("n", F.lit(0)).alias("n"), reason.alias("reason"))


def duration_problems(rows: DataFrame) -> DataFrame:
    """(recording_id, reason) of extraction durations that are repeated, not finite or negative; reports and raises nothing."""
    counted = rows.groupBy("recording_id").agg(F.count("*").alias("n"), F.bool_and(is_finite("duration_seconds")).alias("finite"), F.min("duration_seconds").alias("least"))
    reason = first_failure((F.col("n") > 1, "duplicate_recording_id"), (~F.col("finite"), "nonfinite_duration"), (F.col("least") < 0, "negative_duration"))
    return counted.select("recording_id", reason.alias("reason")).where("reason <> 'ok'")


def recordings_problems(frames: DataFrame, families: list[str]) -> list[str]:
    """Reasons why recordings (recording_id, frame, t, x, y) can't be fitted; none if they can."""
    out = []
    if set(families) != set(FAMILIES):
        out.append("the feature schema needs exactly the five families")
    s = timestamp_summary(frames, ["recording_id"]).agg(F.count("*").alias("recordings"), F.coalesce(F.bool_and("finite"), F.lit(True)).alias("finite"), F.coalesce(F.bool_and("strictly_increasing"), F.lit(True)).alias("rising")).first()
    c = frames.agg(F.count_distinct(F.size("x")).alias("xw"), F.count_distinct(F.size("y")).alias("yw"), F.max(F.size("x")).alias("x"), F.coalesce(F.bool_and(all_finite("x") & all_finite("y")), F.lit(True)).alias("finite")).first()
    if s.recordings < 3:
        out.append("at least three recordings are needed")
    if not s.finite or not s.rising:
        out.append("times must be finite and strictly increasing")
    if c.xw > 1 or c.yw > 1 or (c.x is not None and c.x != len(families)):
        out.append("all recordings need the same columns and target width")
    if not c.finite:
        out.append("features and targets must be finite")
    return out


def panel_problems(panel: DataFrame) -> DataFrame:
    """One row of violation counts of a figure's source table (model, family, effect, ci_low, ci_high)."""
    n = lambda c: F.coalesce(F.sum(c.cast("long")), F.lit(0)).alias
    cells = panel.groupBy("model", "family").agg(F.count("*").alias("n")).agg(F.coalesce(F.sum((F.col("n") > 1).cast("long")), F.lit(0)).alias("repeated_cells"))
    return panel.agg(
        F.count("*").alias("rows"), n(~F.col("family").isin(*FAMILIES))("unknown_families"), n(~(is_finite("effect") & is_finite("ci_low") & is_finite("ci_high")))("nonfinite"), n(F.col("ci_low") > F.col("ci_high"))("reversed_intervals")
    ).crossJoin(cells)  # one row each


def saved_fields(entries: DataFrame, ids: DataFrame, wanted: dict[str, tuple[str, ...]]) -> DataFrame:
    """(id, field, value_json, values, status) of documents' entries (id, path, key, value_json).

    wanted: for each field the keys that may hold it, best first; the first key that is saved anywhere counts. What is not
    saved is 'missing', what is saved with different values is a 'conflict'; nothing is inferred.
    """
    spark = entries.sparkSession
    keys = spark.createDataFrame([(f, k, n) for f, ks in wanted.items() for n, k in enumerate(ks)], "field string, key string, place int")
    found = entries.join(F.broadcast(keys), "key").groupBy("id", "field", "place").agg(F.min("value_json").alias("value_json"), F.count_distinct("value_json").alias("values"))  # as many rows as wanted keys
    best = found.groupBy("id", "field").agg(F.min_by(F.struct("value_json", "values"), "place").alias("r"))
    every = ids.select("id").crossJoin(keys.select("field").distinct())
    rows = every.join(best, ["id", "field"], "left")
    status = F.when(F.col("r").isNull(), "missing").when(F.col("r.values") > 1, "conflict").otherwise("saved")
    return rows.select("id", "field", F.when(status == "saved", F.col("r.value_json")).alias("value_json"), F.coalesce("r.values", F.lit(0)).alias("values"), status.alias("status"))
