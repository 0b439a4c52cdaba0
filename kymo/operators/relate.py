"""Joins and comparisons: file matching, contracts, regression, expected against observed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Tolerances of a regression run: relative for all columns, absolute for activations, times and summaries.
RELATIVE, ACTIVATION, TIME, SUMMARY = 1e-4, 2e-3, 1e-6, 1e-4


def matched_files(audio: DataFrame, alignments: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """Manifest of two file listings (stem, path, filename): a path only where exactly one file matches."""

    def by_stem(files: DataFrame, kind: str) -> DataFrame:
        one = lambda c: F.when(F.count("*") == 1, F.min(c))
        return files.groupBy(F.col("stem").alias("recording_id")).agg(F.count("*").cast("int").alias(f"{kind}_matches"), one("path").alias(f"{kind}_path"), one("filename").alias(f"{kind}_filename"))

    both = by_stem(audio, "audio").join(by_stem(alignments, "alignment"), "recording_id", "full_outer")
    if ids is not None:
        both = ids.select("recording_id").join(both, "recording_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return both.select("recording_id", F.col("recording_id").alias("story_id"), "audio_path", "alignment_path", zero("audio_matches"), zero("alignment_matches"), "audio_filename", "alignment_filename")


def contract_diff(reference: DataFrame, candidate: DataFrame) -> DataFrame:
    """(field, reference, candidate, matches) of two (field, value) tables; a missing field is null, and nulls match."""
    both = reference.select("field", F.col("value").alias("reference")).join(candidate.select("field", F.col("value").alias("candidate")), "field", "full_outer")
    return both.withColumn("matches", F.col("reference").eqNullSafe(F.col("candidate")))


def all_close(a: Column, b: Column, absolute: float, relative: float = RELATIVE) -> Column:
    """|a - b| <= absolute + relative |b|; NaN equals NaN and null equals null."""
    close = F.abs(a - b) <= F.lit(absolute) + F.lit(relative) * F.abs(b)
    return (a.isNull() & b.isNull()) | (a.isNotNull() & b.isNotNull() & F.when(F.isnan(a) | F.isnan(b), F.isnan(a) & F.isnan(b)).otherwise(close))


def regression(reference: DataFrame, candidate: DataFrame, keys: list[str], values: list[str], absolute: float = SUMMARY) -> DataFrame:
    """Keys with where they stand (both, reference, candidate) and whether all values are close."""
    a = reference.select(*keys, *[F.col(v).alias(f"{v}_a") for v in values], F.lit(True).alias("_a"))
    b = candidate.select(*keys, *[F.col(v).alias(f"{v}_b") for v in values], F.lit(True).alias("_b"))
    both = a.join(b, keys, "full_outer")
    side = F.when(F.col("_a") & F.col("_b"), "both").when(F.col("_a"), "reference").otherwise("candidate")
    close = F.lit(True)
    for v in values:
        close = close & all_close(F.col(f"{v}_b"), F.col(f"{v}_a"), absolute)
    return both.select(*keys, side.alias("side"), (F.coalesce(side == "both", F.lit(False)) & close).alias("close"))


def missing_of(expected: DataFrame, observed: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that nothing observed has."""
    return expected.select(*keys).join(observed.select(*keys), keys, "left_anti")


def exact_set(expected: DataFrame, observed: DataFrame, key: str) -> DataFrame:
    """(key, problem): missing, unexpected or duplicate; empty if the sets are the same."""
    counted = observed.groupBy(key).agg(F.count("*").alias("n"))
    both = expected.select(key, F.lit(True).alias("_e")).join(counted, key, "full_outer")
    problem = F.when(F.col("n").isNull(), "missing").when(F.col("_e").isNull(), "unexpected").when(F.col("n") > 1, "duplicate")
    return both.select(key, problem.alias("problem")).where("problem is not null")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join that fails if a key stands more than once on either side."""

    def single(df: DataFrame, name: str) -> DataFrame:
        n = F.count("*").over(Window.partitionBy(*keys))
        return df.withColumn("_n", n).withColumn("_ok", F.assert_true(F.col("_n") == 1, F.lit(f"repeated key on the {name} side"))).where("_ok is null").drop("_n", "_ok")

    return single(left, "left").join(single(right, "right"), keys, how)


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Whether two tables hold the same rows, repetitions included."""
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()


def latest_rows(rows: DataFrame, key: list[str], sequence: str) -> DataFrame:
    """The row of each key with the largest sequence; one aggregate, no sort."""
    rest = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rest), sequence).alias("_r")).select(*key, "_r.*")


def merged_settings(defaults: DataFrame, overrides: DataFrame) -> DataFrame:
    """(model, key, value): defaults for every model, the model's own values before them."""
    every = overrides.select("model").distinct().crossJoin(defaults.select("key", F.col("value").alias("_d")))  # models x a few settings
    own = overrides.select("model", "key", F.col("value").alias("_o"))
    return every.join(own, ["model", "key"], "full_outer").select("model", "key", F.coalesce("_o", "_d").alias("value"))


def identity_mismatches(expected: dict, observed: DataFrame) -> DataFrame:
    """(field, observed, expected) of fields that differ."""
    rows = [(k, None if v is None else str(v)) for k, v in expected.items()]
    wanted = observed.sparkSession.createDataFrame(rows, "field string, expected string")
    return wanted.join(observed.select("field", F.col("value").alias("observed")), "field", "left").where(~F.col("observed").eqNullSafe(F.col("expected"))).select("field", "observed", "expected")


def complete_layers(activations: DataFrame) -> DataFrame:
    """Layers that every recording has; fails where recordings' layers differ."""
    n = activations.agg(F.count_distinct("recording_id").alias("all"))
    layers = activations.groupBy("layer").agg(F.count_distinct("recording_id").alias("n")).crossJoin(n)  # one row
    return layers.withColumn("_ok", F.assert_true(F.col("n") == F.col("all"), F.lit("recordings have different layers"))).where("_ok is null").select("layer").orderBy("layer")


#: Rows of the sample that places the cuts of ranked(), and cuts.
CUT_SAMPLE, CUTS = 4_096, 64


def ranked(rows: DataFrame, order: str, within: tuple[str, ...] = (), descending: bool = False) -> DataFrame:
    """rows with their rank, from 0, in the order of a column whose values differ, among the rows that agree in within.

    Rows are cut into ranges of that column at values of a bounded sample, counted, and numbered within their range from the number of those
    before it: no window holds more than a range of a group. Where the cuts lie makes the ranges even and changes no rank.
    """
    sample = sorted(r[0] for r in rows.select(order).where(F.col(order).isNotNull()).orderBy(F.xxhash64(order)).limit(CUT_SAMPLE).collect())
    cuts = sorted({sample[i] for i in range(len(sample) // CUTS, len(sample), max(1, len(sample) // CUTS))})
    place = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c <= F.col(order))) if cuts else F.lit(0)
    cut = rows.withColumn("_range", F.coalesce(place, F.lit(-1)))
    keys = [*within, "_range"]
    by = Window.partitionBy(*within).orderBy(F.col("_range").desc() if descending else F.col("_range")).rowsBetween(Window.unboundedPreceding, -1)
    before = cut.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).withColumn("_before", F.coalesce(F.sum("_n").over(by), F.lit(0))).drop("_n")  # a row for each range
    one = F.row_number().over(Window.partitionBy(*keys).orderBy(F.col(order).desc() if descending else F.col(order)))
    same = [F.col(f"c.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = cut.withColumn("_one", one).alias("c").join(before.alias("b"), same)
    return joined.select(*[F.col(f"c.{c}") for c in rows.columns], (F.col("b._before") + F.col("c._one") - 1).alias("rank"))
