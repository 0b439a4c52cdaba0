"""Recording-level inference: exact sign flips, cluster bootstrap, false discovery rates, and what is composed of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kymo.schema import FAMILIES

#: Fewest bootstrap resamples, draws of one generator call, level of q that counts as a conclusion.
LEAST_RESAMPLES, DRAWS_AT_ONCE, LEVEL = 10_000, 4_096, 0.05
#: Most recordings of an exact test (two halves of 2^22 sums), most whose sums are listed as a whole.
MOST_EXACT, MOST_ENUMERATED = 44, 16
#: Numbers in a block of the matrix of draws, cells that are resampled together.
COUNTS_AT_ONCE, CELLS_AT_ONCE = 4_000_000, 512


def paired_differences(observed: DataFrame, nulls: DataFrame) -> DataFrame:
    """Observed value minus the mean over null draws, recording by recording."""
    means = nulls.groupBy("recording_id").agg(F.avg("value").alias("mean_null"))
    return observed.join(means, "recording_id").select("recording_id", (F.col("value") - F.col("mean_null")).alias("difference"))


def value_arrays(cells: DataFrame, keys: list[str], value: str = "effect", needed: str | None = None) -> DataFrame:
    """Each cell's values (and weights) as arrays in the order of recordings; with the column named by needed, a cell's number of recordings, as _needed."""
    rows = F.array_sort(F.collect_list(F.struct("recording_id", F.col(value).alias("v"), F.col("duration_seconds").alias("w") if "duration_seconds" in cells.columns else F.lit(1.0).alias("w"))))
    more = [F.max(needed).alias("_needed")] if needed else []
    return cells.groupBy(*keys).agg(rows.alias("_r"), *more).select(*keys, *["_needed"] * bool(needed), F.transform("_r", lambda x: x["v"]).alias("v"), F.transform("_r", lambda x: x["w"]).alias("w"))


def _all_sums(values: np.ndarray) -> np.ndarray:
    """The sums of values under every assignment of signs, each added from left to right."""
    sums = np.zeros(1)
    for v in values:
        sums = np.concatenate([sums + v, sums - v])
    return sums


def extreme_assignments(values: np.ndarray) -> int:
    """How many of the 2^N assignments of signs to N values give a sum at least as far from zero as theirs is.

    Up to MOST_ENUMERATED values the sums are listed. More are cut into halves: of the sums of either half, a few million, the sorted
    right ones are searched for the least that reaches the threshold with each left one, and those from there on are counted.
    Whether a pair reaches it is decided by its rounded sum, so the given assignment always counts. The sums lie symmetrically around zero.
    """
    n = len(values)
    if not 1 <= n <= MOST_EXACT:
        raise ValueError(f"between 1 and {MOST_EXACT} recordings are needed")
    if n <= MOST_ENUMERATED:
        sums = _all_sums(values)
        return int((np.abs(sums) >= abs(sums[0])).sum())
    half = n // 2
    left, right = _all_sums(values[:half]), _all_sums(values[half:])
    threshold = abs(left[0] + right[0])
    if threshold == 0:
        return 1 << n
    (left, left_n), (right, right_n) = (np.unique(x, return_counts=True) for x in (left, right))
    from_here = np.append(np.cumsum(right_n[::-1])[::-1], 0)
    at = np.searchsorted(right, threshold - left)
    while (low := (at > 0) & (left + right[np.maximum(at - 1, 0)] >= threshold)).any():  # rounding of the difference: a step at most but for ties
        at[low] -= 1
    while (high := (at < len(right)) & (left + right[np.minimum(at, len(right) - 1)] < threshold)).any():
        at[high] += 1
    return 2 * int((left_n * from_here[at]).sum())


def sign_flip(arrays: DataFrame, keys: list[str]) -> DataFrame:
    """Exact two-sided sign-flip test of each cell's values v over all 2^N assignments, see extreme_assignments()."""
    n = F.size("v")
    checked = arrays.withColumn("_ok", F.assert_true((n > 0) & (n <= MOST_EXACT), F.lit(f"between 1 and {MOST_EXACT} recordings are needed"))).where("_ok is null").drop("_ok")
    extreme = F.arrow_udf(lambda v: pa.array([extreme_assignments(x.values.to_numpy()) for x in v], pa.int64()), "long")
    return checked.select(*keys, *_signs(), extreme("v").alias("extreme"), F.call_function("shiftleft", F.lit(1).cast("long"), n).alias("assignments")).withColumn("p_value", F.col("extreme") / F.col("assignments"))


def _signs() -> list[Column]:
    """effect, recordings and counts of signs of values v."""
    n, total = F.size("v"), F.aggregate("v", F.lit(0.0), lambda a, x: a + x)
    sign = lambda name, test: F.size(F.filter("v", test)).cast("long").alias(name)
    return [(total / n).alias("effect"), n.cast("long").alias("recordings"), sign("n_positive", lambda x: x > 0), sign("n_negative", lambda x: x < 0), sign("n_zero", lambda x: x == 0)]


def drawn_slots(recordings: int, resamples: int, seed: int) -> np.ndarray:
    """The resampled positions of each draw, from NumPy's default generator in its reference order."""
    generator = np.random.default_rng(seed)
    return np.concatenate([generator.integers(0, recordings, size=(min(DRAWS_AT_ONCE, resamples - s), recordings)) for s in range(0, resamples, DRAWS_AT_ONCE)]).astype(np.int32)


def resample_table(spark, recordings: int, resamples: int, seed: int) -> DataFrame:
    """(draw, slots) of drawn_slots(), for other engines; the intervals here draw where they are computed."""
    if resamples < LEAST_RESAMPLES:
        raise ValueError(f"at least {LEAST_RESAMPLES} resamples are needed")
    rows = drawn_slots(recordings, resamples, seed)
    return spark.createDataFrame(pa.table({"draw": pa.array(np.arange(resamples), pa.int32()), "slots": pa.array(list(rows), pa.list_(pa.int32()))}))


@dataclass(frozen=True)
class Resampling:
    """How often to draw, by NumPy's generator from a seed; or given draws: a row of whole numbers each, the n first of which, modulo n, are the slots for n recordings."""

    resamples: int = LEAST_RESAMPLES
    seed: int = 0
    confidence: float = 0.95
    given: np.ndarray | None = None

    def __post_init__(self):
        if (self.resamples if self.given is None else len(self.given)) < LEAST_RESAMPLES:
            raise ValueError(f"at least {LEAST_RESAMPLES} resamples are needed")
        if not 0 < self.confidence < 1:
            raise ValueError("confidence must lie between 0 and 1")

    def counts(self, n: int) -> Iterator[np.ndarray]:
        """Blocks of the matrix of how often each draw holds each of n recordings; a block has COUNTS_AT_ONCE cells, or one draw."""
        generator = np.random.default_rng(self.seed)
        if self.given is not None and self.given.shape[1] < n:
            raise ValueError(f"the given draws have {self.given.shape[1]} slots, not {n}")
        total = self.resamples if self.given is None else len(self.given)
        step = max(1, min(DRAWS_AT_ONCE, COUNTS_AT_ONCE // n))
        for s in range(0, total, step):
            m = min(step, total - s)
            slots = generator.integers(0, n, size=(m, n)) if self.given is None else self.given[s : s + m, :n] % n
            yield np.bincount((np.arange(m)[:, None] * n + slots).ravel(), minlength=m * n).reshape(m, n).astype(np.float64)

    def intervals(self, values: np.ndarray, weights: np.ndarray | None = None) -> np.ndarray:
        """(cells, 2) percentile ends of the (weighted) mean of cells' values (cells, n) over the draws: products with the counts."""
        means, at = np.empty((self.resamples if self.given is None else len(self.given), len(values))), 0
        for c in self.counts(values.shape[1]):
            means[at : at + len(c)] = c @ values.T / values.shape[1] if weights is None else (c @ (values * weights).T) / (c @ weights.T)
            at += len(c)
        tail = (1 - self.confidence) / 2
        return np.quantile(means, [tail, 1 - tail], axis=0, overwrite_input=True).T  # the means are held once


def _matrices(v: pa.Array, w: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row numbers, values and weights of cells with equally many recordings, CELLS_AT_ONCE at a time; null cells are left out."""
    size = np.where(v.is_valid(), pc.fill_null(pc.list_value_length(v), 0), 0)
    for n in np.unique(size[size > 0]):
        rows = np.flatnonzero(size == n)
        for s in range(0, len(rows), CELLS_AT_ONCE):
            at = rows[s : s + CELLS_AT_ONCE]
            yield at, *(x.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, n) for x in (v, w))


def _ends(found: np.ndarray, name: str) -> tuple[list[pa.Array], list[str]]:
    return [pa.array(x, from_pandas=True) for x in found.T], [f"{name}ci_low", f"{name}ci_high"]


def bootstrap_interval(arrays: DataFrame, keys: list[str], recordings: int | None = None, resamples: int = LEAST_RESAMPLES, seed: int = 0, confidence: float = 0.95, weighted: bool = False, draws: np.ndarray | None = None) -> DataFrame:
    """Percentile interval of the (weighted) mean of each cell's values over resampled recordings; of cells of that many recordings, if it is given."""
    plan = Resampling(resamples, seed, confidence, draws)

    def run(v: pa.Array, w: pa.Array) -> pa.Array:
        out = np.full((len(v), 2), np.nan)
        for at, values, weights in _matrices(v, w):
            out[at] = plan.intervals(values, weights if weighted else None)
        return pa.StructArray.from_arrays(*_ends(out, ""))

    rows = arrays if recordings is None else arrays.where(F.size("v") == recordings)
    return rows.select(*keys, F.arrow_udf(run, "ci_low double, ci_high double")("v", "w").alias("_e")).select(*keys, "_e.*")


def benjamini_hochberg(rows: DataFrame, within: list[str], p: str = "p_value", q: str = "q_value") -> DataFrame:
    """Adjusted p-values within each set: the running minimum of p m / rank from the largest p down, at most 1."""
    by = Window.partitionBy(*within)
    ranked = rows.withColumn("_rank", F.row_number().over(by.orderBy(p))).withColumn("_m", F.count("*").over(by))
    down = by.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(q, F.least(F.lit(1.0), F.min(F.col(p) * F.col("_m") / F.col("_rank")).over(down))).drop("_rank", "_m")


def infer(
    cells: DataFrame, keys: list[str], within: list[str], recordings: int | str, resamples: int = LEAST_RESAMPLES, seed: int = 0, confidence: float = 0.95, adjust: bool = True, draws: np.ndarray | None = None
) -> DataFrame:
    """Sign flip, equal and weighted mean with bootstrap intervals, and adjusted p within each set of families.

    recordings: how many a cell needs, or the column of cells that says so. Cells that lack some are not tested: they come back with
    complete = false. A cell's arrays are made once and go through one function, whose draws serve all cells of a size.
    """
    plan = Resampling(resamples, seed, confidence, draws)
    needed = F.lit(recordings) if isinstance(recordings, int) else F.col("_needed")
    arrays = value_arrays(cells, keys, needed=None if isinstance(recordings, int) else recordings).withColumn("complete", F.size("v") == needed)

    def run(v: pa.Array, w: pa.Array) -> pa.Array:
        extreme, ends = np.full(len(v), -1, dtype=np.int64), [np.full((len(v), 2), np.nan) for _ in range(2)]
        for at, values, weights in _matrices(v, w):
            extreme[at] = [extreme_assignments(x) for x in values]
            for out, by in zip(ends, (None, weights), strict=True):
                out[at] = plan.intervals(values, by)
        (equal, names), (weighted, more) = _ends(ends[0], ""), _ends(ends[1], "weighted_")
        return pa.StructArray.from_arrays([pa.array(extreme), *equal, *weighted], ["extreme", *names, *more])

    tested = F.arrow_udf(run, "extreme long, ci_low double, ci_high double, weighted_ci_low double, weighted_ci_high double")
    ok = lambda c: F.when("complete", c) if isinstance(c, str) else F.when(F.col("complete"), c)
    out = arrays.select("*", *_signs(), tested(ok(F.col("v")), ok(F.col("w"))).alias("_t"))
    total = lambda x: F.aggregate(x, F.lit(0.0), lambda a, v: a + v)
    weighted_effect = total(F.zip_with("v", "w", lambda v, w: v * w)) / total("w")
    assignments = F.call_function("shiftleft", F.lit(1).cast("long"), F.size("v"))
    names = ["effect", "recordings", "n_positive", "n_negative", "n_zero", "extreme", "assignments", "p_value", "weighted_effect", "ci_low", "ci_high", "weighted_ci_low", "weighted_ci_high"]
    out = out.select("*", "_t.*", assignments.alias("assignments"), (F.col("_t.extreme") / assignments).alias("p_value"), weighted_effect.alias("weighted_effect")).select(*keys, "complete", *[ok(F.col(c)).alias(c) for c in names])
    return benjamini_hochberg(out, [*within, "complete"]).withColumn("q_value", ok(F.col("q_value"))) if adjust else out


def analyse(effects: DataFrame, recordings: int, **options) -> DataFrame:
    """Inference over the five families of each model, effects averaged over layers first; another set of families fails."""
    from kymo.operators.summary import aggregate_effects

    found = {r.family for r in effects.select("family").distinct().limit(len(FAMILIES) + 1).collect()}
    if found != set(FAMILIES):
        raise ValueError(f"exactly the families {FAMILIES} are needed, not {sorted(found)}")
    return infer(aggregate_effects(effects), ["model", "family"], ["model"], recordings, **options)


def paired_control(control: DataFrame, original: DataFrame, recordings: int, **options) -> DataFrame:
    """Inference on control minus original, paired one to one."""
    from kymo.operators.relate import one_to_one

    keys = ["model", "layer", "recording_id", "family"]
    pairs = one_to_one(control.select(*keys, F.col("delta_r2").alias("_c"), "duration_seconds"), original.select(*keys, F.col("delta_r2").alias("_o")), keys)
    return infer(pairs.withColumn("effect", F.col("_c") - F.col("_o")), ["model", "layer", "family"], ["model", "layer"], recordings, **options)


def conclusion_flags(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """Whether the sign, or q below LEVEL, differs between two inferences."""
    both = a.select(*keys, F.col("effect").alias("effect_a"), F.col("q_value").alias("q_a")).join(b.select(*keys, F.col("effect").alias("effect_b"), F.col("q_value").alias("q_b")), keys)
    sign = F.signum("effect_a") != F.signum("effect_b")
    level = (F.col("q_a") < LEVEL) != (F.col("q_b") < LEVEL)
    return both.select(*keys, "effect_a", "effect_b", "q_a", "q_b", sign.alias("sign_changed"), level.alias("significance_changed"), (~sign & ~level).alias("stable"))


def summarise_nulls(observed: DataFrame, nulls: DataFrame, expected: int, recordings: int, **options) -> DataFrame:
    """Inference on observed minus mean null, unadjusted; refuses incomplete ensembles."""
    from kymo.operators.summary import null_completeness, null_contrast

    if not null_completeness(nulls, expected).where("not complete").isEmpty():
        raise ValueError("every ensemble needs all of its draws")
    cells = null_contrast(observed, nulls).join(observed.groupBy("recording_id").agg(F.max("duration_seconds").alias("duration_seconds")), "recording_id")
    return infer(cells, ["model", "family"], ["model"], recordings, adjust=False, **options)


def lag_contrast(longer: DataFrame, zero: DataFrame, recordings: int, **options) -> DataFrame:
    """Inference on the effects at zero lag minus those of the longer lags, with the direction."""
    keys = ["model", "recording_id", "family"]
    both = longer.select(*keys, F.col("effect").alias("_a"), "duration_seconds").join(zero.select(*keys, F.col("effect").alias("_b")), keys)
    out = infer(both.withColumn("effect", F.col("_b") - F.col("_a")), ["model", "family"], ["model"], recordings, **options)
    return out.withColumn("direction", F.when(F.col("effect") > 0, "zero lag higher").when(F.col("effect") < 0, "longer lags higher").otherwise("equal"))
