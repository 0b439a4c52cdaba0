"""Encoding models: nested grouped cross-validated ridge from one pass of moments.

One pass over (recording, frame) gives the moments of lagged predictors and targets for each recording. A unit, a (model, layer), then is

1. placed: its recordings get positions, those of an inner fold side by side, and its splits are planned from ids and frame counts alone;
2. a segment tree: moments of 2, 4, 8, … neighbours are merged, eight nodes to a task;
3. summed: each part of each split is merged from the few nodes that cover it (two a level for a run of positions), passing by one at a time;
4. solved: a split a group gives the maps of all reduced models and penalties for each inner fold and for the whole training set;
5. scored: the unit's recordings pass by a few splits' maps, one recording at a time; penalties are chosen from the scores.

No task holds more moments than a split has inner folds, and one batch, so a unit may have any number of recordings. Merges are exact
sums and nothing is subtracted: a held-out recording is in no number that its fit depends on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kymo.functions.streams import grouped_rows, matrix_of, spread
from kymo.operators.moments import (
    Dealing, Models, Moments, Plan, Unit, best_penalty, capacity_basis, cover, group_folds, lag_rows, maps, merged, models, outer_splits, projection, r2, ridge, side_by_side,
)
from kymo.operators.relate import ranked

__all__ = ["Models", "Moments", "Plan", "Unit", "capacity_basis", "dealt_folds", "fit_reports", "fit_scores", "group_folds", "lag_rows", "merged", "outer_splits", "pooled_results", "predictions", "projection", "r2", "recording_moments", "ridge"]

#: Splits whose maps a task holds while a unit's recordings pass by.
SPLITS_AT_ONCE = 8
#: Levels of the tree that one shuffle adds, and shuffles: above that the tree is a row of trees of 512 recordings.
LEVELS_AT_ONCE, ROUNDS = 3, 3

_MOMENTS = "{keys}recording_id string, n bigint, mean array<double>, cross array<double>, raw_n bigint, raw_mean array<double>, raw_cross array<double>"


def recording_moments(frames: DataFrame, plan: Plan, unit: list[str]) -> DataFrame:
    """Moments of each (unit, recording) of frames (unit columns, recording_id, frame, x, y). One shuffle, by unit and recording.

    Frames may also come as a row for each recording, without the column frame, x and y being arrays of its frames' arrays in order: then nothing is shuffled or sorted.
    """

    def of(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("frame")
        x, y = np.stack(rows["x"].to_numpy()).astype(float), np.stack(rows["y"].to_numpy()).astype(float)
        z, r = Moments.of(np.concatenate([lag_rows(x, plan.lags, plan.rate), y], axis=1)), Moments.of(x)
        one = {k: rows[k].iloc[0] for k in [*unit, "recording_id"]}
        return pd.DataFrame([one | {"n": z.n, "mean": z.mean, "cross": z.cross.ravel(), "raw_n": r.n, "raw_mean": r.mean, "raw_cross": r.cross.ravel()}])

    keys = [*unit, "recording_id"]
    schema = _MOMENTS.format(keys="".join(f"{k} string, " for k in unit))
    if "frame" not in frames.columns:
        return _series(frames, keys).mapInArrow(lambda batches: _series_moments(batches, keys, plan), schema)
    typed = frames.select(*[F.col(k).cast("string").alias(k) for k in keys], "frame", F.col("x").cast("array<double>").alias("x"), F.col("y").cast("array<double>").alias("y"))
    return spread(typed, *keys).groupBy(*keys).applyInPandas(of, schema)


def _series(frames: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of whole recordings, typed; one without frames has none."""
    many = "array<array<double>>"
    return frames.where(F.size("x") > 0).select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("x").cast(many).alias("x"), F.col("y").cast(many).alias("y"))


def _series_moments(batches: Iterable[pa.RecordBatch], keys: list[str], plan: Plan) -> Iterator[pa.RecordBatch]:
    floats = pa.list_(pa.float64())
    for b in batches:
        out = []
        for x, y in zip(b["x"], b["y"], strict=True):
            x, y = matrix_of(x), matrix_of(y)
            out.append((Moments.of(np.concatenate([lag_rows(x, plan.lags, plan.rate), y], axis=1)), Moments.of(x)))
        columns = [c for m in zip(*out, strict=True) for c in (pa.array([a.n for a in m], pa.int64()), pa.array([a.mean for a in m], floats), pa.array([a.cross.ravel() for a in m], floats))]
        if out:
            yield pa.RecordBatch.from_arrays([*(b[k] for k in keys), *columns], [*keys, "n", "mean", "cross", "raw_n", "raw_mean", "raw_cross"])




def dealt_folds(sizes: DataFrame, folds: int) -> DataFrame:
    """(recording_id, weight, fold) as group_folds() gives them, for any number of recordings (recording_id, weight).

    The driver deals weights, not recordings: a row of (weight, how many) for each distinct weight, by levels. Where a recording comes
    among those of its weight is ranked by ranges of ids, and its fold follows from that and the loads before.
    """
    counts = sorted(((int(r.weight), r.n) for r in sizes.groupBy("weight").agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)  # distinct weights
    k = min(folds, sum(n for _, n in counts))
    if k < 2:
        raise ValueError("at least two groups are needed")
    loads, before = np.zeros(k, dtype=np.int64), []
    for weight, n in counts:
        before.append((weight, loads.tolist()))
        loads = Dealing(weight, loads).after(n)
    table = sizes.sparkSession.createDataFrame(before, "weight long, loads array<long>")  # distinct weights x folds

    def fold(weight: pa.Array, loads: pa.Array, rank: pa.Array) -> pa.Array:
        rows = pa.table({"weight": weight, "rank": rank, "at": pa.array(np.arange(len(rank)))}).to_pandas()
        out = np.zeros(len(rows), dtype=np.int32)
        for w, part in rows.groupby("weight"):
            out[part["at"]] = Dealing(int(w), np.array(loads[int(part["at"].iloc[0])].as_py(), dtype=np.int64)).fold(part["rank"].to_numpy())
        return pa.array(out)

    placed = ranked(sizes.select("recording_id", F.col("weight").cast("long").alias("weight")), "recording_id", ("weight",), descending=True)
    return placed.join(table, "weight").select("recording_id", "weight", F.arrow_udf(fold, "int")("weight", "loads", "rank").alias("fold"))


#: Splits of a unit: from its ids and frame counts (kind, fold, training ids, held-out ids, parts), a part being ids whose moments are summed.
Splits = Callable[[dict[str, int]], Iterable[tuple[str, int, list[str], list[str], list[list[str]]]]]


def nested_splits(plan: Plan) -> Splits:
    """Outer splits, whose parts are the inner folds of the training recordings; or these as a whole, if nothing is to be chosen."""

    def of(frames: dict[str, int]):
        for kind, fold, train, test in outer_splits(frames, plan.sensitivity_folds, plan.groups):
            if kind in plan.kinds:
                inner = group_folds({i: frames[i] for i in train}, plan.inner_folds) if plan.fixed_alphas is None else dict.fromkeys(train, 0)
                yield kind, fold, train, test, [[i for i in train if inner[i] == f] for f in range(max(inner.values()) + 1)]

    return of


def training_splits(plan: Plan) -> Splits:
    """Outer splits whose only part is the training set."""
    return lambda frames: ((kind, fold, train, test, [train]) for kind, fold, train, test in outer_splits(frames, plan.sensitivity_folds, plan.groups) if kind in plan.kinds)


def pooled_splits(plan: Plan, outer_folds: int) -> Splits:
    """Grouped outer folds; parts are the inner folds of the training recordings, and last the held-out ones."""

    def of(frames: dict[str, int]):
        fold = group_folds(frames, outer_folds)
        for f in range(max(fold.values()) + 1):
            train, test = [i for i in sorted(fold) if fold[i] != f], [i for i in sorted(fold) if fold[i] == f]
            inner = group_folds({i: frames[i] for i in train}, plan.inner_folds)
            yield "pooled", f, train, test, [*([i for i in train if inner[i] == g] for g in range(max(inner.values()) + 1)), test]

    return of


def _order(frames: dict[str, int], folds: int) -> list[str]:
    """A unit's ids by the inner fold that they had if none were held out, so that most parts are a few runs of positions."""
    if len(frames) < 2:
        return list(frames)
    fold = group_folds(frames, folds)
    return sorted(fold, key=fold.__getitem__)  # stable: within a fold in the order of dealing


def _planned(moments: DataFrame, plan: Plan, unit: list[str], splits: Splits) -> tuple[DataFrame, DataFrame]:
    """(unit, recording_id, n, at, recordings, splits) of each recording, and each split with the nodes that its parts need. From ids and counts only."""
    sizes = spread(moments.select(*unit, "recording_id", F.col("n").alias("frames")), *unit)
    keys = "".join(f"{k} string, " for k in unit)

    def of_unit(rows: pd.DataFrame) -> tuple[dict[str, int], list[str], list]:
        frames = dict(zip(rows["recording_id"], (int(n) for n in rows["frames"]), strict=True))
        return frames, _order(frames, plan.inner_folds), list(splits(frames))

    def place(rows: pd.DataFrame) -> pd.DataFrame:
        frames, order, found = of_unit(rows)
        out = pd.DataFrame({"recording_id": order, "at": range(len(order)), "recordings": len(order), "splits": len(found)})
        for k in reversed(unit):
            out.insert(0, k, rows[k].iloc[0])
        return out

    def plan_parts(rows: pd.DataFrame) -> pd.DataFrame:
        frames, order, found = of_unit(rows)
        at = {i: k for k, i in enumerate(order)}

        def part(ids: list[str]) -> dict:
            chosen = np.zeros(len(order), dtype=bool)
            chosen[[at[i] for i in ids]] = True
            nodes = cover(chosen, LEVELS_AT_ONCE * ROUNDS)
            return {"members": np.flatnonzero(chosen).tolist(), "levels": [n[0] for n in nodes], "nodes": [n[1] for n in nodes]}

        out = [(k, kind, fold, train, test, [at[i] for i in test], [part(p) for p in parts]) for k, (kind, fold, train, test, parts) in enumerate(found)]
        done = pd.DataFrame(out, columns=["split", "kind", "fold", "train", "test", "held", "parts"])
        for k in reversed(unit):
            done.insert(0, k, rows[k].iloc[0])
        return done

    placed = sizes.groupBy(*unit).applyInPandas(place, keys + "recording_id string, at int, recordings int, splits int")
    parts = "array<struct<members: array<int>, levels: array<int>, nodes: array<int>>>"
    return placed, sizes.groupBy(*unit).applyInPandas(plan_parts, keys + f"split int, kind string, fold int, train array<string>, test array<string>, held array<int>, parts {parts}")


Pair = tuple[Moments, Moments | None]


def _pair(row: dict) -> Pair:
    k, j = len(row["mean"]), len(row["raw_mean"]) if "raw_mean" in row else 0
    return Moments(row["n"], row["mean"], row["cross"].reshape(k, k)), Moments(row["raw_n"], row["raw_mean"], row["raw_cross"].reshape(j, j)) if j else None


def _plus(a: Pair | None, b: Pair) -> Pair:
    return b if a is None else (a[0] + b[0], a[1] + b[1] if a[1] is not None else None)


def _sum(pairs: Iterable[Pair]) -> Pair:
    out = None
    for p in pairs:
        out = _plus(out, p)
    return out


def _fields(pair: Pair) -> dict:
    out = {"n": pair[0].n, "mean": pair[0].mean, "cross": pair[0].cross.ravel()}
    return out if pair[1] is None else out | {"raw_n": pair[1].n, "raw_mean": pair[1].mean, "raw_cross": pair[1].cross.ravel()}


def _tree(moments: DataFrame, placed: DataFrame, plan: Plan, unit: list[str]) -> DataFrame:
    """(unit, level, node, moments) of every node: leaves are recordings in the order of their positions."""
    columns = ["n", "mean", "cross", *(("raw_n", "raw_mean", "raw_cross") if plan.capacity else ())]
    schema = "".join(f"{k} string, " for k in unit) + "recordings int, level int, node int, n bigint, mean array<double>, cross array<double>" + (", raw_n bigint, raw_mean array<double>, raw_cross array<double>" if plan.capacity else "")
    keys = [*unit, "recordings", "level", "node"]
    base = moments.join(placed, [*unit, "recording_id"]).select(*unit, "recordings", F.lit(0).alias("level"), F.col("at").alias("node"), *columns)
    nodes = base

    def merge(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        known, level = {}, 0
        for row in rows:  # eight at most
            level, known[row["node"]] = row["level"], _pair(row)
        for _ in range(LEVELS_AT_ONCE):
            level += 1
            above: dict[int, Pair] = {}
            for node in sorted(known):
                above[node >> 1] = _plus(above.get(node >> 1), known[node])
            known = above
            for node, pair in known.items():
                yield {**dict(zip(keys[:-2], key[: len(unit) + 1], strict=True)), "level": level, "node": node, **_fields(pair)}

    for k in range(ROUNDS):
        several = base.where((F.col("level") == LEVELS_AT_ONCE * k) & (F.col("recordings") > 1 << (LEVELS_AT_ONCE * k)))
        base = grouped_rows(several.withColumn("above", F.shiftright("node", LEVELS_AT_ONCE)), [*unit, "recordings", "above"], ["node"], merge, schema)
        nodes = nodes.unionByName(base)
    return nodes.drop("recordings")


def _sums(moments: DataFrame, placed: DataFrame, planned: DataFrame, plan: Plan, unit: list[str]) -> DataFrame:
    """The nodes of every part of every split: (unit, split, kind, fold, held, part, members, moments); a part's nodes need only be added."""
    parts = planned.select(*unit, "split", "kind", "fold", "held", F.posexplode("parts").alias("part", "p"))
    each = parts.select(*unit, "split", "kind", "fold", "held", "part", "p.members", F.posexplode(F.arrays_zip("p.levels", "p.nodes")).alias("k", "e"))
    first = F.col("k") == 0  # ids go with a part's first node only
    needs = each.select(*unit, "split", "kind", "fold", "part", "k", F.when(first, F.col("members")).alias("members"), F.when(first & (F.col("part") == 0), F.col("held")).alias("held"), F.col("e.levels").alias("level"), F.col("e.nodes").alias("node"))
    return needs.join(_tree(moments, placed, plan, unit), [*unit, "level", "node"])


def _read_parts(rows: Iterator[dict]) -> tuple[list[Pair], list[list[int]], dict]:
    """The summed parts of a split, their members, and what all its rows share."""
    sums: list[Pair] = []
    members: list[list[int]] = []
    shared: dict = {}
    for row in rows:
        if row["part"] == len(sums):
            sums.append(_pair(row))
            members.append(row["members"])
        else:
            sums[-1] = _plus(sums[-1], _pair(row))
        if row["part"] == 0 and row["k"] == 0:
            shared = {"kind": row["kind"], "fold": row["fold"], "held": row["held"]}
    return sums, members, shared


_MODELS = "split int, kind string, fold int, inner int, members array<int>, penalties array<double>, weights array<double>, intercepts array<double>, basis array<double>, shape array<int>"
#: The inner fold's number of maps of the whole training set.
OUTER = -1


def _models(moments: DataFrame, plan: Plan, unit: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Placed recordings, planned splits, and the maps of each split: one row for each inner fold and one for the training set."""
    placed, planned = _planned(moments, plan, unit, nested_splits(plan))

    def fields(found: Models) -> dict:
        return {"weights": found.weights.ravel(), "intercepts": found.intercepts.ravel(), "basis": found.basis.ravel(), "shape": [*found.weights.shape, found.basis.shape[0]]}

    def solve(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        sums, members, shared = _read_parts(rows)
        same = dict(zip([*unit, "split"], key, strict=True)) | {"kind": shared["kind"], "fold": shared["fold"]}
        given = None
        if plan.fixed_alphas is not None:
            given = [[plan.fixed_alphas[shared["fold"]]["full" if f is None else f]] for f in (None, *plan.omitted)]
        elif len(sums) > 1:
            for f in range(len(sums)):
                yield {**same, "inner": f, "members": members[f], "penalties": None, **fields(models(plan, *_sum(s for g, s in enumerate(sums) if g != f)))}
        penalties = [a[0] for a in given] if given else [float(a) for a in plan.alphas]
        yield {**same, "inner": OUTER, "members": shared["held"], "penalties": penalties, **fields(models(plan, *_sum(sums), given))}

    done = grouped_rows(_sums(moments, placed, planned, plan, unit), [*unit, "split"], ["part", "k"], solve, "".join(f"{k} string, " for k in unit) + _MODELS)
    return placed, planned, done


def _read_models(row: dict) -> Models:
    omitted, penalties, predictors, components, targets = row["shape"]
    return Models(row["weights"].reshape(omitted, penalties, predictors, components), row["intercepts"].reshape(omitted, penalties, components), row["basis"].reshape(targets, components))


def _selected(moments: DataFrame, placed: DataFrame, solved: DataFrame, plan: Plan, unit: list[str], splits_at_once: int) -> DataFrame:
    """Of each split and held-out recording the penalty, score and inner scores of each model: (unit, split, kind, fold, recording_id, frames, alpha, r2, inner)."""
    keys = "".join(f"{k} string, " for k in unit)
    block = (F.col("split") / splits_at_once).cast("int").alias("block")
    maps_ = solved.select(*unit, block, F.lit(0).alias("turn"), "split", "kind", "fold", "inner", "members", "penalties", "weights", "intercepts", "basis", "shape")
    blocks = F.explode(F.sequence(F.lit(0), F.floor((F.col("splits") - 1) / splits_at_once).cast("int"))).alias("block")
    passing = moments.join(placed, [*unit, "recording_id"]).select(*unit, blocks, F.lit(1).alias("turn"), "recording_id", "at", "n", "mean", "cross")

    def score(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        wanted: dict[int, list[tuple[dict, Models]]] = {}
        for row in rows:
            if row["turn"] == 0:
                found = {**dict(zip(unit, key, strict=False)), **{k: row[k] for k in ("split", "kind", "fold", "inner", "penalties")}}, _read_models(row)
                for at in row["members"]:
                    wanted.setdefault(int(at), []).append(found)
            elif row["at"] in wanted:
                pair = _pair(row)
                for same, maps_of in wanted[row["at"]]:
                    yield {**same, "at": row["at"], "recording_id": row["recording_id"], "frames": pair[0].n, "scores": maps_of.scores(pair[0]).ravel()}

    scored = grouped_rows(maps_.unionByName(passing, allowMissingColumns=True), [*unit, "block"], ["turn", "at"], score, keys + "split int, kind string, fold int, inner int, penalties array<double>, at int, recording_id string, frames bigint, scores array<double>")
    many = 1 + len(plan.omitted)

    def choose(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        inner, held = [], []
        for row in rows:
            (held if row["inner"] == OUTER else inner).append(row)
        means = np.mean([r["scores"].reshape(many, -1) for r in inner], axis=0) if inner else np.zeros((many, 0))
        for row in held:
            scores = row["scores"].reshape(many, -1)
            if plan.fixed_alphas is not None:
                alphas = row["penalties"].tolist()
                at = [0] * many
            else:
                alphas = [best_penalty(plan.alphas, m)[0] for m in means]
                at = [[float(a) for a in plan.alphas].index(a) for a in alphas]
            yield {**dict(zip(unit, key, strict=False)), **{k: row[k] for k in ("split", "kind", "fold", "recording_id", "frames")}, "alpha": alphas, "chosen": at, "r2": [scores[m, k] for m, k in enumerate(at)], "inner": [m.tolist() for m in means]}

    return grouped_rows(scored, [*unit, "split"], ["inner", "at"], choose, keys + "split int, kind string, fold int, recording_id string, frames bigint, alpha array<double>, chosen array<int>, r2 array<double>, inner array<array<double>>")


def fit_scores(moments: DataFrame, plan: Plan, unit: list[str], splits_at_once: int = SPLITS_AT_ONCE) -> DataFrame:
    """Score rows of every unit: leave-one-recording-out, and grouped folds if the plan names them. Moments are read several times: persist or store them first.

    splits_at_once: the maps of so many splits are held by a task while a unit's recordings pass by; more of them move less data and take more memory.
    """
    placed, planned, solved = _models(moments, plan, unit)
    found = _selected(moments, placed, solved, plan, unit, splits_at_once)
    alphas = F.array(*[F.lit(float(a)) for a in sorted(set(map(float, plan.alphas)))])
    order = np.argsort([float(a) for a in plan.alphas], kind="stable").tolist()
    by_alpha = lambda m: F.map_from_arrays(alphas, F.array(*[F.get(F.get("inner", F.lit(m)), F.lit(k)) for k in order])) if plan.fixed_alphas is None else F.create_map().cast("map<double,double>")
    get = lambda c, m: F.get(c, F.lit(m))
    families = [
        F.struct(F.lit(f).alias("family"), get("alpha", m + 1).alias("reduced_alpha"), get("r2", m + 1).alias("reduced_r2"), by_alpha(m + 1).alias("reduced_inner_cv_scores"))
        for m, f in enumerate(plan.omitted)
    ]
    rows = found.withColumn("f", F.explode(F.array(*families))).join(planned.select(*unit, "split", "train", "test"), [*unit, "split"])
    return rows.select(
        *unit, F.col("kind").alias("split_kind"), F.col("fold").alias("outer_fold"), "recording_id", "f.family", get("alpha", 0).alias("full_alpha"), "f.reduced_alpha", get("r2", 0).alias("full_r2"), "f.reduced_r2", (get("r2", 0) - F.col("f.reduced_r2")).alias("delta_r2"),
        "frames", (F.col("frames") / plan.rate).alias("duration_seconds"), F.col("train").alias("train_recording_ids"), F.col("test").alias("test_recording_ids"), by_alpha(0).alias("full_inner_cv_scores"), "f.reduced_inner_cv_scores",
    )


REPORT_COLUMNS = "split_kind string, outer_fold int, components int, coverage double, capacity_rank int, capacity_coverage map<string,double>"


def fit_reports(moments: DataFrame, plan: Plan, unit: list[str]) -> DataFrame:
    """Projection and capacity reports of every unit's outer splits."""
    placed, planned = _planned(moments, plan, unit, training_splits(plan))

    def report(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        sums, _, shared = _read_parts(rows)
        found = maps(plan, *_sum(sums))[3]
        c = found["capacity"]
        yield {
            **dict(zip(unit, key, strict=False)), "split_kind": shared["kind"], "outer_fold": shared["fold"], "components": found["components"], "coverage": found["coverage"],
            "capacity_rank": c["rank"] if c else None, "capacity_coverage": list({f: x["explained_variance_coverage"] for f, x in c["families"].items()}.items()) if c else None,
        }

    return grouped_rows(_sums(moments, placed, planned, plan, unit), [*unit, "split"], ["part", "k"], report, "".join(f"{k} string, " for k in unit) + REPORT_COLUMNS)


_POOLED = "outer_fold int, feature_family string, alpha double, full_r2 double, reduced_r2 double, conditional_delta_r2 double, conditional_proportion double"


def pooled_results(moments: DataFrame, plan: Plan, unit: list[str], outer_folds: int, epsilon: float = 0.0) -> DataFrame:
    """The legacy fit: grouped outer folds, scores pooled over a fold's held-out rows, the first of equally good penalties.

    (unit, outer_fold, feature_family, alpha, full_r2, reduced_r2, conditional_delta_r2, conditional_proportion); the full model's rows have NaN.
    """
    placed, planned = _planned(moments, plan, unit, pooled_splits(plan, outer_folds))
    names, nan, width = sorted(set(plan.families)), float("nan"), len(plan.families) * len(plan.lags)
    whole = replace(plan, components=None, capacity=False, omitted=names)

    def pooled(key: tuple, rows: Iterator[dict]) -> Iterator[dict]:
        sums, _, shared = _read_parts(rows)
        basis = side_by_side(np.eye(width), projection(_sum(sums[:-1])[0], width, plan.components)[0])
        *parts, held = [s[0].mapped(basis) for s in sums]
        total = merged(parts)
        inner = [models(whole, merged([p for g, p in enumerate(parts) if g != f]), None).scores(parts[f]) for f in range(len(parts))]
        means = np.mean(inner, axis=0)
        alphas = [float(plan.alphas[int(np.argmax(m))]) for m in means]
        score = models(whole, total, None, [[a] for a in alphas]).scores(held)[:, 0].tolist()
        for m, family in enumerate(["full", *names]):
            d = score[0] - score[m]
            row = (alphas[m], score[0], *((nan, nan, nan) if not m else (score[m], d, d / score[0] if score[0] > epsilon else nan)))
            yield {**dict(zip(unit, key, strict=False)), "outer_fold": shared["fold"], "feature_family": family, **dict(zip(("alpha", "full_r2", "reduced_r2", "conditional_delta_r2", "conditional_proportion"), row, strict=True))}

    return grouped_rows(_sums(moments, placed, planned, plan, unit), [*unit, "split"], ["part", "k"], pooled, "".join(f"{k} string, " for k in unit) + _POOLED)


def predictions(frames: DataFrame, moments: DataFrame, plan: Plan, unit: list[str]) -> DataFrame:
    """Held-out target and full-model prediction of every frame under leave-one-recording-out: (unit, recording_id, frame, kind, v).

    The chosen map of each (unit, recording) is joined to its frames; only this needs a second pass over them. Frames may be a row for each
    recording, as for recording_moments(); numbered from 0 then.
    """
    keys = [*unit, "recording_id"]
    schema = "".join(f"{k} string, " for k in keys) + "frame int, kind string, v array<double>"
    if plan.capacity:
        return frames.sparkSession.createDataFrame([], schema)
    only = replace(plan, omitted=(), kinds=("primary",), sensitivity_folds=None)
    placed, _, solved = _models(moments, only, unit)
    chosen = _selected(moments, placed, solved, only, unit, SPLITS_AT_ONCE).select(*unit, "split", "recording_id", F.get("chosen", F.lit(0)).alias("chosen"))
    maps_ = solved.where(F.col("inner") == OUTER).join(chosen, [*unit, "split"]).select(*keys, "chosen", "weights", "intercepts", "basis", "shape")

    if "frame" not in frames.columns:
        both = _series(frames, keys).join(maps_.hint("shuffle_hash"), keys)  # the maps are the smaller side, and nothing is sorted
        return both.mapInArrow(lambda batches: _series_predictions(batches, keys, plan), schema)
    typed = spread(frames.select(*[F.col(k).cast("string").alias(k) for k in keys], F.col("frame").cast("int").alias("frame"), "x", "y"), *keys)

    def predict(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame(columns=[*keys, "frame", "kind", "v"])
        left, row = left.sort_values("frame"), right.iloc[0]
        found, k = _read_models(row), int(row["chosen"])
        x, y = np.stack(left["x"].to_numpy()).astype(float), np.stack(left["y"].to_numpy()).astype(float)
        full = lag_rows(x, plan.lags, plan.rate) @ found.weights[0, k] + found.intercepts[0, k]
        return pd.concat([pd.DataFrame({**{c: left[c].iloc[0] for c in keys}, "frame": left["frame"].to_numpy(), "kind": kind, "v": list(v)}) for kind, v in (("target", y @ found.basis), ("full", full))])

    return typed.groupBy(*keys).cogroup(maps_.groupBy(*keys)).applyInPandas(predict, schema)


def _series_predictions(batches: Iterable[pa.RecordBatch], keys: list[str], plan: Plan) -> Iterator[pa.RecordBatch]:
    fields = ("chosen", "weights", "intercepts", "basis", "shape")
    for b in batches:
        for i in range(b.num_rows):
            row = {c: b[c][i].values.to_numpy(zero_copy_only=False) if c != "chosen" else b[c][i].as_py() for c in fields}
            found, k, x, y = _read_models(row), row["chosen"], matrix_of(b["x"][i]), matrix_of(b["y"][i])
            full = lag_rows(x, plan.lags, plan.rate) @ found.weights[0, k] + found.intercepts[0, k]
            n, width = full.shape
            v = pa.ListArray.from_arrays(np.arange(0, (2 * n + 1) * width, width, dtype=np.int32), np.concatenate([y @ found.basis, full]).ravel())
            same = [pa.repeat(b[c][i], 2 * n) for c in keys]
            yield pa.RecordBatch.from_arrays([*same, pa.array(np.tile(np.arange(n, dtype=np.int32), 2)), pa.array(np.repeat(["target", "full"], n)), v], [*keys, "frame", "kind", "v"])
