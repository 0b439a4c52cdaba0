"""Moments of recordings, and the algebra of ridge fits on them: folds, projections, penalties, scores.

Every fold, reduced model and penalty depends only on sums over recordings. What the reference refits from rows is here the merged
moments of the training recordings and small dense systems.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np

from kymo.operators.lags import lagged_families, shift_of
from kymo.schema import CAPACITY, FAMILIES

#: Largest common rank of the capacity control.
CAPACITY_RANK = 3


def group_folds(sizes: dict[str, int], folds: int) -> dict[str, int]:
    """Fold of each group: the largest group goes to the lightest fold, as grouped k-fold splitting does.

    Groups of equal size are taken in descending order of their id, and the first of equally light folds gets them.
    """
    k = min(folds, len(sizes))
    if k < 2:
        raise ValueError("at least two groups are needed")
    load, out = [(0, fold) for fold in range(k)], {}
    names = sorted(sizes)
    for i in np.argsort([sizes[n] for n in names], kind="stable")[::-1]:
        lightest, fold = load[0]
        heapq.heapreplace(load, (lightest + sizes[names[i]], fold))
        out[names[i]] = fold
    return out


@dataclass
class Dealing:
    """How recordings of one weight are dealt to folds with given loads, the lightest first, the first of equally light ones.

    Fold i is chosen for the m-th time at load loads[i] + m weight. Those loads, cut into whole weights and rest, come level by level: at a
    level all folds that have reached it take one recording each, in the order of their rests.
    """

    weight: int
    loads: np.ndarray

    def __post_init__(self):
        self.level, rest = np.divmod(self.loads, max(self.weight, 1))
        self.order = np.lexsort((np.arange(len(rest)), rest))

    def _found(self, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The level of the recordings so far dealt, and how many were dealt below it."""
        start = np.sort(self.level)
        i = np.arange(1, len(start) + 1)
        below = i * start - np.cumsum(start)  # dealt below the level at which the i-th lowest fold joins
        joined = np.searchsorted(below, rank, side="right")
        level = start[joined - 1] + (rank - below[joined - 1]) // joined
        return level, below[joined - 1] + (level - start[joined - 1]) * joined

    def fold(self, rank: np.ndarray) -> np.ndarray:
        """The fold of the recordings of these ranks, from 0."""
        if not self.weight:
            return np.full(len(rank), int(np.argmin(self.loads)))
        level, before = self._found(rank)
        taking = self.level[self.order] <= level[:, None]  # in the order in which a level's folds take
        return self.order[(np.cumsum(taking, axis=1) <= (rank - before)[:, None]).sum(axis=1)]

    def after(self, count: int) -> np.ndarray:
        """The loads after so many recordings."""
        if not self.weight or not count:
            return self.loads
        level, before = (int(x[0]) for x in self._found(np.array([count])))
        taken = np.maximum(level - self.level, 0)
        last = self.order[self.level[self.order] <= level][: count - before]
        taken[last] += 1
        return self.loads + taken * self.weight


def outer_splits(frames: dict[str, int], sensitivity_folds: int | None = None, groups: dict[str, str] | None = None) -> list[tuple[str, int, list[str], list[str]]]:
    """(kind, fold, training ids, held-out ids): each recording held out once, then folds of whole groups."""
    ids = sorted(frames)
    out = [("primary", n, [i for i in ids if i != held], [held]) for n, held in enumerate(ids)]
    if sensitivity_folds is not None:
        if sensitivity_folds < 2:
            raise ValueError("sensitivity_folds must be at least two or None")
        label = {i: (groups or {}).get(i, i) for i in ids}
        if groups is not None and set(ids) - set(groups):
            raise ValueError(f"groups are missing for {sorted(set(ids) - set(groups))}")
        sizes: dict[str, int] = {}
        for i in ids:
            sizes[label[i]] = sizes.get(label[i], 0) + frames[i]
        fold = group_folds(sizes, sensitivity_folds)
        out += [("sensitivity", f, [i for i in ids if fold[label[i]] != f], [i for i in ids if fold[label[i]] == f]) for f in range(max(fold.values()) + 1)]
    return out


@dataclass
class Moments:
    """Counts, means and centred cross products of [predictors | targets]; sums of such are exact merges."""

    n: int
    mean: np.ndarray
    cross: np.ndarray

    @staticmethod
    def of(z: np.ndarray) -> Moments:
        mean = z.mean(axis=0) if len(z) else np.zeros(z.shape[1])
        c = z - mean
        return Moments(len(z), mean, c.T @ c)

    def __add__(self, other: Moments) -> Moments:
        n = self.n + other.n
        if not n:
            return self
        d = other.mean - self.mean
        return Moments(n, self.mean + d * (other.n / n), self.cross + other.cross + np.outer(d, d) * (self.n * other.n / n))

    def columns(self, at: np.ndarray) -> Moments:
        return Moments(self.n, self.mean[at], self.cross[np.ix_(at, at)])

    def mapped(self, basis: np.ndarray) -> Moments:
        """Moments of z @ basis."""
        return Moments(self.n, self.mean @ basis, basis.T @ self.cross @ basis)


def merged(parts: Sequence[Moments]) -> Moments:
    out = parts[0]
    for p in parts[1:]:
        out = out + p
    return out


def lag_rows(x: np.ndarray, lags: Sequence[float], rate: float) -> np.ndarray:
    """The lagged design of one recording: lag after lag, zeros beyond the ends."""
    blocks = []
    for lag in lags:
        k = shift_of(lag, rate)
        b = np.zeros_like(x)
        if abs(k) < len(x):
            b[max(k, 0) : len(x) + min(k, 0)] = x[max(-k, 0) : len(x) - max(k, 0)]
        blocks.append(b)
    return np.concatenate(blocks, axis=1)


@dataclass
class Plan:
    """What to fit: column families, lags, penalties, folds, variants."""

    families: list[str]
    lags: Sequence[float] = (0.0,)
    rate: float = 50.0
    alphas: Sequence[float] = (0.1, 1.0, 10.0, 100.0)
    inner_folds: int = 4
    components: int | None = None
    capacity: bool = False
    sensitivity_folds: int | None = None
    groups: dict[str, str] | None = None
    omitted: Sequence[str] = FAMILIES
    fixed_alphas: dict[int, dict[str, float]] | None = None
    kinds: Sequence[str] = ("primary", "sensitivity")
    reports: dict = field(default_factory=dict)

    def __post_init__(self):
        if not self.alphas or any(a < 0 or not math.isfinite(a) for a in self.alphas):
            raise ValueError("alphas must be finite and non-negative")


def projection(total: Moments, width_x: int, components: int | None) -> tuple[np.ndarray, float, list[float]]:
    """Basis of the targets' leading components, their share of the variance, and the cumulated shares."""
    cross = total.cross[width_x:, width_x:]
    width = cross.shape[0]
    if components is None:
        return np.eye(width), 1.0, [1.0]
    k = min(components, width, total.n - 1)
    values, vectors = np.linalg.eigh(cross)
    order = np.argsort(values)[::-1]
    values = np.maximum(values[order], 0)
    whole = values.sum()
    shares = np.cumsum(values[:k]) / whole if whole > 0 else np.zeros(k)
    return vectors[:, order[:k]], float(shares[-1]) if k else 0.0, shares.tolist()


def capacity_basis(raw: Moments, families: list[str], lags: int) -> tuple[np.ndarray, list[str], dict]:
    """Basis that reduces every substantive block to a common rank, for lagged columns; raw: moments of unlagged ones.

    Leading right singular vectors of the uncentred block. Lags and linear maps commute, so one map serves every lag.
    """
    second = raw.cross + raw.n * np.outer(raw.mean, raw.mean)
    at = {f: [i for i, g in enumerate(families) if g == f] for f in FAMILIES}
    eig, available = {}, {}
    for f in CAPACITY:
        block = second[np.ix_(at[f], at[f])]
        values, vectors = np.linalg.eigh(block)
        order = np.argsort(values)[::-1]
        eig[f] = np.maximum(values[order], 0), vectors[:, order]
        available[f] = int((eig[f][0] > eig[f][0].max(initial=0) * max(raw.n, len(at[f])) * np.finfo(float).eps).sum())
    rank = min([CAPACITY_RANK, *available.values()])
    if rank < 1:
        raise ValueError("every family needs a positive training rank")
    columns, names, report = [], [], {}
    for f in CAPACITY:
        basis = np.zeros((len(families), rank))
        basis[at[f]] = eig[f][1][:, :rank]
        columns.append(basis)
        names += [f] * rank
        centred = raw.cross[np.ix_(at[f], at[f])]
        part = np.trace(basis[at[f]].T @ centred @ basis[at[f]])
        report[f] = {"input_columns": len(at[f]), "available_training_rank": available[f], "rank": rank, "explained_variance_coverage": float(part / np.trace(centred)) if np.trace(centred) > 0 else 0.0}
    onset = np.zeros((len(families), len(at["onset"])))
    onset[at["onset"], range(len(at["onset"]))] = 1
    columns.append(onset)
    names += ["onset"] * len(at["onset"])
    one = np.concatenate(columns, axis=1)
    return np.kron(np.eye(lags), one), names, {"enabled": True, "rank": rank, "families": report}


def ridge(total: Moments, width_x: int, keep: np.ndarray, alphas: Sequence[float]) -> dict[float, tuple[np.ndarray, np.ndarray]]:
    """(weights, intercept) on unstandardised columns for each penalty; predictors are standardised for the fit."""
    scale = np.sqrt(np.diag(total.cross)[:width_x][keep] / max(total.n, 1))
    scale = np.where(scale > 10 * np.finfo(float).eps * np.maximum(1.0, np.abs(total.mean[:width_x][keep])), scale, 1.0)
    y = np.arange(width_x, len(total.mean))
    gram = total.cross[np.ix_(keep, keep)] / np.outer(scale, scale)
    right = total.cross[np.ix_(keep, y)] / scale[:, None]
    values, vectors = np.linalg.eigh(gram)
    rotated = vectors.T @ right
    out = {}
    for a in alphas:
        d = np.maximum(values, 0) + a
        inverse = np.where(d > values.max(initial=0) * 1e-13, 1 / np.where(d > 0, d, 1), 0.0)
        w = (vectors @ (rotated * inverse[:, None])) / scale[:, None]
        out[a] = w, total.mean[y] - total.mean[:width_x][keep] @ w
    return out


def r2(test: Moments, width_x: int, keep: np.ndarray, weights: np.ndarray, intercept: np.ndarray) -> float:
    """Variance-weighted R2 of a linear model on the rows behind test, from their moments."""
    y = np.arange(width_x, len(test.mean))
    total = float(np.diag(test.cross)[y].sum())
    residual_mean = test.mean[y] - test.mean[:width_x][keep] @ weights - intercept
    xy = test.cross[np.ix_(keep, y)]
    error = float(np.diag(test.cross)[y].sum() - 2 * (weights * xy).sum() + (weights * (test.cross[np.ix_(keep, keep)] @ weights)).sum() + test.n * (residual_mean**2).sum())
    if total > 0:
        return 1 - error / total
    return 1.0 if error <= 0 else 0.0


def maps(plan: Plan, total: Moments, raw: Moments | None) -> tuple[np.ndarray, list[str], np.ndarray, dict]:
    """What is fitted on the training recordings before any ridge: basis of the lagged predictors, its columns' families, basis of the targets, report."""
    lagged = lagged_families(plan.families, list(plan.lags))
    basis_y, coverage, shares = projection(total, len(lagged), plan.components)
    report = {"components": basis_y.shape[1], "coverage": coverage, "shares": shares, "capacity": None}
    basis_x, names = np.eye(len(lagged)), lagged
    if plan.capacity:
        basis_x, one, report["capacity"] = capacity_basis(raw, plan.families, len(plan.lags))
        names = one * len(plan.lags)
    return basis_x, names, basis_y, report


def side_by_side(basis_x: np.ndarray, basis_y: np.ndarray) -> np.ndarray:
    """One basis of [predictors | targets]."""
    out = np.zeros((basis_x.shape[0] + basis_y.shape[0], basis_x.shape[1] + basis_y.shape[1]))
    out[: basis_x.shape[0], : basis_x.shape[1]], out[basis_x.shape[0] :, basis_x.shape[1] :] = basis_x, basis_y
    return out


@dataclass
class Models:
    """Linear maps of lagged predictors to projected targets, for each omitted family and penalty."""

    weights: np.ndarray  # omitted, penalties, predictors, components
    intercepts: np.ndarray  # omitted, penalties, components
    basis: np.ndarray  # targets, components

    def scores(self, test: Moments) -> np.ndarray:
        """Variance-weighted R2 of each map (omitted, penalties) on the rows behind test, from their moments."""
        p = self.weights.shape[2]
        side = self.weights.transpose(2, 0, 1, 3)
        flat = side.reshape(p, -1)
        squares = (flat * (test.cross[:p, :p] @ flat)).reshape(side.shape).sum(axis=(0, 3))
        shared = (side * (test.cross[:p, p:] @ self.basis)[:, None, None, :]).sum(axis=(0, 3))
        total = float((self.basis * (test.cross[p:, p:] @ self.basis)).sum())
        off = test.mean[p:] @ self.basis - np.tensordot(test.mean[:p], side, axes=1) - self.intercepts
        error = total - 2 * shared + squares + test.n * (off**2).sum(axis=2)
        return 1 - error / total if total > 0 else np.where(error <= 0, 1.0, 0.0)


def models(plan: Plan, total: Moments, raw: Moments | None, penalties: Sequence[Sequence[float]] | None = None, omitted: Sequence[str | None] | None = None) -> Models:
    """Fits on training moments: the full model and one without each family, at each penalty of the plan, or at those given for each of them."""
    basis_x, names, basis_y, _ = maps(plan, total, raw)
    mapped, weights, intercepts = total.mapped(side_by_side(basis_x, basis_y)), [], []
    for k, family in enumerate((None, *plan.omitted) if omitted is None else omitted):
        keep = np.array([i for i, n in enumerate(names) if n != family])
        alphas = [float(a) for a in (plan.alphas if penalties is None else penalties[k])]
        fitted = ridge(mapped, len(names), keep, alphas)
        weights.append([basis_x[:, keep] @ fitted[a][0] for a in alphas])
        intercepts.append([fitted[a][1] for a in alphas])
    return Models(np.array(weights), np.array(intercepts), basis_y)


class Unit:
    """One (model, layer) in memory: the moments of its recordings, and fits on any of them."""

    def __init__(self, plan: Plan, moments: dict[str, Moments], raw: dict[str, Moments]):
        self.plan, self.moments, self.raw = plan, moments, raw

    def totals(self, ids: list[str]) -> tuple[Moments, Moments | None]:
        return merged([self.moments[i] for i in ids]), merged([self.raw[i] for i in ids]) if self.plan.capacity else None

    def prepared(self, train: list[str], test: list[str]) -> tuple[Moments, dict[str, Moments], list[str], dict]:
        """Training moments and each held-out recording's, after maps that are fitted on the training recordings only."""
        total, raw = self.totals(train)
        basis_x, names, basis_y, report = maps(self.plan, total, raw)
        whole = side_by_side(basis_x, basis_y)
        return total.mapped(whole), {i: self.moments[i].mapped(whole) for i in test}, names, report

    def choose(self, train: list[str], omitted: str | None) -> tuple[float, dict[float, float]]:
        """The penalty with the best mean score over recordings of the inner folds; the smallest on ties."""
        fold = group_folds({i: self.moments[i].n for i in train}, self.plan.inner_folds)
        scores = []
        for f in range(max(fold.values()) + 1):
            inner = models(self.plan, *self.totals([i for i in train if fold[i] != f]), omitted=[omitted])
            scores += [inner.scores(self.moments[i])[0] for i in train if fold[i] == f]
        return best_penalty(self.plan.alphas, np.mean(scores, axis=0))


def best_penalty(alphas: Sequence[float], means: np.ndarray) -> tuple[float, dict[float, float]]:
    """The penalty with the best mean score, the smallest on ties, and the means by penalty."""
    found = {float(a): float(m) for a, m in zip(alphas, means, strict=True)}
    return max(sorted(found), key=lambda a: found[a]), found


def cover(chosen: np.ndarray, levels: int) -> list[tuple[int, int]]:
    """The fewest nodes (level, number) of a segment tree that hold the chosen positions and no other; node i of level l spans [i 2^l, (i + 1) 2^l).

    A run of positions needs two nodes a level at most. Positions beyond the last one count as free.
    """
    inside, some = [chosen], [chosen]
    for _ in range(levels):
        if len(inside[-1]) == 1:
            break
        even = len(inside[-1]) + len(inside[-1]) % 2
        inside.append(np.append(inside[-1], [True] * (even - len(inside[-1]))).reshape(-1, 2).all(axis=1))
        some.append(np.append(some[-1], [False] * (even - len(some[-1]))).reshape(-1, 2).any(axis=1))
    whole = [a & b for a, b in zip(inside, some, strict=True)]
    out = []
    for level, nodes in enumerate(whole):
        at = np.flatnonzero(nodes)
        if level + 1 < len(whole):
            at = at[~whole[level + 1][at // 2]]
        out += [(level, int(i)) for i in at]
    return out
