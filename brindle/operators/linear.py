"""Linear models in closed steps: the least-angle path (I15) and passive-aggressive updates."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brindle.session import scratch

#: Rows that one pass of passive-aggressive updates runs along, on average.
BLOCK = 50_000
#: A feature is left out of the path if the others explain all but this share of its variance.
COLLINEAR = 1e-10


@dataclass(frozen=True)
class Moments:
    """Means and centred products of features and target over the rows that have them all."""

    n: int
    x: np.ndarray
    y: float
    xx: np.ndarray
    xy: np.ndarray


def moments(train: DataFrame, features: Sequence[str], target: str) -> Moments:
    """One aggregate of covariances, which Spark merges without cancellation; rows with a null are left out."""
    d = len(features)
    rows = train.select(*[F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(features)], F.col(target).cast("double").alias("y")).dropna()
    asked = [F.count("*").alias("n"), F.avg("y").alias("y"), *[F.avg(f"x{i}").alias(f"x{i}") for i in range(d)], *[F.covar_pop(f"x{i}", "y").alias(f"b{i}") for i in range(d)]]
    asked += [F.covar_pop(f"x{i}", f"x{j}").alias(f"a{i}_{j}") for i in range(d) for j in range(i, d)]
    r = rows.agg(*asked).first()
    if not r["n"]:
        raise ValueError("no row has all features and the target")
    xx = np.array([[r[f"a{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)]) * r["n"]
    return Moments(r["n"], np.array([r[f"x{i}"] for i in range(d)]), r["y"], xx, np.array([r[f"b{i}"] for i in range(d)]) * r["n"])


def path_knots(m: Moments, lasso: bool = True) -> list[tuple[float, np.ndarray]]:
    """(penalty, weights) at each knot, from no feature to least squares.

    Features count at length 1. All active ones share the largest correlation with what is left (the penalty). The weights move so that
    these fall alike, until another feature's correlation reaches them (it joins), or with ``lasso`` until a weight reaches 0 (it
    leaves). Between knots the weights run straight. Constant and collinear features keep weight 0; ties go to the first feature."""
    length = np.sqrt(np.maximum(np.diag(m.xx), 0))
    usable = length > 1e-12 * max(1.0, float(length.max(initial=0)))
    scale = np.where(usable, length, 1.0)
    r, c = m.xx / np.outer(scale, scale), np.where(usable, m.xy / scale, 0.0)
    w, active, out = np.zeros(len(c)), [], set(np.flatnonzero(~usable).tolist())
    penalty = float(np.abs(c).max(initial=0))
    start, left = penalty, False
    knots = [(penalty, np.zeros(len(c)))]
    while penalty > 1e-12 * start and start > 0:
        rest = c - r @ w
        if not left:
            waiting = [j for j in range(len(c)) if j not in active and j not in out]
            new = max(waiting, key=lambda j: (round(abs(rest[j]) / start, 12), -j), default=None)
            if new is not None and abs(rest[new]) >= penalty - 1e-9 * start:
                inside = r[np.ix_(active, active)]
                explained = r[new, active] @ np.linalg.solve(inside, r[active, new]) if active else 0.0
                if 1 - explained <= COLLINEAR:
                    out.add(new)
                    continue
                active.append(new)
        if not active:
            break
        step = np.linalg.solve(r[np.ix_(active, active)], np.sign(rest[active]))
        slope, go, left = r[:, active] @ step, penalty, False
        for j in range(len(c)):
            if j in active or j in out:
                continue
            for over, under in ((penalty - rest[j], 1 - slope[j]), (penalty + rest[j], 1 + slope[j])):
                if under > 1e-12 and over >= -1e-9 * start and over / under < go:
                    go = max(0.0, over / under)  # 0: another one that is level joins before the weights move
        if lasso:
            for i, j in enumerate(active):
                if w[j] and w[j] * step[i] < 0 and -w[j] / step[i] < go:
                    go, left = -w[j] / step[i], j
        w[active] += go * step
        penalty = max(0.0, penalty - go)
        if left is not False:
            w[left] = 0.0
            active.remove(left)
        left = left is not False
        if go > 1e-12 * start:
            knots.append((penalty, w / scale))
    return knots


def least_angle_path(train: DataFrame, features: Sequence[str], target: str, lasso: bool = True) -> DataFrame:
    """I15. (step, penalty, feature, weight): the path's knots; the rows are read once, for their covariances."""
    knots = path_knots(moments(train, features, target), lasso)
    rows = [(i, float(p), c, float(v)) for i, (p, w) in enumerate(knots) for c, v in zip(features, w, strict=True)]
    return train.sparkSession.createDataFrame(rows, "step int, penalty double, feature string, weight double")


def fit_least_angle(train: DataFrame, features: Sequence[str], target: str, penalty: float = 0.0, lasso: bool = True) -> tuple[np.ndarray, float]:
    """I15. (weights, intercept) where the path has ``penalty``, for ``predict_linear``."""
    m = moments(train, features, target)
    knots = path_knots(m, lasso)
    w = knots[0][1] if penalty >= knots[0][0] else knots[-1][1]
    for (high, a), (low, b) in zip(knots, knots[1:], strict=False):
        if low <= penalty < high:
            w = a + (b - a) * ((high - penalty) / (high - low))
    return w, float(m.y - w @ m.x)


def passes(x: np.ndarray, y: np.ndarray, start: np.ndarray, aggressiveness: float, margin: float | None) -> tuple[np.ndarray, float]:
    """Weights (a row for each class or target) after one run along the rows, and the summed loss of ``start``. A row that loses moves
    the weights just so far that it wouldn't, at most ``aggressiveness`` times the row. ``margin``: of a regression's tube; None:
    ``y`` is 1 or -1, with hinge loss."""

    def loss(scores: np.ndarray, truth: np.ndarray) -> np.ndarray:
        return np.maximum(0, 1 - truth * scores) if margin is None else np.maximum(0, np.abs(truth - scores) - margin)

    before = float(loss(x @ start.T, y).sum())
    w, sizes = start.copy(), (x * x).sum(axis=1)
    for row, truth, size in zip(x, y, sizes, strict=True):
        scores = w @ row
        lost = loss(scores, truth)
        if lost.any():
            toward = truth if margin is None else np.sign(truth - scores)
            w += np.outer(np.minimum(aggressiveness, lost / size) * toward, row)
    return w, before


def _block_run(w: np.ndarray, aggressiveness: float, margin: float | None):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_order", "_key"], kind="stable")
        after, lost = passes(np.stack(rows["x"].to_numpy()), np.stack(rows["y"].to_numpy()), w, aggressiveness, margin)
        return pd.DataFrame({"n": [len(rows)], "lost": [lost], "w": [after.ravel().tolist()]})

    return run


def _mixed_rounds(dealt: DataFrame, width: int, outputs: int, aggressiveness: float, margin: float | None, rounds: int, tolerance: float) -> tuple[np.ndarray, list[float]]:
    """Runs in each block from the same weights, whose mean by rows is the next round's start; ends when the loss of the best weights
    falls by less than ``tolerance`` of itself. dealt(_block, _order, _key, x, y)."""
    w, best, losses = np.zeros((outputs, width)), None, []
    for _ in range(rounds + 1):
        blocks = dealt.groupBy("_block").applyInPandas(_block_run(w, aggressiveness, margin), "n long, lost double, w array<double>")
        told = blocks.select("n", "lost", F.posexplode("w").alias("at", "v"))
        means = told.groupBy("at").agg(F.sum(F.col("v") * F.col("n")).alias("s"), F.sum("n").alias("n"), F.sum("lost").alias("lost")).orderBy("at").collect()
        if not means:
            return w, losses
        losses.append(means[0]["lost"] / means[0]["n"])
        if best is None or losses[-1] < best[0]:
            settled = best is not None and losses[-1] > 0 and best[0] - losses[-1] < tolerance * best[0]
            best = (losses[-1], w)
            if settled or not losses[-1]:
                break
        else:
            break
        w = np.array([r["s"] / r["n"] for r in means]).reshape(outputs, width)
    return best[1], losses


def _standardised(train: DataFrame, features: Sequence[str], target: str, key: str, y) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Rows as (_block, _order, _key, x with a 1 for the intercept, y), written once; means and deviations of the features."""
    rows = train.dropna(subset=[*features, target])
    asked = [F.count("*").alias("n"), *[f(F.col(c).cast("double")).alias(f"{k}{i}") for i, c in enumerate(features) for k, f in (("m", F.avg), ("s", F.stddev_pop))]]
    r = rows.agg(*asked).first()
    mean = np.array([r[f"m{i}"] or 0.0 for i in range(len(features))])
    deviation = np.array([r[f"s{i}"] or 1.0 for i in range(len(features))])
    x = F.array(*[(F.col(c).cast("double") - float(m)) / float(s) for c, m, s in zip(features, mean, deviation, strict=True)], F.lit(1.0))
    blocks = max(1, -(-r["n"] // BLOCK))
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("_block"), F.xxhash64(key, F.lit(1)).alias("_order"), F.col(key).cast("string").alias("_key"), x.alias("x"), y.alias("y"))
    return scratch(dealt, "passive-aggressive"), mean, deviation


def _raw(w: np.ndarray, mean: np.ndarray, deviation: np.ndarray) -> tuple[np.ndarray, float]:
    slopes = w[:-1] / deviation
    return slopes, float(w[-1] - slopes @ mean)


def fit_passive_aggressive(train: DataFrame, features: Sequence[str], target: str, key: str, aggressiveness: float = 0.01, rounds: int = 20, tolerance: float = 1e-3) -> list[tuple[str, np.ndarray, float]]:
    """I13. For each class (name, weights, offset), for ``predict_lda``: one class against the others, hinge loss. Features are
    standardised; rows are dealt to blocks by their key and run along in an order of their key, so partitions change no more than the
    rounding of sums. Only weights come to the driver. Rows with a null in a feature or the target are left out."""
    names = [r[0] for r in train.dropna(subset=[*features, target]).select(target).distinct().orderBy(target).collect()]
    y = F.array(*[F.when(F.col(target) == n, 1.0).otherwise(-1.0) for n in names])
    if not names:
        raise ValueError("no row has all features and the target")
    dealt, mean, deviation = _standardised(train, features, target, key, y)
    w, _ = _mixed_rounds(dealt, len(features) + 1, len(names), aggressiveness, None, rounds, tolerance)
    return [(n, *_raw(v, mean, deviation)) for n, v in zip(names, w, strict=True)]


def fit_passive_aggressive_regressor(train: DataFrame, features: Sequence[str], target: str, key: str, aggressiveness: float = 0.01, margin: float = 0.1, rounds: int = 20, tolerance: float = 1e-3) -> tuple[np.ndarray, float]:
    """I13. (weights, intercept) for ``predict_linear``: errors beyond ``margin`` deviations of the target count. As the classifier otherwise."""
    r = train.dropna(subset=[*features, target]).agg(F.avg(F.col(target).cast("double")).alias("m"), F.stddev_pop(F.col(target).cast("double")).alias("s")).first()
    if r["m"] is None:
        raise ValueError("no row has all features and the target")
    size = r["s"] or 1.0
    dealt, mean, deviation = _standardised(train, features, target, key, F.array((F.col(target).cast("double") - r["m"]) / size))
    w, _ = _mixed_rounds(dealt, len(features) + 1, 1, aggressiveness, margin, rounds, tolerance)
    slopes, offset = _raw(w[0], mean, deviation)
    return slopes * size, offset * size + r["m"]
