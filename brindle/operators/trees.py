"""Extra trees grown level by level (I3): one random threshold for each candidate feature of a node."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf


@dataclass
class ExtraTree:
    """Nodes by number, the root first. A leaf has feature -1. ``sums``: of a class's rows, or of 1, y and y squared."""

    feature: list[int] = field(default_factory=lambda: [-1])
    threshold: list[float] = field(default_factory=lambda: [0.0])
    left: list[int] = field(default_factory=lambda: [0])
    sums: list[np.ndarray | None] = field(default_factory=lambda: [None])

    def leaves(self, x: np.ndarray, depth: int) -> np.ndarray:
        """The node where each row ends. A right child is its left sibling's number and 1; a missing value goes left."""
        feature, threshold, left = np.array(self.feature), np.array(self.threshold), np.array(self.left)
        at, rows = np.zeros(len(x), np.int64), np.arange(len(x))
        for _ in range(depth):
            inner = feature[at] >= 0
            at = np.where(inner, left[at] + (x[rows, feature[at]] > threshold[at]), at)
        return at


@dataclass(frozen=True)
class ExtraForest:
    trees: list[ExtraTree]
    classes: list | None  # None: regression
    features: list[str]
    depth: int


def uniform(*what) -> float:
    """A number in [0, 1) that depends on ``what`` only."""
    return int(hashlib.md5("-".join(map(str, what)).encode()).hexdigest()[:13], 16) / 16**13


def impurity(sums: np.ndarray, classification: bool) -> np.ndarray:
    """Rows times Gini impurity, or times variance, along the last axis."""
    if classification:
        n = sums.sum(axis=-1)
        return n - (sums**2).sum(axis=-1) / np.maximum(n, 1)
    return sums[..., 2] - sums[..., 1] ** 2 / np.maximum(sums[..., 0], 1)


def _columns(batch: pa.RecordBatch, d: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.float64) for i in range(d)], axis=1)
    return x, batch.column(d).to_numpy(zero_copy_only=False)


def _outcomes(y: np.ndarray, width: int, classification: bool) -> np.ndarray:
    return np.eye(width)[y.astype(np.int64)] if classification else np.stack([np.ones(len(y)), y, y * y], axis=1)


def _ranges(trees: list[ExtraTree], open_: list[list[int]], d: int, width: int, classification: bool, depth: int):
    """A task's least and greatest value of each feature in each open node, and the node's sums."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = [np.full((len(nodes), d), np.inf) for nodes in open_]
        high = [np.full((len(nodes), d), -np.inf) for nodes in open_]
        sums = [np.zeros((len(nodes), width)) for nodes in open_]
        for batch in batches:
            x, y = _columns(batch, d)
            told = _outcomes(y, width, classification)
            for t, (tree, nodes) in enumerate(zip(trees, open_, strict=True)):
                slot = np.full(len(tree.feature), -1)
                slot[nodes] = np.arange(len(nodes))
                at = slot[tree.leaves(x, depth)]
                rows = at >= 0
                np.fmin.at(low[t], at[rows], x[rows])
                np.fmax.at(high[t], at[rows], x[rows])
                np.add.at(sums[t], at[rows], told[rows])
        for t, nodes in enumerate(open_):
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array([t] * len(nodes), pa.int32()), pa.array(nodes, pa.int32()), *[pa.array(list(m[t]), pa.list_(pa.float64())) for m in (low, high, sums)]], names=["tree", "node", "low", "high", "sums"])

    return run


def _splits(trees: list[ExtraTree], draws: list[dict[int, list[tuple[int, float]]]], d: int, width: int, classification: bool, depth: int):
    """A task's sums on the right of each drawn split of each open node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right = [{node: np.zeros((len(own), width)) for node, own in tree.items()} for tree in draws]
        for batch in batches:
            x, y = _columns(batch, d)
            told = _outcomes(y, width, classification)
            for tree, own, found in zip(trees, draws, right, strict=True):
                at = tree.leaves(x, depth)
                order = np.argsort(at, kind="stable")
                nodes, starts = np.unique(at[order], return_index=True)
                for node, rows in zip(nodes.tolist(), np.split(order, starts[1:]), strict=True):
                    for i, (f, cut) in enumerate(own.get(node, ())):
                        found[node][i] += told[rows[x[rows, f] > cut]].sum(axis=0)
        flat = [(t, node, i, list(s)) for t, found in enumerate(right) for node, own in found.items() for i, s in enumerate(own)]
        if flat:
            t, node, i, s = zip(*flat, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(t, pa.int32()), pa.array(node, pa.int32()), pa.array(i, pa.int32()), pa.array(s, pa.list_(pa.float64()))], names=["tree", "node", "draw", "sums"])

    return run


def fit_extra_trees(train: DataFrame, features: Sequence[str], target: str, classification: bool = True, trees: int = 10, depth: int = 6, tried: int | None = None, least: int = 2, seed: int = 7) -> ExtraForest:
    """I3. A level of all trees takes two passes over the rows: each open node's ranges, then the outcome sums on the right of its
    drawn splits. A node of ``least`` rows or more that isn't pure draws ``tried`` features whose values differ (root of their number,
    or all for a regression) and for each a threshold in its range, and keeps the split that lowers impurity most (ties to the
    feature drawn first). Draws depend on seed, tree, node and feature only. No row is shuffled: tasks send sums for each open node,
    and the driver holds the forest, 2 to the ``depth`` nodes a tree at most. Rows with a null target are left out."""
    features = list(features)
    d = len(features)
    rows = train.where(F.col(target).isNotNull())
    classes = sorted(r[0] for r in rows.select(target).distinct().collect()) if classification else None
    if classes == [] or (not classification and not rows.take(1)):
        raise ValueError(f"no row has a value of {target}")
    outcome = F.array_position(F.array(*map(F.lit, classes)), F.col(target)) - 1 if classification else F.col(target).cast("double")
    rows = rows.select(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)).alias(f"x{i}") for i, c in enumerate(features)], outcome.alias("y"))
    width = len(classes) if classification else 3
    tried = tried or (max(1, math.isqrt(d)) if classification else d)
    forest, open_ = [ExtraTree() for _ in range(trees)], [[0] for _ in range(trees)]
    total = lambda: F.array(*[F.sum(F.col("sums")[i]) for i in range(width)]).alias("sums")
    for level in range(depth + 1):
        shape = "tree int, node int, low array<double>, high array<double>, sums array<double>"
        ends = rows.mapInArrow(_ranges(forest, open_, d, width, classification, level), shape).groupBy("tree", "node")
        told = ends.agg(F.array(*[F.min(F.col("low")[i]) for i in range(d)]).alias("low"), F.array(*[F.max(F.col("high")[i]) for i in range(d)]).alias("high"), total()).collect()
        draws: list[dict[int, list[tuple[int, float]]]] = [{} for _ in forest]
        for r in told:
            t, node, sums = r["tree"], r["node"], np.array(r["sums"])
            forest[t].sums[node] = sums
            n = sums.sum() if classification else sums[0]
            wide = [i for i in range(d) if r["low"][i] < r["high"][i]]
            if level == depth or n < least or impurity(sums, classification) <= 1e-9 * n or not wide:
                continue
            wide.sort(key=lambda i, t=t, node=node: (uniform(seed, t, node, i, "order"), i))
            draws[t][node] = [(i, r["low"][i] + (r["high"][i] - r["low"][i]) * uniform(seed, t, node, i, "cut")) for i in wide[:tried]]
        if not any(draws):
            break
        parts = rows.mapInArrow(_splits(forest, draws, d, width, classification, level), "tree int, node int, draw int, sums array<double>")
        best: dict[tuple[int, int], tuple] = {}
        for r in parts.groupBy("tree", "node", "draw").agg(total()).collect():
            right, both = np.array(r["sums"]), forest[r["tree"]].sums[r["node"]]
            left_over = float(impurity(right, classification) + impurity(both - right, classification))
            place = (round(left_over / max(float(impurity(both, classification)), 1e-300), 9), r["draw"])
            at = (r["tree"], r["node"])
            best[at] = min(best.get(at, (place,)), (place,))
        open_ = [[] for _ in forest]
        for (t, node), ((_, draw),) in sorted(best.items()):
            tree = forest[t]
            tree.feature[node], tree.threshold[node] = draws[t][node][draw]
            tree.left[node] = len(tree.feature)
            open_[t] += [len(tree.feature), len(tree.feature) + 1]
            tree.feature += [-1, -1]
            tree.threshold += [0.0, 0.0]
            tree.left += [0, 0]
            tree.sums += [None, None]
    return ExtraForest(forest, classes, features, depth)


def predict_extra_trees(model: ExtraForest, df: DataFrame, key: str) -> DataFrame:
    """(key, pred, confidence): the class of the largest mean share over the trees' leaves (ties to the smallest), or the mean of their means."""
    values = [np.array([s / s.sum() if model.classes else [s[1] / s[0]] for s in tree.sums]) for tree in model.trees]

    @pandas_udf("array<double>")
    def scores(x: pd.Series) -> pd.Series:
        if not len(x):
            return pd.Series([], dtype=object)
        held = np.stack(x.to_numpy()).astype(np.float64)
        return pd.Series(list(sum(v[tree.leaves(held, model.depth)] for tree, v in zip(model.trees, values, strict=True)) / len(values)))

    x = F.array(*[F.coalesce(F.col(c).cast("double"), F.lit(math.nan)) for c in model.features])
    out = df.select(key, scores(x).alias("_s"))
    if model.classes is None:
        return out.select(key, F.col("_s")[0].alias("pred"), F.lit(1.0).alias("confidence"))
    best = F.array_max("_s")
    return out.select(key, F.get(F.array(*map(F.lit, model.classes)), F.array_position("_s", best).cast("int") - 1).alias("pred"), best.alias("confidence"))
