"""Extra trees against a plain recursion on the same draws."""

import numpy as np
import pytest

from brindle.operators import trees

NAMES = ["a", "b", "c", "d"]


def data(spark, n=240):
    rng = np.random.default_rng(6)
    x = np.round(rng.normal(0, 1, (n, 4)), 3)
    x[:, 3] = 5.0  # never splits
    kind = np.where(x[:, 0] > 0.3, "u", np.where(x[:, 1] > 0, "v", "w"))
    y = np.round(2 * x[:, 0] - x[:, 2] + rng.normal(0, 0.1, n), 3)
    rows = [(i, *map(float, r), str(k), float(t)) for i, (r, k, t) in enumerate(zip(x, kind, y, strict=True))]
    return x, kind, y, spark.createDataFrame(rows, "id long, a double, b double, c double, d double, kind string, y double").repartition(3)


def grow(x, y, tree, depth, tried, classification, seed=7):
    """{node: (feature, threshold, rows)} of one tree, level by level, children numbered as they come."""

    def bad(v):
        if classification:
            return len(v) - sum((v == c).sum() ** 2 for c in set(v)) / max(1, len(v))
        return ((v - v.mean()) ** 2).sum() if len(v) else 0.0

    out, level, count = {}, [(0, np.arange(len(x)))], 1
    for at in range(depth + 1):
        below = []
        for node, rows in level:
            out[node] = (-1, 0.0, rows)
            wide = [i for i in range(x.shape[1]) if x[rows, i].min() < x[rows, i].max()]
            if at == depth or len(rows) < 2 or bad(y[rows]) <= 1e-9 * len(rows) or not wide:
                continue
            wide.sort(key=lambda i: (trees.uniform(seed, tree, node, i, "order"), i))
            cuts = []
            for draw, i in enumerate(wide[:tried]):
                low, high = x[rows, i].min(), x[rows, i].max()
                cut = low + (high - low) * trees.uniform(seed, tree, node, i, "cut")
                right = x[rows, i] > cut
                cuts.append((round((bad(y[rows][right]) + bad(y[rows][~right])) / bad(y[rows]), 9), draw, i, cut, right))
            _, _, i, cut, right = min(cuts, key=lambda c: c[:2])
            out[node] = (i, cut, rows)
            below += [(count, rows[~right]), (count + 1, rows[right])]
            count += 2
        level = below
    return out


@pytest.mark.parametrize("classification", [True, False])
def test_forest_is_the_plain_recursion(spark, classification):
    x, kind, y, df = data(spark)
    target, truth = ("kind", kind) if classification else ("y", y)
    model = trees.fit_extra_trees(df, NAMES, target, classification, trees=3, depth=4, tried=2)
    for t, tree in enumerate(model.trees):
        plain = grow(x, truth, t, 4, 2, classification)
        assert len(plain) == len(tree.feature) > 7
        for node, (f, cut, rows) in plain.items():
            assert tree.feature[node] == f and tree.threshold[node] == pytest.approx(cut)
            assert (tree.sums[node].sum() if classification else tree.sums[node][0]) == len(rows)
    found = {r["id"]: r for r in trees.predict_extra_trees(model, df, "id").collect()}
    if classification:
        shares = sum(np.array([tree.sums[n] / tree.sums[n].sum() for n in tree.leaves(x, 4)]) for tree in model.trees) / 3
        assert [found[i]["pred"] for i in range(len(x))] == [model.classes[i] for i in shares.argmax(axis=1)]
        assert np.mean([found[i]["pred"] == kind[i] for i in range(len(x))]) > 0.8
    else:
        means = sum(np.array([tree.sums[n][1] / tree.sums[n][0] for n in tree.leaves(x, 4)]) for tree in model.trees) / 3
        assert np.allclose([found[i]["pred"] for i in range(len(x))], means)
        assert ((means - y) ** 2).mean() < 0.5 * y.var()


def test_odd_rows(spark):
    shape = "id long, a double, b double, kind string"
    df = spark.createDataFrame([(1, None, 1.0, "u"), (2, 2.0, None, "v"), (3, 3.0, 1.0, None), (4, None, None, "u")], shape)
    model = trees.fit_extra_trees(df, ["a", "b"], "kind", trees=2, depth=3)
    assert model.classes == ["u", "v"] and all(tree.feature == [-1] for tree in model.trees)  # no feature has two values
    assert {r["pred"] for r in trees.predict_extra_trees(model, df, "id").collect()} == {"u"}
    assert trees.predict_extra_trees(model, df.where("false"), "id").collect() == []
    with pytest.raises(ValueError):
        trees.fit_extra_trees(df.where("false"), ["a"], "kind")
