"""The least-angle path by its conditions and against least squares, passive-aggressive updates against a plain loop."""

import numpy as np
import pytest

from brindle.operators import linear, models

NAMES = ["a", "b", "c", "d", "e"]


def table(spark, rng, n=400):
    x = rng.normal(0, 1, (n, 5)) * [1, 10, 3, 0.1, 2]
    x[:, 1] += 4 * x[:, 0]
    x[:, 4] -= 0.9 * x[:, 2]
    y = x @ [3.0, -0.5, 0.0, 20.0, 1.5] + rng.normal(0, 2, n) + 7
    rows = [(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))]
    return x, y, spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in NAMES) + ", y double")


@pytest.mark.parametrize("seed", range(4))
def test_path_meets_the_lasso_conditions(spark, seed):
    x, y, df = table(spark, np.random.default_rng(seed))
    knots = linear.path_knots(linear.moments(df, NAMES, "y"))
    xc, yc = x - x.mean(axis=0), y - y.mean()
    unit = np.sqrt((xc**2).sum(axis=0))
    between = [((p + q) / 2, (v + w) / 2) for (p, v), (q, w) in zip(knots, knots[1:], strict=False)]
    for penalty, w in [*knots, *between]:
        pull = xc.T @ (yc - xc @ w) / unit
        assert np.abs(pull).max() <= penalty + 1e-6 * knots[0][0]
        on = np.abs(w) > 1e-12
        assert np.allclose(pull[on], np.sign(w[on]) * penalty, atol=1e-6 * knots[0][0])
    assert [p for p, _ in knots] == sorted((p for p, _ in knots), reverse=True)
    assert np.allclose(knots[-1][1], np.linalg.lstsq(xc, yc, rcond=None)[0], atol=1e-6)


def test_a_weight_can_leave_the_path():
    """Two features together make the target; a third is like both and comes first, then leaves."""
    xx = np.array([[1.0, 0.0, 0.7], [0.0, 1.0, 0.7], [0.7, 0.7, 1.0]])
    m = linear.Moments(100, np.zeros(3), 0.0, xx, xx @ np.array([1.0, 1.0, -0.2]))
    knots = linear.path_knots(m)
    signs = [np.sign(np.round(w[2], 9)) for _, w in knots]
    assert 1.0 in signs and signs[-1] == -1.0 and 0.0 in signs[signs.index(1.0) :]
    assert np.allclose(knots[-1][1], [1.0, 1.0, -0.2])


def test_path_of_odd_features(spark):
    df = spark.createDataFrame([(float(i), 2.0 * i, 1.0, None if i == 3 else 3.0 * i + 1) for i in range(8)], "a double, twice double, flat double, y double")
    last = [r for r in linear.least_angle_path(df, ["a", "twice", "flat"], "y").collect() if r["penalty"] < 1e-9]
    assert sum(r["weight"] * {"a": 1, "twice": 2, "flat": 0}[r["feature"]] for r in last) == pytest.approx(3.0)
    assert [r["weight"] for r in last if r["feature"] == "flat"] == [0.0]
    w, b = linear.fit_least_angle(df, ["a"], "y")
    assert (w[0], b) == (pytest.approx(3.0), pytest.approx(1.0))
    assert not linear.fit_least_angle(df, ["a"], "y", penalty=1e9)[0].any()
    with pytest.raises(ValueError):
        linear.moments(df.where("false"), ["a"], "y")


def test_updates_are_the_plain_loop():
    rng = np.random.default_rng(2)
    x, y = rng.normal(0, 1, (50, 3)), np.sign(rng.normal(0, 1, (50, 2)))
    found, lost = linear.passes(x, y, np.zeros((2, 3)), 0.5, None)
    for c in range(2):
        w = np.zeros(3)
        for row, truth in zip(x, y[:, c], strict=True):
            loss = max(0.0, 1 - truth * (w @ row))
            w = w + min(0.5, loss / (row @ row)) * truth * row
        assert np.allclose(found[c], w)
    assert lost == 100.0


def test_classes_are_told_apart_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK", 60)
    rng = np.random.default_rng(4)
    rows = [(i, float(5 * (i % 3) + rng.normal(0, 0.6)), float(1000 * (i % 3 == 1) + rng.normal(0, 50)), "uvw"[i % 3]) for i in range(300)]
    df = spark.createDataFrame([*rows, (900, None, 1.0, "u"), (901, 1.0, 1.0, None)], "id long, a double, b double, kind string")
    model = linear.fit_passive_aggressive(df, ["a", "b"], "kind", "id")
    again = linear.fit_passive_aggressive(df.repartition(7), ["a", "b"], "kind", "id")
    assert all(np.allclose(m[1], n[1], rtol=1e-9, atol=1e-12) and m[2] == pytest.approx(n[2]) for m, n in zip(model, again, strict=True))
    told = models.predict_lda(model, df.where("id < 300"), ["a", "b"], "id").join(df.select("id", "kind"), "id").collect()
    assert sum(r["pred"] == r["kind"] for r in told) > 0.95 * 300


def test_regression_is_near_least_squares(spark, monkeypatch):
    monkeypatch.setattr(linear, "BLOCK", 100)
    x, y, df = table(spark, np.random.default_rng(0))
    w, b = linear.fit_passive_aggressive_regressor(df, NAMES, "y", "id")
    exact = np.linalg.lstsq(np.c_[x, np.ones(len(x))], y, rcond=None)[0]
    assert np.abs(y - x @ w - b).mean() < 1.15 * np.abs(y - np.c_[x, np.ones(len(x))] @ exact).mean()
