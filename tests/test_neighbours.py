"""The cover tree, its clusters and the k-NN join against brute force."""

import numpy as np
import pytest

from brindle.operators import neighbours

SHAPE = "id string, v array<double>, _cell int"


def rows(rng, n=300, d=3):
    """Points around few centres, with equal ones, as (id, vector, a column whose name the join uses itself)."""
    centres = rng.normal(0, 10, (5, d))
    points = np.round(centres[rng.integers(0, 5, n)] + rng.normal(0, 1, (n, d)), 2)
    points[n // 2 : n // 2 + 20] = points[0]
    return [(f"r{i:04d}", p.tolist(), 1) for i, p in enumerate(points)]


def brute(asked, base, k, metric, same):
    out = {}
    for key, q, _ in asked:
        found = []
        for name, v, _ in base:
            if same and name == key:
                continue
            a, b = np.array(q), np.array(v)
            d = 1 - a @ b / np.sqrt((a @ a) * (b @ b)) if metric == "cosine" else np.sqrt(((a - b) ** 2).sum())
            found.append((round(float(d), 9) + 0.0, name))
        out[key] = [name for _, name in sorted(found)[:k]]
    return out


@pytest.fixture
def small(monkeypatch):
    """Limits at which 300 rows make many cells, parts and blocks."""
    for name, n in {"CELL": 12, "ROW_BLOCK": 9, "QUERY_BLOCK": 7, "GROWN_ON": 150}.items():
        monkeypatch.setattr(neighbours, name, n)


@pytest.mark.parametrize("metric", ["euclidean", "cosine"])
@pytest.mark.parametrize("same", [True, False])
def test_join_is_brute_force(spark, small, metric, same):
    base = rows(np.random.default_rng(3))
    asked = base[::7]
    found = neighbours.knn_join(spark.createDataFrame(asked, SHAPE), spark.createDataFrame(base, SHAPE), "id", "v", 4, metric, same).collect()
    told = {}
    for r in sorted(found, key=lambda r: (r["id"], r["rank"])):
        told.setdefault(r["id"], []).append(r["neighbour"])
    assert told == brute(asked, base, 4, metric, same)


def test_bound_leaves_cells_out(spark, small):
    base = spark.createDataFrame(rows(np.random.default_rng(3)), SHAPE)
    tree = neighbours.cover_tree(base, "id", "v", 25)
    data = base.withColumn("n", neighbours.nearest_node(tree.vectors)("v")).select("n.*").toPandas()
    radii = data.groupby("cell")["far"].max().reindex(range(len(tree.keys))).to_numpy()
    visit = neighbours._visited(tree.vectors, radii, data["far"].to_numpy(), data["cell"].to_numpy(), 4, False)
    cells = [len(r["c"]) for r in base.select(visit("v").alias("c")).collect()]
    assert sum(cells) < 0.4 * len(cells) * len(tree.keys)


def test_join_of_odd_rows(spark, small):
    odd = [("a", [0.0, 0.0], 0), ("b", None, 0), ("c", [None, 1.0], 0), ("d", [3.0, 4.0], 0), ("e", [float("nan"), 1.0], 0)]
    df = spark.createDataFrame(odd, SHAPE)
    found = neighbours.knn_join(df, df, "id", "v", 3, same=True).collect()
    assert {(r["id"], r["neighbour"], r["distance"]) for r in found} == {("a", "d", 5.0), ("d", "a", 5.0)}
    assert [r["id"] for r in neighbours.knn_join(df, df, "id", "v", 3, "cosine").collect()] == ["d"]  # no direction at length 0
    none = df.where("false")
    assert neighbours.knn_join(none, df, "id", "v").collect() == []
    assert neighbours.knn_join(df, none, "id", "v").collect() == []


def test_tree_is_nested_nets(spark):
    data = rows(np.random.default_rng(5))
    tree = neighbours.cover_tree(spark.createDataFrame(data, SHAPE), "id", "v", 60)
    points = np.array([v for _, v, _ in data])
    assert tree.keys[0] == "r0000" and len(tree.keys) == 60 and tree.levels == sorted(tree.levels)
    for level in range(1, max(tree.levels) + 1):
        upto = tree.vectors[: sum(x <= level for x in tree.levels)]
        apart = np.linalg.norm(upto[:, None] - upto[None], axis=2) + np.eye(len(upto)) * 1e9
        assert apart.min() > tree.radii[level]
        if level < max(tree.levels):  # the last level may be cut short
            assert np.linalg.norm(points[:, None] - upto[None], axis=2).min(axis=1).max() <= tree.radii[level] + 1e-6
    assert all(p < i for i, p in enumerate(tree.parents[1:], 1))


def test_tree_ends_at_equal_rows(spark):
    df = spark.createDataFrame([("a", [1.0], 0), ("b", [1.0], 0), ("c", [2.0], 0)], SHAPE)
    assert neighbours.cover_tree(df, "id", "v").keys == ["a", "c"]
    assert neighbours.cover_tree(df.where("false"), "id", "v") is None


def test_clusters_are_the_planted_ones(spark):
    rng = np.random.default_rng(1)
    data = [(f"r{i:03d}", (np.array([40.0 * (i % 4), -30.0 * (i % 4)]) + rng.normal(0, 1, 2)).tolist(), i % 4) for i in range(200)]
    df = spark.createDataFrame([*data, ("x", None, 0)], SHAPE)
    told = neighbours.cluster_tree(df, "id", "v", 4).collect()
    assert len(told) == 200 and len({(r["_cell"], r["cluster"]) for r in told}) == 4
    assert neighbours.cluster_tree(df.where("false"), "id", "v", 4).collect() == []
