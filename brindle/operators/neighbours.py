"""A cover tree over vectors, and what is found with it: exact nearest neighbours (F15) and clusters."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.pandas.types import to_arrow_type

from brindle.session import scratch

#: Nodes of a tree at most. They go to every task.
NODES = 1_024
#: Rows for which a join's tree gets one node, and rows at most that it is grown on; all rows are dealt to its nodes.
CELL, GROWN_ON = 10_000, 100_000
#: Rows and queries that one task compares at a time, on average.
ROW_BLOCK, QUERY_BLOCK = 50_000, 4_096
#: Rows whose distances to all nodes a task holds at a time.
STEP = 2_048


@dataclass(frozen=True)
class Tree:
    """Nested nets. Nodes stand in the order in which they came: those of a level's end and all before it lie further apart than
    ``radii[level]``, and every row of a finished level lies within it of a node. A node's parent was the nearest when it came."""

    keys: list
    vectors: np.ndarray
    parents: list[int]
    levels: list[int]
    radii: list[float]


def _distances(rows: np.ndarray, nodes: np.ndarray) -> np.ndarray:
    squares = (rows * rows).sum(axis=1)[:, None] + (nodes * nodes).sum(axis=1) - 2 * rows @ nodes.T
    return np.sqrt(np.maximum(squares, 0))


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _slack(*sides: np.ndarray) -> float:
    """More than distances from products can be off by."""
    return 1e-7 * (1 + sum(float(np.sqrt((s * s).sum(axis=1)).max(initial=0)) for s in sides))


def _usable(vector: str) -> Column:
    return F.col(vector).isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x.cast("double")))


def _outermost(nodes: np.ndarray):
    """For each batch and node the row that lies furthest from it among those nearest to it (ties by key)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, STEP):
                part = batch.slice(start, STEP)
                away = _distances(_matrix(part.column(1)), nodes)
                cell = away.argmin(axis=1)
                told = pd.DataFrame({"cell": cell, "far": away[np.arange(len(cell)), cell], "at": np.arange(len(cell)), "key": part.column(0).to_pandas()})
                best = told.sort_values(["far", "key"], ascending=[False, True], kind="stable").drop_duplicates("cell")
                rows = part.take(pa.array(best["at"].to_numpy()))
                yield pa.RecordBatch.from_arrays([pa.array(best["cell"], pa.int32()), pa.array(best["far"], pa.float64()), rows.column(0), rows.column(1)], names=["_cell", "_far", "_key", "_v"])

    return run


def cover_tree(df: DataFrame, key: str, vector: str, nodes: int = NODES, base: float = 2.0) -> Tree | None:
    """The tree's first ``nodes`` nodes; None without rows. The root is the row of the smallest key. A level's radius is ``base`` times
    smaller than the one before. A round passes over the rows once and takes from each node's cell its outermost row; those
    beyond the radius come in, furthest first, if they lie further than it from what came in this round. A level ends when none
    is left beyond its radius. The driver holds one row for each node. Rows without a full vector are left out, and rows equal
    to a node are never another one."""
    rows = df.where(_usable(vector)).select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_v"))
    root = rows.agg(F.min_by(F.struct("_key", "_v"), "_key").alias("r")).first()["r"]
    if root is None:
        return None
    keys, vectors, parents, levels, radii = [root["_key"]], [np.array(root["_v"])], [0], [0], []
    shape = f"_cell int, _far double, _key {rows.schema['_key'].dataType.simpleString()}, _v array<double>"
    while len(keys) < nodes:
        held = np.array(vectors)
        outer = rows.mapInArrow(_outermost(held), shape).groupBy("_cell").agg(F.min_by(F.struct("_far", "_key", "_v"), F.struct(-F.col("_far"), F.col("_key"))).alias("r"))
        found = sorted(((r["r"], r["_cell"]) for r in outer.collect()), key=lambda x: (-x[0]["_far"], x[0]["_key"]))
        furthest = found[0][0]["_far"]
        if furthest <= _slack(held):
            break
        radii = radii or [furthest]
        while furthest <= radii[-1]:
            radii.append(radii[-1] / base)
        come: list[np.ndarray] = []
        for row, cell in found:
            v = np.array(row["_v"])
            if row["_far"] <= radii[-1] or len(keys) == nodes:
                break
            if not come or _distances(np.array(come), v[None]).min() > radii[-1]:
                come.append(v)
                keys.append(row["_key"])
                parents.append(cell)
                levels.append(len(radii) - 1)
        vectors += come
    return Tree(keys, np.array(vectors), parents, levels, radii or [0.0])


def nearest_node(nodes: np.ndarray):
    """A column function: (cell, far) of a vector's nearest node, ties to the earlier one."""

    @pandas_udf("cell int, far double")
    def run(v: pd.Series) -> pd.DataFrame:
        parts = [pd.DataFrame({"cell": pd.Series(dtype="int32"), "far": pd.Series(dtype="float64")})]
        for start in range(0, len(v), STEP):
            away = _distances(np.stack(v.iloc[start : start + STEP].to_numpy()).astype(np.float64), nodes)
            cell = away.argmin(axis=1)
            parts.append(pd.DataFrame({"cell": cell.astype(np.int32), "far": away[np.arange(len(cell)), cell]}))
        return pd.concat(parts[1:] or parts, ignore_index=True)

    return run


def cluster_tree(df: DataFrame, key: str, vector: str, k: int) -> DataFrame:
    """I24. ``df`` with ``cluster``, the nearest of the cover tree's first ``k`` nodes from 0 (fewer if fewer vectors differ); rows
    without a full vector are left out."""
    tree = cover_tree(df, key, vector, k)
    if tree is None:
        return df.where(F.lit(False)).withColumn("cluster", F.lit(None).cast("int"))
    return df.where(_usable(vector)).withColumn("cluster", nearest_node(tree.vectors)(F.col(vector).cast("array<double>"))["cell"])


def _visited(nodes: np.ndarray, radii: np.ndarray, near: np.ndarray, own: np.ndarray, wanted: int, cosine: bool):
    """For a query the cells that can hold one of its ``wanted`` nearest rows. ``near`` and ``own``: distances of the rows closest to the nodes, and
    those rows' nodes. By the triangle inequality such a row is no further than the node's distance and its own together, so the
    ``wanted``-th smallest sum bounds the distance that counts. A cell is left out if all its rows lie beyond that bound: by its
    radius, or since the plane between its node and the query's nearest one does."""
    between = _distances(nodes, nodes)

    @pandas_udf("array<int>")
    def run(v: pd.Series) -> pd.Series:
        out = []
        for start in range(0, len(v), 64):
            q = np.stack(v.iloc[start : start + 64].to_numpy()).astype(np.float64)
            away, slack = _distances(q, nodes), _slack(q, nodes)
            reach = np.partition(away[:, own] + near, wanted - 1, axis=1)[:, wanted - 1] if len(near) >= wanted else np.full(len(q), np.inf)
            first = away.argmin(axis=1)
            gap = between[first]
            with np.errstate(divide="ignore", invalid="ignore"):
                plane = np.where(gap > 0, (away**2 - away[np.arange(len(q)), first][:, None] ** 2) / (2 * gap), -np.inf)
            bound = reach[:, None] + (4 * slack + (1e-4 if cosine else 0))
            out += [np.flatnonzero(x) for x in (away - radii <= bound) & (plane <= bound) & np.isfinite(radii)]
        return pd.Series(out, dtype=object)

    return run


def _compare(k: int, cosine: bool, same: bool, kind: pa.DataType):
    """The k nearest rows of a block for each query of a block. Products find who may be among them, and these are measured again
    by differences (or by the cosine), so results don't hang on blocks."""

    def run(rows: pa.Table, queries: pa.Table) -> pa.Table:
        found: list[tuple] = []
        if rows.num_rows and queries.num_rows:
            b, q = _matrix(rows["_v"]), _matrix(queries["_v"])
            names, asked = rows["_b"], queries["_q"].to_pylist()
            sizes = (b * b).sum(axis=1)
            for start in range(0, len(q), 256):
                part = q[start : start + 256]
                squares = np.maximum(sizes + (part * part).sum(axis=1)[:, None] - 2 * part @ b.T, 0)
                for i, row in enumerate(squares):
                    key, v = asked[start + i], part[i]
                    at = np.arange(len(row))
                    if len(row) > k + 1:
                        last = np.partition(row, k)[k]
                        at = np.flatnonzero(row <= (np.sqrt(last) + 1e-8) ** 2 + 1e-8 * cosine + 1e-11 * (sizes.max() + v @ v))
                    d = 1 - (b[at] * v).sum(axis=1) if cosine else np.sqrt(((b[at] - v) ** 2).sum(axis=1))
                    who = names.take(pa.array(at)).to_pylist()
                    own = sorted((float(np.round(x, 9)), n, float(x)) for x, n in zip(d, who, strict=True) if not (same and n == key))
                    found += [(key, n, x) for _, n, x in own[:k]]
        columns = list(zip(*found, strict=True)) if found else [[], [], []]
        return pa.table([pa.array(columns[0], queries["_q"].type), pa.array(columns[1], kind), pa.array(columns[2], pa.float64())], names=["_q", "_b", "distance"])

    return run


def _dealt(q: DataFrame, b: DataFrame, n: int, nodes: int, k: int, wanted: int, cosine: bool) -> tuple[DataFrame, DataFrame, dict[int, int], dict[int, int]]:
    """Rows with their cell, queries with the cells they visit, and how many of both a cell has."""
    tree = cover_tree(b.where(F.pmod(F.xxhash64("_b"), F.lit(-(-n // GROWN_ON))) == 0) if n > GROWN_ON else b, "_b", "_v", nodes)
    dealt = scratch(b.withColumn("_n", nearest_node(tree.vectors)("_v")).select("_b", "_v", F.col("_n.cell").alias("_cell"), F.col("_n.far").alias("_far")), "knn-rows")
    close = Window.partitionBy("_cell").orderBy("_far")
    nearest = dealt.select("_cell", "_far").withColumn("_i", F.row_number().over(close)).where(F.col("_i") <= k + 1)
    stats = dealt.groupBy("_cell").agg(F.count("*").alias("n"), F.max("_far").alias("far"))
    told = stats.join(nearest.groupBy("_cell").agg(F.collect_list("_far").alias("near")), "_cell").collect()
    radii, sizes = np.full(len(tree.keys), -np.inf), {r["_cell"]: r["n"] for r in told}
    for r in told:
        radii[r["_cell"]] = r["far"]
    near, own = np.array([x for r in told for x in r["near"]]), np.array([r["_cell"] for r in told for _ in r["near"]])
    asked = scratch(q.withColumn("_cells", _visited(tree.vectors, radii, near, own, wanted, cosine)("_v")), "knn-queries")
    visits = asked.select(F.explode("_cells").alias("_cell")).groupBy("_cell").agg(F.count("*").alias("n")).collect()
    return dealt, asked, sizes, {r["_cell"]: r["n"] for r in visits}


def knn_join(queries: DataFrame, base: DataFrame, key: str, vector: str, k: int = 5, metric: str = "euclidean", same: bool = False) -> DataFrame:
    """F15. (key, neighbour, distance, rank): the exact k nearest rows of ``base`` for each query, ties by key after 9 decimals.

    Both sides stay distributed. Rows are dealt to the cells of a cover tree's nodes, and large cells into parts; a query goes to the
    cells that its bound allows, and meets their parts in blocks of queries, so a task compares about ROW_BLOCK rows with
    QUERY_BLOCK queries. Only nodes, and k + 1 distances for each, are on the driver. The tree steers what is compared and never what is found.
    ``same``: both sides are one table, and a row isn't its own neighbour. Rows and queries without a full vector (with ``cosine``: of
    length 0) have no neighbours and are none; all vectors have as many entries. Keys of a side are unique."""
    cosine = metric == "cosine"

    def ready(df: DataFrame, name: str) -> DataFrame:
        v = F.col("_v")
        found = df.where(_usable(vector)).select(F.col(key).alias(name), F.col(vector).cast("array<double>").alias("_v"))
        if not cosine:
            return found
        length = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))
        return found.withColumn("_l", length).where("_l > 0").select(name, F.transform(v, lambda x: x / F.col("_l")).alias("_v"))

    q, b = ready(queries, "_q"), ready(base, "_b")
    kinds = {c: x.schema[c].dataType for x, c in ((q, "_q"), (b, "_b"))}
    n = b.count()
    nodes = min(NODES, -(-n // CELL))
    result = f"{key} {kinds['_q'].simpleString()}, neighbour {kinds['_b'].simpleString()}, distance double, rank int"
    if nodes <= 1:  # one cell: there is nothing to leave out
        dealt, asked = b.withColumn("_cell", F.lit(0)), q.withColumn("_cells", F.array(F.lit(0)))
        sizes, visits = {0: n}, {0: q.count() if n else 0}
    else:
        dealt, asked, sizes, visits = _dealt(q, b, n, nodes, k, k + same, cosine)
    plan = [(c, -(-sizes[c] // ROW_BLOCK), -(-m // QUERY_BLOCK)) for c, m in visits.items() if m]
    if not plan:
        return q.sparkSession.createDataFrame([], result)
    cells = F.broadcast(q.sparkSession.createDataFrame(plan, "_cell int, _parts int, _blocks int"))  # a row for each node at most
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    deal = lambda name, c: F.pmod(F.xxhash64(name), F.col(c)).cast("int")
    left = dealt.join(cells, "_cell").select("_b", "_v", "_cell", deal("_b", "_parts").alias("_part"), every("_blocks").alias("_block"))
    right = asked.select("_q", "_v", F.explode("_cells").alias("_cell")).join(cells, "_cell").select("_q", "_v", "_cell", every("_parts").alias("_part"), deal("_q", "_blocks").alias("_block"))
    on = ["_cell", "_part", "_block"]
    shape = f"_q {kinds['_q'].simpleString()}, _b {kinds['_b'].simpleString()}, distance double"
    met = left.groupBy(*on).cogroup(right.groupBy(*on)).applyInArrow(_compare(k, cosine, same, to_arrow_type(kinds["_b"])), shape)
    w = Window.partitionBy("_q").orderBy(F.round("distance", 9), "_b")
    return met.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("_q").alias(key), F.col("_b").alias("neighbour"), "distance", "rank")
