"""Exact row numbers along an order, without sending a table through one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import scratch

#: Rows of a block that one task orders, on average.
BLOCK = 50_000
#: Of the sketches that propose brackets: a cut is off by 1 / ACCURACY of the rows at most.
ACCURACY = 10_000


def blocks_of(uniform: Column, rows: int) -> Column:
    """Blocks in ascending order for a uniform value in [0, 1)."""
    return F.floor(uniform * max(1, -(-rows // BLOCK)))


def quantile_blocks(df: DataFrame, order: str, rows: int) -> Column:
    """Blocks in ascending order for any orderable numeric column or time, cut at approximate quantiles."""
    n = min(10_000, max(1, -(-rows // BLOCK)))
    if n == 1:
        return F.lit(0).cast("long")
    value = F.col(order).cast("timestamp").cast("double") if "timestamp" in df.schema[order].dataType.simpleString() else F.col(order).cast("double")
    cuts = df.agg(F.percentile_approx(value, [k / n for k in range(1, n)], 10_000)).first()[0] or []
    return F.size(F.filter(F.array(*[F.lit(float(c)) for c in sorted(set(cuts))]), lambda c: c <= value)).cast("long")


def sorted_blocks(df: DataFrame, order: Sequence, out: str = "_at") -> DataFrame:
    """``df`` written in ranges of any orderable columns, with the number of a row's range as ``out``."""
    df = scratch(df, "ranges")
    parts = -(-df.count() // BLOCK)
    if parts <= 1:
        return df.withColumn(out, F.lit(0))
    return scratch(df.repartitionByRange(parts, *order).withColumn(out, F.spark_partition_id()), "ranges")


def number_rows(df: DataFrame, by: Sequence[str], block: Column, order: Sequence[str], out: str = "nth", total: str | None = None) -> DataFrame:
    """Number the rows of each group from 1 in the order of (block, *order), as ``out``; ``total`` names a
    column for the group's size. Blocks are counted, the counts summed along the group, and rows are
    numbered inside their block, so the order is exact and no task holds more than a block."""
    dealt = df.withColumn("_block", block)
    group = [F.col(c) for c in by] or [F.lit(0)]
    along = Window.partitionBy(*group).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*by, "_block").agg(F.count("*").alias("_n"))
    starts = starts.withColumns({"_start": F.coalesce(F.sum("_n").over(along), F.lit(0)), "_all": F.sum("_n").over(Window.partitionBy(*group))})
    keys = [*by, "_block"]
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start", "_all")
    numbered = dealt.withColumn("_nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & numbered[k].eqNullSafe(starts[f"_k{i}"])
    more = [F.col("_all").alias(total)] if total else []
    return numbered.join(starts, on).select(*df.columns, (F.col("_start") + F.col("_nth")).alias(out), *more)


def scan(df: DataFrame, by: Sequence[str], block: Column, order: Sequence, outs: dict[str, tuple[str, Column]], backwards: bool = False) -> DataFrame:
    """Running sums or maxima of each group along (block, *order), this row included, as columns: ``outs`` is {name: (``sum`` or
    ``max``, value)}. ``backwards``: from this row to the end. Blocks are aggregated, their results run along the
    group, and rows are only run along inside their block. ``df`` is read twice, so it should be a written table."""
    fold = {"sum": F.sum, "max": F.max}
    dealt = df.withColumns({"_block": block} | {f"_x_{name}": value for name, (_, value) in outs.items()})
    keys = [*by, "_block"]
    first = Window.unboundedPreceding
    group = [F.col(c) for c in by] or [F.lit(0)]
    if backwards:  # along the order turned round: a frame that ends at the last row would be summed anew for each row
        dealt = dealt.withColumn("_x", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
        order = [F.desc("_x")]
    others = Window.partitionBy(*group).orderBy(F.desc("_block") if backwards else "_block").rowsBetween(first, -1)
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(first, 0)
    starts = dealt.groupBy(*keys).agg(*[fold[kind](f"_x_{name}").alias(f"_s_{name}") for name, (kind, _) in outs.items()])
    starts = starts.withColumns({f"_s_{name}": fold[kind](f"_s_{name}").over(others) for name, (kind, _) in outs.items()})
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], *[f"_s_{name}" for name in outs])
    run = dealt.withColumns({f"_x_{name}": fold[kind](f"_x_{name}").over(inside) for name, (kind, _) in outs.items()})
    on = F.lit(True)
    for i, k in enumerate(keys):
        on = on & run[k].eqNullSafe(starts[f"_k{i}"])
    joined = run.join(starts, on)
    both = {"sum": lambda a, b: F.coalesce(a + b, a, b), "max": F.greatest}
    return joined.select(*df.columns, *[both[kind](F.col(f"_s_{name}"), F.col(f"_x_{name}")).alias(name) for name, (kind, _) in outs.items()])


def quantiles(df: DataFrame, columns: dict[str, Column], shares: Sequence[float]) -> dict[str, list[float | None]]:
    """Exact quantiles of numbers, linear between neighbours, for each of ``columns`` by name; null for one without values.

    Each wanted rank is narrowed to a bracket of values: a sketch of the values inside proposes two cuts close to the rank, and a
    counted pass tells on which side of which cut the rank lies, so a poor sketch costs a pass and no exactness. A bracket
    loses its ends' values each time, however often they come. Values are gathered only from brackets of
    BLOCK rows or fewer. All columns and ranks share their passes; a pass is one aggregate of a few numbers.
    """
    value = {c: x.cast("double") for c, x in columns.items()}
    ends = df.agg(*[f(x).alias(f"{k}|{c}") for c, x in value.items() for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]).first()
    at = {(c, q): (ends[f"n|{c}"] - 1) * q for c in value for q in shares if ends[f"n|{c}"]}
    ranks = {(c, r) for (c, _), p in at.items() for r in (math.floor(p), math.ceil(p))}
    found: dict[tuple[str, int], float] = {}
    #: (column, rank): the bracket's ends, the rows before it and those in it
    open_ = {(c, r): (ends[f"low|{c}"], ends[f"high|{c}"], 0, ends[f"n|{c}"]) for c, r in ranks}
    while open_:
        for key, (low, high, _, _) in list(open_.items()):
            if low == high or math.isnan(low):
                found[key] = low
                del open_[key]
        jobs = list(open_.items())
        if not jobs:
            break
        asked = []
        for i, ((c, rank), (low, high, before, rows)) in enumerate(jobs):
            inside = F.when((value[c] >= low) & (value[c] <= high), value[c])
            if rows <= BLOCK:
                asked.append(F.get(F.array_sort(F.collect_list(inside)), F.lit(rank - before)).alias(f"v{i}"))
            else:
                near = [min(1.0, max(0.0, (rank - before) / rows + d)) for d in (-2 / ACCURACY, 2 / ACCURACY)]
                asked.append(F.percentile_approx(inside, near, ACCURACY).alias(f"v{i}"))
        told = df.agg(*asked).first()
        cut, counts = {}, []
        for i, (key, (low, high, _, rows)) in enumerate(jobs):
            if rows <= BLOCK:
                found[key] = told[f"v{i}"]
                del open_[key]
                continue
            x, (a, b) = value[key[0]], told[f"v{i}"]
            cut[i] = (a, b)
            inside = (x >= low) & (x <= high)
            parts = {"l": inside & (x < a), "a": x == a, "m": (x > a) & (x < b), "b": (x == b) & (x > a), "h": inside & (x > b)}
            for name, test in parts.items():
                counts += [f(F.when(test, x)).alias(f"{k}{name}{i}") for k, f in (("n", F.count), ("low", F.min), ("high", F.max))]
        told = df.agg(*counts).first() if counts else None
        for i in cut:
            key, (_, _, before, _) = jobs[i]
            for name in "lambh":  # in ascending order
                n = told[f"n{name}{i}"]
                if key[1] < before + n:
                    open_[key] = (told[f"low{name}{i}"], told[f"high{name}{i}"], before, n)
                    break
                before += n

    def between(c: str, q: float) -> float | None:
        if (c, q) not in at:
            return None
        p, low, high = at[c, q], math.floor(at[c, q]), math.ceil(at[c, q])
        return found[c, low] if low == high else (high - p) * found[c, low] + (p - low) * found[c, high]

    return {c: [between(c, q) for q in shares] for c in value}
