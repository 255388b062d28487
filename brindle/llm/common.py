"""Helpers that several text operators share."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.session import counted

#: Rows that one task ranks at most, on average.
RANK_BLOCK = 2_000
#: Rows of a table of keys and numbers that may be broadcast.
SMALL = 500_000


def small(df: DataFrame, rows: int = SMALL) -> DataFrame:
    """``df``, marked for broadcast if it has ``rows`` rows or fewer, else left to a shuffle join. It is
    counted, so it should be a written table of narrow rows."""
    return F.broadcast(df) if counted(df) <= rows else df


def slices(batches: Iterator[pa.RecordBatch], rows: int = 1_000) -> Iterator[pa.RecordBatch]:
    """The same rows in smaller batches, so that a worker holds few texts in Python's own form at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def ranked(df: DataFrame, by: Sequence[str], order: Sequence[str], out: str, rows: int | None = None, block: Column | None = None) -> DataFrame:
    """Number the rows of each group of ``by`` from 0 without gaps, as ``out``.

    A group of any size is dealt over hash blocks of about ``RANK_BLOCK`` rows: each block is counted,
    the counts are summed along the group, and rows are numbered inside their block. No task ever
    holds a whole hot group. ``df`` is read twice, so it should be a written table. Rows that agree in
    ``order`` get their numbers in any order. ``rows``: how many rows ``df`` has, if known. ``block``: the
    blocks, numbered in the order in which they count, if hashes of ``order`` won't do.
    """
    rows = df.count() if rows is None else rows
    blocks = max(1, -(-rows // RANK_BLOCK))
    keys = [*by, "_block"]
    dealt = df.withColumn("_block", F.pmod(F.xxhash64(*order), F.lit(blocks)) if block is None else block)
    along = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = dealt.groupBy(*keys).agg(F.count("*").alias("_n"))
    starts = starts.withColumn("_start", F.coalesce(F.sum("_n").over(along), F.lit(0)))
    starts = starts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], "_start")
    inside = Window.partitionBy(*keys).orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside).cast("long") - 1)
    on: Column = F.lit(True)
    for i, k in enumerate(keys):
        on = on & numbered[k].eqNullSafe(starts[f"_k{i}"])
    return numbered.join(starts, on).select(*df.columns, (F.col("_row") + F.col("_start")).alias(out))
