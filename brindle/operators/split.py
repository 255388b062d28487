"""Splitting and weighted sampling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brindle.functions.keys import u
from brindle.operators.ranks import blocks_of, number_rows, quantile_blocks
from brindle.session import scratch


def _shuffled(df: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Adds _nth (from 1) and _all: the place in the order of the key's bucket and the size of the group."""
    tossed = df.withColumn("_u", u(key))
    return number_rows(tossed, by, blocks_of(F.col("_u"), df.count()), ["_u", key], "_nth", "_all").drop("_u")


def split_holdout(df: DataFrame, key: str, test: float = 0.1, stratify: str | None = None) -> DataFrame:
    """G1. Adds part: the last ``test`` share of each stratum, in the order of the key's bucket, is ``test``."""
    placed = _shuffled(df, key, [stratify] if stratify else [])
    late = F.col("_nth") > F.col("_all") - F.floor(F.col("_all") * test)
    return placed.withColumn("part", F.when(late, "test").otherwise("train")).drop("_nth", "_all")


def _folds(placed: DataFrame, n: int) -> DataFrame:
    return placed.withColumn("fold", ((F.col("_nth") - 1) % n).cast("int")).drop("_nth", "_all")


def split_kfold(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """G2. Adds fold: the place in the order of the key's bucket, modulo ``n``."""
    return _folds(_shuffled(df, key), n)


def split_stratified(df: DataFrame, key: str, target: str, n: int = 5) -> DataFrame:
    """G3. Like G2 within each class; plain if a class has fewer rows than folds."""
    least = df.groupBy(target).count().agg(F.min("count")).first()[0]
    if least is None or least < n:
        return split_kfold(df, key, n)
    return _folds(_shuffled(df, key, [target]), n)


def split_time(df: DataFrame, ts: str, key: str, n: int = 5) -> DataFrame:
    """G4. Adds tile, 1 to n + 1, by time; fold k trains on tiles up to k and tests on tile k + 1. The first
    tiles take one row more where the rows don't divide evenly."""
    placed = number_rows(df, (), quantile_blocks(df, ts, df.count()), [ts, key], "_nth", "_all")
    tiles, at = n + 1, F.col("_nth") - 1
    size, more = F.floor(F.col("_all") / tiles), F.col("_all") % tiles
    tile = F.when(at < more * (size + 1), F.floor(at / (size + 1))).otherwise(more + F.floor((at - more * (size + 1)) / F.greatest(size, F.lit(1))))
    return placed.withColumn("tile", (tile + 1).cast("int")).drop("_nth", "_all")


def nested_splits(df: DataFrame, key: str, folds: int = 5, ensemble: float = 0.0, can_split: bool = True) -> DataFrame:
    """G5. Adds split: test1 (0.1 of all), then test2 (0.2 of the rest with 5 folds, else 0.1), perhaps
    ensemble, else train. Tasks that can't be split are all train."""
    if not can_split:
        return df.withColumn("split", F.lit("train"))
    second = 0.2 if folds == 5 else 0.1
    split = F.when(u(key, "one") < 0.1, "test1").when(u(key, "two") < second, "test2")
    if ensemble:
        split = split.when(u(key, "three") < ensemble, "ensemble")
    return df.withColumn("split", split.otherwise("train"))


def weighted_sample(df: DataFrame, key: str, weight: str, k: int, seed: str = "") -> DataFrame:
    """G6. ``k`` rows without replacement: the smallest -ln(u) / weight. A top-k, never a full sort."""
    return df.where(F.col(weight) > 0).withColumn("_s", -F.log(F.greatest(u(key, seed), F.lit(1e-12))) / F.col(weight)).orderBy("_s", key).limit(k).drop("_s")


def weighted_choice(df: DataFrame, key: str, weight: str, n: int, seed: str = "") -> DataFrame:
    """G7. ``n`` draws with replacement from a table of weights: (draw, key). Weights are summed in blocks along the
    key, 10,000 blocks at most; a draw finds its block, then its row by a join inside the block."""
    block = F.ascii(key) if isinstance(df.schema[key].dataType, StringType) else quantile_blocks(df, key, df.count())
    inside = Window.partitionBy("_block").orderBy(key)
    upto, before = inside.rowsBetween(Window.unboundedPreceding, 0), inside.rowsBetween(Window.unboundedPreceding, -1)
    sums = df.select(key, F.col(weight).alias("_w"), block.alias("_block"))
    sums = sums.withColumns({"_hi": F.sum("_w").over(upto), "_lo": F.coalesce(F.sum("_w").over(before), F.lit(0.0))})
    along = Window.orderBy("_block")
    blocks = sums.groupBy("_block").agg(F.max("_hi").alias("_all"))
    blocks = blocks.select("_block", F.coalesce(F.sum("_all").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("_from"), F.sum("_all").over(along.rowsBetween(Window.unboundedPreceding, 0)).alias("_to"))
    blocks = scratch(blocks, "weight-blocks")
    total = blocks.agg(F.max("_to")).first()[0] or 0.0
    draws = df.sparkSession.range(n).select(F.col("id").alias("draw"), (u("id", seed) * F.lit(float(total))).alias("_u"))
    draws = draws.join(F.broadcast(blocks), (F.col("_u") >= F.col("_from")) & (F.col("_u") < F.col("_to"))).withColumn("_u", F.col("_u") - F.col("_from"))
    return draws.join(sums, "_block").where((F.col("_u") < F.col("_hi")) & (F.col("_u") >= F.col("_lo"))).select("draw", key)
