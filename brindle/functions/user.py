"""User extension surface (L1 to L4)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf, udtf

STEPS: dict[str, type] = {}


def register_step(name: str, cls: type) -> None:
    """L1. Make a Transformer or Estimator known by name."""
    if name in STEPS:
        raise ValueError(f"step {name} exists")
    STEPS[name] = cls


def make_step(name: str, **params):
    """L1. An instance of a registered step."""
    return STEPS[name](**params)


def map_rows(df: DataFrame, fn: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """L2. A vectorized function of batches of rows."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield fn(batch)

    return df.mapInPandas(run, schema)


def metric_udf(fn: Callable[[pd.Series, pd.Series], float]):
    """L3. A user metric of truth and predictions as an aggregate. It sees a whole group, so it is for the
    groups of a score table (candidate, fold), not for unbounded ones."""

    def metric(truth: pd.Series, pred: pd.Series) -> float:
        return float(fn(truth, pred))

    return pandas_udf(metric, "double")


def explode_udtf(fn: Callable[[str], list[tuple]], schema: str):
    """L4. A table function: one value to many rows."""

    class Rows:
        def eval(self, value: str):
            yield from fn(value)

    return udtf(Rows, returnType=schema)


def mean_absolute(truth: pd.Series, pred: pd.Series) -> float:
    """A sample metric for L3."""
    return (truth - pred).abs().mean()


def half_up(batch: pd.DataFrame) -> pd.DataFrame:
    """A sample batch function for L2: values times two."""
    return batch.assign(value=batch["value"] * 2)


def tokens_of(value: str) -> list[tuple]:
    """A sample table function for L4: the parts of a dashed string."""
    return [(i, part) for i, part in enumerate((value or "").split("-"))]


def group_key(*columns: str):
    return F.concat_ws("|", *columns)
