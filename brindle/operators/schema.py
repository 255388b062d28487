"""Column roles, selection by role, and type conversion."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KEY = "row_id"
RESERVED = ("confidence", "d3mIndex")
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)


@dataclass(frozen=True)
class Problem:
    """A task: its targets, kind, metrics, keywords and columns that only training may see."""

    targets: tuple[str, ...]
    task: str = "classification"
    metrics: tuple[str, ...] = ("f1Macro",)
    keywords: tuple[str, ...] = ()
    privileged: tuple[str, ...] = ()
    pos_label: str | None = None


def roles_of(df: DataFrame, name: str) -> list[str]:
    return list(df.schema[name].metadata.get("roles", []))


def with_roles(df: DataFrame, roles: dict[str, Sequence[str]]) -> DataFrame:
    """Give columns their roles; other metadata stays."""
    for name, own in roles.items():
        df = df.withMetadata(name, df.schema[name].metadata | {"roles": list(own)})
    return df


def set_roles(df: DataFrame, problem: Problem) -> DataFrame:
    """B1. Suggested targets become plain attributes unless they are the problem's; true targets lose the
    attribute role; privileged columns are marked."""
    out = {}
    for name in df.columns:
        own = [r for r in roles_of(df, name) if r not in ("suggestedTarget", "target", "trueTarget", "privileged")]
        if name in problem.targets:
            own = [r for r in own if r != "attribute"] + ["target", "trueTarget"]
        elif name in problem.privileged:
            own = own + ["privileged"]
        out[name] = own
    return with_roles(df, out)


def select_roles(df: DataFrame, roles: Sequence[str], use: Sequence[str] = (), exclude: Sequence[str] = ()) -> DataFrame:
    """B2. Columns with any of ``roles``, and those in ``use``, without ``exclude``, in their order."""
    keep = [c for c in df.columns if (set(roles) & set(roles_of(df, c)) or c in use) and c not in exclude]
    return df.select(*keep)


def drop_roles(df: DataFrame, roles: Sequence[str]) -> DataFrame:
    """B3. Without the columns that have any of ``roles``."""
    return df.select(*[c for c in df.columns if not set(roles) & set(roles_of(df, c))])


def drop_augmented(df: DataFrame, original: Sequence[str]) -> DataFrame:
    """B4. Without columns that augmentation added (role ``augmented``), the others in original order."""
    kept = [c for c in df.columns if "augmented" not in roles_of(df, c)]
    return df.select(*[c for c in original if c in kept], *[c for c in kept if c not in original])


def as_text(df: DataFrame, name: str) -> Column:
    """A value as text; arrays joined by commas."""
    if isinstance(df.schema[name].dataType, T.ArrayType):
        return F.array_join(F.transform(F.col(name), lambda x: x.cast("string")), ",")
    return F.col(name).cast("string")


def target_frame(df: DataFrame, key: str, targets: Sequence[str]) -> DataFrame:
    """B5. Key first, then the targets as text. Reserved or repeated names and missing keys raise."""
    if len(set(targets)) != len(targets) or set(targets) & set(RESERVED):
        raise ValueError("a target's name is reserved or repeated")
    if key not in df.columns:
        raise ValueError(f"no key column {key}")
    return df.select(F.col(key).cast("string").alias(key), *[as_text(df, t).alias(t) for t in targets])


def check_key(df: DataFrame, key: str) -> None:
    """Raise if the key is null or repeated anywhere (one aggregate)."""
    bad = df.groupBy(key).count().where(F.col(key).isNull() | (F.col("count") > 1))
    if not bad.isEmpty():
        raise ValueError(f"{key} is missing or repeated")


def parse_columns(df: DataFrame, types: dict[str, str]) -> DataFrame:
    """B6. Text columns to their declared types; what doesn't parse is null."""
    out = {}
    for name, kind in types.items():
        text = F.trim(F.col(name))
        if kind == "dateTime":
            out[name] = F.try_to_timestamp(text)
        elif kind == "realVector":
            out[name] = F.transform(F.split(text, ","), lambda x: x.try_cast("double"))
        elif kind in ("string", "text", "categorical", "json"):
            out[name] = F.col(name)
        else:
            out[name] = text.try_cast({"integer": "bigint", "real": "double", "boolean": "boolean"}[kind])
    return df.withColumns(out)


def cast_to(df: DataFrame, columns: Sequence[str], kind: str) -> DataFrame:
    """B7. Cast columns to one type; values that don't fit are null."""
    return df.withColumns({c: F.col(c).try_cast(kind) for c in columns})


def to_numeric(df: DataFrame, keep: Sequence[str] = (), drop_non_numeric: bool = True) -> DataFrame:
    """B8. All columns but ``keep`` to double; those without a single number are dropped if asked."""
    names = [c for c in df.columns if c not in keep]
    cast = df.withColumns({c: F.col(c).try_cast("double") for c in names})
    if not drop_non_numeric or not names:
        return cast
    found = cast.agg(*[F.count(c).alias(c) for c in names]).first()
    return cast.select(*[c for c in df.columns if c in keep or found[c]])


def drop_empty_targets(df: DataFrame, problem: Problem) -> DataFrame:
    """B9. Without rows whose target is null or empty; clustering keeps all."""
    if problem.task == "clustering":
        return df
    for t in problem.targets:
        df = df.where(F.col(t).isNotNull() & (F.col(t).cast("string") != ""))
    return df


def construct_predictions(df: DataFrame, key: str, pred: str, target: str) -> DataFrame:
    """B10. Key and prediction under the target's name."""
    return df.select(key, F.col(pred).alias(target))


def cols_to_vector(df: DataFrame, columns: Sequence[str], out: str, dense: bool = True) -> DataFrame:
    """B11. Columns to one array (or ML vector)."""
    array = F.array(*[F.col(c).cast("double") for c in columns])
    return df.withColumn(out, array if dense else array_to_vector(array))


def vector_to_cols(df: DataFrame, column: str, size: int, prefix: str) -> DataFrame:
    """B11. An array or ML vector to ``size`` columns."""
    kind = df.schema[column].dataType
    array = F.col(column) if isinstance(kind, T.ArrayType) else vector_to_array(F.col(column))
    return df.withColumns({f"{prefix}{i}": F.get(array, F.lit(i)) for i in range(size)})


def compose_group_key(df: DataFrame, columns: Sequence[str], out: str = "group_key") -> DataFrame:
    """B12. Several grouping columns as one key."""
    return df.withColumn(out, F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]))


def condition(df: DataFrame, keep: Sequence[str], max_expansion: int = 30) -> DataFrame:
    """B13. Numbers only: numeric columns as double, text columns of at most ``max_expansion`` values as
    one 0/1 column for each, wider ones dropped."""
    from brindle.operators.encode import one_hot

    names = [f.name for f in df.schema if f.name not in keep]
    numbers = [c for c in names if isinstance(df.schema[c].dataType, NUMERIC)]
    texts = [c for c in names if c not in numbers]
    sizes = df.agg(*[F.count_distinct(c).alias(c) for c in texts]).first() if texts else {}
    narrow = [c for c in texts if sizes[c] <= max_expansion]
    out = df.select(*keep, *[F.col(c).cast("double").alias(c) for c in numbers], *narrow)
    return one_hot(out, narrow, max_values=max_expansion)
