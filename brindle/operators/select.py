"""Feature selection, reduction and synthesis."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.feature import PCA, UnivariateFeatureSelector
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brindle.functions.keys import u
from brindle.operators.schema import cols_to_vector
from brindle.session import scratch


def select_variance(df: DataFrame, features: Sequence[str], t: float = 0.0) -> DataFrame:
    """E1. Without features whose sample variance is at most ``t``."""
    found = df.agg(*[F.var_samp(c).alias(c) for c in features]).first()
    return df.select(*[c for c in df.columns if c not in features or (found[c] or 0.0) > t])


def select_fwe(df: DataFrame, features: Sequence[str], label: str, alpha: float = 0.01, categorical: bool = True) -> list[str]:
    """E2. The features that pass a family-wise error test."""
    vector = cols_to_vector(df, features, "_v", dense=False)
    selector = UnivariateFeatureSelector(featuresCol="_v", labelCol=label, outputCol="_o", selectionMode="fwe")
    selector = selector.setFeatureType("continuous").setLabelType("categorical" if categorical else "continuous").setSelectionThreshold(alpha)
    return [features[i] for i in selector.fit(vector).selectedFeatures]


def f_scores(df: DataFrame, features: Sequence[str], target: str, classification: bool = True) -> DataFrame:
    """(feature, f): ANOVA F over classes, or r2 (n - 2) / (1 - r2) of a regression, from one aggregate."""
    if not classification:
        row = [F.struct(F.lit(c).alias("feature"), (F.pow(F.corr(c, target), F.lit(2.0)) * (F.count("*") - 2) / (1 - F.pow(F.corr(c, target), F.lit(2.0)))).alias("f")) for c in features]
        return df.agg(F.array(*row).alias("x")).select(F.inline("x"))
    by = df.groupBy(target).agg(F.count("*").alias("n"), *[F.avg(c).alias(f"m|{c}") for c in features], *[F.var_pop(c).alias(f"v|{c}") for c in features])
    rows = []
    for c in features:
        m, v = F.col(f"`m|{c}`"), F.col(f"`v|{c}`")
        total, k = F.sum("n"), F.count("*")
        between = F.sum(F.col("n") * m * m) - F.pow(F.sum(F.col("n") * m), F.lit(2.0)) / total
        within = F.sum(F.col("n") * v)
        rows.append(F.struct(F.lit(c).alias("feature"), ((between / (k - 1)) / (within / (total - k))).alias("f")))
    return by.agg(F.array(*rows).alias("x")).select(F.inline("x"))


def select_percentile(df: DataFrame, features: Sequence[str], target: str, pct: float = 50, classification: bool = True) -> DataFrame:
    """E3. The top ``pct`` percent of the features by F score (ties by name), and all other columns."""
    scores = f_scores(df, features, target, classification).orderBy(F.desc("f"), "feature").collect()
    keep = {r["feature"] for r in scores[: max(1, int(len(features) * pct / 100))]}
    return df.select(*[c for c in df.columns if c not in features or c in keep])


def select_univariate(df: DataFrame, features: Sequence[str], target: str, mode: str = "percentile", param: float = 50, classification: bool = True) -> DataFrame:
    """E4. Generic form of E3: the best share (``percentile``) or number (``k_best``) of features."""
    pct = param if mode == "percentile" else 100 * param / len(features)
    return select_percentile(df, features, target, pct, classification)


def binned(df: DataFrame, features: Sequence[str], nbins: int) -> DataFrame:
    """Equal-width bin numbers, 0 to nbins - 1, of each feature."""
    ends = df.agg(*[F.min(c).alias(f"l|{c}") for c in features], *[F.max(c).alias(f"h|{c}") for c in features]).first()
    width = {c: ((ends[f"h|{c}"] - ends[f"l|{c}"]) / nbins) or 1.0 for c in features}
    return df.withColumns({c: F.least(F.floor((F.col(c) - ends[f"l|{c}"]) / width[c]), F.lit(nbins - 1)).cast("int") for c in features})


def mutual_information(df: DataFrame, pairs: Sequence[tuple[Sequence[str], str]]) -> list[float]:
    """I(X; Y) in nats for each (columns of X, Y), the columns of X binned: all joint tables come from one grouping, keyed by
    the pair. A row becomes one for each pair, counted before the shuffle; a joint table has at most as many rows
    as there are combinations of bins and values of Y. Only the results come to the driver."""
    if not pairs:
        return []
    cells = [F.struct(F.lit(i).alias("pair"), F.array(*[F.col(c).cast("int") for c in xs]).alias("x"), F.col(y).cast("string").alias("y")) for i, (xs, y) in enumerate(pairs)]
    joint = df.select(F.explode(F.array(*cells)).alias("c")).groupBy("c.pair", "c.x", "c.y").agg(F.count("*").alias("n"))
    over = lambda *by: F.sum("n").over(Window.partitionBy("pair", *by))
    told = joint.withColumns({"nx": over("x"), "ny": over("y"), "total": over()})
    part = F.col("n") / F.col("total") * F.log(F.col("n").cast("double") * F.col("total") / (F.col("nx").cast("double") * F.col("ny")))
    found = dict(told.groupBy("pair").agg(F.sum(part)).collect())
    return [found.get(i, 0.0) for i in range(len(pairs))]


def select_jmi(df: DataFrame, features: Sequence[str], target: str, nbins: int = 5, k: int = 3) -> list[str]:
    """E5. Joint mutual information: the most informative feature, then each time the one with the largest
    sum of I(X, S; Y) over those chosen; ties by name."""
    bins = binned(df, features, nbins).select(*features, target)
    first = dict(zip(features, mutual_information(bins, [([c], target) for c in features]), strict=True))
    chosen = [min(features, key=lambda c: (-round(first[c], 9), c))]
    while len(chosen) < min(k, len(features)):
        rest = [c for c in features if c not in chosen]
        both = iter(mutual_information(bins, [([c, s], target) for c in rest for s in chosen]))
        gain = {c: sum(next(both) for _ in chosen) for c in rest}
        chosen.append(min(rest, key=lambda c: (-round(gain[c], 9), c)))
    return chosen


def select_mb(df: DataFrame, features: Sequence[str], target: str, nbins: int = 4, least: float = 1e-3) -> list[str]:
    """E6. Markov blanket by score: features are added while I(X; Y | chosen) grows by ``least``, then those
    are taken out whose removal costs less."""
    bins = binned(df, features, nbins).select(*features, target)
    info = lambda sets: mutual_information(bins, [(s, target) for s in sets])
    chosen: list[str] = []
    now = 0.0
    while len(chosen) < min(4, len(features)):
        rest = [c for c in features if c not in chosen]
        gains = {c: x - now for c, x in zip(rest, info([[*chosen, c] for c in rest]), strict=True)}
        best = min(gains, key=lambda c: (-round(gains[c], 9), c))
        if gains[best] < least:
            break
        chosen.append(best)
        now += gains[best]
    while len(chosen) > 1:
        left = dict(zip(chosen, info([[x for x in chosen if x != c] for c in chosen]), strict=True))
        worst = next((c for c in chosen if now - left[c] < least), None)
        if worst is None:
            break
        chosen.remove(worst)
        now = left[worst]
    return chosen


def select_smb(df: DataFrame, features: Sequence[str], target: str, nbins: int = 4, least: float = 1e-3) -> list[str]:
    """E7. Markov blanket, simultaneous: a feature stays if it informs the target given each other one."""
    bins = binned(df, features, nbins).select(*features, target)
    pairs = [(a, b) for a in features for b in features if a != b]
    told = mutual_information(bins, [*(([c], target) for c in features), *(([a, b], target) for a, b in pairs)])
    alone, both = dict(zip(features, told, strict=False)), dict(zip(pairs, told[len(features) :], strict=True))
    keep = [c for c in features if alone[c] >= least]
    return [a for a in keep if all(both[a, b] - alone[b] >= least for b in keep if b != a)] or keep[:1]


def pca(df: DataFrame, vector: str, k: int, out: str = "pca") -> DataFrame:
    """E8. Principal components of an array column."""
    ready = df.withColumn("_v", array_to_vector(F.transform(F.col(vector), lambda x: x.cast("double"))))
    model = PCA(k=k, inputCol="_v", outputCol="_p").fit(ready)
    return model.transform(ready).withColumn(out, vector_to_array("_p")).drop("_v", "_p")


def _array(values) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)


def kernel_pca(df: DataFrame, vector: str, key: str, k: int = 4, kernel: str = "rbf", landmarks: int = 32, gamma: float = 1.0) -> DataFrame:
    """E9. Kernel PCA by Nystroem: kernels to a fixed number of landmark rows (first by key bucket), then PCA."""
    rows = df.select(vector).orderBy(u(key, "landmark"), key).limit(landmarks).collect()
    points = [[float(x) for x in r[0]] for r in rows]

    def value(p: list[float]) -> Column:
        dot, own = _dot(F.col(vector), _array(p)), sum(x * x for x in p)
        norm = _dot(F.col(vector), F.col(vector).cast("array<double>"))
        return {"rbf": F.exp(-gamma * (norm - 2 * dot + own)), "cosine": dot / F.sqrt(norm * own), "sigmoid": F.tanh(gamma * dot + 1), "poly": F.pow(gamma * dot + 1, F.lit(3.0))}[kernel]

    gram = np.array([[sum(a * b for a, b in zip(p, q, strict=True)) for q in points] for p in points])
    norms = np.diag(gram)
    full = {"rbf": np.exp(-gamma * (norms[:, None] - 2 * gram + norms)), "cosine": gram / np.sqrt(np.outer(norms, norms)), "sigmoid": np.tanh(gamma * gram + 1), "poly": (gamma * gram + 1) ** 3}[kernel]
    values, vectors = np.linalg.eigh(full)
    root = vectors @ np.diag(1 / np.sqrt(np.maximum(values, 1e-6))) @ vectors.T
    mapped = df.withColumn("_k", F.array(*[value(p) for p in points]))
    mapped = mapped.withColumn("_f", F.array(*[_dot(F.col("_k"), _array(row)) for row in root]))
    return pca(mapped, "_f", k, "kernel_pca").drop("_k", "_f")


def huber_pca(df: DataFrame, features: Sequence[str], k: int = 2, t: float = 2.0, rounds: int = 3) -> DataFrame:
    """E10. Robust PCA: rows far from the fitted plane get weight t / r, and the plane is fitted again from
    weighted moments, which one aggregate gives."""
    weight: Column = F.lit(1.0)
    d = len(features)
    for _ in range(rounds):
        w = df.withColumn("_w", weight)
        sums = [F.sum("_w").alias("s")] + [F.sum(F.col("_w") * F.col(c)).alias(f"m{i}") for i, c in enumerate(features)]
        sums += [F.sum(F.col("_w") * F.col(a) * F.col(b)).alias(f"c{i}_{j}") for i, a in enumerate(features) for j, b in enumerate(features) if i <= j]
        r = w.agg(*sums).first()
        mean = np.array([r[f"m{i}"] / r["s"] for i in range(d)])
        cov = np.array([[r[f"c{min(i, j)}_{max(i, j)}"] / r["s"] for j in range(d)] for i in range(d)]) - np.outer(mean, mean)
        basis = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
        basis = basis * np.where(basis[np.abs(basis).argmax(axis=0), range(k)] < 0, -1, 1)
        centred = F.array(*[F.col(c) - float(m) for c, m in zip(features, mean, strict=True)])
        parts = [_dot(centred, _array(basis[:, j])) for j in range(k)]
        residual = F.sqrt(F.greatest(_dot(centred, centred) - sum((p * p for p in parts[1:]), parts[0] * parts[0]), F.lit(0.0)))
        scale = float(np.sqrt(max(np.trace(cov) - np.linalg.eigvalsh(cov)[::-1][:k].sum(), 1e-12)))
        weight = F.least(F.lit(1.0), F.lit(t * scale) / F.greatest(residual, F.lit(1e-12)))
    return df.withColumns({f"pc{j + 1}": p for j, p in enumerate(parts)} | {"weight": weight})


def sign(i: int, j: int) -> float:
    """+1 or -1 from the md5 bucket of ``i-j``."""
    import hashlib

    return 1.0 if int(hashlib.md5(f"{i}-{j}".encode()).hexdigest()[:8], 16) / 4294967296 < 0.5 else -1.0


def random_projection(df: DataFrame, vector: str, size: int, k: int = 4) -> DataFrame:
    """E11. ``size`` values to ``k`` by a matrix of +1 and -1 over sqrt(k)."""
    rows = [_array(sign(i, j) / k**0.5 for i in range(size)) for j in range(k)]
    return df.withColumns({f"rp{j}": _dot(F.col(vector), row) for j, row in enumerate(rows)})


def prune_similar(df: DataFrame, groups: DataFrame | None = None, hi: float = 0.9, lo: float = 0.4) -> DataFrame:
    """E12. ``df(column, ord, vec)``: columns are taken in order; one with a cosine over ``hi`` or under
    ``lo`` to a column joins its group. Of each group the column with most such matches stays (ties by
    order). Returns (column, matches) of those that stay."""
    a, b = df.alias("a"), df.alias("b")
    norm = lambda c: F.sqrt(_dot(F.col(c), F.col(c)))
    pairs = a.join(b, F.col("a.column") != F.col("b.column")).withColumn("cos", _dot(F.col("a.vec"), F.col("b.vec")) / (norm("a.vec") * norm("b.vec")))
    near = pairs.where((F.col("cos") > hi) | (F.col("cos") < lo)).select(F.col("a.column").alias("column"), F.col("a.ord").alias("ord"), F.col("b.ord").alias("other"))
    counts = df.join(near, ["column", "ord"], "left").groupBy("column", "ord").agg(F.count("other").alias("matches"), F.least(F.min("other"), F.min("ord")).alias("head"))
    counts = counts.withColumn("head", F.coalesce("head", "ord"))
    best = counts.groupBy("head").agg(F.max_by(F.struct("column", "matches"), F.struct("matches", -F.col("ord"))).alias("x"))
    return best.select("x.*")


def synthesize_single(df: DataFrame, numbers: Sequence[str] = (), texts: Sequence[str] = (), dates: Sequence[str] = ()) -> DataFrame:
    """E13. Ratios of neighbouring numbers, text lengths and date parts, in one projection."""
    out = {f"{a}_per_{b}": F.try_divide(F.col(a), F.col(b)) for a, b in zip(numbers, numbers[1:], strict=False)}
    out |= {f"{c}_length": F.length(c) for c in texts}
    out |= {f"{c}_{name}": f(c) for c in dates for name, f in (("year", F.year), ("month", F.month), ("day", F.dayofmonth))}
    return df.withColumns(out)


def synthesize_multi(parent: DataFrame, child: DataFrame, key: str, child_key: str, numbers: Sequence[str], texts: Sequence[str] = (), prefix: str = "child") -> DataFrame:
    """E14. Aggregates of a child table on the parent's key: one partial aggregate, one join. Parents without
    children have count 0 and nulls."""
    aggs = [F.count("*").alias(f"{prefix}_count")]
    for c in numbers:
        aggs += [f(c).alias(f"{prefix}_{c}_{n}") for n, f in (("sum", F.sum), ("avg", F.avg), ("min", F.min), ("max", F.max), ("std", F.stddev_samp))]
    aggs += [F.count_distinct(c).alias(f"{prefix}_{c}_distinct") for c in texts]
    by = child.groupBy(F.col(child_key).alias("_key")).agg(*aggs)
    return parent.join(by, parent[key] == by["_key"], "left").drop("_key").fillna(0, [f"{prefix}_count"])
