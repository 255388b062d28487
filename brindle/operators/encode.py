"""Encoding, text features and scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.clustering import LDA
from pyspark.ml.feature import CountVectorizer, MaxAbsScaler, RegexTokenizer, RobustScaler, StandardScaler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brindle.operators.ranks import number_rows, quantiles, sorted_blocks
from brindle.operators.schema import cols_to_vector, vector_to_cols
from brindle.session import scratch

#: Columns that one source column may become.
MAX_COLUMNS = 1_000
#: Terms that go to every task, in bytes at most; rows from which on a term is dealt with apart where there are more.
TERM_BYTES, HOT_ROWS = 64_000_000, 1_000_000


def top_values(df: DataFrame, column: str, n: int) -> list:
    """The ``n`` most frequent values, ties by value; never more than ``n`` reach the driver."""
    rows = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n")).orderBy(F.desc("n"), column).limit(n)
    return [r[0] for r in rows.collect()]


def encode(df: DataFrame, columns: Sequence[str], n_limit: int = 12) -> DataFrame:
    """D1. 0/1 columns for the top values, the rest to ``other``, nulls to ``null``."""
    out = {}
    for c in columns:
        top = top_values(df, c, n_limit)
        out |= {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in top}
        out |= {f"{c}_other": F.coalesce((~F.col(c).isin(top)).cast("int"), F.lit(0)), f"{c}_null": F.col(c).isNull().cast("int")}
    return df.withColumns(out).drop(*columns)


def label_index(df: DataFrame, column: str) -> DataFrame:
    """(value, label): values by descending count, ties by value, from 0."""
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    order = [F.desc("n"), F.asc("value")]
    return number_rows(sorted_blocks(counts, order), [], F.col("_at"), order).select("value", (F.col("nth") - 1).cast("int").alias("label"))


def label_encode(df: DataFrame, column: str, out: str) -> DataFrame:
    """D2. Values to numbers by descending frequency; null stays null."""
    return df.join(label_index(df, column), F.col(column) == F.col("value"), "left").withColumnRenamed("label", out).drop("value")


def label_decode(df: DataFrame, index: DataFrame, column: str, out: str) -> DataFrame:
    """D2. Numbers back to values."""
    return df.join(index.withColumnRenamed("value", out), F.col(column) == F.col("label"), "left").drop("label")


def one_hot(df: DataFrame, columns: Sequence[str], max_values: int = 16) -> DataFrame:
    """D3. 0/1 columns for at most ``max_values`` values; unknown ones are 0 everywhere."""
    out = {}
    for c in columns:
        out |= {f"{c}_{v}": F.coalesce((F.col(c) == v).cast("int"), F.lit(0)) for v in top_values(df, c, max_values)}
    return df.withColumns(out).drop(*columns)


def binary_encode(df: DataFrame, column: str, min_values: int = 17) -> DataFrame:
    """D4. The bits of a value's index (from 1, by count then value); narrower columns stay. Null is 0."""
    index = label_index(df, column)
    n = index.count()
    if n < min_values:
        return df
    joined = df.join(index, F.col(column) == F.col("value"), "left").withColumn("_i", F.coalesce(F.col("label") + 1, F.lit(0)))
    bits = {f"{column}_b{b}": F.getbit(F.col("_i"), F.lit(b)).cast("int") for b in range(n.bit_length())}
    return joined.withColumns(bits).drop("value", "label", "_i", column)


def unary_encode(df: DataFrame, column: str) -> DataFrame:
    """D5. Thermometer code of the sorted distinct values: column k is 1 from value k on. More values than
    MAX_COLUMNS raise, since each is a column."""
    values = [r[0] for r in df.where(F.col(column).isNotNull()).select(column).distinct().orderBy(column).limit(MAX_COLUMNS + 1).collect()]
    if len(values) > MAX_COLUMNS:
        raise ValueError(f"{column} has more than {MAX_COLUMNS} values")
    return df.withColumns({f"{column}_ge{k}": F.coalesce((F.col(column) >= F.lit(v)).cast("int"), F.lit(0)) for k, v in enumerate(values)})


def tokens(column: str | Column) -> Column:
    """Lower-case word tokens."""
    column = F.col(column) if isinstance(column, str) else column
    return F.regexp_extract_all(F.lower(F.coalesce(column, F.lit(""))), F.lit("[a-z]+"), F.lit(0))


def term_counts(df: DataFrame, by: Sequence[str], terms: Column) -> DataFrame:
    """(*by, term, tf), written once; the first of ``by`` is the row's key. Texts are dealt by it before they are cut up, so their terms
    are counted where they are, and a text crosses the network instead of its many terms."""
    dealt = df.repartition(by[0]).select(*by, F.explode(terms).alias("term"))
    return scratch(dealt.groupBy(*by, "term").agg(F.count("*").alias("tf")), "terms")


def join_terms(rows: DataFrame, terms: DataFrame) -> DataFrame:
    """``rows`` with what ``terms`` (written; term, df and more) says of their term. ``df`` is the number of rows that a term has. Up to
    TERM_BYTES of terms go to the tasks. Of more, only those that have over a million rows and one of 10,000 of all rows do,
    10,000 at most, and the rest meets its rows by a shuffle in which no term is hot."""
    told = terms.agg(F.sum(F.octet_length("term") + 8 * len(terms.columns)).alias("bytes"), F.sum("df").alias("rows")).first()
    if (told["bytes"] or 0) <= TERM_BYTES:
        return rows.join(F.broadcast(terms), "term")
    hot = F.col("df") > max(HOT_ROWS, told["rows"] // 10_000)
    often = F.broadcast(terms.where(hot))
    return rows.join(often, "term").unionByName(rows.join(often.select("term"), "term", "left_anti").join(terms.where(~hot), "term"))


def text_encode(df: DataFrame, key: str, text: str, target: str) -> DataFrame:
    """D6. For each class c the mean over a row's tokens of ln((n_tc + 1) / (n_t + V)); no token: 0."""
    words = term_counts(df.select(key, target, text), [key, target], tokens(text))
    counts = words.groupBy("term", target).agg(F.sum("tf").alias("n"), F.count("*").alias("df"))
    classes = df.select(F.col(target).alias("class")).where("class is not null").distinct()
    v = classes.count()
    grid = counts.groupBy("term").agg(F.sum("n").alias("total"), F.sum("df").alias("df"), F.map_from_entries(F.collect_list(F.when(F.col(target).isNotNull(), F.struct(target, "n")))).alias("by"))
    if v > MAX_COLUMNS:
        raise ValueError(f"{target} has more than {MAX_COLUMNS} classes")
    names = sorted(r[0] for r in classes.collect())
    weights = grid.select("term", "df", *[F.log((F.coalesce(F.try_element_at("by", F.lit(c)), F.lit(0)) + 1) / (F.col("total") + v)).alias(f"w_{c}") for c in names])
    told = join_terms(words.select(key, "term", "tf"), scratch(weights, "term-weights"))
    means = told.groupBy(key).agg(*[(F.sum(F.col(f"w_{c}") * F.col("tf")) / F.sum("tf")).alias(f"{text}_{c}") for c in names])
    return df.join(means, key, "left").fillna(0.0, [f"{text}_{c}" for c in names])


def ngrams(column: str, n: int) -> Column:
    """Word n-grams of a text; shorter texts have none. The text is cut into words once, not once for each n-gram."""
    t = tokens(column)
    if n == 1:
        return t
    places = lambda w: F.sequence(F.lit(1), F.size(w) - n + 1)
    grams = lambda w: F.when(F.size(w) >= n, F.transform(places(w), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.element_at(F.transform(F.array(t), grams), 1)


def count_vector(df: DataFrame, key: str, column: str, n: int = 1, min_df: int = 1, max_df: float = 1.0) -> DataFrame:
    """D7. Sparse counts in long form, (key, term, tf, df), of terms in ``min_df`` documents at least and in a
    share of ``max_df`` at most."""
    total = df.count()
    tf = term_counts(df.select(key, column), [key], ngrams(column, n))
    known = tf.groupBy("term").agg(F.count("*").alias("df")).where((F.col("df") >= min_df) & (F.col("df") <= max_df * total))
    return join_terms(tf, scratch(known, "term-rows")).select(key, "term", "tf", "df")


def tfidf(df: DataFrame, key: str, column: str) -> DataFrame:
    """D8. (key, term, tfidf) with the raw count and ln((N + 1) / (df + 1))."""
    total = df.count()
    return count_vector(df, key, column).select(key, "term", (F.col("tf") * F.log(F.lit(total + 1.0) / (F.col("df") + 1))).alias("tfidf"))


def topics(df: DataFrame, column: str, k: int = 5, iters: int = 10, vocabulary: int = 2_000, share: float = 0.5) -> DataFrame:
    """D9. Topic shares of each text by online LDA."""
    words = RegexTokenizer(inputCol=column, outputCol="_words", pattern="[^a-z]+").transform(df.fillna("", [column]))
    counted = CountVectorizer(inputCol="_words", outputCol="_counts", vocabSize=vocabulary, minDF=2).fit(words).transform(words)
    model = LDA(k=k, maxIter=iters, optimizer="online", subsamplingRate=share, featuresCol="_counts", seed=7).fit(counted)
    return model.transform(counted).withColumn("topics", vector_to_array("topicDistribution")).drop("_words", "_counts", "topicDistribution")


def text_factors(df: DataFrame, columns: Sequence[str], n_hidden: int = 5, threshold: float = 50.0) -> DataFrame:
    """D10. Long text columns become ``n_hidden`` latent factors each; those of a mean length below
    ``threshold`` stay. Topics stand in for correlation explanation."""
    lengths = df.agg(*[F.avg(F.length(c)).alias(c) for c in columns]).first()
    for c in columns:
        if (lengths[c] or 0.0) >= threshold:
            df = vector_to_cols(topics(df, c, n_hidden), "topics", n_hidden, f"{c}_factor").drop("topics", c)
    return df


def _scaled(df: DataFrame, columns: Sequence[str], scaler) -> DataFrame:
    vector = cols_to_vector(df, columns, "_v", dense=False)
    scaler = scaler.setInputCol("_v").setOutputCol("_s")
    out = scaler.fit(vector).transform(vector).withColumn("_a", vector_to_array("_s"))
    return out.withColumns({c: F.get("_a", F.lit(i)) for i, c in enumerate(columns)}).drop("_v", "_s", "_a")


def scale_maxabs(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D11. Each column over its largest absolute value."""
    return _scaled(df, columns, MaxAbsScaler())


def scale_iqr(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D12. (x - median) / (Q3 - Q1), exact quartiles; a range of 0 counts as 1."""
    q = quantiles(df, {c: F.col(c) for c in columns}, (0.25, 0.5, 0.75))
    return df.withColumns({c: (F.col(c) - q[c][1]) / ((q[c][2] - q[c][0]) or 1.0) for c in columns if q[c][1] is not None})


def scale_robust(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D13. Like D12 with approximate quartiles, in one mergeable pass."""
    return _scaled(df, columns, RobustScaler(withCentering=True, withScaling=True))


def scale_standard(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """D14. Mean 0 and sample standard deviation 1."""
    return _scaled(df, columns, StandardScaler(withMean=True, withStd=True))
