"""Counts of terms: n-grams, and the join of rows with terms on both ways."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from brindle.operators import encode


def test_ngrams(spark):
    df = spark.createDataFrame([("A b, c D",), ("a",), ("",), (None,)], "t string")
    assert [r[0] for r in df.select(encode.ngrams("t", 2)).collect()] == [["a b", "b c", "c d"], [], [], []]
    assert [r[0] for r in df.select(encode.ngrams("t", 5)).collect()] == [[], [], [], []]


def test_a_long_text_is_cut_up_once(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}" for i in range(60_000)]
    found = spark.createDataFrame([(" ".join(words),)], "t string").select(F.size(encode.ngrams("t", 3))).first()[0]
    assert found == 59_998


@pytest.mark.parametrize(("held", "hot"), [(64_000_000, 1_000_000), (0, 3), (0, 1_000_000)])
def test_terms_meet_their_rows_on_every_way(spark, monkeypatch, held, hot):
    monkeypatch.setattr(encode, "TERM_BYTES", held)
    monkeypatch.setattr(encode, "HOT_ROWS", hot)
    texts = {1: "the cat and the dog", 2: "the bird", 3: "the cat the end", 4: "the", 5: None, 6: "a the b"}
    df = spark.createDataFrame(list(texts.items()), "id long, text string")
    counts = {i: Counter((t or "").split()) for i, t in texts.items()}
    rows = Counter(w for c in counts.values() for w in c)
    found = {(r["id"], r["term"], r["tf"], r["df"]) for r in encode.count_vector(df, "id", "text", min_df=1).collect()}
    assert found == {(i, w, n, rows[w]) for i, c in counts.items() for w, n in c.items()}
    coded = encode.text_encode(df.withColumn("kind", F.when(F.col("id") < 3, "x").when(F.col("id") < 6, "y")), "id", "text", "kind").collect()
    assert len(coded) == 6 and {r["id"]: r["text_x"] for r in coded}[5] == 0.0
