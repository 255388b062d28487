"""Running sums, maxima and row numbers over blocks, against plain loops."""

import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.functions import metrics
from brindle.operators import encode, ranks, select


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(ranks, "BLOCK", 7)


def test_scans_equal_loops(spark):
    rng = random.Random(1)
    rows = [(rng.choice(("a", "b", None)), i, rng.randrange(40) / 4, rng.choice((None, *range(9)))) for i in range(150)]
    df = spark.createDataFrame(rows, "g string, id int, s double, v int").repartition(3)
    block = ranks.quantile_blocks(df, "s", len(rows))
    assert df.select(block).distinct().count() > 5
    ahead = {r.id: (r.total, r.most) for r in ranks.scan(df, ["g"], block, ["s", "id"], {"total": ("sum", F.col("v")), "most": ("max", F.col("v"))}).collect()}
    back = {r.id: r.most for r in ranks.scan(df, [], block, ["s", "id"], {"most": ("max", F.col("v"))}, backwards=True).collect()}
    order = sorted(rows, key=lambda r: (r[2], r[1]))
    for i, row in enumerate(order):
        seen = [r[3] for r in order[: i + 1] if r[0] == row[0] and r[3] is not None]
        assert ahead[row[1]] == ((sum(seen), max(seen)) if seen else (None, None))
        later = [r[3] for r in order[i:] if r[3] is not None]
        assert back[row[1]] == (max(later) if later else None)


def test_labels_by_count_then_value(spark):
    values = [f"v{i % 50}" for i in range(90)] + [None]
    found = {r.value: r.label for r in encode.label_index(spark.createDataFrame([(v,) for v in values], "c string"), "c").collect()}
    want = sorted({v for v in values if v}, key=lambda v: (-values.count(v), v))
    assert found == {v: i for i, v in enumerate(want)}


def test_auc_and_top_k_in_small_blocks(spark):
    rng = random.Random(2)
    rows = [("c", "f", "t", i, str(rng.randrange(2)), float(rng.randrange(30)), rng.randrange(12) / 12) for i in range(120)]
    p = spark.createDataFrame(rows, "candidate_id string, fold string, target string, row_id int, truth string, pred double, confidence double")
    pos, neg = ([r[6] for r in rows if r[4] == x] for x in "10")
    want = sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg))
    assert metrics.roc_auc(p, "1").first().value == pytest.approx(want)
    p = p.withColumn("truth", (F.col("row_id") * 7 % 120).cast("string"))
    top = {r[3] for r in sorted(rows, key=lambda r: (-(r[3] * 7 % 120), r[3]))[:20]} & {r[3] for r in sorted(rows, key=lambda r: (-r[5], r[3]))[:20]}
    assert metrics.precision_at_k(p, 20).first().value == pytest.approx(len(top) / 20)


@pytest.mark.parametrize("accuracy", [3, 100])
def test_quantiles_are_exact_whatever_the_sketch(spark, monkeypatch, accuracy):
    monkeypatch.setattr(ranks, "ACCURACY", accuracy)
    rng = random.Random(accuracy)
    wide = [rng.choice((None, 10 ** rng.uniform(-200, 200), -rng.random())) for _ in range(400)]
    ties = [rng.choice((0.0, 0.0, 0.0, 1.0, 1.0, 2.5)) for _ in range(400)]
    two = [float(i % 2) for i in range(400)]
    df = spark.createDataFrame(list(zip(wide, ties, two, [None] * 400, strict=True)), "wide double, ties double, two double, none double").repartition(3)
    shares = (0.0, 0.1, 0.25, 0.5, 0.75, 0.997, 1.0)
    found = ranks.quantiles(df, {c: F.col(c) for c in df.columns}, shares)
    for name, values in (("wide", [x for x in wide if x is not None]), ("ties", ties), ("two", two)):
        for q, got in zip(shares, found[name], strict=True):
            assert math.isclose(got, float(np.quantile(values, q)), rel_tol=1e-9, abs_tol=1e-12), (name, q)
    assert found["none"] == [None] * len(shares)
    assert ranks.quantiles(df.limit(0), {"two": F.col("two")}, [0.5]) == {"two": [None]}


def test_mutual_information_equals_a_plain_sum(spark):
    rng = random.Random(5)
    rows = [(rng.randrange(4), rng.choice((0, 1, None)), rng.choice("ab")) for _ in range(300)]
    df = spark.createDataFrame(rows, "p int, q int, y string")
    found = select.mutual_information(df, [(["p"], "y"), (["p", "q"], "y")])

    def plain(xs):
        joint, left, right = Counter(xs), Counter(x for x, _ in xs), Counter(y for _, y in xs)
        return sum(n / 300 * math.log(n * 300 / (left[x] * right[y])) for (x, y), n in joint.items())

    assert found == pytest.approx([plain([(p, y) for p, _, y in rows]), plain([((p, q), y) for p, q, y in rows])])
    assert select.mutual_information(df, []) == []


def test_backwards_scan_of_a_whole_block(spark):
    df = spark.range(45_000).select("id", F.pmod(F.xxhash64("id"), F.lit(1_000_000)).alias("v"))
    began = time.monotonic()
    back = {r.id: (r.most, r.all) for r in ranks.scan(df, [], F.lit(0), ["id"], {"most": ("max", F.col("v")), "all": ("sum", F.col("v"))}, backwards=True).collect()}
    assert time.monotonic() - began < 20
    most, total = 0, 0
    for r in sorted(df.collect(), reverse=True):
        most, total = max(most, r.v), total + r.v
        assert back[r.id] == (most, total)
