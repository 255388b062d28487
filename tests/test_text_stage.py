"""The text stage (D6, J2): its means against plain loops, however many tokens go to the tasks, and what it shuffles."""

import math
import random
import re
from collections import Counter

import pytest

from brindle.operators import encode
from brindle.plans import stages
from brindle.session import scratch


def shuffled(spark):
    listed = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark._jvm.double, 0), None)
    return sum(listed.apply(i).shuffleWriteBytes() for i in range(listed.size()))


@pytest.mark.parametrize("room", [64_000_000, 20_000, 0])
def test_means_and_shuffled_bytes(spark, monkeypatch, room):
    monkeypatch.setattr(encode, "TERM_BYTES", room)
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefgh", k=9)) for _ in range(2_000)]
    texts = [" ".join(words[int(2_000 * rng.random() ** 3)] for _ in range(300)) for _ in range(400)] + ["", "??", None]
    rows = [(i, t, rng.choice("xy")) for i, t in enumerate(texts + texts[:5])]
    df = scratch(spark.createDataFrame(rows, "id long, t string, c string").repartition(4), "text-rows")
    seen = Counter((w, c) for _, t, c in rows for w in re.findall("[a-z]+", t or ""))
    total = Counter(w for _, t, _ in rows for w in re.findall("[a-z]+", t or ""))
    model = stages.TargetText(column="t", target="c").fit(df)
    before = shuffled(spark)
    found = {r.id: r for r in model.transform(df.select("id", "t")).select("id", *model.outputs).collect()}
    moved = shuffled(spark) - before
    assert len(found) == len(rows)
    for i, t, _ in rows:
        told = re.findall("[a-z]+", t or "")
        for k, c in enumerate("xy"):
            want = sum(math.log((seen[w, c] + 1) / (total[w] + 2)) for w in told) / len(told) if told else 0.0
            assert found[i][f"_text_t_{k}"] == pytest.approx(want, abs=1e-9)
    if room > 1_000_000:
        assert moved < 0.2 * sum(len(t or "") for t in texts)
