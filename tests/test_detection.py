"""H12 against brute force, and at sizes where comparing each prediction with each box of its image takes minutes."""

import random
import time

import pytest
from pyspark.sql import functions as F

from brindle.functions import metrics

TRUTH, PRED = "image long, box_id long, x1 double, y1 double, x2 double, y2 double", "image long, pred_id long, x1 double, y1 double, x2 double, y2 double, confidence double"


def brute(truth, pred, least=0.5):
    def iou(p, t):
        if None in p or None in t:
            return 0.0
        area = lambda a, b, c, d: max(0.0, c - a) * max(0.0, d - b)
        inter = area(max(p[0], t[0]), max(p[1], t[1]), min(p[2], t[2]), min(p[3], t[3]))
        union = area(*p) + area(*t) - inter
        return inter / union if union else 0.0

    rows = []
    for image, pid, *p, conf in pred:
        found = [(-iou(p, t), box) for i, box, *t in truth if i == image and image is not None]
        overlap, box = min(found, default=(0.0, None))
        rows.append((-conf, pid, image, box, -overlap))
    taken, tps, curve = set(), 0, []
    for k, (_, _, image, box, overlap) in enumerate(sorted(rows), 1):
        tp = overlap >= least and (image, box) not in taken
        taken.add((image, box))
        tps += tp
        curve.append((tp, tps / k))
    envelope, total = 0.0, 0.0
    for tp, precision in reversed(curve):
        envelope = max(envelope, precision)
        total += envelope * tp
    return total / len(truth)


@pytest.mark.parametrize("seed", range(4))
def test_boxes_of_all_sizes_against_brute_force(spark, seed):
    rng = random.Random(seed)

    def box():
        side = 2.0 ** rng.randint(-3, 7)
        x, y = rng.uniform(-60, 60), rng.uniform(-60, 60)
        return x, y, x + side * rng.uniform(0.2, 1), y + side * rng.uniform(0.2, 1)

    truth = [(rng.randint(0, 3), i, *box()) for i in range(150)]
    near = lambda t: [c + rng.uniform(-0.1, 0.1) * (t[4] - t[2]) for c in t[2:]]
    pred = [(t[0], i, *near(t), rng.random()) for i, t in enumerate(rng.choices(truth, k=250))]
    pred += [(rng.randint(0, 5), 300 + i, *box(), rng.random()) for i in range(100)]
    pred += [(t[0], 500 + i, *t[2:], round(rng.random(), 1)) for i, t in enumerate(rng.choices(truth, k=40))]
    pred += [(None, 600, 0.0, 0.0, 9.0, 9.0, 0.9), (0, 601, None, 0.0, 9.0, 9.0, 0.95), (1, 602, 5.0, 5.0, 5.0, 5.0, 0.99), (2, 603, 9.0, 9.0, 1.0, 1.0, 0.97)]
    truth += [(t[0], 200 + i, *t[2:]) for i, t in enumerate(truth[:20])] + [(3, 300, 0.0, None, 1.0, 1.0), (None, 301, 0.0, 0.0, 9.0, 9.0)]
    told = metrics.detection_ap(spark.createDataFrame(truth, TRUTH), spark.createDataFrame(pred, PRED)).first()["value"]
    assert told == pytest.approx(brute(truth, pred), abs=1e-12) and told > 0.2


@pytest.mark.parametrize("places", [50, 6_000])
def test_many_boxes_in_one_image(spark, places):
    """6,000 boxes and as many predictions, at few places or each at its own."""
    rows = spark.range(6_000).withColumn("x1", (F.col("id") % places) * 20.0).withColumn("x2", F.col("x1") + 18)
    truth = rows.select(F.lit(1).alias("image"), F.col("id").alias("box_id"), "x1", F.lit(0.0).alias("y1"), "x2", F.lit(18.0).alias("y2"))
    pred = rows.select(F.lit(1).alias("image"), F.col("id").alias("pred_id"), "x1", F.lit(0.0).alias("y1"), "x2", F.lit(17.0).alias("y2"), (1 / (F.col("id") + 1)).alias("confidence"))
    began = time.monotonic()
    # the first prediction at a place takes its first box, and all later ones there are false
    assert metrics.detection_ap(truth, pred).first()["value"] == pytest.approx(places / 6_000)
    assert time.monotonic() - began < 60
