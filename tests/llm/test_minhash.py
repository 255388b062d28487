import random

import numpy as np
import pytest

from brindle.llm import jaccard, minhash
from brindle.session import table
from tests.conftest import SF
from tests.llm.brute import near_duplicates as brute


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, n int, signature string").repartition(3)
    return sorted((tuple(r) for r in minhash.near_duplicates(docs).collect()), key=str)


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted((tuple(r) for r in minhash.op13_minhash_dedup(spark, SF).collect()), key=str) == brute(docs, 4, 80)


def test_chains_of_near_copies_at_the_threshold(spark):
    rng = random.Random(5)
    rows = []
    for g in range(25):
        words = [f"w{rng.randrange(400)}" for _ in range(rng.choice((4, 5, 9, 30, 120, 700)))]
        for _ in range(rng.choice((2, 3, 12))):
            rows.append((len(rows), " ".join(words)))
            for _ in range(max(1, len(words) // rng.choice((20, 36, 60)))):
                words[rng.randrange(len(words))] = f"v{rng.randrange(10**6)}"
    want = brute(rows, 4, 80)
    assert found(spark, rows) == want
    assert len({r[2] for r in want}) < len(rows)


def test_a_shared_passage_and_a_large_group(spark):
    rng = random.Random(6)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.randrange(5, 60)))) for i in range(120)]
    base = [f"b{i}" for i in range(80)]
    for i in range(200, 400):
        own = list(base)
        own[rng.randrange(80)] = f"c{i % 30}"
        rows.append((i, " ".join(own)))
    assert found(spark, rows) == brute(rows, 4, 80)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two three"), (None, "one two three"), (None, "alone in here now"), (7, "a b c d"), (7, "a b c d"), (7, "é É z y x"), (8, "\x1c x")]
    rows += [(9, "word " * 50), (10, "word " * 4000)]
    assert found(spark, rows) == brute(rows, 4, 80)
    assert found(spark, []) == []


def test_signatures_under_the_distance_always_meet():
    rng = np.random.default_rng(3)
    one = rng.integers(0, 1 << 16, (400, minhash.CHUNKS * minhash.WIDTH)).astype(np.uint16)
    two = one.copy()
    for row in two:
        at = rng.choice(len(row), rng.integers(0, minhash.DISTANCE + 1), replace=False)
        row[at] += 1
    assert all(set(x) & set(y) for x, y in zip(minhash.chunk_keys(one), minhash.chunk_keys(two), strict=True))


def test_components_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(4)
    for common, own in ((800, 100), (300, 350)):
        pools = [rng.integers(0, 1 << 64, common + 2 * own, np.uint64) for _ in range(200)]
        left, right = minhash.signatures([p[: common + own] for p in pools]), minhash.signatures([np.concatenate([p[:common], p[common + own :]]) for p in pools])
        assert (left == right).mean() == pytest.approx((common + 0.0) / (common + 2 * own), abs=0.02)


def test_spanning_pairs_join_what_all_pairs_join():
    rng = np.random.default_rng(8)
    for n, m in ((2, 1), (30, 25), (60, 400)):
        i, j = np.sort(rng.choice(n, (m, 2)), axis=1).T
        labels = rng.integers(0, n, n)
        weights = rng.integers(0, 5, m) / 5

        def joined(pairs):
            up = labels.copy()
            for x, y in pairs:
                up[up == up[x]] = up[y]
            return sorted(tuple(np.flatnonzero(up == u)) for u in set(up.tolist()))

        best = minhash.spanning(i, j, weights, labels)
        assert joined(zip(i[best], j[best], strict=True)) == joined(zip(i, j, strict=True))
        assert len(best) <= len(set(labels.tolist())) - 1


def test_pairs_that_fail_are_not_tried_for_ever(spark):
    """Long sets with a similarity under the threshold: bitmaps can't tell, so every pair is tried once."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(9000)]
    rows = []
    for i in range(14):
        own = list(base)
        for _ in range(420 if i % 2 else 250):
            own[rng.randrange(9000)] = f"x{rng.randrange(10**7)}"
        rows.append((i, " ".join(own)))
    assert found(spark, rows) == brute(rows, 4, 80)


def test_groups_with_no_pair_left_are_not_looked_at_again(spark, monkeypatch):
    names, write = [], jaccard.scratch
    monkeypatch.setattr(jaccard, "scratch", lambda df, name: names.append(name) or write(df, name))
    rng, base = random.Random(10), [f"w{i}" for i in range(200)]
    rows = [(i, " ".join(f"v{rng.randrange(9)}" if k == 7 * (i % 5) else w for k, w in enumerate(base))) for i in range(30)]
    assert found(spark, rows) == brute(rows, 4, 80)
    assert names.count("jaccard-met") == 1
