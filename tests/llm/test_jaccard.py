import random
import re

import numpy as np
import pandas as pd
import pytest

from brindle.llm import jaccard
from brindle.session import table
from tests.conftest import SF


def brute_sets(rows):
    out = []
    for _, text in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    return out


def brute(rows):
    sets = brute_sets(rows)
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    by = {}
    for i, s in enumerate(sets):
        for g in s:
            by.setdefault(g, []).append(i)
    seen = set()
    for own in by.values():
        for x in range(len(own)):
            for y in range(x):
                a, b = own[x], own[y]
                if (a, b) not in seen:
                    seen.add((a, b))
                    common = len(sets[a] & sets[b])
                    if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                        up[max(find(a), find(b))] = min(find(a), find(b))
    low = {}
    for i, (doc, _) in enumerate(rows):
        r = find(i)
        low[r] = min(low.get(r, doc), doc)
    return sorted((doc, len(sets[i]), low[find(i)]) for i, (doc, _) in enumerate(rows))


def found(spark, rows):
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, n int").repartition(3)
    return sorted(tuple(r) for r in jaccard.jaccard_components(docs).collect())


def test_query_equals_brute_force(spark):
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted(tuple(r) for r in jaccard.op3_jaccard_join(spark, SF).collect()) == brute(docs)


def chained(seed):
    """Families of copies with more and more edits, some sharing a long passage, copies and odd rows."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdefgh", k=4))
    passage = [word() for _ in range(40)]
    rows = []
    for _ in range(6):
        base = [word() for _ in range(rng.choice([3, 6, 30, 120]))] + (passage if rng.random() < 0.6 else [])
        for _ in range(12):
            rows.append(" ".join(base))
            for _ in range(rng.randint(0, 3)):
                base = [*base]
                base[rng.randrange(len(base))] = word()
    rows += rows[:9] + ["", None, " \n", "One", "one", "ONE two", "É x", "é x", "x " * 5_000]
    rng.shuffle(rows)
    return [(rng.randrange(10**6) * 1000 + i, t) for i, t in enumerate(rows)]


@pytest.mark.parametrize("seed", [1, 2])
def test_chains_equal_brute_force(spark, seed, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK", 5)  # long lists are compared block by block
    rows = chained(seed)
    assert found(spark, rows) == brute(rows)


def test_empty_null_and_repeated(spark):
    assert found(spark, []) == []
    docs = spark.createDataFrame([(None, "a b c"), (5, "a b c"), (5, "a b c"), (None, None), (7, "")], "doc_id long, text string")
    result = jaccard.jaccard_components(docs)
    assert sorted(map(tuple, result.collect()), key=str) == sorted([(None, 1, 5), (5, 1, 5), (5, 1, 5), (None, 0, None), (7, 0, 7)], key=str)
    kept = jaccard.keep_one(docs, result)
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([(5, "a b c"), (None, None), (7, "")], key=str)


def test_linked_at_the_edge():
    a = np.arange(100, dtype=np.uint64)
    assert jaccard.linked(a, a[:75]) and not jaccard.linked(a, a[:74])
    assert not jaccard.linked(a[:0], a[:0])


def test_marked_keeps_every_wanted_row(spark):
    docs = spark.createDataFrame([(i if i else None, str(i)) for i in range(2_000)], "doc_id long, text string")
    wanted = docs.where("doc_id is null or doc_id % 50 = 7").select("doc_id")
    kept = {r.text for r in jaccard.marked(docs, wanted).collect()}
    assert kept >= {"0", *(str(i) for i in range(7, 2_000, 50))} and len(kept) < 60


def test_keep_one_tells_rows_with_one_doc_id_apart(spark):
    words = lambda c, n=20: " ".join(f"{c}{k}" for k in range(n))
    lone = [(None, words(c), 1) for c in "abcdef"]  # six components without an id
    rows = [*lone, (None, "", 1), (None, "", 2), (None, None, 1), (1, words("x"), 1), (9, words("x") + " more", 1), (9, words("y"), 1), (9, words("y"), 1), (9, "", 1), (9, " ", 1), (9, "", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int").repartition(3)
    want = [*lone, (None, "", 1), (None, "", 2), (None, None, 1), (1, words("x"), 1), (9, words("y"), 1), (9, "", 1), (9, " ", 1)]
    kept = jaccard.keep_one(docs, jaccard.labelled_rows(docs))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)


@pytest.mark.parametrize("bits", [3, 8])
def test_shingles_that_share_a_list_lose_no_link(spark, bits):
    rng = random.Random(bits)
    base = [[f"w{rng.randrange(400)}" for _ in range(90)] for _ in range(12)]
    rows = []
    for words in base:
        for change in (0, 1, 2, 3, 4):
            own = list(words)
            for at in rng.sample(range(90), change):
                own[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    told = jaccard.labelled_rows(docs, finder=lambda d, words, percent: jaccard.find_links(d, words, percent, bits))
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in told.collect()) == brute(rows)
    sets = [jaccard.Shingler()(text) for _, text in rows]
    assert any(jaccard.spare(s, bits) for s in sets)
    assert not any(jaccard.spare(s) for s in sets)


def test_pairs_that_leave_the_groups_grow_with_the_members(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(100)]
    rows = []
    for i in range(90):
        own = list(base)
        for at in rng.sample(range(100), rng.randint(1, 3)):
            own[at] = f"x{rng.randrange(10**6)}"
        rows.append((i * 7, " ".join(own)))
    written, write = [], jaccard.scratch

    def counted(df, name):
        out = write(df, name)
        written.append((name, out.count()))
        return out

    # nothing is joined before all pairs are looked at, so nearly all of them are open
    monkeypatch.setattr(jaccard, "first_links", lambda lists, sets, percent: sets.select(sets.digest.alias("a"), sets.digest.alias("b")).limit(1))
    monkeypatch.setattr(jaccard, "scratch", counted)
    assert found(spark, rows) == brute(rows)
    met, members = ([n for name, n in written if name == f"jaccard-{x}"] for x in ("met", "groups"))
    assert len(met) > 1 and met[0] <= 2 * members[0]


def test_no_pair_is_left_out_in_the_end():
    n = 60
    rng = np.random.default_rng(3)
    bits = [np.zeros(8 * jaccard.BITS, np.uint8) for _ in range(n)]
    for b in bits:
        b[rng.integers(0, len(b), 3)] = 1
    lists = [np.arange(4)] * n
    rows = pd.DataFrame({"id": np.arange(n) - 30, "n": 100, "block": 0, "label": [str(i) for i in range(n)], "bits": [b.tobytes() for b in bits], "lists": lists})
    tried = pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
    counts = []
    while True:  # no pair links, so all of them have to come
        met = jaccard._compare(75, 1, at_once=500)((7, 0, 0), rows, tried)
        counts.append(len(met))
        tried = pd.concat([tried, met[["a", "b"]]])
        if not met["left"].any():
            break
    assert max(counts) <= 2 * n and len(counts) > 10
    assert len(tried) == len(tried.drop_duplicates()) == n * (n - 1) // 2


@pytest.mark.parametrize("few", [0, 100_000])
def test_few_labels_and_pairs_are_broadcast(spark, few, monkeypatch):
    """Rounds over few nodes have no sorts, and of few pairs only the sets in them are shuffled; results are the same."""
    plan, write, plans = lambda df: df._jdf.queryExecution().executedPlan().toString(), jaccard.scratch, []
    monkeypatch.setattr(jaccard, "FEW", few)
    monkeypatch.setattr(jaccard, "scratch", lambda df, name: plans.append(plan(df) if name == "link-labels" else "") or write(df, name))
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = [(bytes([i]), bytes([i + 1])) for i in range(60) if i != 30]
        labels = jaccard.components(spark.createDataFrame(rows, "a binary, b binary"))
        assert sorted((r.node[0], r.label[0]) for r in labels.collect()) == [(i, 0 if i <= 30 else 31) for i in range(61)]
        assert any("SortMergeJoin" in p for p in plans) == (few == 0)
        texts = [f"{'one two three four five six seven eight nine ten eleven ' * 2}{x}" for x in ("", "more", "less")] + ["quite another text in here, of its own", "alone"]
        sets = write(spark.createDataFrame([(t,) for t in texts], "text string").mapInArrow(jaccard._sets(5, 32), "id long, digest binary, n long, spare long, set binary, bits binary"), "test-sets")
        ids = {r.n: r.id for r in sets.collect()}
        every = [(x, y) for x in ids.values() for y in ids.values() if x < y] * 2
        found = jaccard.verified(write(spark.createDataFrame(every, "a long, b long"), "test-pairs"), sets, 75)
        assert plan(found).count("BroadcastHashJoin") == (2 if few else 0)
        named = {bytes(r.digest): r.id for r in sets.collect()}
        whole = {r.id: np.frombuffer(r.set, np.uint64) for r in sets.collect()}
        assert sorted((named[bytes(r.a)], named[bytes(r.b)]) for r in found.collect()) == sorted(p for p in every if jaccard.linked(whole[p[0]], whole[p[1]]))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_components_of_few_links_take_few_jobs(spark):
    """Every job, and every new plan after a shuffle, stays on the driver's heap: a round over few nodes is a write and its broadcasts.
    A chain takes several rounds; links that repeat, loop or are missing do no harm."""
    links = [(bytes([i]), bytes([i + 1])) for i in range(60) if i != 30] + [(b"\x00", b"\x01"), (b"\x02", b"\x02"), (b"\x50", b"\x50")]
    stored = jaccard.scratch(spark.createDataFrame(links, "a binary, b binary").coalesce(1), "test-links")
    spent = lambda: spark.sparkContext._jsc.sc().dagScheduler().numTotalJobs()
    keys = ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")
    modes, rounds, write = [spark.conf.get(k) for k in keys], [], jaccard.scratch
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(jaccard, "scratch", lambda df, name: rounds.append(name) or write(df, name))
        before = spent()
        labels = jaccard.components(stored)
        jobs = spent() - before
    found = sorted((r.node[0], r.label[0]) for r in labels.collect())
    assert found == [(i, 0 if i <= 30 else 31) for i in range(61)] + [(80, 80)]
    turns = rounds.count("link-labels") - 1
    assert turns > 3
    assert jobs <= 3 + 3 * turns, (jobs, turns)
    empty = jaccard.scratch(stored.where("a > b"), "test-links")
    assert jaccard.components(empty).count() == 0
    assert [spark.conf.get(k) for k in keys] == modes


def test_texts_are_read_once_to_keep_one(spark):
    """Rows that go are told apart from those that stay in one scan, null doc_ids and texts without words too."""
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "g h"), (None, "g h"), (4, None), (None, None), (None, None), (None, " "), (5, ""), (6, "i")]
    docs = jaccard.scratch(spark.createDataFrame(rows, "doc_id long, text string"), "test-docs")
    kept = jaccard.keep_one(docs, jaccard.labelled_rows(docs))
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert sum("text:string" in line for line in plan.splitlines() if "FileScan" in line) == 1
    want = [r for r in rows if r not in ((2, "a b c d e f"), (None, "g h"))]
    assert sorted(map(str, map(tuple, kept.collect()))) == sorted(map(str, want))
    twice = docs.union(docs)
    want = list(dict.fromkeys(r for r in want if r[0] is not None)) + [r for r in rows if r[0] is None and not (r[1] or "").strip()] * 2
    assert sorted(map(str, map(tuple, jaccard.keep_one(twice, jaccard.labelled_rows(twice)).collect()))) == sorted(map(str, want))
