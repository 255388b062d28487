import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from brindle.llm import collocations
from brindle.session import table
from tests.conftest import SF


def brute(rows, least, top):
    n, f = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for size in range(1, 6):
                for i in range(len(w) - size + 1):
                    f[lang, tuple(w[i : i + size])] += 1
    out = []
    often = {p: a for p, a in f.items() if a >= least and len(p[1]) > 1}
    inside = set()
    for (lang, p), a in often.items():
        for size in range(2, len(p)):
            for i in range(len(p) - size + 1):
                q = (lang, p[i : i + size])
                if 100 * a >= 100 * f[q]:
                    inside.add(q)
    for (lang, p), a in often.items():
        if (lang, p) not in inside:
            cuts = [(1000 * a * n[lang] // (f[lang, p[:k]] * f[lang, p[k:]]), k) for k in range(1, len(p))]
            s, k = min(cuts)
            out.append((lang, " ".join(p), a, f[lang, p[:k]], f[lang, p[k:]], n[lang], s))
    ranked = []
    for lang in {r[0] for r in out}:
        own = sorted((r for r in out if r[0] == lang), key=lambda r: (-r[6], -r[2], r[1].encode()))[:top]
        ranked += [(r[0], i + 1, *r[1:]) for i, r in enumerate(own)]
    return sorted(ranked)


def found(spark, rows, **more):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, n int, phrase string").repartition(3)
    return sorted(tuple(r) for r in collocations.best_phrases(docs, **more).collect())


def corpus():
    rng = random.Random(2)
    rows = []
    for lang, size in (("xx", 400), (None, 60)):
        vocabulary = [f"w{i}" for i in range(150)] + ["Ärger", "éa", "\x1cz", "a b", "no break"]
        weights = [1 / (i + 1) for i in range(len(vocabulary))]
        fixed = [rng.sample(vocabulary, rng.choice((2, 3, 4, 5, 7))) for _ in range(40)]
        for _ in range(size):
            words = rng.choices(vocabulary, weights, k=rng.randrange(40))
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(words) + 1)
                words[at:at] = rng.choice(fixed)
            rows.append((lang, rng.choice((" ", "  ", " \t")).join(w.upper() if rng.random() < 0.1 else w + rng.choice(("", "", "", ".", ",", "\n", "\r\n")) for w in words)))
    rows += [("xx", None), ("xx", ""), (None, None), ("yy", "alone"), ("xx", "b b b b b b b b " * 8), ("xx", "...,,;\n"), ("", "empty name " * 12)]
    return rows


@pytest.mark.parametrize(("least", "top", "opened"), [(9, 30, 25), (9, 2000, 10), (12, 12, 3)])
def test_equals_brute_force(spark, least, top, opened):
    rows = corpus()
    want = brute(rows, least, top)
    assert found(spark, rows, least=least, top=top, opened=opened) == want
    assert len({r[0] for r in want}) >= 2


def test_query_equals_brute_force(spark):
    rows = [(r.lang, r.text) for r in table(spark, SF, "documents").collect()]
    assert sorted(tuple(r) for r in collocations.op12_collocations(spark, SF).collect()) == brute(rows, 100, 2000)


def test_empty_tables(spark):
    assert found(spark, []) == [] and found(spark, [("a", None), (None, " .")]) == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    values = [(10**13, 10**15, 10**13 - 1, 10**13 - 7), (123, 10**18, 10**9 + 7, 998_244_353), (100, 1000, 100, 100)]
    df = spark.createDataFrame(values, "a long, n long, l long, r long")
    got = [r[0] for r in df.select(collocations.score(*(F.col(c) for c in "anlr"))).collect()]
    assert got == [1000 * a * n // (x * r) for a, n, x, r in values]


def test_chunks_go_off_one_by_one_and_do_not_end_with_a_batch(monkeypatch):
    monkeypatch.setattr(collocations, "CHUNK_WORDS", 100)
    texts = [("xx" if i % 3 else "yy", f"a b c w{i}.") for i in range(300)]
    batches = [pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*texts[at : at + 5], strict=True)], names=["lang", "text"]) for at in range(0, 300, 5)]
    rows = list(collocations._chunks(iter(batches)))
    assert all(b.num_rows == 1 for b in rows) and len(rows) < len(batches)
    monkeypatch.setattr(collocations, "OPEN_CHUNKS", 2)
    few = list(collocations._chunks(iter(batches)))
    assert len(few) > len(rows)
    for out in (rows, few):
        words = [(lang, w) for b in out for lang, own, _, places in collocations._opened(b) for w in (own[i - 1] for i in places if i)]
        assert Counter(words) == Counter((lang, w.encode()) for lang, t in texts for w in t.rstrip(".").split())


def test_tasks_get_few_rows_at_once(spark, monkeypatch):
    name, seen, write = "spark.sql.execution.arrow.maxRecordsPerBatch", {}, collocations.scratch
    before = spark.conf.get(name)
    monkeypatch.setattr(collocations, "scratch", lambda df, as_: (seen.update({as_: int(spark.conf.get(name))}), write(df, as_))[1])
    assert found(spark, [("xx", "a b a b c " * 9)], least=9, top=5)
    assert seen["collocations-chunks"] <= 1_000 and {seen[f"collocations-{x}"] for x in ("words", "keys", "grown")} == {1}
    assert spark.conf.get(name) == before
