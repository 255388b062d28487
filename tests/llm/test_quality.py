import math
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import quality
from brindle.session import table
from tests.conftest import SF


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    hit = {i + k for i in range(len(words) - 7) if seen[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines, before, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in before
            before.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(hit)


ODD = [None, "", "\n \n", "a b\na b\na b ", "x " * 40, "é\x1cü\xa0y # |<>", "one two three four five six seven eight " * 3 + "end", "w" * 30_000]


def test_counts_equal_brute_force(spark):
    for text in [*ODD, *(r.text for r in table(spark, SF, "documents").collect())]:
        assert quality.base_counts(text) == brute_counts(text)


def ngrams(text):
    body = " " * (quality.ORDER - 1) + " ".join(re.findall(r"[^\x20\x09-\x0D]+", text))
    return [body[i : i + quality.ORDER] for i in range(len(body) - quality.ORDER + 1)]


def brute_model(texts):
    """Interpolated modified Kneser-Ney by dictionaries."""
    counts = {quality.ORDER: Counter(g for t in texts for g in ngrams(t))}
    for n in range(quality.ORDER - 1, 0, -1):
        counts[n] = Counter(g[1:] for g in counts[n + 1])
    discounts, contexts = {}, {}
    for n, c in counts.items():
        k = [sum(v == i for v in c.values()) for i in range(1, 5)]
        d = [0, 0.5, 0.75, 0.9]
        if all(k[:3]):
            y = k[0] / (k[0] + 2 * k[1])
            own = [0, 1 - 2 * y * k[1] / k[0], 2 - 3 * y * k[2] / k[1], 3 - 4 * y * k[3] / k[2]]
            d = [o if 0 < o < max(i, 1e-9) else x for i, (o, x) in enumerate(zip(own, d, strict=True))]
        discounts[n] = d
        contexts[n] = defaultdict(lambda: [0, 0.0])
        for g, v in c.items():
            contexts[n][g[:-1]][0] += v
            contexts[n][g[:-1]][1] += d[min(v, 3)]

    def prob(g):
        if not g:
            return 1 / len(counts[1])
        c, n = counts[len(g)], len(g)
        if g[:-1] not in contexts[n]:
            return prob(g[1:])
        total, left = contexts[n][g[:-1]]
        return (c[g] - discounts[n][min(c[g], 3)]) / total + left / total * prob(g[1:])

    return prob, counts


def brute_logs(docs):
    """Each (lang, text)'s log perplexity, None where it fails the base rules."""
    texts = {(lang or "", text or "") for _, text, lang in docs}
    passed = {x for x in texts if not quality.fails(brute_counts(x[1])[0], brute_counts(x[1])[4])}
    out = dict.fromkeys(texts)
    for lang in {x for x, _ in passed}:
        prob, _ = brute_model([t for x, t in passed if x == lang])
        known = {}
        for text in (t for x, t in passed if x == lang):
            own = [known[g] if g in known else known.setdefault(g, math.log(prob(g))) for g in ngrams(text)]
            out[lang, text] = -sum(own) / len(own)
    return out


def test_perplexity_equals_brute_force(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    extra = [(10**6, "a b c d e f g h i j k l m n o p q r s t u v w é 漢字 \U0001f600", None), (None, "x", "en")]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    want = brute_logs([tuple(r) for r in docs.collect()])
    for held in (quality.HELD, 0):  # arrays in every task, and a join
        for r in quality.judge(docs, held=held).collect():
            assert r.log_perplexity == (None if want[r.lang or "", r.text or ""] is None else pytest.approx(want[r.lang or "", r.text or ""], rel=1e-5))


def test_probabilities_sum_to_one(spark):
    prob, counts = brute_model(["the cat sat on the mat", "the hat sat on the cat", "a cat"])
    for before in ("the ", "cat ", "zzzz", "sat "):
        assert sum(prob(before + c) for c in counts[1]) == pytest.approx(1)


def test_a_large_alphabet_is_counted_alike():
    text = " ".join("".join(chr(0x4E00 + (i * 7919 + k) % 20_000) for k in range(3)) for i in range(9_000))
    grams, counts = quality.count_grams([quality.points(text), quality.points("ab ab")])
    assert dict(zip(grams, counts.tolist(), strict=True)) == Counter([*ngrams(text), *ngrams("ab ab")])


def test_copies_and_the_order_of_rows_change_nothing(spark):
    docs = table(spark, SF, "documents").select("doc_id", "text", "lang")
    alone = {r.doc_id: r.log_perplexity for r in quality.judge(docs).collect()}
    first = docs.where(F.col("doc_id").isin([k for k, v in alone.items() if v is not None])).orderBy(F.length("text").desc()).first()
    copies = spark.range(300).select((F.col("id") + 10**6).alias("doc_id"), F.lit(first.text).alias("text"), F.lit(first.lang).alias("lang"))
    for r in quality.judge(docs.unionByName(copies).repartition(7)).collect():
        want = alone.get(r.doc_id, alone[first.doc_id])
        assert r.log_perplexity == (None if want is None else pytest.approx(want, rel=1e-6))


def test_query_and_bands(spark):
    docs = table(spark, SF, "documents")
    rows = quality.op10_quality_rules(spark, SF).collect()
    assert len(rows) == docs.count()
    by = defaultdict(list)
    lang, text = ({r.doc_id: r[x] for r in docs.collect()} for x in ("lang", "text"))
    for r in rows:
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
        if not r.base_failed:
            by[lang[r.doc_id]].append(r)
    for own in by.values():
        logs = sorted({text[r.doc_id]: r.log_perplexity for r in own}.values())
        low, high = logs[-(-len(logs) // 4) - 1], logs[-(-3 * len(logs) // 4) - 1]
        for r in own:
            reach = quality.BAND * max(high - low, quality.LEAST_RANGE) * math.sqrt(1 + quality.SHORT / r.n_words)
            assert r.kept == (low - reach <= r.log_perplexity <= high + reach)


def test_odd_rows(spark):
    rows = [(i if i else None, t, None if i % 2 else "en", 1) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    found = quality.judge(docs)
    assert found.columns[:3] == ["doc_id", "text", "lang"]
    assert found.count() == len(rows) and found.where("kept").count() == 0
    assert quality.judge(docs.limit(0)).count() == 0
    assert quality.judge(docs.withColumn("text", F.lit(None).cast("string"))).where("kept").count() == 0
