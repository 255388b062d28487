import math
import re
from collections import Counter, defaultdict

import pytest

from brindle.llm import language
from brindle.session import table
from tests.conftest import SF

ODD = [None, "", "123 !!", "the and of", "été", "漢字", "a" * 50_000, "½ ²"]


def test_held_out_accuracy(spark):
    found = language.op8_language_id(spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").collect()
    assert len(found) == table(spark, SF, "documents").count()
    told = [r for r in found if r.held_out]
    assert 0 < len(told) < len(found)
    assert sum(r.lang == r.lang_pred for r in told) >= 0.97 * len(told)
    assert all(0 <= r.score <= 1 for r in found)


def test_odd_texts_and_no_model(spark):
    rows = [(i if i else None, t, "x", 0.5) for i, t in enumerate(ODD)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang_pred string, score double")
    model = language.train(table(spark, SF, "documents"))
    found = {r.doc_id or 0: r for r in language.identify(docs, model).collect()}
    assert [found[i].lang_pred for i in (0, 1, 2, 7)] == ["und"] * 4
    assert found[3].lang_pred == "en"
    assert all(r.lang_pred != "und" for i, r in found.items() if i in (3, 4, 6))
    bare = language.train(spark.createDataFrame([(1, "12 34", "x")], "doc_id long, text string, lang string"))
    assert {r.lang_pred for r in language.identify(docs, bare).collect()} == {"und", "x"}
    none = language.train(table(spark, SF, "documents").where("false"))
    assert {r.lang_pred for r in language.identify(docs, none).collect()} == {"und"}
    assert language.identify(docs.limit(0), model).count() == 0


def test_backoff_is_by_hand(spark):
    docs = spark.createDataFrame([(1, "ab ab cd", "x"), (2, "ef ef ef", "y"), (3, None, "z"), (4, "ef", None)], "doc_id long, text string, lang string")
    langs, tables = language.train(docs)
    assert langs == ["x", "y"]
    assert tables[0].items.to_pylist() == ["ab", "cd", "ef"]
    scorer = language.Scorer(langs, tables)
    assert (scorer.word("ab") == tables[0].get("ab")).all()
    assert (scorer.word("abz") == (tables[3].get(" ab"))).all()  # no 4-gram is known, one 3-gram is
    assert scorer.predict("ab") [0] == "x" and scorer.predict("efq")[0] == "y"


def brute(learned, texts):
    """(language, score) of each text by dictionaries of counts."""
    find = re.compile(r"[^\W\d_]+").findall
    counts = defaultdict(lambda: defaultdict(Counter))
    for text, lang in learned:
        for w in find(text.lower()):
            counts[0][lang][w] += 1
            for n in range(1, 5):
                p = f" {w} " if n > 1 else w
                counts[n][lang].update(p[i : i + n] for i in range(len(p) - n + 1))
    langs = sorted(counts[0])
    items = {n: set().union(*c.values()) for n, c in counts.items()}
    totals = {(n, x): sum(counts[n][x].values()) + 0.5 * len(items[n]) for n in counts for x in langs}

    def log(n, item):
        return [math.log((counts[n][x][item] + 0.5) / totals[n, x]) for x in langs]

    def word(w):
        if w in items[0]:
            return log(0, w)
        for n in range(4, 0, -1):
            p = f" {w} " if n > 1 else w
            hits = [log(n, p[i : i + n]) for i in range(len(p) - n + 1) if p[i : i + n] in items[n]]
            if hits:
                return [sum(x) / len(hits) for x in zip(*hits, strict=True)]
        return [0.0] * len(langs)

    out = []
    for text in texts:
        words = find((text or "").lower())
        if not any(c.isalpha() for w in words for c in w):
            out.append(("und", 0.0))
            continue
        sums = [sum(x) for x in zip(*map(word, words), strict=True)]
        odds = [math.exp((s - max(sums)) * min(1, 50 / len(words))) for s in sums]
        out.append((langs[odds.index(max(odds))], max(odds) / sum(odds)))
    return out


def test_query_equals_brute_force(spark):
    rows = table(spark, SF, "documents").collect()
    found = {r.doc_id: r for r in language.op8_language_id(spark, SF).collect()}
    learned = [(r.text, r.lang) for r in rows if not found[r.doc_id].held_out and r.text is not None and r.lang is not None]
    for r, (lang, score) in zip(rows, brute(learned, [r.text for r in rows]), strict=True):
        assert found[r.doc_id].lang_pred == lang
        assert found[r.doc_id].score == pytest.approx(score, abs=1e-3)


def test_many_languages_ties_and_repeated_rows(spark):
    """No language is left out, however many there are; of equal scores the first name wins."""
    def name(i):
        return "".join(chr(97 + i // 26**k % 26) for k in range(3))

    rows = [(i, f"q{name(i)}x q{name(i)}y", name(i)) for i in range(260)]
    docs = spark.createDataFrame(rows + [rows[7], rows[7], (None, "both", "b"), (1000, "both", "a")], "doc_id long, text string, lang string")
    langs, tables = language.train(docs)
    assert len(langs) == 262
    found = language.identify(docs, (langs, tables)).collect()
    assert len(found) == 264
    assert all(r.lang_pred == ("a" if r.text == "both" else r.lang) for r in found)
