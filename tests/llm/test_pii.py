import hashlib
import re

from pyspark.sql import functions as F

from brindle.llm import pii
from brindle.session import table
from tests.conftest import SF

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def brute(text):
    out = []
    for kind, pattern in PLAIN.items():
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(p) > 255 for p in m[0].split(".")):
                continue
            if kind == "card" and not (16 <= len(digits) <= 19 and luhn(digits)):
                continue
            if kind == "phone" and not 8 <= len(digits) <= 15:
                continue
            out.append(f"{kind}:{m.start()}:{m.end()}")
    return ",".join(out)


ODD = [
    None, "", "a@b.c%d@e.f x@y z@@w.v é😀 q@r.s.t.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.003.255 1.2.3", "4111 1111 1111 1111 4111-1111-1111-1112 4111111111111111",
    "+1 (234) 567-8901 +12345 ++44 20 7946 0958.", "9" * 50_000, "a" * 50_000 + "@", "1 2" * 3_000, "@" * 999, "x.y" * 9_000 + "@h.i.j", "+1" + " " * 9_000, "1.1.1.1" * 500,
    "a@b." + "c." * 5_000, "Card: 4111 1111 1111 1111, mail bob@x.org and +49 (0)30 1234567!",
]


def test_base_spans_equal_plain_patterns(spark):
    docs = spark.createDataFrame([(i if i else None, t, "x") for i, t in enumerate(ODD)], "doc_id long, text string, spans string")
    found = {r.doc_id: r.s for r in pii.find_personal(docs).select("doc_id", pii._said(F.col("spans")).alias("s")).collect()}
    assert found == {i if i else None: brute(t) for i, t in enumerate(ODD)}


def test_query_on_the_table(spark):
    found = {r.doc_id: r for r in pii.op9_pii(spark, SF).collect()}
    docs = table(spark, SF, "documents").collect()
    assert len(found) == len(docs)
    for d in docs:
        want, row = brute(d.text), found[d.doc_id]
        assert row.base_sha256 == hashlib.sha256(want.encode()).hexdigest()
        assert row.spans.startswith(want)
        assert [row.n_email, row.n_ip, row.n_card, row.n_phone] == [want.count(k + ":") for k in PLAIN]


def corpus(spark):
    filler = "the of and to in that was his it with as for had you not be her is at by".split()
    rows = []
    for i in range(600):
        words = [filler[(i * 7 + k * k + k * i) % 20] for k in range(60)]
        if i % 100 == 1:  # six different contexts of one entity, each with the telling word
            words[20 + i // 100] = "Zebulon,"
            words[22 + i // 100] = "bob@hidden.org"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, "copy of kim@twice.org whose gnomon is told") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_disclosing_terms(spark):
    docs = corpus(spark)
    base = pii.find_base(docs).where(F.size("spans") > 0)
    terms = pii.disclosing_terms(base, docs).collect()
    assert {(t.entity, t.term) for t in terms} == {("email:bob@hidden.org", "zebulon")}  # copies are one context
    found = pii.find_personal(docs).where("exists(spans, s -> s.kind = 'term')").select("doc_id", "text", "spans", pii.sanitise(F.col("text"), F.col("spans")).alias("clean")).collect()
    assert len(found) == 6
    for r in found:
        (span,) = [s for s in r.spans if s.kind == "term"]
        assert r.text[span.start : span.end] == "Zebulon"
        assert r.clean == r.text.replace("Zebulon", "[...]").replace("bob@hidden.org", "[EMAIL]")


def test_sanitise_overlap_and_empty(spark):
    docs = spark.createDataFrame([(1, "call +4111111111111111 now é a@b.de"), (2, None), (3, "plain")], "doc_id long, text string")
    clean = {r.doc_id: r.c for r in pii.find_personal(docs).select("doc_id", pii.sanitise(F.col("text"), F.col("spans")).alias("c")).collect()}
    assert clean == {1: "call +[CARD] now é [EMAIL]", 2: "", 3: "plain"}
    assert pii.find_personal(docs.limit(0)).count() == 0


def test_sql_says_the_same(spark):
    import duckdb

    docs = corpus(spark).unionByName(spark.createDataFrame([(5_000 + i, t) for i, t in enumerate(ODD[:6])], "doc_id long, text string"))
    documents = docs.toPandas()  # noqa: F841  (DuckDB reads it by name)
    want = {r[0]: r[6] for r in duckdb.sql(pii._sql()).fetchall()}
    found = {r.doc_id: r.s for r in pii.find_personal(docs).select("doc_id", pii._said(F.col("spans")).alias("s")).collect()}
    assert found == want and sum("term" in s for s in want.values()) == 6


def telling(spark, rows):
    """The texts in which a term was found, with the terms."""
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.find_personal(docs).where("exists(spans, s -> s.kind = 'term')").select("doc_id", F.transform(F.filter("spans", lambda s: s["kind"] == "term"), lambda s: s["value"]).alias("terms"))
    return {r.doc_id: set(r.terms) for r in found.collect()}


def test_share_of_rows_does_not_matter(spark):
    rows = [(r.doc_id, r.text) for r in corpus(spark).collect()]
    small = [r for r in rows if r[0] % 100 == 1 or r[0] < 60]  # 65 rows, the entity in a tenth of them
    ids = {i * 100 + 1 for i in range(6)}
    assert telling(spark, small) == dict.fromkeys(ids, {"Zebulon"})
    copies = [(5_000 + i, rows[1][1]) for i in range(300)]  # and a third of all rows, by copies of one text
    assert telling(spark, rows + copies) == dict.fromkeys(ids | {i for i, _ in copies}, {"Zebulon"})


def test_near_takes_words_whatever_their_length(spark):
    long = [f"{k}{'w' * 90}" for k in range(9)]
    text = " ".join(["Zebulon", *long[:7]]) + "\n\tbob@hidden.org\r\n " + " ".join([*long[:7], "gnomon", "after"])
    words = spark.createDataFrame([(1, text), (2, "lead " + text)], "doc_id long, text string")
    near = pii.find_base(words).select(pii._near(F.col("text"), F.col("spans")[0]).alias("near")).collect()
    assert [r.near for r in near] == [["zebulon", *long[:7], *long[:7], "gnomon"]] * 2
