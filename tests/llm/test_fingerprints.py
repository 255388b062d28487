import hashlib
import re

from pyspark.sql import functions as F

from brindle.llm import fingerprints
from brindle.session import table
from tests.conftest import SF


def edited(rows):
    """{doc_id: edited text} by the definition."""
    rows = sorted((d, t or "") for d, t in rows)
    out = {}
    for i, (d, t) in enumerate(rows):
        n = len(t) // 4
        out[d] = t[: len(t) - n] + rows[(i + 1) % len(rows)][1][:n]
    return out


def test_query_on_the_table(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RUN", 30)  # several runs
    rows = {r.doc_id: r for r in fingerprints.op5_fingerprints(spark, SF).collect()}
    docs = [(r.doc_id, r.text) for r in table(spark, SF, "documents").collect()]
    want = edited(docs)
    assert set(rows) == set(want)
    by_text = {}
    for d, t in docs:
        r = rows[d]
        assert r.n_chars == len(t or "")
        assert r.edited_sha256 == hashlib.sha256(want[d].encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    whole = [r for r in rows.values() if r.n_chars > 400]
    assert sum(r.near_edited for r in whole) / len(whole) > 0.5
    assert sum(r.near_next for r in whole) / len(whole) < 0.1


def test_anchors_by_hand(spark):
    """Closed syncmers of each text by plain loops over Spark's own hashes."""
    texts = ["a b c d e f g h a b c d e f g h i j k", "one two three", "x", "", " \n ", "p q r s", "é\tü  ö\nß ñ"]
    frame = spark.createDataFrame([(t,) for t in texts], "text string")
    found = {r.text: r.a for r in frame.select("text", fingerprints.anchors(F.col("text")).alias("a")).collect()}
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        if not w:
            assert found[t] == []
        elif len(w) < fingerprints.K:
            assert [tuple(x) for x in found[t]] == [(0, spark.sql("select hash(:t) h", {"t": " ".join(w)}).first().h)]
        else:
            pair = {p: spark.sql("select xxhash64(:a, :b) h", {"a": p[0], "b": p[1]}).first().h for p in set(zip(w, w[1:], strict=False))}
            want = []
            for i in range(len(w) - 4):
                a, b, c, d = (pair[w[i + j], w[i + j + 1]] for j in range(4))
                if min(a, b, c, d) in (a, d):
                    want.append((i, spark.sql(f"select hash({a}L, {c}L, {d}L) h").first().h))
            assert [tuple(x) for x in found[t]] == want


def near(spark, a, b):
    """Likeness of two texts, and the same by plain sets of (anchor, next anchor, distance)."""
    frame = spark.createDataFrame([(a, b)], "a string, b string").select(fingerprints.anchors(F.col("a")).alias("a"), fingerprints.anchors(F.col("b")).alias("b"))
    r = frame.select("a", "b", fingerprints.likeness(fingerprints.steps(F.col("a")), fingerprints.steps(F.col("b"))).alias("n")).first()

    def steps(x):
        return {(u.hash, v and v.hash, v and v.place - u.place) for u, v in zip(x, [*x[1:], None], strict=False)}

    x, y = steps(r.a), steps(r.b)
    assert abs(r.n - (len(x & y) / len(x | y) if x | y else 1)) < 1e-12
    return r.n


def test_places_count_in_texts_of_any_length(spark):
    words = [f"w{i * 7919 % 10_007}" for i in range(20_000)]
    whole = " ".join(words)
    assert near(spark, whole, whole) == 1
    changed = [*words[:9_000], "other", *words[9_001:]]
    assert 0.99 < near(spark, whole, " ".join(changed)) < 1  # one word of 20,000 is seen
    shared = " ".join([f"x{i}" for i in range(5_000)] + words[3_000:3_100])
    assert 0 < near(spark, whole, shared) < 0.02  # and so is a shared passage
    assert near(spark, "a b c d e f g", "a b c d e f g h") > near(spark, "a b c d e f g", "g f e d c b a")
    assert near(spark, "", " ") == 1 and near(spark, "", "a") == 0


def test_two_level_lookup(spark):
    for n in (0, 1, 2, 3, 7, 10, 26):
        cuts = [3 * k for k in range(1, n + 1)]
        for r in spark.range(-1, 90).select("id", fingerprints._runs(cuts, F.col("id")).alias("n")).collect():
            assert r.n == sum(c <= r.id for c in cuts)


def test_null_repeated_and_empty(spark):
    rows = [(None, "a b c d e"), (3, None), (3, "x y"), (7, "z" * 9), (7, "z" * 9)]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, edited int")
    assert fingerprints.fingerprint_documents(docs).count() == 5
    assert fingerprints.fingerprint_documents(docs.limit(0)).count() == 0
    one = fingerprints.fingerprint_documents(docs.where("text = 'x y'")).first()
    assert one.edited == "x y" and one.next_anchors == one.anchors
    same = fingerprints.fingerprint_documents(docs.where("doc_id = 7")).collect()
    assert [r.edited for r in same] == ["z" * 9] * 2
    alike = docs.limit(1).select(fingerprints.likeness(F.array().cast("array<long>"), F.array().cast("array<long>")).alias("e"), fingerprints.likeness(F.array(F.lit(1), F.lit(2)), F.array(F.lit(2), F.lit(3))).alias("t")).first()
    assert alike.e == 1.0 and abs(alike.t - 1 / 3) < 1e-9
