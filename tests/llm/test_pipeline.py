from pyspark.sql import functions as F

import corpus_pipeline
from brindle.session import table
from tests.conftest import SF
from tests.llm.test_jaccard import brute


def test_stages_and_run(spark, tmp_path):
    docs = table(spark, SF, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{name}")
        after = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "jaccard_join":
            want = {low for _, _, low in brute([(r.doc_id, r.text) for r in docs.collect()])}
            assert {r.doc_id for r in after.collect()} == want
        elif name == "personal_data":
            assert after.count() == docs.count()
        else:
            assert 0.8 * docs.count() < after.count() <= docs.count()
        docs = after
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == {r.doc_id for r in docs.select("doc_id").collect()}
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).select(*key).collect())) == sorted(map(tuple, packed.select(*key).collect()))


CLASHES = ("spans", "key", "terms", "_text", "_lang", "_row", "kept", "n_words", "log_perplexity", "base_failed", "score", "lang_pred", "held_out", "component", "n")


def test_stages_carry_clashing_columns_nulls_and_repeated_rows(spark):
    docs = table(spark, SF, "documents").orderBy("doc_id").limit(40)
    odd = docs.limit(4).withColumns({"text": F.when(F.col("doc_id") % 2 == 0, F.lit("")), "doc_id": F.col("doc_id") + 10**6})
    unknown = docs.limit(1).withColumns({"doc_id": F.lit(None).cast("long"), "lang": F.lit(None).cast("string"), "source": F.lit(None).cast("string")})
    docs = docs.unionByName(docs.limit(5)).unionByName(odd).unionByName(unknown)
    docs = docs.withColumns({c: F.concat(F.lit(f"{c}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))) for c in CLASHES}).cache()
    n, out = docs.count(), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        out[name] = rows = after.collect()
        for row in rows:
            said = "none" if row.doc_id is None else str(row.doc_id)
            assert all(row[c] == f"{c}:{said}" for c in CLASHES), name
    assert all(r.text for r in out["language_id"]) and all(r.text for r in out["quality_rules"])
    assert len(out["personal_data"]) == n and all(r.text is not None for r in out["personal_data"])
    kept = [(r.doc_id, r.text) for r in out["jaccard_join"]]
    assert len(kept) == len(set(kept)) and sum(not text for _, text in kept) == 4
    assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= n


def test_stages_take_an_empty_table(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, SF).count() == 0
