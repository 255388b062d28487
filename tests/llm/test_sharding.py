import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from brindle.llm import sharding
from brindle.session import table
from tests.conftest import SF


def held(rows, shards=8):
    """The law and the slots hold; returns the shards' members by text."""
    sizes = Counter(r.shard for r in rows)
    assert max(sizes.values(), default=0) - min((sizes.get(k, 0) for k in range(shards)), default=0) <= 1
    for k in range(shards):
        assert sorted(r.slot for r in rows if r.shard == k) == list(range(sizes.get(k, 0)))


def cut(rows, of):
    groups = defaultdict(Counter)
    for r in rows:
        for g in of(r):
            groups[g][r.shard] += 1
    return sum(sum(c.values()) - max(c.values()) for c in groups.values())


def test_query_by_its_definition(spark):
    docs = {r.doc_id: r.text or "" for r in table(spark, SF, "documents").collect()}
    rows = sharding.op2_sharding(spark, SF).collect()
    assert {r.doc_id for r in rows} == set(docs) and len(rows) == len(docs)
    held(rows)
    for r in rows:
        assert r.size == len(docs[r.doc_id].encode()) + 1 and r.text_crc32 == zlib.crc32(docs[r.doc_id].encode())
        assert r.law == "rows" and r.grown_shard is None
    assert cut(rows, lambda r: [docs[r.doc_id]]) == 0


def test_a_hot_group_cuts_few_pairs(spark):
    """A third of all rows is one group, the rest are pairs: the hot one, larger than any shard, is cut into as
    few parts as can be, and pairs only where shards of odd sizes meet."""
    rows = [(i, "hot") for i in range(300)] + [(1_000 + i, f"pair {i // 2}") for i in range(600)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 8).collect()
    held(out)
    texts = dict(rows)
    assert cut([r for r in out if texts[r.doc_id] != "hot"], lambda r: [texts[r.doc_id]]) <= 4
    assert len({r.shard for r in out if texts[r.doc_id] == "hot"}) == 3


def test_groups_of_all_sizes(spark):
    rows = [(k * 1_000 + i, f"group {k}") for k in range(1, 41) for i in range(k)]
    out = sharding.shard_documents(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    held(out, 4)
    texts = dict(rows)
    groups = defaultdict(set)
    for r in out:
        groups[texts[r.doc_id]].add(r.shard)
    assert sum(len(x) > 1 for x in groups.values()) <= 3  # one at each border at most


@pytest.mark.parametrize("shards", [2, 3])
def test_overlapping_groups_move_to_their_neighbours(spark, shards):
    """Communities whose members share several groups: propagation must lower the cut of its start."""
    size, rows, links = 60, [], []
    for c in range(shards):
        for i in range(size):
            rows.append((c * size + i,))
            links += [(c * size + i, f"{(c * 7 + i * 13) % 97:02d}-{c}-{(i + k) // 4}") for k in (0, 2)]
    docs = spark.createDataFrame(rows, "id long")
    frame = spark.createDataFrame(links, "id long, group string")
    quotas = [size] * shards
    lead = frame.groupBy("id").agg(F.min("group").alias("_lead"))
    start = lead.join(lead.groupBy("_lead").agg(F.count("*").alias("_n")), "_lead").withColumn("shard", F.pmod(F.xxhash64("_lead"), F.lit(shards)).cast("int"))
    before = sharding._cut(frame, sharding.settle(start, quotas))
    out = sharding.shard_rows(docs, frame, shards)
    after = sharding.cut_links(out, frame).first().cut
    held(out.collect(), shards)
    of = defaultdict(list)
    for i, g in links:
        of[i].append(g)
    assert after == cut(out.collect(), lambda r: of[r.id]) <= before


def test_null_repeated_empty_and_clashing(spark):
    rows = [(None, None, 1), (None, "", 1), (3, "x", 2), (3, "x", 2), (3, "y", 3), (4, "z" * 100_000, 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, shard int")
    out = sharding.shard_documents(docs, 2).collect()
    held(out, 2)
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    assert len({r.shard for r in out if r["size"] == 1}) == 1  # null and empty are equal
    assert sharding.shard_documents(docs.limit(0)).count() == 0
    same = sharding.shard_documents(docs.withColumn("text", F.lit("one")), 8).collect()
    held(same)
