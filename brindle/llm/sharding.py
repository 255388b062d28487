"""Sharding by balanced label propagation: linked documents gather in one shard under even quotas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.llm.common import RANK_BLOCK, ranked
from brindle.session import scratch, table

SHARDS = 8
#: Passes in which whole groups look for room before what is left fills the shards row by row.
PASSES = 12
#: Label rounds go on while each lowers the cut by this share at least.
LEAST_FALL = 0.001


def _case(values: dict[int, int], key: Column, default: int) -> Column:
    out = F.lit(default).cast("long")
    for k, v in values.items():
        out = F.when(key == k, F.lit(v).cast("long")).otherwise(out)
    return out


def _loads(state: DataFrame, shards: int) -> dict[int, int]:
    found = {r["shard"]: r["n"] for r in state.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    return {k: found.get(k, 0) for k in range(shards)}


def _large_first(rows: int) -> Column:
    """Blocks for :func:`ranked` in which each _lead's rows follow one another, leads of more rows (_n) first.
    A large lead has blocks of its own, as many as it needs."""
    buckets = F.lit(max(1, -(-rows // RANK_BLOCK)))
    inner = F.floor(F.col("_n") / RANK_BLOCK) + 1
    bucket = F.when(inner > 1, F.xxhash64("_lead")).otherwise(F.pmod(F.xxhash64("_lead"), buckets))
    return F.struct((-F.floor(F.log2("_n"))).alias("size"), bucket.alias("bucket"), F.pmod(F.xxhash64("id"), inner).alias("inner"))


def settle(state: DataFrame, quotas: list[int]) -> DataFrame:
    """(id, _lead, _n, shard): places for whole leads (the rows of ``state`` with one _lead, _n of them) within
    the quotas, large ones first. ``state`` says in its shard where each would like to be.

    In each pass the leads that ask for a shard are lined up and those that fit into its room stay; the others ask
    for a shard that has room for them. Only a lead that is larger than any room is cut; leads larger than a shard
    come first. Rows that have found no
    place after PASSES passes are left out.
    """
    n = len(quotas)
    placed, waiting = None, state
    for turn in range(PASSES + n):
        held = _loads(placed, n) if placed is not None else dict.fromkeys(range(n), 0)
        room = {k: quotas[k] - held[k] for k in range(n)}
        count, largest = waiting.agg(F.count("*"), F.max("_n")).first()
        most = max(room.values())
        if not count or not most:
            break
        later = None
        if largest > max(quotas):  # n at most: these are cut in any case, but into few parts if they come first
            waiting, later = waiting.where(F.col("_n") > max(quotas)), waiting.where(F.col("_n") <= max(quotas))
        if turn:
            widest = max(room, key=lambda k: room[k])
            fits = F.filter(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(v).alias("room")) for k, v in room.items()]), lambda x: x["room"] >= F.col("_n"))
            some = F.get(fits, F.pmod(F.xxhash64("_lead", F.lit(turn)), F.greatest(F.size(fits), F.lit(1))).cast("int"))["k"]
            waiting = waiting.withColumn("shard", F.coalesce(some, F.lit(widest)).cast("int"))
        lined = scratch(ranked(waiting, ["shard"], ["_lead", "id"], "_place", count, _large_first(count)), "shard-lined")
        ends = lined.groupBy("shard", "_lead").agg(F.max("_place").alias("_end"))
        lined = lined.join(ends, ["shard", "_lead"])
        free = _case(room, F.col("shard"), 0)
        fine = (F.col("_end") < free) | ((F.col("_n") > most) & (F.col("_place") < free))
        lined = scratch(lined.select("id", "_lead", "_n", "shard", fine.alias("_fine")), "shard-settled")
        own = lined.where("_fine").drop("_fine")
        placed = scratch(placed.unionByName(own), "shard-placed") if placed is not None else own
        # of a lead that was cut, the rest is a smaller lead
        rest = lined.where("not _fine").drop("_fine")
        sizes = rest.groupBy("_lead").agg(F.count("*").alias("_n"))
        rest = rest.drop("_n").join(sizes, "_lead").select("id", "_lead", "_n", "shard")
        waiting = scratch(rest.unionByName(later) if later is not None else rest, "shard-waiting")
    return placed if placed is not None else state.limit(0)


def _cut(links: DataFrame, state: DataFrame) -> int:
    """How many members are not where most of their group is, over all groups."""
    parts = links.join(state.select("id", "shard"), "id").groupBy("group", "shard").agg(F.count("*").alias("n"))
    whole = links.groupBy("group").agg(F.count("*").alias("all"))
    cut = parts.groupBy("group").agg(F.max("n").alias("most")).join(whole, "group", "right").agg(F.sum(F.col("all") - F.coalesce("most", F.lit(0))))
    return cut.first()[0] or 0


def propagate(links: DataFrame, quotas: list[int]) -> DataFrame:
    """(id, shard) for the linked documents in ``links(id, group)``; members of a group are neighbours.

    Documents start where the first of their groups hashes to, within the quotas (:func:`settle`). Then, in each
    round, every group counts its members per shard, a document adds up the counts of its groups and asks to
    move where it has more neighbours than where it is. Moves between two shards are matched, and beyond that a
    shard takes what it has room for, those with the largest gain first; half of the documents may ask in
    a round, the others in the next, so that neighbours don't just change places. Rounds go on until neither half
    lowers the cut by LEAST_FALL of it; a round that doesn't lower it is undone. Only numbers of
    shards and of pairs of shards come to the driver. Documents that find no room are not returned.
    """
    n = len(quotas)
    lead = links.groupBy("id").agg(F.min("group").alias("_lead"))
    sizes = lead.groupBy("_lead").agg(F.count("*").alias("_n"))
    start = lead.join(sizes, "_lead").select("id", "_lead", "_n", F.pmod(F.xxhash64("_lead"), F.lit(n)).cast("int").alias("shard"))
    state = settle(scratch(start, "shard-start"), quotas)
    cut, idle, turn = _cut(links, state), 0, 0
    while cut and idle < 2:
        load = _loads(state, n)
        votes = links.join(state.select("id", "shard"), "id").groupBy("group", "shard").agg(F.count("*").alias("votes"))
        here = links.join(votes, "group").groupBy("id", "shard").agg(F.sum("votes").alias("votes"))
        groups = links.groupBy("id").agg(F.count("*").alias("groups"))
        asked = here.withColumnRenamed("shard", "target").join(state.select("id", "_lead", "shard").where(F.pmod(F.xxhash64("id", F.lit(turn // 2)), F.lit(2)) == turn % 2), "id")
        asked = asked.groupBy("id", "_lead", "shard").agg(
            F.max(F.when(F.col("target") != F.col("shard"), F.struct("votes", (-F.col("target")).alias("low")))).alias("to"),
            F.max(F.when(F.col("target") == F.col("shard"), F.col("votes"))).alias("own"),
        )
        asked = asked.join(groups, "id").withColumns({"gain": F.col("to.votes") - F.col("own") + F.col("groups"), "target": -F.col("to.low")})
        asked = scratch(asked.where("gain > 0").select("id", "_lead", "shard", "target", "gain"), "shard-asked")
        wish = {(r["shard"], r["target"]): r["n"] for r in asked.groupBy("shard", "target").agg(F.count("*").alias("n")).collect()}
        grant = {(a, b): min(k, wish.get((b, a), 0)) for (a, b), k in wish.items()}
        room = {k: quotas[k] - load[k] for k in range(n)}
        for (a, b), k in sorted(wish.items()):
            more = min(k - grant[a, b], room[b])
            grant[a, b] += more
            room[b] -= more
            room[a] += more
        if any(grant.values()):
            pair = F.col("shard") * n + F.col("target")
            gains = F.struct((-F.col("gain")).alias("gain"), F.pmod(F.xxhash64("_lead"), F.lit(max(1, sum(wish.values()) // RANK_BLOCK))).alias("bucket"))
            lined = ranked(asked.withColumn("_pair", pair), ["_pair"], ["_lead", "id"], "_place", sum(wish.values()), gains)
            granted = lined.where(F.col("_place") < _case({a * n + b: k for (a, b), k in grant.items()}, F.col("_pair"), 0)).select("id", "target")
            moved = scratch(state.join(granted, "id", "left").select("id", "_lead", "_n", F.coalesce("target", "shard").cast("int").alias("shard")), "shard-state")
            now = _cut(links, moved)
        else:
            moved, now = state, cut
        idle = 0 if now < cut * (1 - LEAST_FALL) else idle + 1
        if now < cut:
            state, cut = moved, now
        turn += 1
    return state.select("id", "shard")


def shard_rows(docs: DataFrame, links: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Put the rows of ``docs`` (with a unique ``id``) into shards whose row counts differ by at most
    one, keeping linked rows together where that allows. Adds shard and slot (from 0, gapless).

    Linked rows get their shards from :func:`propagate`; all others then fill each shard to its quota.
    No links, an empty table and groups larger than a shard are all fine.
    """
    total = docs.count()
    quotas = [total // shards + (k < total % shards) for k in range(shards)]
    placed = scratch(propagate(links, quotas), "shard-linked")
    load = _loads(placed, shards)
    free = scratch(docs.select("id").join(placed, "id", "left_anti"), "shard-free")
    numbered = ranked(free.withColumn("_all", F.lit(0)), ["_all"], ["id"], "_place")
    shard, upto = F.lit(shards - 1), sum(quotas) - sum(load.values())
    for k in range(shards - 1, -1, -1):
        shard = F.when(F.col("_place") < upto, F.lit(k)).otherwise(shard)
        upto -= quotas[k] - load[k]
    filled = numbered.select("id", shard.cast("int").alias("shard"))
    where = scratch(placed.select("id", F.col("shard").cast("int")).unionByName(filled), "shard-all")
    return docs.join(ranked(where, ["shard"], ["id"], "slot", total), "id")


def cut_links(placed: DataFrame, links: DataFrame) -> DataFrame:
    """One row: how many links (each document to its group's largest part) are cut by the shards."""
    return placed.sparkSession.createDataFrame([(_cut(links, placed),)], "cut long")


def shard_documents(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Shard documents under the law ``rows``; documents with equal texts are linked.

    Null texts count as empty and are equal to empty ones. A null or repeated doc_id is a row like any
    other. Other columns than doc_id and text are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    base = docs.select(
        "doc_id",
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.unhex(F.sha2(text, 256)).alias("group"),
    )
    base = scratch(base, "shard-docs")
    # equal rows can't be told apart by their values: they are numbered
    named = ranked(base, ["doc_id"], ["doc_id", "group"], "_copy")
    named = scratch(named.withColumn("id", F.unhex(F.md5(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "_copy")))), "shard-rows")
    shared = named.groupBy("group").agg(F.count("*").alias("_n")).where("_n > 1").select("group")
    links = scratch(named.join(shared, "group").select("id", "group"), "shard-links")
    return shard_rows(named.drop("_copy"), links, shards)


@query("op2_sharding")
def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard all documents into shards 0 to 7 whose row counts differ by at most one."""
    placed = shard_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
