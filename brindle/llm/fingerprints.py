"""Document fingerprints from closed syncmers of words."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.llm.common import small
from brindle.session import scratch, table

WORD_GAP = r"[\x20\x09-\x0D]+"
#: A k-mer is K words, its inner substrings are pairs of words.
K = 5
#: Documents of a run of doc_ids, and runs at most: their bounds are a constant, so beyond
#: RUN * RUNS = 1e9 documents runs get longer.
RUN, RUNS = 4_000, 250_000


def _let(value: Column, body) -> Column:
    """body(value) with the value computed once for the row, not once for each use inside a lambda."""
    return F.element_at(F.transform(F.array(value), body), 1)


def anchors(text: Column) -> Column:
    """The closed syncmers of a text in order, as structs of place (the first word's number) and hash.

    Words are hashed, and every pair of neighbours. Of the K - 1 pairs inside a k-mer the smallest hash
    must be the first or the last one, which depends on the k-mer alone, never on what surrounds it.
    Fewer words than K are one k-mer; no word gives no anchor.
    """

    def chosen(pairs: Column) -> Column:
        last = K - 2

        def closed(i: Column) -> Column:
            inner = [F.get(pairs, i + j) for j in range(1, last)]
            edge = F.least(F.get(pairs, i), F.get(pairs, i + last))
            return edge <= (F.least(*inner) if len(inner) > 1 else inner[0])

        places = F.filter(F.sequence(F.lit(0), F.size(pairs) - (K - 1)), closed)
        # pairs at both ends and, for an odd word between them, the pair that holds it
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.hash(*[F.get(pairs, i + j) for j in (*range(0, last, 2), last)]).alias("hash")))

    def paired(words: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.size(words) - 2), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1)))

    def whole(words: Column) -> Column:
        one = F.array(F.struct(F.lit(0).alias("place"), F.hash(F.array_join(words, " ")).alias("hash")))
        return F.when(F.size(words) >= K, _let(paired(words), chosen)).when(F.size(words) > 0, one)

    words = F.filter(F.split(text, WORD_GAP), lambda w: w != "")
    return F.coalesce(_let(words, whole), F.array().cast("array<struct<place:int,hash:int>>"))


def steps(found: Column) -> Column:
    """What places are matched by: for each anchor its hash, the next one's and how many words on it
    stands (the last one: no next), as distinct numbers."""

    def step(a: Column, i: Column) -> Column:
        following = F.get(found, i + 1)
        return F.xxhash64(a["hash"], following["hash"], following["place"] - a["place"])

    return F.array_distinct(F.transform(found, step))


def likeness(a: Column, b: Column) -> Column:
    """Likeness of two fingerprints by their :func:`steps`, 0 to 1: an anchor matches where the same one is
    followed by the same next one at the same distance; of all different anchors so placed, the share
    that matches. Two empty ones are alike."""
    both = F.size(F.array_intersect(a, b))
    every = F.size(a) + F.size(b) - both
    return F.when(every == 0, 1.0).otherwise(both / F.greatest(every, F.lit(1)))


def written(found: Column) -> Column:
    """A fingerprint as text: for each anchor eight hexadecimal digits of its hash, and one for how many
    words it stands behind the one before (closed syncmers are never over K - 2 words apart)."""
    parts = F.transform(
        found, lambda a, i: F.concat(F.right(F.concat(F.lit("0000000"), F.lower(F.hex(a["hash"]))), F.lit(8)), (a["place"] - F.when(i > 0, F.get(found, i - 1)["place"]).otherwise(F.lit(0))).cast("string"))
    )
    return F.array_join(parts, "")


def _runs(cuts: list, value: Column) -> Column:
    """How many of the sorted ``cuts`` are at most ``value``, looked up in two levels."""
    if not cuts:
        return F.lit(0)
    width = math.isqrt(len(cuts) - 1) + 1
    at_most = lambda own: F.size(F.filter(own, lambda c: c <= value))
    outer = at_most(F.array(*map(F.lit, cuts[::width])))
    inner = F.array(*(F.array(*map(F.lit, cuts[i : i + width])) for i in range(0, len(cuts), width)))
    return F.when(outer > 0, (outer - 1) * width + at_most(F.get(inner, outer - 1))).otherwise(0)


def with_next(docs: DataFrame, columns: list[str], add=lambda df: df) -> DataFrame:
    """Add next_<column> for each of ``columns``: the values of the next row in ascending order of
    (doc_id, text), nulls first; after the last row comes the first.

    Rows are dealt into runs of doc_ids by approximate quantiles, so no task sees all of them. The first
    row of each run is also given to the run before, so each run looks ahead by itself and rows
    are shuffled once. ``add`` makes more columns once rows are dealt.
    """
    runs = max(1, min(RUNS, -(-docs.count() // RUN)))
    cuts = docs.agg(F.percentile_approx("doc_id", [k / runs for k in range(1, runs)] or [0.5], max(10_000, 4 * runs)).alias("cuts")).first()["cuts"]
    run = F.when(F.col("doc_id").isNull(), 0).otherwise(_runs(sorted(set(cuts or [])) if runs > 1 else [], F.col("doc_id")))
    held = docs.withColumns({"_run": run.cast("int"), "_tie": F.xxhash64("text")})
    low = held.groupBy("_run").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("id"), "_tie")).alias("low"))
    every = Window.orderBy("_run").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    after = low.select("_run", F.coalesce(F.lead("low").over(Window.orderBy("_run")), F.first("low").over(every)).alias("low"))
    after = small(scratch(after, "next-heads"))
    same = (after["low.known"] == held["doc_id"].isNotNull()) & (after["low.id"] == F.coalesce(held["doc_id"], F.lit(0))) & (after["low._tie"] == held["_tie"])
    heads = held.join(after, same).select(*docs.columns, after["_run"], held["_tie"], F.lit(True).alias("_extra"))
    heads = scratch(heads.dropDuplicates(["_run"]), "next-texts")
    dealt = held.withColumn("_extra", F.lit(False)).unionByName(heads).repartition(F.col("_run"))
    order = Window.partitionBy("_run").orderBy("_extra", F.asc_nulls_first("doc_id"), "_tie")
    ahead = add(dealt)
    keep = [c for c in ahead.columns if c not in ("_run", "_tie", "_extra")]
    found = ahead.withColumn("_next", F.lead(F.struct(*columns)).over(order)).where(~F.col("_extra"))
    return found.select(*keep, *[F.col("_next")[c].alias(f"next_{c}") for c in columns])


def edited(text: Column, following: Column) -> Column:
    """The text with its last quarter of code points replaced by the first as many of the following one."""
    n = F.char_length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, text, edited, anchors, edited_anchors, next_anchors) for each row of ``docs``.

    A null text counts as empty and has no anchors; a null doc_id comes first in the order; rows that
    repeat a doc_id follow each other in the order of their texts' hashes; a single row is its own next
    one; an empty table stays empty. Texts and fingerprints are whole; other columns are not read.
    """
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    near = with_next(base, ["text", "anchors"], lambda df: df.withColumn("anchors", anchors(F.col("text"))))
    near = near.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    return near.select("doc_id", "text", "edited", "anchors", anchors(F.col("edited")).alias("edited_anchors"), "next_anchors")


@query("op5_fingerprints")
def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint every document and its edited text."""
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    found = found.withColumns({f"_{x}": steps(F.col(x)) for x in ("anchors", "edited_anchors", "next_anchors")})
    return found.select(
        "doc_id",
        F.char_length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("anchors")).alias("fingerprint"),
        written(F.col("edited_anchors")).alias("edited_fingerprint"),
        likeness(F.col("_anchors"), F.col("_edited_anchors")).alias("near_edited"),
        likeness(F.col("_anchors"), F.col("_next_anchors")).alias("near_next"),
    )
