"""N-gram Jaccard join: T-occurrence search over inverted lists of word shingles, in the DivideSkip way.

A document with n shingles needs T = ceil(3n/4) of them in common with any partner. Lists are ordered from
short to long by a frequency sketch. Of the document's n - T + L shortest lists a partner must stand in L,
so only these are merged (each task sends its entries sorted, and the sorted runs are merged), and documents without
so many shared lists drop out. A pair's occurrences in the merged lists are counted, and it is a candidate
from L on. The long lists are never merged: whether a candidate stands in the list of a shingle is
asked by binary search for the shingle in the candidate's sorted set, which needs no list of a common
shingle in one place. A pair stays if its overlap reaches what it needs.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.llm.common import slices, small
from brindle.session import counted, planned_once, release, scratch, table

WORDS, PERCENT = 5, 75
#: Slots of the frequency sketch: fixed, so it can be broadcast. Any order of the lists gives right
#: results; a better one gives fewer candidates.
SKETCH = 1 << 20
SKETCH_PARTS = 16
#: L as hundredths of n. A larger L merges more lists and lets fewer documents through.
SHARED = 15
#: 64-bit words of the bitmap of documents that have a candidate, which is fixed too; it only saves work.
WANTED = 1 << 20
#: 64-bit words of a document's bitmap (the parity of its shingles by slot).
BITS = 64
#: Rounds in which components that meet in a list are joined by a few pairs, before all pairs are looked at.
JOINING = 3
#: Members of a list that one task compares with each other.
BLOCK = 4096
#: Entries of the merged lists in one part, and of the open lists in one group, on average.
PART_ENTRIES, GROUP_ROWS = 8_000_000, 1_000_000
#: Nodes or pairs that are broadcast, so that a round over a few of them has no sorts and one shuffle. A larger table is joined
#: by shuffles.
FEW = 100_000
#: Bits of a shingle that name its list, beside the part.
LIST_BITS = 32
_MIX, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingles of texts; hashes of words are remembered for a while."""

    def __init__(self, words: int = WORDS) -> None:
        self.words = words

        class Hashes(dict):
            def __missing__(self, word: bytes) -> int:
                if len(self) > 150_000:
                    self.clear()
                self[word] = h = xxhash.xxh3_64_intdigest(word)
                return h

        self.hash_of = Hashes().__getitem__

    def __call__(self, text: str | None) -> np.ndarray:
        words = (text or "").encode().lower().split()  # A-Z only
        if not words:
            return np.zeros(0, np.uint64)
        h = np.fromiter(map(self.hash_of, words), np.uint64, len(words))
        k = min(self.words, len(words))
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out * _STEP + h[i : len(words) - k + 1 + i]) * _MIX
            out ^= out >> np.uint64(29)
        return np.unique(out)


def needed(n: int, percent: int = PERCENT) -> int:
    """The least overlap of a set of n shingles with any partner."""
    return -(-percent * n // 100)


def shared_least(n: int, percent: int = PERCENT) -> int:
    """How many of a document's merged shingles a partner must have at least. A partner may be as small as
    percent / 100 of n, and sends as many of its own."""
    return SHARED * percent * n // 10_000


def occurrences_least(n_a, n_b):
    """How many shingles the two members of a linked pair have in common in the merged lists at least, as
    columns: each sends SHARED hundredths more of its lists than it may miss."""
    return F.greatest(F.lit(1), F.ceil(F.least(n_a, n_b) * SHARED / 100))


def spare(s: np.ndarray, bits: int = LIST_BITS) -> int:
    """How many shingles of a sorted set may stand in a list that another one of the set stands in already: those
    whose first ``bits`` bits are another's too. A pair's lists are fewer than its common shingles by no more
    than this, for either member."""
    return int((np.diff(s >> np.uint64(64 - bits)) == 0).sum())


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    """Whether two sorted sets link: the shorter one is probed for in the longer one."""
    a, b = (a, b) if len(a) <= len(b) else (b, a)
    if not len(a) or 100 * len(a) < percent * len(b):
        return False
    common = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum())
    return 100 * common >= percent * (len(a) + len(b) - common)


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def _short(digests: list[bytes]) -> np.ndarray:
    """Class numbers for candidates: half a digest. Classes that share one are told apart later."""
    return np.frombuffer(b"".join(digests), ">i8").reshape(-1, 2)[:, 0].astype(np.int64)


def row_key(docs: DataFrame):
    """Names a row by its doc_id and text: only rows that agree in both share it. Nulls count as values."""
    text = F.coalesce(F.md5(docs["text"]), F.lit("null"))
    return F.unhex(F.md5(F.concat(text, F.coalesce(F.concat(F.lit(":"), docs["doc_id"].cast("string")), F.lit("")))))


_FIRST = "part int, doc_id {id}, row binary, n long, digest binary, slots binary"


def _first_pass(words: int):
    """Each document's set size and digest; at the end how often the task's sets fall in each slot."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, slots = Shingler(words), set(), np.zeros(SKETCH, np.uint32)
        kind = None
        for batch in slices(batches):
            kind = batch.column(0).type
            sizes, digests, fresh = [], [], []
            for text in batch.column(1).to_pylist():
                s = shingle(text)
                sizes.append(len(s))
                digests.append(d := _digest(s))
                if d not in seen:
                    seen.add(d)
                    fresh.append(s)
            if fresh:
                slots += np.bincount((np.concatenate(fresh) & np.uint64(SKETCH - 1)).astype(np.int64), minlength=SKETCH).astype(np.uint32)
            n = len(sizes)
            yield pa.RecordBatch.from_arrays([pa.array([-1] * n, pa.int32()), batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.nulls(n, pa.binary())], names=["part", "doc_id", "row", "n", "digest", "slots"])
        if kind is not None:
            n = SKETCH_PARTS
            yield pa.RecordBatch.from_arrays([pa.array(range(n), pa.int32()), pa.nulls(n, kind), pa.nulls(n, pa.binary()), pa.nulls(n, pa.int64()), pa.nulls(n, pa.binary()), pa.array([x.tobytes() for x in np.split(slots, n)], pa.binary())], names=["part", "doc_id", "row", "n", "digest", "slots"])

    return run


def _sum_slots(rows: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros(SKETCH // SKETCH_PARTS, np.uint64)
    for blob in rows["slots"]:
        total += np.frombuffer(blob, np.uint32)
    return pd.DataFrame({"part": rows["part"].iloc[:1], "slots": [np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()]})


def _postings(words: int, percent: int, parts: int, sketch, bits: int = LIST_BITS):
    """The short lists' entries, dealt over ``parts`` by shingle: ``bits`` bits of the shingle and the class, with
    the number of lists that the class must share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen, often = Shingler(words), set(), np.frombuffer(sketch.value, np.uint32)
        for batch in slices(batches, 3_000):
            digests, lists, least = [], [], []
            for text in batch.column(0).to_pylist():
                s = shingle(text)
                if len(s) and (d := _digest(s)) not in seen:
                    seen.add(d)
                    # sorted already, so a stable sort by frequency is one by (frequency, shingle)
                    order = np.argsort(often[(s & np.uint64(SKETCH - 1)).astype(np.int64)], kind="stable")
                    digests.append(d)
                    least.append(max(1, shared_least(len(s), percent) - spare(s, bits)))
                    more = max(1, -(-SHARED * len(s) // 100))
                    lists.append(s[order[: len(s) - needed(len(s), percent) + more]])
            if not lists:
                continue
            s = np.concatenate(lists)
            at = np.repeat(np.arange(len(lists), dtype=np.uint32), [len(x) for x in lists])
            part, key = (s >> np.uint64(20)) % np.uint64(parts), s >> np.uint64(64 - bits)
            order = np.argsort((part << np.uint64(32)) | key)  # a sorted run for each part
            ends = np.cumsum(np.bincount(part.astype(np.int64), minlength=parts))[:-1]
            keys, at, ids = np.split(key.astype(np.uint32)[order], ends), np.split(at[order], ends), _short(digests)
            least = np.array(least, np.uint32)
            rows: list[list] = [[], [], [], [], []]
            for p in range(parts):
                if len(keys[p]):
                    own, inside = np.unique(at[p], return_inverse=True)
                    for column, x in zip(rows, (p, keys[p].tobytes(), inside.astype(np.uint16 if len(own) < 65536 else np.uint32).tobytes(), ids[own].tobytes(), least[own].tobytes()), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), *(pa.array(r, pa.binary()) for r in rows[1:])], names=["part", "keys", "places", "ids", "least"])

    return run


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    """Merge the lists of a part: (list, id, least) for lists with two classes or more."""
    keys, ids, least = [], [], []
    for k, places, own, n in zip(rows["keys"], rows["places"], rows["ids"], rows["least"], strict=True):
        k = np.frombuffer(k, np.uint32)
        at = np.frombuffer(places, np.uint16 if len(places) == 2 * len(k) else np.uint32)
        keys.append(k)
        ids.append(np.frombuffer(own, np.int64)[at])
        least.append(np.frombuffer(n, np.uint32)[at])
    k, i, n = np.concatenate(keys), np.concatenate(ids), np.concatenate(least)
    order = np.argsort(k, kind="stable")  # merges the sorted runs
    k, i, n = k[order], i[order], n[order]
    once = np.ones(len(k), bool)  # most lists have one entry: these need no second sort
    once[1:] &= k[1:] != k[:-1]
    once[:-1] &= k[1:] != k[:-1]
    k, i, n = k[~once], i[~once], n[~once]
    order = np.lexsort((i, k))
    k, i, n = k[order], i[order], n[order]
    fresh = np.ones(len(k), bool)
    fresh[1:] = (k[1:] != k[:-1]) | (i[1:] != i[:-1])
    k, i, n = k[fresh], i[fresh], n[fresh]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(k)))
    many = np.repeat(sizes > 1, sizes)
    part = np.int64(rows["part"].iloc[0]) << np.int64(32)
    return pd.DataFrame({"list": part + k[many].astype(np.int64), "id": i[many], "least": n[many].astype(np.int64)})


def _sets(words: int, list_bits: int):
    """Sets and bitmaps of documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = Shingler(words), set()
        for batch in slices(batches):
            rows: list[list] = [[], [], [], [], [], []]
            for text in batch.column(0).to_pylist():
                s = shingle(text)
                if not len(s) or (d := _digest(s)) in seen:
                    continue
                seen.add(d)
                parity = np.bincount((s >> np.uint64(7)).astype(np.int64) & (64 * BITS - 1), minlength=64 * BITS) & 1
                for column, x in zip(rows, (int(_short([d])[0]), d, len(s), spare(s, list_bits), s.tobytes(), np.packbits(parity.astype(bool)).tobytes()), strict=True):
                    column.append(x)
            kinds = [pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, kinds, strict=True)], names=["id", "digest", "n", "spare", "set", "bits"])

    return run


def marked(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose doc_id is in ``wanted``, and perhaps a few more: a bitmap of WANTED words
    at most is broadcast, so no text is shuffled."""
    key = F.xxhash64("doc_id")
    slot, by = F.pmod(key, F.lit(WANTED)), F.pmod(F.shiftright(key, 20), F.lit(64)).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), by)
    bitmap = wanted.groupBy(slot.alias("_slot")).agg(F.bit_or(bit).alias("_bits"))
    probed = docs.withColumn("_slot", slot).join(F.broadcast(bitmap), "_slot")
    return probed.where(F.col("_bits").bitwiseAND(bit) != 0).select(*docs.columns)


def _verify(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = (batch.column(c).to_pylist() for c in ("set_a", "set_b"))
            keep = [linked(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64), percent) for x, y in zip(left, right, strict=True)]
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """(a, b) as digests: the pairs of class numbers ``pairs(a, b)``, a written table, that link by their whole sets. Of few
    pairs only the sets that stand in one are shuffled."""
    of = lambda x: sets.select(F.col("id").alias(x), F.col("digest").alias(f"digest_{x}"), F.col("set").alias(f"set_{x}"))
    left, right = pairs.join(of("a"), "a"), of("b")
    if counted(pairs) <= FEW:
        left, right = of("a").join(F.broadcast(pairs), "a"), right.join(F.broadcast(pairs.select("b")), "b", "left_semi")
    both = left.join(right, "b")
    both = both.where(F.col("digest_a") != F.col("digest_b")).select(F.col("digest_a").alias("a"), F.col("digest_b").alias("b"), "set_a", "set_b")
    return both.mapInArrow(_verify(percent), "a binary, b binary")


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label) for every node of ``links(a, b)``; the label is its component's smallest node.

    Each round takes the smallest label among a node and its neighbours, then the label's own label, so that
    chains shorten by half; every round is written to shared scratch space and tells by that whether a label changed. ``links`` is a
    written table. The labels of ``FEW`` nodes or fewer go to the edges, and a round is one job beside its broadcast, written by as
    many tasks as there are cores; those of more nodes are joined by shuffles.
    """
    spark = links.sparkSession
    few, cores = counted(links) <= FEW // 2, spark.sparkContext.defaultParallelism
    dealt_out = lambda df: df.coalesce(cores) if few else df  # noqa: E731  else they lie in a file for each shuffle partition
    with planned_once(spark, cores) if few else contextlib.nullcontext():
        # both ways, and from each node to itself
        ends = (F.struct(F.col(x).alias("a"), F.col(y).alias("b")) for x, y in ("ab", "ba", "aa", "bb"))
        edges = scratch(dealt_out(links.select(F.inline(F.array(*ends))).distinct()), "link-edges")
        labels = scratch(dealt_out(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("label"))), "link-labels")
        for _ in range(rounds):
            sent, changed = F.broadcast(labels) if few else labels, Observation()
            told = edges.join(sent.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node"))
            told = told.agg(F.min(F.when(F.col("a") == F.col("b"), F.col("label"))).alias("old"), F.min("label").alias("low"))
            far = sent.select(F.col("node").alias("low"), F.col("label").alias("far"))
            lower = told.join(far, "low").select("node", "old", F.least("low", "far").alias("label"))
            lower = lower.observe(changed, F.count_if(F.col("old") != F.col("label")).alias("n"))
            labels = scratch(dealt_out(lower.select("node", "label")), "link-labels")
            if not changed.get["n"]:
                return labels
    raise RuntimeError("the components did not settle")


def spanning(i: np.ndarray, j: np.ndarray, weights: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """Which pairs (i, j), the lightest ones, join all components that the pairs could join. Components
    are numbered by ``labels``; in each round every component takes its lightest pair."""
    order = np.lexsort((j, i, weights))
    i, j, labels, taken = i[order], j[order], labels.copy(), np.zeros(len(i), bool)
    alive = np.flatnonzero(labels[i] != labels[j])
    while len(alive):
        ends = np.stack([labels[i[alive]], labels[j[alive]]], 1).ravel()
        own, first = np.unique(ends, return_index=True)  # pairs are in order, so the first one is the lightest
        best = alive[first // 2]
        taken[best] = True
        up = np.arange(labels.max() + 1)
        other = labels[i[best]] + labels[j[best]] - own
        up[own] = np.where((first // 2)[np.searchsorted(own, other)] == first // 2, np.minimum(own, other), other)
        while (up[up] != up).any():
            up = up[up]
        labels = up[labels]
        alive = alive[labels[i[alive]] != labels[j[alive]]]
    return order[taken]


_MET = ("group", "low", "high", "a", "b")


def _compare(percent: int, more: int, at_once: int = 1 << 20):
    """Pairs of a group's members from different components that stand together in a list, that size and bitmaps allow to
    link and that weren't tried before: those that would join the components, the likeliest first, and ``more``
    others for each member. ``left`` tells that the group may have further ones. A member brings all its lists in the
    group in one row. The lists are worked on together: each entry meets the next one of its list, then the one after, ..."""

    def run(key: tuple, rows: pd.DataFrame, tried: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id", kind="stable")  # members are numbered by id
        ids, sizes, blocks = (rows[c].to_numpy() for c in ("id", "n", "block"))
        codes = pd.factorize(rows["label"])[0]
        kept, weights, left = np.zeros(0, np.int64), np.zeros(0), False
        if codes.max(initial=0) == 0:
            return pd.DataFrame(dict(zip(_MET, (kept,) * 5, strict=True)) | {"left": np.zeros(0, bool)})
        number = np.searchsorted(ids, ids)  # classes that share an id share it
        done = np.searchsorted(ids, tried["a"].to_numpy()) * len(ids) + np.searchsorted(ids, tried["b"].to_numpy())
        bits = np.frombuffer(b"".join(rows["bits"]), np.uint64).reshape(-1, BITS)
        lists = np.concatenate(list(rows["lists"]))
        member = np.repeat(np.arange(len(ids)), [len(x) for x in rows["lists"]])
        order = np.argsort(lists, kind="stable")
        lists, member = lists[order], member[order]
        n, block, labels = sizes[member], blocks[member], codes[member]
        ends = np.searchsorted(lists, lists, side="right")
        held, size = [], 0

        def sift() -> None:
            """A pair stands in many lists: it is looked at once."""
            nonlocal held, size, kept, weights, left
            pairs = np.unique(np.concatenate(held))
            i, j = np.divmod(pairs, len(ids))
            fresh = (number[i] != number[j]) & ~np.isin(number[i] * len(ids) + number[j], done)
            found, apart = [kept], [weights]
            i, j, pairs = i[fresh], j[fresh], pairs[fresh]
            for at in range(0, len(i), 1 << 14):
                x, y = i[at : at + (1 << 14)], j[at : at + (1 << 14)]
                # overlap >= p (x + y) / (100 + p) leaves at most (100 - p) (x + y) / (100 + p) apart
                differ = np.bitwise_count(bits[x] ^ bits[y]).sum(axis=1, dtype=np.int64)
                ok = (100 + percent) * differ <= (100 - percent) * (sizes[x] + sizes[y])
                found.append(pairs[at : at + (1 << 14)][ok])
                apart.append((differ / (sizes[x] + sizes[y]))[ok])
            pairs, at = np.unique(np.concatenate(found), return_index=True)
            weights = np.concatenate(apart)[at]
            if len(pairs) > more * len(ids):
                best = spanning(*np.divmod(pairs, len(ids)), weights, codes)
                at = np.union1d(best, np.argsort(weights, kind="stable")[: more * len(ids)])
                left |= len(at) < len(pairs)
                pairs, weights = pairs[at], weights[at]
            kept, held, size = pairs, [], 0

        alive, step = np.arange(len(lists)), 0
        while len(alive):
            step += 1
            alive = alive[ends[alive] > alive + step]
            j = alive + step
            ok = (labels[alive] != labels[j]) & (100 * np.minimum(n[alive], n[j]) >= percent * np.maximum(n[alive], n[j]))
            if key[1] != key[2]:  # only pairs from the two blocks
                ok &= block[alive] != block[j]
            if ok.any():
                held.append(member[alive[ok]] * len(ids) + member[j[ok]])
                size += int(ok.sum())
            if size > at_once:
                sift()
        if held:
            sift()
        i, j = np.divmod(kept, len(ids))
        same = lambda x: np.full(len(i), x)
        return pd.DataFrame(dict(zip(_MET, (*map(same, key), ids[i], ids[j]), strict=True)) | {"left": same(left)})

    return run


def _labelled(sets: DataFrame, links: DataFrame, more: tuple[str, ...] = ()) -> DataFrame:
    """(id, label, ...) of every class with a set; a class without a link is its own label."""
    labels = components(links).withColumnRenamed("node", "digest")
    named = sets.select("id", "digest", *more).join(labels, "digest", "left")
    return named.select("id", F.coalesce("label", "digest").alias("label"), *more)


def sets_of(docs: DataFrame, told: DataFrame, lists: DataFrame, words: int, list_bits: int = LIST_BITS) -> DataFrame:
    """(id, digest, n, spare, set, bits) of the classes that stand in ``lists``, each class once."""
    short = F.conv(F.hex(F.substring("digest", 1, 8)), 16, -10).cast("long").alias("id")
    classes = told.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select(short, "doc_id")
    ids = lists.select("id").distinct()
    wanted = classes.join(ids, "id").select("doc_id")
    sets = marked(docs, wanted).select("text").mapInArrow(_sets(words, list_bits), "id long, digest binary, n long, spare long, set binary, bits binary")
    sets = sets.join(ids, "id", "left_semi").groupBy("id", "digest")
    return scratch(sets.agg(*(F.first(c).alias(c) for c in ("n", "spare", "set", "bits"))), "jaccard-sets")  # copies once


def first_links(lists: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Some of the links (a, b) between classes that stand together in one of ``lists(list, id, pivot)``, a written
    table whose pivot is the list's smallest id: every class is held against the smallest member of the
    lists that it shares most, then a few pairs of each two components that meet."""
    shared = lists.where(F.col("id") != F.col("pivot")).groupBy("id", "pivot").agg(F.count("*").alias("shared"))
    shared = scratch(shared, "jaccard-shared")
    stars = shared.groupBy(F.col("id").alias("a")).agg(F.max_by("pivot", F.struct("shared", "pivot")).alias("b"))
    # classes that share a number are candidates of each other
    twins = sets.groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("a"), F.col("id").alias("b"))
    links = scratch(verified(scratch(stars.union(twins), "jaccard-stars"), sets, percent), "jaccard-links")
    for turn in range(JOINING):  # a few pairs for each two components that meet in a list
        named = scratch(_labelled(sets, links).select("id", F.xxhash64("label").alias("label")), "jaccard-labels")
        met = shared.join(named.withColumnRenamed("label", "x"), "id").join(named.select(F.col("id").alias("pivot"), F.col("label").alias("y")), "pivot").where("x != y")
        key = (F.least("x", "y").alias("l"), F.greatest("x", "y").alias("h"), F.pmod(F.xxhash64("id", F.lit(turn)), F.lit(JOINING)).alias("k"))
        tries = met.groupBy(*key).agg(F.max_by(F.struct(F.col("id").alias("a"), F.col("pivot").alias("b")), F.struct("shared", F.xxhash64("id", "pivot", F.lit(turn)))).alias("t"))
        more = scratch(verified(scratch(tries.select("t.*"), "jaccard-tries"), sets, percent), "jaccard-links")
        if more.isEmpty():
            break
        links = scratch(links.union(more), "jaccard-links")
    release(lists.sparkSession)
    return links


def dealt(lists: DataFrame, members: DataFrame) -> DataFrame:
    """(group, low, high, block, id, lists): the members of lists with several components, dealt into groups to be
    compared. A long list is cut into blocks, and each two blocks are a group; short ones share a group."""
    shuffles = int(lists.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spread = lists.select("list", "id").join(members.select("id", "label"), "id").groupBy("list")
    open_lists = spread.agg(F.min("label").alias("l"), F.max("label").alias("h"), F.count("*").alias("k")).where("l != h")
    blocks = F.ceil(F.col("k") / F.lit(BLOCK)).cast("int")
    rest = lists.select("list", "id", "pivot").join(open_lists.select("list", blocks.alias("blocks")), "list")
    rest = rest.withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rest = rest.withColumns({"low": F.least("block", "with"), "high": F.greatest("block", "with")})
    # lists with one smallest member hold much the same pairs: in one of four groups these are found once
    groups = max(8 * shuffles, counted(lists) // GROUP_ROWS)
    near = F.pmod(F.xxhash64("pivot", F.pmod("list", F.lit(4))), F.lit(groups))
    rest = rest.withColumn("group", F.when(F.col("blocks") == 1, near).otherwise(F.col("list")))
    # a member's size and bitmap come once to each group, however many of its lists are there
    return rest.groupBy("group", "low", "high", "block", "id").agg(F.collect_list("list").alias("lists"))


def met_often(pairs: DataFrame, lists: DataFrame, members: DataFrame, enough: Callable) -> DataFrame:
    """The ``pairs(a, b)`` that meet ``enough(n_a, n_b)`` times in ``lists(list, id)``, common shingles that share a list
    told by ``spare``. Both are written tables."""
    ids = scratch(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "jaccard-ids")
    own = lists.join(small(ids), "id", "left_semi").groupBy("id").agg(F.collect_list("list").alias("own"))
    own = own.join(members.groupBy("id").agg(F.min("n").alias("n"), F.max("spare").alias("spare")), "id")
    of = lambda x: own.select(F.col("id").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in ("own", "n", "spare")))
    times = F.size(F.array_intersect("own_a", "own_b")) + F.least("spare_a", "spare_b")
    return pairs.join(of("a"), "a").join(of("b"), "b").where(times >= enough(F.col("n_a"), F.col("n_b"))).select("a", "b")


def links_in(lists: DataFrame, sets: DataFrame, percent: int, enough: Callable | None = None) -> DataFrame:
    """Links (a, b) between classes that stand together in one of ``lists``, enough of them that every two classes that
    a link joins are connected: :func:`first_links`, and then, group of lists by group, pairs of members that are still in
    different components, as many as a group has members and those that would join its components. Groups that have
    more of them come again, once these are confirmed and components joined, until none has a pair left that could
    join two components and wasn't tried. ``enough(n_a, n_b)``: how often a linked pair meets at least, if that is known."""
    spark = lists.sparkSession
    links = first_links(lists, sets, percent)
    labelled = lambda: scratch(_labelled(sets, links, ("n", "spare", "bits")), "jaccard-members")
    members, schema = labelled(), "group long, low int, high int, a long, b long, left boolean"
    groups = scratch(dealt(lists, members), "jaccard-groups")
    release(spark)
    tried, turn, keys = spark.createDataFrame([], schema), 0, ["group", "low", "high"]
    while True:
        rows = groups.join(members, "id").groupBy(*keys)
        met = rows.cogroup(tried.groupBy(*(F.col(c).alias(f"_{c}") for c in keys))).applyInPandas(_compare(percent, 4**turn), schema)
        met = scratch(met, "jaccard-met")
        pairs = met.select("a", "b").distinct()
        if turn:
            pairs = pairs.join(tried.select("a", "b").distinct(), ["a", "b"], "left_anti")
        pairs = scratch(pairs, "jaccard-pairs")
        release(spark)
        if enough:
            pairs = scratch(met_often(pairs, lists, members, enough), "jaccard-pairs")
        links = scratch(links.union(verified(pairs, sets, percent)), "jaccard-links")
        again = scratch(met.where("left").select(*keys).distinct(), "jaccard-again")
        if again.isEmpty():
            return links
        groups = scratch(groups.join(small(again), keys, "left_semi"), "jaccard-groups")
        tried, members, turn = scratch(tried.union(met), "jaccard-tried"), labelled(), turn + 1


def find_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, bits: int = LIST_BITS) -> tuple[DataFrame, DataFrame]:
    """(documents, links). Documents: (doc_id, row, n, digest), the digest names the class of equal sets.
    Links: (a, b) between classes, as :func:`links_in` finds them in the merged lists. ``bits`` name a list within its part; with
    fewer of them shingles share lists, which finds the same links from more candidates.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = scratch(docs.withColumn("row", row_key(docs)).mapInArrow(_first_pass(words), _FIRST.format(id=kind)), "jaccard-first")
    told = first.where("part < 0").select("doc_id", "row", "n", "digest")
    sums = first.where("part >= 0").groupBy("part").applyInPandas(_sum_slots, "part int, slots binary").orderBy("part").collect()
    sketch = spark.sparkContext.broadcast(b"".join(r["slots"] for r in sums) or bytes(4 * SKETCH))
    texts = docs.select("text")
    sent = (told.agg(F.sum("n")).first()[0] or 0) * (100 - percent + SHARED) // 100
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), sent // PART_ENTRIES)
    entries = texts.mapInArrow(_postings(words, percent, parts, sketch, bits), "part int, keys binary, places binary, ids binary, least binary")
    release(spark)
    merged = scratch(entries.groupBy("part").applyInPandas(_merge, "list long, id long, least long"), "jaccard-merged")
    release(spark)
    able = merged.groupBy("id").agg(F.count("*").alias("k"), F.min("least").alias("least")).where(F.col("k") >= F.col("least"))
    lists = merged.select("list", "id").join(able.select("id"), "id")
    heads = lists.groupBy("list").agg(F.count("*").alias("k"), F.min("id").alias("pivot")).where("k > 1").select("list", "pivot")
    lists = scratch(lists.join(heads, "list").select("list", "id", "pivot"), "jaccard-lists")
    return told, links_in(lists, sets_of(docs, told, lists, words, bits), percent, occurrences_least)


def labelled_rows(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, finder: Callable = find_links) -> DataFrame:
    """(doc_id, row, n_shingles, component_id, component) for each row of ``docs(doc_id, text)``.

    row is its :func:`row_key`; component tells components apart, whatever their ids, and is null for a
    text without words. The others are as in :func:`jaccard_components`. ``finder`` finds the links.
    """
    told, links = finder(docs, words, percent)
    release(docs.sparkSession)
    labels = components(links)
    classes = told.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("low"))
    classes = classes.join(labels.withColumnRenamed("node", "digest"), "digest", "left").select("digest", "low", F.coalesce("label", "digest").alias("label"))
    least = classes.groupBy("label").agg(F.min("low").alias("component_id"))
    named = classes.join(least, "label").select("digest", "component_id", F.col("label").alias("component"))
    whole = told.where("n > 0").join(named, "digest").select("doc_id", "row", F.col("n").alias("n_shingles"), "component_id", "component")
    alone = told.where("n = 0").select("doc_id", "row", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("component"))
    return whole.unionByName(alone)


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs(doc_id, text)``.

    Two documents link if 100 * intersection >= percent * union of their sets of ``words``-word shingles
    (fewer words: the whole sequence is the one shingle). component_id is the smallest doc_id that links
    reach. A text without words, or null, links with nothing and is its own component. Repeated rows
    are equal documents; a null doc_id takes part but is never the smallest; an empty table stays empty.
    """
    return labelled_rows(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay: of each component the one with the smallest (doc_id, row key), once.

    ``found`` comes from :func:`labelled_rows`; if it lacks the components (doc_ids alone don't tell them
    apart) they are looked for again. Of rows without words, those that share a doc_id and a text stay
    once; without a doc_id nothing makes them one document, and all stay.
    """
    if "component" not in found.columns:
        found = labelled_rows(docs)
    rows = found.groupBy("row").agg(F.first("component").alias("component"), F.first("doc_id").alias("doc_id"), F.count("*").alias("n"))
    rows = scratch(rows, "jaccard-rows")  # else each query below has the plan of all labels in it
    first = F.struct(F.col("doc_id").isNull(), "doc_id", "row")
    kept = rows.where(F.col("component").isNotNull()).groupBy("component").agg(F.min_by(F.struct("row", "n"), first).alias("k")).select("k.*")
    kept = kept.union(rows.where(F.col("component").isNull() & F.col("doc_id").isNotNull()).select("row", "n"))
    alone = rows.where(F.col("component").isNull() & F.col("doc_id").isNull()).select("row")
    once = kept.where("n = 1").select("row").union(alone)
    left_out = scratch(rows.join(once, "row", "left_anti").select(F.col("row").alias("_row")), "jaccard-left-out")
    more = scratch(kept.where("n > 1").select(F.col("row").alias("_row")), "jaccard-kept")
    release(docs.sparkSession)
    named = docs.withColumn("_row", row_key(docs))
    # rows agree that share a key; while few are left out no text is shuffled, but for those with a double
    stay = named.join(small(left_out), "_row", "left_anti").select(*docs.columns)
    if more.isEmpty():
        return stay
    return stay.unionByName(named.join(small(more), "_row", "left_semi").dropDuplicates(["_row"]).select(*docs.columns))


@query("op3_jaccard_join")
def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents."""
    return jaccard_components(table(spark, sf_dir, "documents"))
