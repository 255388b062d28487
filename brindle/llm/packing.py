"""Best-fit packing of token sequences by large-item matching."""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.bpe import encode_documents
from brindle.llm.catalog import query
from brindle.llm.common import ranked
from brindle.session import scratch, table

CAPACITY = 2048


def plan_bins(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Where the items of each length go: rows (length, from, upto, sequence, each, offset).

    ``counts`` says how many items have each length. Items number ``from`` to ``upto`` - 1 of a length
    go to the sequences from ``sequence`` on, ``each`` to a sequence, at ``offset``. Lengths are handled
    from long to short. Those over a third of the capacity are matched: a sequence takes one, and its
    gap the largest one that fits, so two at most. Shorter ones go to the smallest gap that holds them, as many as
    it holds; then to new sequences. Equal sequences are handled together, so the work and the plan
    depend on the number of lengths (the capacity at most), not on the number of items.
    """
    left = {n: c for n, c in counts.items() if c > 0}
    if any(n < 1 or n > capacity for n in left):
        raise ValueError("every length must be between 1 and the capacity")
    used = dict.fromkeys(left, 0)
    plan: list[tuple[int, int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # by gap: (first sequence, number of sequences)
    opened = 0

    def put(length: int, first: int, bins: int, each: int, at: int) -> None:
        plan.append((length, used[length], used[length] + bins * each, first, each, at))
        used[length] += bins * each
        left[length] -= bins * each

    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    partners = sorted(large)
    for n in large:
        while left[n]:
            k = bisect.bisect_right(partners, min(capacity - n, n)) - 1
            while k >= 0 and not left[partners[k]]:
                k -= 1
            m = partners[k] if k >= 0 else 0
            if m == n and left[n] < 2:
                m = next((x for x in reversed(partners[:k]) if left[x]), 0)
            if m == n:
                bins = left[n] // 2
                put(n, opened, bins, 2, 0)
                gap = capacity - 2 * n
            else:
                bins = min(left[n], left[m]) if m else left[n]
                put(n, opened, bins, 1, 0)
                if m:
                    put(m, opened, bins, 1, n)
                gap = capacity - n - m
            gaps.setdefault(gap, []).append((opened, bins))
            opened += bins
    order = sorted(g for g in gaps if g)
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            k = bisect.bisect_left(order, n)
            if k < len(order):
                gap = order[k]
                first, bins = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap], order[k]
            else:
                gap, first = capacity, opened
                bins = -(-left[n] // (capacity // n))
                opened += bins
            each = min(gap // n, left[n])
            some = min(bins, left[n] // each)
            put(n, first, some, each, capacity - gap)
            for g, at, number in ((gap - each * n, first, some), (gap, first + some, bins - some)):
                if g and number:
                    if g not in gaps:
                        gaps[g] = []
                        bisect.insort(order, g)
                    gaps[g].append((at, number))
    return plan


def pack_pieces(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Add sequence_id and offset to ``pieces`` (a written table with doc_id, piece and length from 1 to
    the capacity; what it holds besides stays).

    Only the number of pieces of each length, ``capacity`` numbers at most, reaches the driver, and the
    plan has a few rows for each. Pieces of one length are interchangeable: they are numbered (hot
    lengths over many tasks) and find their place by number. An empty table stays empty; repeated rows
    get places of their own.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = spark.createDataFrame(plan_bins(counts, capacity), "length long, since long, upto long, first long, each long, at long")
    numbered = ranked(pieces, ["length"], ["doc_id", "piece"], "_number", sum(counts.values()))
    plan = F.broadcast(plan.withColumnRenamed("length", "_length"))  # a few rows for each length
    at = (F.col("length") == F.col("_length")) & (F.col("_number") >= F.col("since")) & (F.col("_number") < F.col("upto"))
    placed = numbered.join(plan, at)
    nth = F.col("_number") - F.col("since")
    return placed.select(*pieces.columns, (F.col("first") + F.floor(nth / F.col("each"))).cast("long").alias("sequence_id"), (F.col("at") + nth % F.col("each") * F.col("length")).alias("offset"))


def _cutter(capacity: int, end: int, with_ids: bool):
    last = np.uint32(end).tobytes()

    def cut(found: pd.DataFrame) -> pd.DataFrame:
        rows: list[list] = [[], [], [], [], [], []]
        for doc, ids in zip(found["doc_id"], found["ids"], strict=True):
            blob = ids + last
            for k, at in enumerate(range(0, len(blob), 4 * capacity)):
                own = blob[at : at + 4 * capacity]
                for column, x in zip(rows, (doc, k, at // 4, len(own) // 4, zlib.crc32(own), own), strict=True):
                    column.append(x)
        names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
        kinds = [found["doc_id"].dtype, "int32", "int64", "int64", "int64", object]
        return pd.DataFrame({c: pd.Series(r, dtype=k) for c, r, k in list(zip(names, rows, kinds, strict=True))[: 5 + with_ids]})

    return cut


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Encode ``docs(doc_id, text)``, end each with the id ``end`` and cut it into pieces of ``capacity``
    ids: (doc_id, piece, start, length, ids_crc32, ids). A null or empty text is one piece, the end id."""
    columns = "piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids
    return encode_documents(docs, path, split="spaces", store=True, then=(_cutter(capacity, end, with_ids), columns))


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token sequences themselves: (sequence_id, ids), from packed pieces with their ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", F.hex("ids").alias("ids"))))
    return packed.groupBy("sequence_id").agg(F.unhex(F.concat_ws("", F.transform(parts, lambda p: p["ids"]))).alias("ids"))


def pack_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end: int = 0, with_ids: bool = True) -> DataFrame:
    """Tokenize documents and pack them into as few sequences of ``capacity`` ids as best fit finds.
    A null doc_id is kept; other columns than doc_id and text are not read."""
    return pack_pieces(scratch(cut_documents(docs, path, capacity, end, with_ids), "packing-pieces"), capacity)


def pack_word_bpe(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Pack documents at the production setting: the lower-case word BPE, 2048 ids, end id 0."""
    import public_tokenizers

    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), with_ids=with_ids)


@query("op1_best_fit_packing")
def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    return pack_word_bpe(table(spark, sf_dir, "documents").select("doc_id", "text"))
