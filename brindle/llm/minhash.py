"""MinHash near-dedup: a multi-index Hamming join of b-bit MinHash signatures.

A signature is 40 components of 16 bits. It is cut into 10 chunks of 4; by the pigeonhole principle two
signatures that differ in at most 19 components have a chunk in which they differ in at most one. Every chunk
is therefore entered four times, each time without another one of its components, so chunks with one error
meet in an entry. The join finds all pairs under that distance, and more by luck; what it finds is confirmed on
the full sets, so the distance rejects nothing itself. Two sets with similarity s miss each other in all chunks with the
probability (1 - s^4 - 4 s^3 (1 - s))^10: 4e-8 at 0.80, 3e-10 at 0.85.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import jaccard
from brindle.llm.catalog import query
from brindle.llm.common import slices
from brindle.llm.jaccard import spanning as spanning
from brindle.session import scratch, table

WORDS, PERCENT = 4, 80
#: Chunks of a signature, components of a chunk, and components that may differ in a chunk.
CHUNKS, WIDTH, ERRORS = 10, 4, 1
#: b: bits of a component. Three components and the entry's number are one 64-bit key.
BITS = 16
#: The distance under which no pair is missed.
DISTANCE = CHUNKS * (ERRORS + 1) - 1
_KEPT = list(combinations(range(WIDTH), WIDTH - ERRORS))
_SEEDS = np.random.default_rng(20_240_229).integers(1, 1 << 63, (2, CHUNKS * WIDTH), np.uint64)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """The (n, CHUNKS * WIDTH) components of n sets that aren't empty."""
    values = np.concatenate(sets)
    starts = np.cumsum([0, *(len(s) for s in sets[:-1])])
    out = np.empty((len(sets), CHUNKS * WIDTH), np.uint16)
    for i, (mask, factor) in enumerate(zip(*_SEEDS, strict=True)):
        least = np.minimum.reduceat((values ^ mask) * (factor | np.uint64(1)), starts)
        out[:, i] = (least ^ (least >> np.uint64(31))) & np.uint64((1 << BITS) - 1)
    return out


def chunk_keys(found: np.ndarray) -> np.ndarray:
    """The (n, entries) keys of n signatures: each chunk without ERRORS of its components, in every way."""
    wide = found.astype(np.int64).reshape(len(found), CHUNKS, WIDTH)
    keys = []
    for number, kept in enumerate(_KEPT):
        key = np.arange(CHUNKS, dtype=np.int64)[None, :] * len(_KEPT) + number
        for c in kept:
            key = key << BITS | wide[:, :, c]
        keys.append(key)
    return np.concatenate(keys, axis=1)


def _first_pass(words: int):
    """Each document's set size and digest; a set's signature with the first row of the task that has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingle, seen = jaccard.Shingler(words), set()
        for batch in slices(batches):
            sizes, digests, fresh, at = [], [], [], []
            for i, text in enumerate(batch.column(1).to_pylist()):
                s = shingle(text)
                sizes.append(len(s))
                digests.append(d := jaccard._digest(s))
                if len(s) and d not in seen:
                    seen.add(d)
                    fresh.append(s)
                    at.append(i)
            own: list[bytes | None] = [None] * len(sizes)
            if fresh:
                for i, row in zip(at, signatures(fresh), strict=True):
                    own[i] = row.tobytes()
            columns = [batch.column(0), batch.column(2), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(own, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "n", "digest", "signature"])

    return run


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(list, id): the index entries of signatures."""
    for batch in batches:
        if batch.num_rows:
            found = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint16).reshape(-1, CHUNKS * WIDTH)
            keys, ids = chunk_keys(found), jaccard._short(batch.column("digest").to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(ids, keys.shape[1]))], names=["list", "id"])


def find_links(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """(documents, links), as :func:`brindle.llm.jaccard.find_links` returns them, by the multi-index join.

    Equal sets are one class, so a copy costs no entries. Entries that one class alone has are dropped. A list
    of any size is held against its smallest member first; only members that are then still in different
    components are compared, in blocks, as :func:`brindle.llm.jaccard.links_in` says.
    """
    docs = docs.select("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    first = docs.withColumn("row", jaccard.row_key(docs)).mapInArrow(_first_pass(words), f"doc_id {kind}, row binary, n long, digest binary, signature binary")
    told = scratch(first, "minhash-first")
    classes = told.where("signature is not null").groupBy("digest").agg(F.first("signature").alias("signature"))
    entries = scratch(classes.mapInArrow(_entries, "list long, id long"), "minhash-entries")
    heads = entries.groupBy("list").agg(F.count("*").alias("k"), F.min("id").alias("pivot")).where("k > 1")
    lists = scratch(entries.join(heads.select("list", "pivot"), "list").select("list", "id", "pivot"), "minhash-lists")
    return told.drop("signature"), jaccard.links_in(lists, jaccard.sets_of(docs, told, lists, words), percent)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs(doc_id, text)``.

    Two documents link if 100 * intersection >= percent * union of their sets of ``words``-word shingles
    (fewer words: the whole sequence is the one shingle). component_id is the smallest doc_id that links
    reach; kept: the row has it. A text without words, or null, links with nothing and is its own component.
    Repeated rows are equal documents; a null doc_id takes part but is never the smallest, and is kept only
    where no other doc_id is in its component; an empty table stays empty. Other columns are not read. The chunks are made for
    ``percent`` of 80 or more; a lower one loses more pairs (see the module).
    """
    found = jaccard.labelled_rows(docs, words, percent, find_links)
    return found.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


@query("op13_minhash_dedup")
def op13_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of near duplicates among all documents, and which document of each stays."""
    return near_duplicates(table(spark, sf_dir, "documents"))
