"""Cross-tokenizer alignment: which tokens of two tokenizers cover the same bytes of a text.

In each batch pandas.merge_asof finds, for each token's start, the other side's token that covers it; the union
of both directions are the overlaps. Where a token and the one that covers its start begin together, a group
begins: up to there both sides ended together. A document's tokens lie in a range of byte offsets of their own,
which keys the search by document.
"""

from __future__ import annotations

import base64
import functools
import hashlib
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.bpe import _WS, _pack, _unpack, gather
from brindle.llm.catalog import query
from brindle.session import scratch, table

#: Units that a worker remembers, units that are aligned at once, and pairs of documents that make a chunk full.
REMEMBERED, AT_ONCE, CHUNK_PAIRS = 200_000, 100_000, 2_000_000
_BLANK_FIRST, _BLANK_LAST = re.compile(f"[{_WS}]"), re.compile(f".*[{_WS}]\\Z", re.S)


def _ragged(parts: list, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """Lists one after another, and their lengths."""
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter((x for p in parts for x in p), kind, int(lengths.sum())), lengths


class Side:
    """A tokenizer with the bytes of its pieces; ids of the units it has seen."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.pieces, self.sizes = pieces, np.fromiter(map(len, pieces), np.int64, len(pieces))
        self.clear()

    def clear(self) -> None:
        self.ids, self.lengths = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.starts = self.lengths

    def add(self, encoded: list[list[int]]) -> list[bytes]:
        """Remember the ids of new units; the bytes that each joins to."""
        ids, lengths = _ragged(encoded, np.int64)
        self.ids, self.lengths = np.concatenate([self.ids, ids]), np.concatenate([self.lengths, lengths])
        self.starts = np.cumsum(self.lengths) - self.lengths
        return [b"".join([self.pieces[i] for i in own]) for own in encoded]

    def of(self, units: np.ndarray) -> np.ndarray:
        return gather(self.ids, self.starts, self.lengths, units)


class Units(dict):
    """Texts as numbers of units, and the units' ids under both tokenizers.

    A unit begins with a space that has no white space around it: there no tokenizer's token goes on, so
    a unit's ids are the same in every text, and each distinct one is encoded once.
    """

    def __init__(self, ranks: str, model: str) -> None:
        import public_tokenizers
        import sentencepiece
        import tiktoken

        with open(ranks, "rb") as lines:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode_a = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={}).encode_ordinary
        self.model_b = sentencepiece.SentencePieceProcessor(model_file=model)
        names = [self.model_b.id_to_piece(i) for i in range(self.model_b.get_piece_size())]
        shown = [bytes([int(n[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", n) else n.replace("▁", " ").encode() for n in names]
        pieces = [b""] * (max(merges.values()) + 1)
        for piece, i in merges.items():
            pieces[i] = piece
        self.a, self.b = Side(pieces), Side(shown)
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.head: list[bool] = []
        self.tail: list[bool] = []
        self.whole = np.zeros(0, bool)
        self.a.clear()
        self.b.clear()

    def __missing__(self, unit: str) -> int:
        self[unit] = n = len(self)
        self.fresh.append(unit)
        self.head.append(not unit or _BLANK_FIRST.match(unit) is not None)
        self.tail.append(not unit or _BLANK_LAST.match(unit) is not None)
        return n

    def numbers(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        found = [self[p] for p in parts]
        head, tail = self.head, self.tail
        joined = [i for i in range(1, len(found)) if head[found[i]] or tail[found[i - 1]]]
        if joined:
            starts = sorted(set(range(len(parts))).difference(joined))
            found = [found[i] if j == i + 1 else self[" ".join(parts[i:j])] for i, j in zip(starts, [*starts[1:], len(parts)], strict=True)]
        return np.array(found, np.int64)

    def learn(self) -> None:
        """Encode the units that are new."""
        fresh, self.fresh = self.fresh, []
        if fresh:
            want = [b" " + u.encode() for u in fresh]
            a = self.a.add([self.encode_a(" " + u) for u in fresh])
            b = self.b.add(self.model_b.encode(fresh, num_threads=1))
            same = np.fromiter((x == w == y for x, w, y in zip(a, want, b, strict=True)), bool, len(want))
            self.whole = np.concatenate([self.whole, same])


@functools.lru_cache(maxsize=1)
def _units(ranks: str, model: str) -> Units:
    """One for each worker process."""
    return Units(ranks, model)


def overlaps(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which token of the other side covers each token's start, in both directions: for each of ``a`` one of ``b``
    and for each of ``b`` one of ``a``. Starts ascend, both sides cover the same bytes and begin together."""
    left, right = pd.DataFrame({"at": a, "a": np.arange(len(a))}), pd.DataFrame({"at": b, "b": np.arange(len(b))})
    return pd.merge_asof(left, right, on="at")["b"].to_numpy(), pd.merge_asof(right, left, on="at")["a"].to_numpy()


def overlap_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All (i, j) whose tokens share a byte, in order."""
    of_a, of_b = overlaps(a, b)
    both = np.concatenate([np.stack([np.arange(len(a)), of_a], 1), np.stack([of_b, np.arange(len(b))], 1)])
    return np.unique(both, axis=0)


def groups(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of each token's group, from 0, on both sides."""
    of_a, of_b = overlaps(a, b)
    return np.cumsum(b[of_a] == a) - 1, np.cumsum(a[of_b] == b) - 1


def group_links(in_a: np.ndarray, in_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All (i, j) of tokens in the same group, group by group."""
    n_a, n_b = np.bincount(in_a), np.bincount(in_b)
    each_a = np.repeat(n_b, n_a)  # links of each token of a
    i = np.repeat(np.arange(len(in_a)), each_a)
    first = np.repeat(np.cumsum(each_a) - each_a, each_a)
    return i, np.arange(len(i)) - first + np.repeat(np.repeat(np.cumsum(n_b) - n_b, n_a), each_a)


@functools.lru_cache(maxsize=1)
def _written(size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Every id as decimal digits with the sign behind it: `,` inside a side, `|` after A, `;` after B."""
    parts = [f"{i}{sign}".encode() for sign in ",|;" for i in range(size)]
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.frombuffer(b"".join(parts), np.uint8), np.cumsum(lengths) - lengths, lengths


class _Document:
    """What is known of a document after some of its units."""

    def __init__(self) -> None:
        self.n_a = self.n_b = self.n_groups = self.n_links = 0
        self.sha, self.keys = None, []

    def add(self, n_a: int, n_b: int, n_groups: int, text: bytes, keys: np.ndarray) -> None:
        self.n_a, self.n_b, self.n_groups, self.n_links = self.n_a + n_a, self.n_b + n_b, self.n_groups + n_groups, self.n_links + len(keys)
        if self.sha is None:
            self.sha = hashlib.sha256(text)
        else:
            self.sha.update(b";" + text)
        self.keys.append(np.unique(keys, return_counts=True))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct pairs and how often each is linked."""
        if len(self.keys) < 2:
            return self.keys[0] if self.keys else (np.zeros(0, np.int64), np.zeros(0, np.int64))
        keys, at = np.unique(np.concatenate([k for k, _ in self.keys]), return_inverse=True)
        return keys, np.bincount(at, np.concatenate([n for _, n in self.keys])).astype(np.int64)


def _align(known: Units, held: list[tuple[_Document, np.ndarray]]) -> None:
    """Align the units of some documents, or of parts of them, together."""
    units = np.concatenate([u for _, u in held])
    ids_a, ids_b = known.a.of(units), known.b.of(units)
    size_a, size_b = known.a.sizes[ids_a], known.b.sizes[ids_b]
    in_a, in_b = groups(np.cumsum(size_a) - size_a, np.cumsum(size_b) - size_b)
    i, j = group_links(in_a, in_b)
    keys = ids_a[i] << 32 | ids_b[j]
    # A's tokens of a group are written before B's: each stands behind those of the groups before it
    n_a, n_b = np.bincount(in_a), np.bincount(in_b)
    signs_a, signs_b = np.zeros(len(in_a), np.int64), np.zeros(len(in_b), np.int64)
    signs_a[np.cumsum(n_a) - 1], signs_b[np.cumsum(n_b) - 1] = 1, 2
    values, starts, lengths = _written(max(len(known.a.sizes), len(known.b.sizes)))
    step, order = len(lengths) // 3, np.empty(len(in_a) + len(in_b), np.int64)
    order[np.arange(len(in_a)) + (np.cumsum(n_b) - n_b)[in_a]] = signs_a * step + ids_a
    order[np.arange(len(in_b)) + np.cumsum(n_a)[in_b]] = signs_b * step + ids_b
    text = gather(values, starts, lengths, order).tobytes()
    # where each document's tokens, groups, links and letters end
    at = np.cumsum([len(u) for _, u in held]) - 1
    end_a, end_b = np.cumsum(known.a.lengths[units])[at], np.cumsum(known.b.lengths[units])[at]
    end_g = in_a[end_a - 1] + 1
    end_l, end_t = np.cumsum(n_a * n_b)[end_g - 1], np.cumsum(lengths[order])[end_a + end_b - 1]
    ends = np.stack([end_a, end_b, end_g, end_l, end_t], 1)
    begins = np.concatenate([np.zeros((1, 5), np.int64), ends[:-1]])
    for (doc, _), (a0, b0, g0, l0, t0), (a1, b1, g1, l1, t1) in zip(held, begins.tolist(), ends.tolist(), strict=True):
        doc.add(a1 - a0, b1 - b0, g1 - g0, text[t0 : t1 - 1], keys[l0:l1])


_NUMBERS = ("n_a", "n_b", "n_groups", "n_links")
_STORED = "chunk long, doc_id {id}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, places binary, times binary, a array<int>, b array<int>, docs array<int>"


def _chunk(ids: pa.Array, found: list[_Document]) -> pa.RecordBatch:
    """Documents with their distinct pairs as numbers of the chunk's pairs, and in one row those pairs with the
    number of documents that hold each."""
    number, own = uuid.uuid4().int >> 65, [d.pairs() for d in found]
    keys, places, docs = np.unique(np.concatenate([k for k, _ in own]), return_inverse=True, return_counts=True)
    cuts = np.cumsum([len(k) for k, _ in own])[:-1]
    n = len(found)
    columns = [
        pa.array([number] * (n + 1), pa.int64()),
        pa.concat_arrays([ids, pa.nulls(1, ids.type)]),
        *(pa.array([*(getattr(d, c) for d in found), None], pa.int64()) for c in _NUMBERS),
        pa.array([*("" if d.sha is None else d.sha.hexdigest() for d in found), None]),
        pa.array([*(_pack(p.astype(np.uint32)) for p in np.split(places, cuts)), None], pa.binary()),
        pa.array([*(_pack(t.astype(np.uint32)) for _, t in own), None], pa.binary()),
        *(pa.array([*[None] * n, x.astype(np.int32)], pa.list_(pa.int32())) for x in (keys >> 32, keys & 0xFFFFFFFF, docs)),
    ]
    return pa.RecordBatch.from_arrays(columns, names=["chunk", "doc_id", *_NUMBERS, "groups_sha256", "places", "times", "a", "b", "docs"])


def _aligned(ranks: str, model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _units(ranks, model)
        for batch in batches:
            found: list[_Document] = []
            held: list[tuple[_Document, np.ndarray]] = []
            begin = size = pairs = 0

            def settle() -> int:
                known.learn()
                # a text whose pieces join to other bytes under one tokenizer has no tokens
                parts = [(d, u) for d, whole in held if known.whole[whole].all() for u in np.array_split(whole, -(-len(whole) // AT_ONCE))]
                first, own = 0, 0
                for last, (_, u) in enumerate(parts):
                    own += len(u)
                    if own >= AT_ONCE or last + 1 == len(parts):
                        _align(known, parts[first : last + 1])
                        first, own = last + 1, 0
                held.clear()
                if len(known) > REMEMBERED:
                    known.forget()
                return sum(len(k) for d, _ in parts for k, _ in d.keys[-1:])

            for i, value in enumerate(batch.column(1)):
                text = value.as_py()
                found.append(doc := _Document())
                if text:
                    units = known.numbers(text)
                    held.append((doc, units))
                    size += len(units)
                if size >= AT_ONCE:
                    pairs, size = pairs + settle(), 0
                    if pairs >= CHUNK_PAIRS:
                        yield _chunk(batch.column(0).slice(begin, i + 1 - begin), found)
                        found, begin, pairs = [], i + 1, 0
            if held:
                settle()
            if found:
                yield _chunk(batch.column(0).slice(begin), found)

    return run


def _scored(docs: pa.Table, pairs: pa.Table) -> pa.Table:
    """Look the corpus-wide counts of a chunk's pairs up for its documents."""
    order = np.argsort(pairs["a"].to_numpy().astype(np.int64) << 32 | pairs["b"].to_numpy().astype(np.int64))
    counts, best = pairs["count"].to_numpy()[order], pairs["best"].to_numpy(zero_copy_only=False)[order]
    n_best, sums = [], []
    for places, times in zip(docs["places"].to_pylist(), docs["times"].to_pylist(), strict=True):
        at, n = _unpack(places, np.uint32), _unpack(times, np.uint32).astype(np.int64)
        n_best.append(int(n[best[at]].sum()))
        sums.append(int((n * counts[at]).sum()))
    columns = [docs["doc_id"], *(docs[c] for c in _NUMBERS), pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), docs["groups_sha256"]]
    return pa.table(columns, names=["doc_id", *_NUMBERS, "n_best", "count_sum", "groups_sha256"])


def align_documents(docs: DataFrame, ranks: str, model: str) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of ``docs(doc_id, text)``.

    A encodes the text behind a space by the byte-level merges in ``ranks``, B the text by the sentencepiece
    ``model``; special tokens' strings are plain text. Offsets where a token of both ends cut the tokens into groups; every
    A and B token of a group are linked. A pair of ids counts the documents that hold it linked; a link is best
    if no pair of its A id counts more. groups_sha256 is over ``a1,a2|b1;a3|b2,b3``.

    Documents' distinct pairs are counted by Spark; the counts come back to each chunk of documents by a join. A
    text that is null, empty, or whose tokens' bytes differ from it under one tokenizer has zeros and ''. Repeated rows count each;
    a null doc_id is kept; an empty table gives none; texts are whole, long ones are aligned in parts that begin where
    groups do. Other columns are not read.
    """
    kind = docs.schema["doc_id"].dataType.simpleString()
    stored = scratch(docs.select("doc_id", "text").mapInArrow(_aligned(ranks, model), _STORED.format(id=kind)), "alignment")
    held = stored.where("a is not null").select("chunk", F.inline(F.arrays_zip("a", "b", "docs")))
    sums = held.groupBy("a", "b").agg(F.sum("docs").alias("count"))
    # an A id has at most as many partners as B has ids
    best = F.col("count") == F.max("count").over(Window.partitionBy("a"))
    told = held.select(F.col("chunk").alias("of"), "a", "b").join(scratch(sums.withColumn("best", best), "alignment-pairs"), ["a", "b"])
    rows = stored.where("a is null").select("chunk", "doc_id", *_NUMBERS, "groups_sha256", "places", "times")
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return rows.groupBy("chunk").cogroup(told.groupBy("of")).applyInArrow(_scored, schema)


@query("op11_token_alignment")
def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Align every document's tokens under a byte-level BPE and a sentencepiece BPE."""
    import public_tokenizers

    paths = (public_tokenizers.path(x) for x in ("byte_bpe_50k.tiktoken", "piece_bpe_32k.model"))
    return align_documents(table(spark, sf_dir, "documents"), *paths)
