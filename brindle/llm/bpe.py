"""BPE by a distinct-word table: every distinct word is encoded once, ids are joined back by position."""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.session import scratch, table

#: Unicode white space, as the tokenizers' patterns see it.
_WS = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Units that a byte-level pre-tokenizer never joins: a word with the one space before it, or white space.
_UNIT = re.compile(f" ?[^{_WS}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]")
#: A word goes to the same part with any of these around it.
_MARKS = b" .,;:!?%&$#*"
_CHUNKS = "chunk long, part int, doc_id string, first binary, second binary"
_IDS = "chunk long, places binary, lengths binary, ids binary"


class _Numbered(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def byte_units(text: str) -> list[bytes]:
    return [u.encode() for u in _UNIT.findall(text)]


def space_units(text: str) -> list[bytes]:
    """For a tokenizer that drops white space: what stands between ASCII white space."""
    return text.encode().split()


SPLITS = {"bytes": byte_units, "spaces": space_units}


def _pack(array: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(array.tobytes())


def _unpack(blob: bytes, kind: type) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), kind)


def gather(values: np.ndarray, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The runs values[starts[i] : starts[i] + lengths[i]] for i in ``at``, one after another."""
    n = lengths[at]
    total = int(n.sum())
    if not total:
        return values[:0]
    ends = np.cumsum(n)
    return values[np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[at], n)]


def _content(words: dict[bytes, int], bodies: list[bytes]) -> int:
    """A chunk's key follows from what it holds. Words and documents are read apart, and may be read again
    when an executor is lost: chunks that are composed otherwise then don't meet, see :func:`_joined`."""
    h = xxhash.xxh3_64(b"\0".join(words))
    h.update(b"".join(bodies))
    return h.intdigest() - (1 << 63)


def _chunker(split: str, parts: int):
    """Each Arrow batch of documents is a chunk: its documents as numbers of the chunk's distinct words,
    and those words dealt over ``parts`` by hash."""
    units = SPLITS[split]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            words = _Numbered()
            number_of = words.__getitem__
            bodies = [_pack(np.fromiter(map(number_of, units(t.as_py() or "")), np.uint32)) for t in batch.column(1)]
            n, number = len(bodies), _content(words, bodies)
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array([-1] * n, pa.int32()), batch.column(0), pa.array(bodies, pa.binary()), pa.nulls(n, pa.binary())],
                names=["chunk", "part", "doc_id", "first", "second"],
            )
            dealt: dict[int, tuple[list[bytes], list[int]]] = {}
            for word, i in words.items():
                own = dealt.setdefault(zlib.crc32(word.strip(_MARKS)) % parts, ([], []))
                own[0].append(word)
                own[1].append(i)
            n = len(dealt)
            blobs = [_pack(np.frombuffer(b"".join(w), np.uint8)) for w, _ in dealt.values()]
            sizes = [_pack(np.array([*map(len, w), *i], np.uint32)) for w, i in dealt.values()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([number] * n, pa.int64()), pa.array(list(dealt), pa.int32()), pa.nulls(n, batch.column(0).type), pa.array(blobs, pa.binary()), pa.array(sizes, pa.binary())],
                names=["chunk", "part", "doc_id", "first", "second"],
            )

    return run


def load_tokenizer(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


#: A plain word: perhaps a space, Latin letters, then marks that no pre-tokenizer joins to a letter.
_PLAIN = re.compile("( ?)([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\\[-`{-~]*)")
#: How byte-level vocabularies write each byte.
_SHOWN = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_CHARS = {b: chr(b) for b in _SHOWN} | {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _SHOWN)}
#: Words that one call of the tokenizer encodes together, and calls before their ids are collected.
_TOGETHER, _CALLS = 64, 256
_DECODED = 256
#: Documents whose distinct words make one part of the word table, on average.
PART_DOCS = 4_000


class WordEncoder:
    """Ids of distinct words. Plain ones go to the vocabulary's merges directly, many to a call, without
    the normalizer and the pre-tokenizer, which wouldn't change them; all others to the whole tokenizer."""

    def __init__(self, path: str, split: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        self.whole, self.split = load_tokenizer(path), split
        self.merges = Tokenizer(self.whole.model)
        self.merges.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        pieces = self.whole.get_vocab()
        #: whether an id ends a word (vocabularies with word ends), or begins one (with marked spaces)
        self.edge = np.zeros(max(pieces.values()) + 1, bool)
        for piece, i in pieces.items():
            self.edge[i] = piece.endswith("</w>") if split == "spaces" else piece.startswith(BYTE_CHARS[32])

    def _singly(self, words: list[str], tokenizer) -> tuple[np.ndarray, np.ndarray]:
        ids, lengths = [], []
        for i in range(0, len(words), 2_000):
            for e in tokenizer.encode_batch_fast(words[i : i + 2_000], add_special_tokens=False):
                own = e.ids
                lengths.append(len(own))
                ids.append(np.array(own, np.uint32))
        return np.concatenate([np.zeros(0, np.uint32), *ids]), np.array(lengths, np.int64)

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        lines, parts = [" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)], [np.zeros(0, np.uint32)]
        for i in range(0, len(lines), _CALLS):
            parts += [np.array(e.ids, np.uint32) for e in self.merges.encode_batch_fast(lines[i : i + _CALLS], add_special_tokens=False)]
        ids = np.concatenate(parts)
        edges = np.flatnonzero(self.edge[ids])
        bounds = np.append(edges + 1, len(ids))[: len(edges)] if self.split == "spaces" else np.append(edges[1:], len(ids))[: len(edges)]
        lengths = np.diff(bounds, prepend=0)
        if len(lengths) != len(words):  # a vocabulary whose words' edges can't be seen
            return self._singly(words, self.merges)
        return ids, lengths

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All words' ids one after another, and how many each has."""
        cores, tails, others = _Numbered(), _Numbered(), []
        kind, at, end = np.zeros(len(words), np.int8), np.zeros(len(words), np.int64), np.full(len(words), -1, np.int64)
        lower = self.split == "spaces"
        plain: list[_Numbered] = [cores, _Numbered()]  # with the mark of words' edges, without
        for i, word in enumerate(words):
            text = word.decode()
            m = _PLAIN.fullmatch(text)
            if m is None or (lower and m[1]):
                kind[i], at[i] = 2, len(others)
                others.append(text)
                continue
            bare = not lower and not m[1]
            kind[i], at[i] = bare, plain[bare][m[1] + (m[2].lower() if lower else m[2])]
            if m[3]:
                end[i] = tails[m[3]]
        show = lambda own: [w.encode().decode("latin-1").translate(BYTE_CHARS) for w in own]
        groups = [self._together(show(cores)), self._singly(show(plain[1]), self.merges), self._singly(others, self.whole), self._singly(list(tails), self.whole)]
        first = np.cumsum([0, *(len(n) for _, n in groups)])
        ids, lengths = np.concatenate([x for x, _ in groups]), np.append(np.concatenate([n for _, n in groups]), 0)
        starts = np.cumsum(lengths) - lengths
        both = np.empty((len(words), 2), np.int64)
        both[:, 0] = first[kind] + at
        both[:, 1] = np.where(end < 0, len(lengths) - 1, first[3] + end)
        return gather(ids, starts, lengths, both.ravel()), lengths[both].sum(axis=1)


@functools.lru_cache(maxsize=2)
def word_encoder(path: str, split: str) -> WordEncoder:
    """One encoder for each worker process: a tokenizer is slow to load and slow to give its memory back."""
    return WordEncoder(path, split)


def _encoder(path: str, split: str):
    """Encodes the words of one part, each distinct one once, and gives every chunk its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        known = _Numbered()
        wanted = []
        for blob, sizes in zip(rows["first"], rows["second"], strict=True):
            letters, both = _unpack(blob, np.uint8).tobytes(), _unpack(sizes, np.uint32)
            lengths, places = both[: len(both) // 2], both[len(both) // 2 :]
            ends = np.cumsum(lengths).tolist()
            at = np.fromiter((known[letters[a:b]] for a, b in zip([0, *ends], ends, strict=False)), np.int64)
            wanted.append((places, at))
        ids, lengths = word_encoder(path, split)(list(known))
        starts = np.cumsum(lengths) - lengths
        return pd.DataFrame({
            "chunk": rows["chunk"],
            "places": [_pack(p) for p, _ in wanted],
            "lengths": [_pack(lengths[at].astype(np.uint32)) for _, at in wanted],
            "ids": [_pack(gather(ids, starts, lengths, at)) for _, at in wanted],
        })

    return run


def _joined(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
    """Puts the ids of a chunk's words in their places in its documents."""
    places = [_unpack(x, np.uint32) for x in words["places"]]
    lengths = [_unpack(x, np.uint32) for x in words["lengths"]]
    ids = [_unpack(x, np.uint32) for x in words["ids"]]
    empty = np.zeros(0, np.uint32)
    place, length = np.concatenate([empty, *places]).astype(np.int64), np.concatenate([empty, *lengths]).astype(np.int64)
    values = np.concatenate([empty, *ids])
    lengths_by, starts_by = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    lengths_by[place], starts_by[place] = length, np.cumsum(length) - length
    bodies = [_unpack(x, np.uint32) for x in docs["first"]]
    if max((int(b.max()) for b in bodies if len(b)), default=-1) >= len(place):
        raise RuntimeError("a chunk's words are missing: its documents were read in another order than its words")
    return pd.DataFrame({"doc_id": docs["doc_id"], "ids": [gather(values, starts_by, lengths_by, b).tobytes() for b in bodies]})


def encode_documents(docs: DataFrame, path: str, split: str = "bytes", store: bool = False, then: tuple[Callable[[pd.DataFrame], pd.DataFrame], str] | None = None) -> DataFrame:
    """(doc_id, ids) of ``docs(doc_id, text)``: ids as little-endian unsigned 32-bit integers, as the
    tokenizers library encodes the whole text with the file ``path`` and without special tokens.

    ``split`` names the units that the tokenizer's pre-tokenizer never joins: ``bytes`` for a byte-level
    one, ``spaces`` for one that drops white space. Tasks split their documents into units and send each
    distinct one to its hash part; a part encodes each distinct unit once; the ids go back to the chunk
    and into place. ``store`` keeps the split documents in shared scratch space: more disk, less time.
    ``then``: what to make of each chunk's (doc_id, ids) in the same worker, and the columns besides doc_id.

    A null text is empty and has no ids; repeated rows are encoded each; a null doc_id is kept; an empty
    table gives none. Texts of any length are whole. Other columns are not read.
    """
    spark = docs.sparkSession
    parts = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), docs.count() // PART_DOCS)
    kind = docs.schema["doc_id"].dataType.simpleString()
    docs = docs.select(F.col("doc_id").cast("string"), "text")  # pandas would make a long column with nulls double
    chunks = docs.mapInArrow(_chunker(split, parts), _CHUNKS)
    chunks = scratch(chunks, "bpe-chunks") if store else chunks
    words = chunks.where("part >= 0").groupBy("part").applyInPandas(_encoder(path, split), _IDS)
    bodies = chunks.where("part < 0").groupBy("chunk")
    finish, columns = then or (None, "ids binary")

    def join(docs: pd.DataFrame, words: pd.DataFrame) -> pd.DataFrame:
        found = _joined(docs, words)
        return finish(found) if finish else found

    whole = bodies.cogroup(words.groupBy("chunk")).applyInPandas(join, f"doc_id string, {columns}")
    return whole.withColumn("doc_id", F.col("doc_id").cast(kind))


def pieces_of(spark: SparkSession, path: str) -> DataFrame:
    """The id-to-piece table (id, piece bytes) of a byte-level tokenizer, special tokens included."""
    tokenizer = load_tokenizer(path)
    special = {i: t.content for i, t in tokenizer.get_added_tokens_decoder().items()}
    byte_of = {c: b for b, c in BYTE_CHARS.items()}
    rows = [(i, special[i].encode() if i in special else bytes(byte_of[c] for c in piece)) for piece, i in tokenizer.get_vocab().items()]
    return spark.createDataFrame(rows, "id int, piece binary")


class Pieces:
    """The pieces of a vocabulary, to be looked up by id. It is bounded by the vocabulary: 16 MB here."""

    def __init__(self, pieces: DataFrame) -> None:
        known = pieces.orderBy("id").toPandas()
        size = int(known["id"].max()) + 1 if len(known) else 0
        if known["piece"].map(len).sum() > 16 << 20:
            raise ValueError("a vocabulary of over 16 MB")
        self.lengths = np.zeros(size, np.int64)
        self.lengths[known["id"]] = known["piece"].map(len)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.values = np.frombuffer(b"".join(known["piece"]), np.uint8)

    def text(self, blob: bytes | None) -> str:
        ids = np.frombuffer(blob or b"", "<u4").astype(np.int64)
        return gather(self.values, self.starts, self.lengths, ids[ids < len(self.lengths)]).tobytes().decode("utf-8", "replace")


def decode_documents(encoded: DataFrame, pieces: DataFrame) -> DataFrame:
    """Add ``text`` to ``encoded(doc_id, ids, ...)`` by a join of every id with ``pieces(id, piece)``.

    The pieces are the vocabulary, so each task has a copy to join with. An id that the vocabulary lacks
    has no piece; bytes that are no UTF-8 become U+FFFD; null ids are none.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Pieces(pieces))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, _DECODED):  # small batches go on, so no worker holds many texts
                batch = whole.slice(at, _DECODED)
                out = [shared.value.text(blob.as_py()) for blob in batch.column("ids")]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.string())], names=[*batch.schema.names, "text"])

    kept = encoded.drop("text")
    return kept.mapInArrow(run, kept.withColumn("text", F.lit("")).schema)


def round_trip(docs: DataFrame, path: str, split: str = "bytes") -> DataFrame:
    """(doc_id, ids, text): documents encoded, and decoded again where the ids are put together."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(Pieces(pieces_of(spark, path)))

    def decode(found: pd.DataFrame) -> pd.DataFrame:
        return found.assign(text=[shared.value.text(x) for x in found["ids"]])

    return encode_documents(docs, path, split, then=(decode, "ids binary, text string"))


@query("op7_bpe_round_trip")
def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every document, decode its ids again, and return digests of both."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.json")
    decoded = round_trip(table(spark, sf_dir, "documents"), path)
    n = F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens")
    return decoded.select("doc_id", n, F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
