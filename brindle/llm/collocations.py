"""Phrase collocation mining: best-first branch-and-bound growth of phrases.

A phrase of n-fold count a in a language of N words has, for each cut into a first and a last part with counts l and r, the
score floor(1000 a N / (l r)); a is at most l and at most r, so a phrase that begins or ends with a word of count f
scores 1000 N / f at most. The words of each language are the first prefixes, the rarest with the highest bounds. A round
opens the words up to a count F (the frontier) and grows phrases that begin or end with one of them word
by word, as long as the grown part itself is frequent. That counts every part and every extension of a phrase whose
both ends are open, so its score and its survival are final. A language is settled once its 2000th surviving score is above
the bound of all closed words; if not, F becomes the count up to which a phrase could still reach that score.
"""

from __future__ import annotations

import contextlib
import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.bpe import _Numbered, _pack, _unpack
from brindle.llm.catalog import query
from brindle.session import scratch, table

LEAST, LONGEST, TOP = 100, 5, 2000
#: Words of each language that the first round opens, at least.
OPENED = 6000
#: How many times the words a round opens if the one before it found too few phrases.
WIDER = 2
#: Bits of the tables that tell tasks which words and phrases go on, fixed so that they can be broadcast. What shares a
#: bit with one of them only costs work: the counts that decide are those of whole phrases.
BITS = 1 << 23
#: Words after which a task closes a chunk of a language.
CHUNK_WORDS = 1_000_000
#: Words and chunks that a task keeps open at most.
OPEN_WORDS, OPEN_CHUNKS = 4 * CHUNK_WORDS, 1_000
#: Texts, and chunks, that Spark hands to a task at once: a batch lies in the executor and in the worker.
TEXTS_AT_ONCE, CHUNKS_AT_ONCE = 500, 1
_SEPARATORS = b".,;:!?\n\x0b\x0c\r"
_MARKED = bytes.maketrans(_SEPARATORS + b"\t", b"\n" * len(_SEPARATORS) + b" ")
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Chunk:
    """Texts of one language as numbers of its own words; 0 parts pieces, 1 is nothing."""

    def __init__(self) -> None:
        self.words = _Numbered({b"\n": 0, b"": 1})
        self.parts: list[np.ndarray] = []
        self.size = 0

    def add(self, text: str) -> None:
        units = text.encode().lower().translate(_MARKED).replace(b"\n", b" \n ").split(b" ")  # A-Z only
        units.append(b"\n")
        self.parts.append(np.fromiter(map(self.words.__getitem__, units), np.uint32, len(units)))
        self.size += len(units)

    def row(self) -> tuple[bytes, bytes]:
        places = np.concatenate(self.parts)
        places = places[places != 1]
        return zstandard.ZstdCompressor(level=1).compress(b"\n".join(list(self.words)[2:])), _pack(np.maximum(places, 1) - 1)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each chunk goes off as a row of its own once it is full; all do if those that are open get too many or too long."""
    open_chunks: dict[str, _Chunk] = {}
    held = 0

    def close(langs: list[str]) -> Iterator[pa.RecordBatch]:
        for lang in langs:
            words, places = open_chunks.pop(lang).row()
            columns = [pa.array([x], t) for x, t in zip((lang, words, places), (pa.string(), pa.binary(), pa.binary()), strict=True)]
            yield pa.RecordBatch.from_arrays(columns, names=["lang", "words", "places"])

    for batch in batches:
        for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if text:
                chunk = open_chunks.setdefault(lang, _Chunk())
                held -= chunk.size
                chunk.add(text)
                held += chunk.size
                if chunk.size >= CHUNK_WORDS:
                    held -= chunk.size
                    yield from close([lang])
                elif held >= OPEN_WORDS or len(open_chunks) >= OPEN_CHUNKS:
                    held = 0
                    yield from close(list(open_chunks))
    yield from close(list(open_chunks))


def _opened(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes], np.ndarray, np.ndarray]]:
    """(language, words, their 64-bit codes, places) of each chunk; place 0 parts pieces, word i has place i + 1."""
    for lang, words, places in zip(*(batch.column(c).to_pylist() for c in ("lang", "words", "places")), strict=True):
        own = zstandard.ZstdDecompressor().decompress(words).split(b"\n") if words else []
        at = _unpack(places, np.uint32)
        if not len(at) or not at.any():
            continue
        seed = xxhash.xxh3_64_intdigest(lang.encode()) & 0xFFFFFFFF
        yield lang, own, np.fromiter((xxhash.xxh3_64_intdigest(w, seed) for w in own), np.uint64, len(own)), at.astype(np.int64)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lang, words, codes, places in _opened(batch):
            n = np.bincount(places, minlength=len(words) + 1)[1:]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words)), pa.array([w.decode() for w in words]), pa.array(codes.view(np.int64)), pa.array(n)], names=["lang", "word", "code", "n"])


@contextlib.contextmanager
def batches_of(spark: SparkSession, rows: int) -> Iterator[None]:
    """Tasks that are begun inside get ``rows`` rows at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def bit_table(keys: DataFrame) -> bytes:
    """A table of BITS bits with the bit of each ``key`` (a long) set; put together by Spark, of fixed size."""
    slot = F.pmod(F.col("key"), F.lit(BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.pmod(slot, F.lit(64)).cast("int"))
    rows = keys.groupBy(F.floor(slot / 64).cast("int").alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(BITS // 64, np.int64)
    out[rows["at"].to_numpy()] = rows["bits"].to_numpy()
    return out.tobytes()


def _has(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Whether the table has the keys' bits; keys are taken as signed, as Spark does."""
    slot = np.mod(keys.view(np.int64), BITS)
    return (bits[slot >> 6] >> (slot & 63)) & 1 == 1


class _Grower:
    """Finds where in a chunk grown phrases stand. ``tables``: bits of frequent words, of open words, and for each length
    from 2 of the phrases that go on."""

    def __init__(self, tables: list[bytes]) -> None:
        self.tables = [np.frombuffer(t, np.int64) for t in tables]

    def __call__(self, codes: np.ndarray, places: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(length, starts, keys) of the grown phrases of each length, up to one word longer than the tables know."""
        known = np.append(np.zeros(1, np.uint64), codes)
        often, ahead = (np.append(False, _has(t, codes)) for t in self.tables[:2])
        words, often, ahead = known[places], often[places], ahead[places]
        # runs of frequent words; a phrase grows from its first word if that is open, or from its last one
        at = np.flatnonzero(often[:-1] & often[1:] & (ahead[:-1] | ahead[1:]))
        key = (words[at] * _STEP + words[at + 1]) * _MIX
        key ^= key >> np.uint64(29)
        length = 2
        while True:
            if length == len(self.tables):
                yield length, at, key
                return
            ok = _has(self.tables[length], key)
            at, key = at[ok], key[ok]
            yield length, at, key
            if length == LONGEST:
                return
            right = at[(at + length < len(places)) & ahead[at]]
            right = right[often[right + length]]
            left = at[(at > 0) & ahead[at + length - 1]]
            left = left[often[left - 1]] - 1
            at, length = np.union1d(left, right), length + 1
            key = words[at]
            for i in range(1, length):
                key = (key * _STEP + words[at + i]) * _MIX
                key ^= key >> np.uint64(29)


def _key_counts(tables):
    """(key, n): how often the phrases that are one word longer than the tables know occur in a chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = _Grower(tables.value)
        for batch in batches:
            for _, _, codes, places in _opened(batch):
                *_, (_, _, keys) = grow(codes, places)
                keys, n = np.unique(keys, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n)], names=["key", "n"])

    return run


def _phrase_counts(tables):
    """(lang, phrase, words, n) of the phrases of all lengths that passed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grow = _Grower(tables.value)
        for batch in batches:
            for lang, words, codes, places in _opened(batch):
                for length, at, _ in grow(codes, places):
                    rows, n = np.unique(np.stack([places[at + i] for i in range(length)], 1), axis=0, return_counts=True)
                    phrases = [b" ".join([words[i - 1] for i in row]).decode() for row in rows.tolist()]
                    columns = [pa.array([lang] * len(n), pa.string()), pa.array(phrases, pa.string()), pa.array([length] * len(n), pa.int32()), pa.array(n)]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "size", "n"])

    return run


def grown(chunks: DataFrame, words: DataFrame, opened: DataFrame, least: int) -> DataFrame:
    """(lang, phrase, size, a): all phrases of 2 to LONGEST words that occur ``least`` times and begin or end with a word
    of ``opened``. ``words`` are the frequent ones, both have (lang, code)."""
    spark = chunks.sparkSession
    context = spark.sparkContext
    code = F.col("code").alias("key")
    tables = [bit_table(words.select(code)), bit_table(opened.select(code))]
    for length in range(2, LONGEST + 1):
        sums = chunks.mapInArrow(_key_counts(context.broadcast(tables)), "key long, n long").groupBy("key").agg(F.sum("n").alias("n"))
        with batches_of(spark, CHUNKS_AT_ONCE):
            often = scratch(sums.where(F.col("n") >= least).select("key"), "collocations-keys")
        more = bit_table(often)
        tables = [*tables, more]
        if not any(more):
            break
    found = chunks.mapInArrow(_phrase_counts(context.broadcast(tables)), "lang string, phrase string, size int, n long")
    sums = found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("a"))
    with batches_of(spark, CHUNKS_AT_ONCE):
        return scratch(sums.where(F.col("a") >= least), "collocations-grown")


def score(a, n, l, r):  # noqa: E741
    """floor(1000 a n / (l r)) as a column, exact: a product has up to 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(1000)) * wide(a) * wide(n), wide(l) * wide(r))


def survivors(phrases: DataFrame, words: DataFrame, limits: DataFrame) -> DataFrame:
    """(lang, phrase, a, l, r, n, score) of the candidates among ``phrases`` whose both ends are open and that no longer
    phrase makes superfluous. ``words(lang, word, f)``, ``limits(lang, n, open)``."""
    counts = words.select("lang", F.col("word").alias("part"), "f").unionByName(phrases.select("lang", F.col("phrase").alias("part"), F.col("a").alias("f")))
    split = phrases.withColumn("w", F.split("phrase", " ", -1))
    part = lambda first, n: F.array_join(F.slice("w", first, n), " ")
    cuts = split.select("lang", "phrase", "size", "a", "w", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "size", "a", "k", part(F.lit(1), F.col("k")).alias("first"), part(F.col("k") + 1, F.col("size") - F.col("k")).alias("rest"))
    named = lambda x, n: counts.select("lang", F.col("part").alias(x), F.col("f").alias(n))
    # parts that begin and end with closed words aren't counted: those phrases are left for a later round
    cuts = cuts.join(named("first", "l"), ["lang", "first"]).join(named("rest", "r"), ["lang", "rest"]).join(limits, "lang")
    told = F.struct(score(F.col("a"), F.col("n"), F.col("l"), F.col("r")).alias("score"), "k", "l", "r")
    ends_open = (F.max(F.when(F.col("k") == 1, F.col("l") <= F.col("open"))) & F.max(F.when(F.col("k") == F.col("size") - 1, F.col("r") <= F.col("open")))).alias("whole")
    whole = cuts.groupBy("lang", "phrase", "size", "a", "n").agg(F.min(told).alias("t"), ends_open).where("whole")
    longer = split.where("size > 2").select("lang", "a", F.explode(F.array(part(F.lit(1), F.col("size") - 1), part(F.lit(2), F.col("size") - 1))).alias("phrase"))
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    kept = whole.join(longer, ["lang", "phrase"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a")))
    return kept.select("lang", "phrase", "a", "t.l", "t.r", "n", "t.score")


def best_phrases(docs: DataFrame, least: int = LEAST, top: int = TOP, opened: int = OPENED) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's first ``top`` phrases of 2 to 5 words.

    ``docs(text, lang)``: A-Z are lower-cased, `.,;:!?` and line ends part pieces, spaces and tabs words. a is a phrase's count, l
    and r those of the parts of its lowest-scoring cut, n the language's words. A null lang is ``und``; null and empty
    texts have no words; repeated rows count each; an empty table gives none. Phrases that only occur inside one longer
    phrase are dropped. Order: score, a (descending), phrase by bytes. Texts are whole; other columns are not read.
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), F.col("text").cast("string"))
    spark = docs.sparkSession
    with batches_of(spark, TEXTS_AT_ONCE):
        chunks = scratch(texts.mapInArrow(_chunks, "lang string, words binary, places binary"), "collocations-chunks")
    counted = chunks.mapInArrow(_word_counts, "lang string, word string, code long, n long")
    with batches_of(spark, CHUNKS_AT_ONCE):
        counted = scratch(counted.groupBy("lang", "word", "code").agg(F.sum("n").alias("f")), "collocations-words")
    totals = counted.groupBy("lang").agg(F.sum("f").alias("n"))
    words = scratch(counted.where(F.col("f") >= least), "collocations-often")
    # the counts up to which words are open: the rarest ones first, as their bounds are highest
    steps = Window.partitionBy("lang").orderBy("f").rowsBetween(Window.unboundedPreceding, 0)
    steps = words.groupBy("lang", "f").agg(F.count("*").alias("c")).withColumn("upto", F.sum("c").over(steps))
    steps = scratch(steps, "collocations-steps")
    first = steps.groupBy("lang").agg(F.coalesce(F.min(F.when(F.col("upto") >= opened, F.col("f"))), F.max("f")).alias("open"))
    limits = scratch(totals.join(first, "lang"), "collocations-limits")
    done, order = [], (F.desc("score"), F.desc("a"), F.asc("phrase"))
    while True:
        some = words.join(limits.select("lang", "open"), "lang")
        phrases = grown(chunks, words, some.where(F.col("f") <= F.col("open")), least)
        ranked = survivors(phrases, words, limits).withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
        ranked = scratch(ranked.where(F.col("rank") <= top), "collocations-ranked")
        last = ranked.where(F.col("rank") == top).select("lang", F.col("score").alias("last"))
        closed = some.where(F.col("f") > F.col("open")).groupBy("lang").agg(F.min("f").alias("next"), F.max("f").alias("end"))
        had = steps.join(limits.select("lang", F.col("open").alias("f")), ["lang", "f"]).select("lang", F.col("upto").alias("had"))
        wider = steps.join(had, "lang").where(F.col("upto") >= WIDER * F.col("had")).groupBy("lang").agg(F.min("f").alias("wider"))
        closed = closed.join(wider, "lang", "left")
        state = limits.join(closed, "lang", "left").join(last, "lang", "left")
        bound = score(F.lit(1), F.col("n"), F.lit(1), F.col("next"))
        settled = F.col("next").isNull() | F.coalesce(F.col("last") > bound, F.lit(False))
        # a phrase with a higher end can't reach the last score; with too few phrases, more words are opened
        reach = F.coalesce(F.when(F.col("last") > 0, score(F.lit(1), F.col("n"), F.lit(1), F.col("last"))), F.col("wider"), F.col("end"))
        upto = steps.select("lang", F.col("f").alias("open"))
        state = scratch(state.select("lang", "n", settled.alias("settled"), F.greatest(reach, F.col("next")).alias("reach")), "collocations-state")
        done.append(ranked.join(state.where("settled").select("lang"), "lang", "left_semi"))
        limits = state.where(~F.col("settled")).join(upto, "lang").where(F.col("open") <= F.col("reach"))
        limits = scratch(limits.groupBy("lang", "n").agg(F.max("open").alias("open")), "collocations-limits")
        if limits.isEmpty():
            break
    return functools.reduce(DataFrame.unionByName, done).select("lang", F.col("rank").cast("long"), "phrase", "a", "l", "r", "n", "score")


@query("op12_collocations")
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each language's best collocations over all documents."""
    return best_phrases(table(spark, sf_dir, "documents"))
