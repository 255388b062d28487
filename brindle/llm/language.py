"""Language ID by word-first backoff: known words by log frequency, unseen ones by character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.llm.common import slices
from brindle.session import scratch, table

#: The model is fitted on about so many labelled documents of a language at most, and of all languages
#: together, chosen by hash of doc_id. All languages are learned, and all words and n-grams of the sample.
SAMPLE_DOCS, ALL_DOCS = 1_000, 20_000
LONGEST = 4  # characters of the longest n-grams
SMOOTH = 0.5
#: Words that count for the score: a longer text doesn't get surer than one of so many words.
SURE_WORDS = 50
CACHE = 400_000  # scores of words that are remembered, over all languages
WORD = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"


def grams(word: str, n: int) -> list[str]:
    """Character n-grams of a word between its two ends; a single character stands without them."""
    padded = f" {word} " if n > 1 else word
    return [padded[i : i + n] for i in range(len(padded) - n + 1)]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, 5_000):
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found.setdefault(lang, Counter()).update(WORD.findall(text.lower()))
        for lang, words in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(words), pa.string()), pa.array(list(words), pa.string()), pa.array(list(words.values()), pa.int64())], names=["lang", "item", "n"])


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found: dict[tuple[str, int], Counter] = {}
        for lang, word, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            for size in range(1, LONGEST + 1):
                own = found.setdefault((lang, size), Counter())
                for g in grams(word, size):
                    own[g] += n
        for (lang, size), own in found.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(own), pa.string()), pa.array([size] * len(own), pa.int32()), pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], names=["lang", "size", "item", "n"])


class Logs:
    """Log frequencies of items (words, or n-grams of one length) by language: sparse, since most items stand in
    one language. ``unseen`` is what the others have."""

    def __init__(self, items: pa.Array, ends: np.ndarray, langs: np.ndarray, logs: np.ndarray, unseen: np.ndarray) -> None:
        self.items, self.ends, self.langs, self.logs, self.unseen = items, ends, langs, logs, unseen
        self.places: dict[str, int] | None = None
        self.told: dict[str, np.ndarray] = {}

    def remembered(self, item: str) -> np.ndarray | None:
        """As :meth:`get`, for items that come again and again; at most CACHE numbers are remembered."""
        if (out := self.told.get(item)) is None and (out := self.get(item)) is not None and len(self.told) * len(out) < CACHE:
            self.told[item] = out
        return out

    def get(self, item: str) -> np.ndarray | None:
        if self.places is None:
            self.places = {x: i for i, x in enumerate(self.items.to_pylist())}
        i = self.places.get(item)
        if i is None:
            return None
        own = slice(self.ends[i - 1] if i else 0, self.ends[i])
        out = self.unseen.copy()
        out[self.langs[own]] = self.logs[own]
        return out


def train(docs: DataFrame) -> tuple[list[str], list[Logs]]:
    """Languages and, for words (at 0) and n-grams (at n), the log frequencies of each item by language.

    Learns from ``docs(doc_id, text, lang)`` with both text and lang, on about SAMPLE_DOCS of a language and
    ALL_DOCS altogether. That sample bounds the tables, so the driver and every task can hold them.
    """
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = known.groupBy("lang").agg(F.count("*").alias("n")).collect()
    langs = sorted(r["lang"] for r in rows)
    if not langs:
        return [], []
    wanted = min(SAMPLE_DOCS, ALL_DOCS / len(langs))
    share = F.create_map(*(x for r in rows for x in (F.lit(r["lang"]), F.lit(min(1.0, wanted / r["n"])))))
    dice = F.pmod(F.xxhash64("doc_id", F.lit("sample")), F.lit(1_000_000)) / 1e6
    sample = known.where(dice < share[F.col("lang")]).select("lang", "text")
    words = scratch(sample.mapInArrow(_count_words, "lang string, item string, n long").groupBy("lang", "item").agg(F.sum("n").alias("n")), "lang-words")
    sized = words.mapInArrow(_count_grams, "lang string, size int, item string, n long").groupBy("lang", "size", "item").agg(F.sum("n").alias("n"))
    number = F.create_map(*(x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))))
    counts = words.select("lang", F.lit(0).alias("size"), "item", "n").unionByName(sized)
    counts = counts.orderBy("size", "item", "lang").select("size", "item", number[F.col("lang")].alias("lang"), "n").toArrow()
    bounds = np.searchsorted(counts.column("size").to_numpy(), range(LONGEST + 2))
    tables = []
    for size in range(LONGEST + 1):
        own = counts.slice(bounds[size], bounds[size + 1] - bounds[size]).combine_chunks()
        coded = own.column("item").combine_chunks().dictionary_encode()
        at, items = coded.indices.to_numpy(), coded.dictionary
        n, lang = own.column("n").to_numpy(), own.column("lang").to_numpy()
        totals = np.bincount(lang, n, len(langs)) + SMOOTH * max(1, len(items))
        logs = np.log((n + SMOOTH) / totals[lang]).astype(np.float32)
        tables.append(Logs(items, np.cumsum(np.bincount(at, minlength=len(items))), lang, logs, np.log(SMOOTH / totals).astype(np.float32)))
    return langs, tables


class Scorer:
    """Log scores of words by language, remembered up to CACHE numbers."""

    def __init__(self, langs: list[str], tables: list[Logs]) -> None:
        self.langs, self.tables = langs, tables
        self.cache = max(1_000, CACHE // max(1, len(langs)))
        self.forget()

    def forget(self) -> None:
        outer = self

        class Rows(dict):
            def __missing__(self, word: str) -> int:
                if len(outer.values) == len(self):
                    outer.values = np.concatenate([outer.values, np.zeros_like(outer.values)])
                outer.values[len(self)] = outer.word(word)
                self[word] = n = len(self)
                return n

        self.rows, self.values = Rows(), np.zeros((1024, len(self.langs)), np.float32)

    def word(self, word: str) -> np.ndarray | float:
        """A known word's log frequencies; else the mean over its longest n-grams that are known."""
        if (found := self.tables[0].get(word)) is not None:
            return found
        for n in range(LONGEST, 0, -1):
            hits = [x for g in grams(word, n) if (x := self.tables[n].remembered(g)) is not None]
            if hits:
                return sum(hits) / len(hits)
        return 0.0

    def predict(self, text: str | None) -> tuple[str, float]:
        words = WORD.findall((text or "").lower())
        if not self.langs or not any(map(str.isalpha, words)) and not any(c.isalpha() for w in words for c in w):
            return UNKNOWN, 0.0
        if len(self.rows) > self.cache:
            self.forget()
        at = np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))
        total = self.values[at].sum(axis=0, dtype=np.float64)
        total = (total - total.max()) * min(1.0, SURE_WORDS / len(words))
        odds = np.exp(total)
        best = int(odds.argmax())
        return self.langs[best], float(odds[best] / odds.sum())


def identify(docs: DataFrame, model: tuple[list[str], list[Logs]]) -> DataFrame:
    """Add lang_pred and score (0 to 1) to ``docs``, from the whole text alone.

    A text that is null or has no letter, and any text without a model, is ``und`` with score 0. Ties
    go to the first language by name. Repeated rows and empty tables are fine; columns named lang_pred
    or score are replaced.
    """
    docs = docs.drop("lang_pred", "score")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in slices(batches):
            found = [scorer.predict(t) for t in batch.column(place).to_pylist()]
            more = [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0)}).schema)


def identify_languages(docs: DataFrame) -> DataFrame:
    """Learn from the documents that are not held out, then predict for all."""
    return identify(docs, train(docs.select("doc_id", "text", "lang").where(~held_out(F.col("doc_id")))))


@query("op8_language_id")
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.where(~held_out(F.col("doc_id"))))
    found = identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")
