"""Quality rules: base counts, and perplexity bands of a modified Kneser-Ney n-gram model."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm.catalog import query
from brindle.llm.common import small
from brindle.session import scratch, table

#: Characters of an n-gram. All of Unicode counts, nothing is folded, so the model grows with the corpus.
ORDER = 5
MARKS = "#*$%&|<>"
MIN_WORDS, MAX_REPEATED, REPEAT_WINDOW = 20, 30, 8
#: A language's band reaches so many interquartile ranges (of log perplexity) below and above its
#: quartiles; a range under LEAST_RANGE counts as that. A short text's mean varies more: for n words the
#: reach grows by sqrt(1 + SHORT / n).
BAND, LEAST_RANGE, SHORT = 2.0, 0.015, 50
#: Entries of a model (12 bytes each) that tasks may hold. A larger model is joined with the n-grams instead.
HELD = 8_000_000
#: Characters that are counted at once.
BLOCK = 1 << 21
#: Discounts where a language has too few n-grams to tell them.
DISCOUNTS = (0.5, 0.75, 0.9)
_SPACES = " \t\n\r\x0b\x0c"
_MIX, _ODD = 0x9E3779B97F4A7C15, 0x5851F42D4C957F2D


def points(text: str) -> np.ndarray:
    """A text's code points after ORDER - 1 spaces; any run of white space is one space."""
    body = " " * (ORDER - 1) + b" ".join(text.encode().split()).decode()
    return np.frombuffer(body.encode("utf-32-le"), np.uint32)


def hashes(s: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the n-gram that begins at each code point of ``s``."""
    n, out = len(s) - ORDER + 1, np.zeros(max(0, len(s) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        out = out * np.uint64(_MIX) + s[k : k + n] + np.uint64(1)
    return out ^ (out >> np.uint64(32))


def count_grams(texts: list[np.ndarray]) -> tuple[list[str], np.ndarray]:
    """The distinct n-grams of some texts' points, and how often each stands there. N-grams are written as
    numbers over the alphabet of these texts, so that none is mistaken for another."""
    s = np.concatenate(texts)
    inside = np.ones(len(s), bool)
    ends = np.cumsum([len(t) for t in texts])
    for k in range(1, ORDER):
        inside[ends - k] = False
    inside = inside[: len(s) - ORDER + 1]
    n = len(inside)
    letters = np.unique(s)
    if len(letters) ** ORDER < 2**63:
        digit = np.zeros(int(letters[-1]) + 1, np.int64)
        digit[letters] = np.arange(len(letters))
        s = digit[s]
        grams = np.zeros(n, np.int64)
        for k in range(ORDER):
            grams = grams * len(letters) + s[k : k + n]
        grams, counts = np.unique(grams[inside], return_counts=True)
        found = np.empty((len(grams), ORDER), np.uint32)
        for k in range(ORDER - 1, -1, -1):
            grams, last = np.divmod(grams, len(letters))
            found[:, k] = letters[last]
    else:  # an alphabet of thousands: compared character by character
        windows = np.lib.stride_tricks.sliding_window_view(s, ORDER)[inside]
        found, counts = np.unique(windows, axis=0, return_counts=True)
    whole = np.ascontiguousarray(found, np.uint32).tobytes().decode("utf-32-le")
    return [whole[i : i + ORDER] for i in range(0, len(whole), ORDER)], counts


def repeated_words(words: list[bytes], window: int = REPEAT_WINDOW) -> int:
    """Words that stand in a window of ``window`` words found twice or more in the text. If windows have
    equal hashes they are compared exactly: pairs are numbered, then pairs of pairs, and so on (``window``
    is a power of 2)."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    ids = np.fromiter(map(hash, words), np.int64, len(words))
    mixed = np.zeros(n, np.int64)
    for k in range(window):
        mixed = mixed * np.int64(_ODD) + ids[k : k + n]
    mixed.sort()
    if (mixed[1:] != mixed[:-1]).all():
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    size = 1
    while size < window:
        pairs = ids[:-size] * (int(ids.max()) + 1) + ids[size:]
        _, ids = np.unique(pairs, return_inverse=True)
        size *= 2
    twice = np.bincount(ids)[ids] > 1
    cover = np.zeros(len(words) + 1, np.int64)
    cover[:n] += twice
    cover[window : window + n] -= twice
    return int((np.cumsum(cover) > 0).sum())


def fails(n_words: int, n_repeat_words: int) -> bool:
    """Whether a text fails the base rules."""
    return n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEATED * n_words


def base_counts(text: str | None) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    text = text or ""
    words = text.encode().split()
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    spaces = sum(text.count(c) for c in _SPACES)
    return len(words), len(text) - spaces, sum(text.count(c) for c in MARKS), len(lines) - len(set(lines)), repeated_words(words)


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of the texts that pass the base rules, summed over about BLOCK characters."""
    held: dict[str, list[np.ndarray]] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, texts in held.items():
            grams, counts = count_grams(texts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["lang", "gram", "n"])
        held.clear()

    for batch in batches:
        for lang, text in zip(batch.column("lang"), batch.column("text"), strict=True):
            text = text.as_py()
            words = text.encode().split() if text else []
            if fails(len(words), 0) or fails(len(words), repeated_words(words)):
                continue
            held.setdefault(lang.as_py(), []).append(points(text))
            size += len(text)
            if size > BLOCK:
                yield from flush()
                size = 0
    yield from flush()


def first_copies(docs: DataFrame) -> DataFrame:
    """The rows of ``docs(doc_id, lang, text)`` without later copies of a text in its language: of each
    group those with the smallest doc_id stay. Rows that agree in all three can't be told apart, so all of
    them stay."""
    named = docs.withColumn("_text", F.unhex(F.md5("text")))
    groups = named.groupBy("lang", "_text").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_low")).where("_n > 1")
    found = named.join(small(scratch(groups, "quality-copies")), ["lang", "_text"], "left")
    return found.where(F.col("_n").isNull() | F.col("doc_id").eqNullSafe(F.col("_low"))).select("lang", "text")


def train(docs: DataFrame) -> DataFrame:
    """(lang, gram, log): the modified Kneser-Ney model of each language in ``docs(doc_id, lang, text)``, as
    the log probability of each n-gram's last character after those before it.

    Counts cover every text that passes the base rules, each distinct one once. N-grams of the highest
    order have their counts, shorter ones the number of different characters before them. All orders lie
    in one table; discounts come from how many n-grams have counts 1 to 4, and what they leave goes to
    the n-gram without its first character, down to a single one out of the language's characters.
    """
    counts = first_copies(docs).mapInArrow(_count, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    level = scratch(counts, "quality-grams")
    levels = level
    for n in range(ORDER - 1, 0, -1):
        level = level.groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("n"))
        levels = levels.unionByName(level)
    levels = scratch(levels.withColumn("size", F.char_length("gram")), "quality-levels")

    few = levels.groupBy("lang", "size").agg(*[F.count_if(F.col("n") == k).cast("double").alias(f"n{k}") for k in range(1, 5)], F.count("*").alias("known"))
    y = F.col("n1") / (F.col("n1") + 2 * F.col("n2"))
    enough = (F.col("n1") > 0) & (F.col("n2") > 0) & (F.col("n3") > 0)
    for k, usual in enumerate(DISCOUNTS, 1):
        d = F.lit(k) - (k + 1) * y * F.col(f"n{k + 1}") / F.when(enough, F.col(f"n{k}"))
        few = few.withColumn(f"d{k}", F.when(enough & (d > 0) & (d < k), d).otherwise(F.lit(usual)))
    few = small(scratch(few.select("lang", "size", "known", "d1", "d2", "d3"), "quality-discounts"))
    own = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    terms = levels.join(few, ["lang", "size"]).withColumns({"d": own, "before": F.substring("gram", F.lit(1), F.col("size") - 1)})
    after = terms.groupBy("lang", "size", "before").agg(F.sum("n").alias("total"), F.sum("d").alias("left"))
    terms = terms.join(after, ["lang", "size", "before"])
    terms = terms.select("lang", "size", "gram", ((F.col("n") - F.col("d")) / F.col("total")).alias("own"), (F.col("left") / F.col("total")).alias("weight"), "known")
    terms = scratch(terms, "quality-terms")

    def at(n: int) -> DataFrame:
        return terms.where(F.col("size") == n).select("lang", F.col("gram").alias(f"gram{n}"), F.col("own").alias(f"own{n}"), F.col("weight").alias(f"weight{n}"), F.col("known").alias(f"known{n}"))

    found = at(1)
    p = F.col("own1") + F.col("weight1") / F.col("known1")
    found = found.select("lang", "gram1", p.alias("p"))
    for n in range(2, ORDER + 1):
        longer = at(n).withColumn(f"gram{n - 1}", F.substring(f"gram{n}", 2, n - 1))
        found = longer.join(found, ["lang", f"gram{n - 1}"]).select("lang", f"gram{n}", (F.col(f"own{n}") + F.col(f"weight{n}") * F.col("p")).alias("p"))
    return scratch(found.select("lang", F.col(f"gram{ORDER}").alias("gram"), F.log("p").alias("log")), "quality-model")


def _as_arrays(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        grams = np.array(batch.column("gram").to_pylist(), object)
        logs = batch.column("log").to_numpy()
        for lang in sorted(set(langs)):
            own = langs == lang
            h = hashes(np.frombuffer("".join(grams[own]).encode("utf-32-le"), np.uint32))[::ORDER]
            yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([h.tobytes()], pa.binary()), pa.array([logs[own].astype(np.float32).tobytes()], pa.binary())], names=["lang", "hashes", "logs"])


def sorted_arrays(model: DataFrame) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """For each language the sorted hashes of its n-grams, and their logs. For models of HELD entries at most."""
    parts: dict[str, list] = {}
    for r in model.mapInArrow(_as_arrays, "lang string, hashes binary, logs binary").toLocalIterator():
        parts.setdefault(r["lang"], []).append((np.frombuffer(r["hashes"], np.uint64), np.frombuffer(r["logs"], np.float32)))
    out = {}
    for lang, own in parts.items():
        h, logs = (np.concatenate(x) for x in zip(*own, strict=True))
        order = np.argsort(h)
        out[lang] = h[order], logs[order]
    return out


def log_perplexity(text: str, known: tuple[np.ndarray, np.ndarray]) -> float:
    """Mean of -log probability over the characters of a text whose n-grams were counted."""
    h = np.sort(hashes(points(text)))
    at = np.searchsorted(known[0], h)
    if at[-1] == len(known[0]) or (known[0][at] != h).any():
        raise ValueError("a text whose n-grams were not counted")
    return -float(known[1][at].sum(dtype=np.float64)) / len(h)


def _measure(keep: list[str], shared):
    """``keep``, the base counts and, with a model at hand, the log perplexity of each whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value if shared else None
        for batch in batches:
            rows = []
            for lang, text in zip(batch.column("_lang"), batch.column("text"), strict=True):
                text = text.as_py()
                counts = base_counts(text)
                rows.append((*counts, None if known is None or fails(counts[0], counts[4]) else log_perplexity(text, known[lang.as_py()])))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.int64()] * 5 + [pa.float64()]
            more = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *more], names=[*keep, *COUNTS, "log_perplexity"])

    return run


def _grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, lang, gram, n) for each text's distinct n-grams."""
    for batch in batches:
        for key, lang, text in zip(*(batch.column(c) for c in ("_text", "_lang", "text")), strict=True):
            words = (text.as_py() or "").encode().split()
            if not fails(len(words), repeated_words(words)):
                grams, counts = count_grams([points(text.as_py())])
                n = len(grams)
                yield pa.RecordBatch.from_arrays([pa.array([key.as_py()] * n, pa.binary()), pa.array([lang.as_py()] * n, pa.string()), pa.array(grams, pa.string()), pa.array(counts, pa.int64())], names=["_text", "_lang", "gram", "n"])


def measure(docs: DataFrame, keep: list[str], model: DataFrame, held: int = HELD) -> DataFrame:
    """The columns ``keep`` of ``docs`` with _text (a digest), the base counts, base_failed and, for texts that pass the base rules,
    log_perplexity.

    A model of ``held`` entries or fewer goes to the tasks as sorted arrays. A larger one stays where it
    is, and the texts' n-grams, each distinct text's once, are joined with it: more disk, the same figures.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    named = docs.withColumns({"_lang": F.coalesce("lang", F.lit("")), "_text": F.unhex(F.md5(text))})
    keep = [*keep, "_text"]
    empty = named.select(*keep).withColumns({c: F.lit(0).cast("long") for c in COUNTS} | {"log_perplexity": F.lit(0.0).cast("double")})
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in empty.schema)
    small_enough = model.count() <= held
    shared = docs.sparkSession.sparkContext.broadcast(sorted_arrays(model)) if small_enough else None
    measured = named.mapInArrow(_measure(keep, shared), schema)
    if not small_enough:
        once = named.groupBy("_lang", "_text").agg(F.first("text").alias("text"))
        grams = once.mapInArrow(_grams, "_text binary, _lang string, gram string, n long")
        known = model.withColumnRenamed("lang", "_lang")
        sums = grams.join(known, ["_lang", "gram"]).groupBy("_lang", "_text").agg((-F.sum(F.col("n") * F.col("log")) / F.sum("n")).alias("_found"))
        left = measured.withColumn("_lang", F.coalesce("lang", F.lit("")))
        measured = left.join(sums, ["_lang", "_text"], "left").withColumn("log_perplexity", F.col("_found")).select(*empty.columns)
    return measured.withColumn("base_failed", base_failed())


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED * F.col("n_words"))


def bands(measured: DataFrame) -> DataFrame:
    """(lang, low, high, reach): the quartiles of a language's log perplexities, over all its distinct texts
    that pass the base rules, and how far a long document may lie outside."""
    q = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    found = measured.where(~F.col("base_failed")).groupBy(F.coalesce("lang", F.lit("")).alias("_lang"), "_text").agg(F.min("log_perplexity").alias("log_perplexity"))
    found = found.groupBy("_lang").agg(q.alias("q"))
    reach = F.lit(BAND) * F.greatest(F.col("q")[1] - F.col("q")[0], F.lit(LEAST_RANGE))
    return found.select("_lang", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), reach.alias("reach"))


def judge(docs: DataFrame, keep: list[str] | None = None, held: int = HELD) -> DataFrame:
    """Add the base counts, log_perplexity, base_failed and kept to ``docs(doc_id, text, lang, ...)``.

    A document is kept if it passes the base rules and its log perplexity lies in its language's band.
    ``keep`` names the columns to carry (all by default; lang is always among them). A null or empty
    text has no words and fails; a null lang is a language of its own, the same as an empty one; equal
    texts of a language are judged alike, and count once in model and band unless their doc_ids agree
    too; an empty table stays empty; columns named like the outputs are replaced.
    """
    keep = [c for c in (keep or docs.columns) if c not in (*COUNTS, "log_perplexity", "base_failed", "kept", "_text", "_lang")]
    keep += [] if "lang" in keep else ["lang"]
    model = train(docs.select("doc_id", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")))
    measured = scratch(measure(docs.select("text", *(c for c in keep if c != "text")), keep, model, held), "quality-measured")
    limits = small(scratch(bands(measured), "quality-bands"))
    judged = measured.join(limits, F.coalesce(measured["lang"], F.lit("")) == limits["_lang"], "left")
    reach = F.col("reach") * F.sqrt(1 + SHORT / F.greatest("n_words", F.lit(1)))
    inside = F.coalesce(F.col("log_perplexity").between(F.col("low") - reach, F.col("high") + reach), F.lit(False))
    return judged.select(*(c for c in measured.columns if c != "_text"), (~F.col("base_failed") & inside).alias("kept"))


@query("op10_quality_rules")
def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Count and judge every document."""
    judged = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"), keep=["doc_id", "lang"])
    return judged.select("doc_id", *COUNTS, "base_failed", "kept", "log_perplexity")
