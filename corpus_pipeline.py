"""A corpus pipeline: language ID, quality rules, near-duplicate removal, PII, packing."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import jaccard, language, packing, pii, quality
from brindle.session import release, scratch, table

#: A document stays if its language is known with this score at least.
LEAST_SCORE = 0.5


#: Rows of the batches that go to Python workers. A batch lies in the worker and in the executor at once, so
#: stages that look at each document alone take few; packing looks for the distinct words of a batch.
FEW_ROWS, MANY_ROWS = 1_000, 10_000


#: Columns that stages read or change; all others only pass through them.
OWN = ("doc_id", "text", "lang", "n_chars")


def stage(step: Callable, rows: int = FEW_ROWS) -> Callable:
    """A stage begins with what the ones before it left on the driver released, and sets its batches' rows.

    Columns other than OWN bear names of no meaning inside the stage and get their own back from it, so none of them can
    clash with what an operator adds, whatever it is called. A table of no rows stays one."""

    @functools.wraps(step)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        release(spark)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
        names = docs.columns
        inside = [c if c in OWN else f"_passed_{i}" for i, c in enumerate(names)]
        found = step(spark, docs.toDF(*inside), sf_dir)
        return found.toDF(*names) if found.columns == inside else found

    return run


@stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told; lang becomes the prediction. Learns from the documents that are
    not held out. A null text, or one without a letter, has no language and goes; a null lang teaches nothing and is
    filled; repeated rows are told alike and all stay."""
    found = language.identify_languages(docs).where((F.col("lang_pred") != language.UNKNOWN) & (F.col("score") >= LEAST_SCORE))
    return found.withColumn("lang", F.col("lang_pred")).select(*docs.columns)


@stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and lie in their language's perplexity band. A null or empty text has no words
    and goes; a null lang is a language of its own; repeated rows are judged alike and all stay."""
    return quality.judge(docs).where("kept").select(*docs.columns)


@stage
def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, the one with the smallest doc_id; of rows that agree in doc_id and
    text one stays. Texts without words, null ones too, are no duplicates of each other unless they share a doc_id
    and agree; a null doc_id comes last."""
    return jaccard.keep_one(docs, jaccard.labelled_rows(docs)).select(*docs.columns)


@stage
def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data and what discloses it replaced in their texts; n_chars follows. A null text becomes
    an empty one; repeated rows get the same text and all stay."""
    found = pii.find_personal(docs, [c for c in docs.columns if c not in ("doc_id", "text")])
    clean = found.withColumn("text", pii.sanitise(F.col("text"), F.col("spans")))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*docs.columns)


@functools.partial(stage, rows=MANY_ROWS)
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's pieces with their places in sequences of 2048 tokens. A null text counts as empty and is one token;
    repeated rows are packed each."""
    return packing.pack_word_bpe(docs)


STAGES = [
    ("language_id", language_id),
    ("quality_rules", quality_rules),
    ("jaccard_join", jaccard_join),
    ("personal_data", personal_data),
    ("best_fit_packing", best_fit_packing),
]

#: SQL can't express the language model, the perplexity bands or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again as the next one's input."""
    docs = table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = scratch(step(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
