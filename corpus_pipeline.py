"""A corpus from `documents`: language, near copies, benchmark passages, personal data, packing.

Each stage is (name, function of (spark, docs, sf_dir)); its rows, written as Parquet, are the next one's docs. A row that a stage drops is gone
for the later ones; texts that it changes stay changed. All but the last return the columns of documents, the last one row a packed piece.

Rows with a null in any column are handled as the operators say: without a text or letters, a row goes at the first stage; without a doc_id, it can be no
near copy and stays; a null lang is filled in; a null source or n_chars stays, but n_chars is set where personal data was masked.
Repeated rows count as one document from the second stage on. Empty tables pass through as empty tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wrenloom.llm import bestfit, crf, decontaminate, langid, ngramjoin
from wrenloom.llm.common import stash, table, unstash


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a known language; the models are trained on a bounded sample of the labelled rows of docs."""
    return langid.keep_known(docs, langid.train(langid.training_sample(docs)))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that with the least doc_id, of each group linked by n-gram Jaccard."""
    return ngramjoin.keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item in them."""
    return decontaminate.keep_clean(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data masked."""
    return crf.redact_rows(docs, crf.trained())


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, piece, start, length, bin_id, place) of every piece of every document."""
    return bestfit.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language),
    ("ngram_jaccard", near_copies),
    ("decontamination", decontamination),
    ("pii", personal_data),
    ("best_fit_packing", packing),
]

#: Language models, the random field and bulk-synchronous packing are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, over the whole of documents; each stage's rows are written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    before = None
    for name, stage in STAGES[:-1]:
        docs = stash(stage(spark, docs, sf_dir), name)
        if before is not None:
            unstash(before)
        before = docs
    out = STAGES[-1][1](spark, docs, sf_dir)
    if before is not None and out.sparkSession is spark:
        unstash(before)  # packing has read it in full and checkpointed what it needs
    return out
