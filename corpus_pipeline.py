"""The corpus pipeline: quality rules, near duplicates, benchmark passages, personal data, packing.

Every stage takes nulls in any column, empty and very long texts, repeated rows, empty tables and columns of any further
name; what it does with them stands with it. The caller has written a stage's rows before it calls the next one, which
deletes what else the former stages have left in the shared folder. Ties are decided the same way in every run, but for the numbers of sequences.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from constella.llm import _store, decontaminate, ngram_join, packing, pii, quality


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
#: Folders that the stage before has written and that its result was read from.
_left: list[str] = []


def _tidy(stage: Stage) -> Stage:
    """A stage that first deletes what the one before has left, but for what ``docs`` itself is read from."""

    @functools.wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _store.discard(spark, _left, docs)
        _left.clear()
        with _store.scope() as made:
            out = stage(spark, docs, sf_dir)
        _left.extend(made)
        return out

    return run


@_tidy
def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, null and empty texts among them; rows of equal text, language and source share their fate."""
    return quality.keep_good(docs)


@_tidy
def single(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates stays, that of the smallest identifier; one row of it. Rows without an identifier, and empty texts, stay."""
    return ngram_join.keep_one(docs)


@_tidy
def unspoilt(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark passages are cut out; a document of which no word is left goes. Texts without passages stay as they are, null included."""
    return decontaminate.remove_passages(docs, _store.table(spark, sf_dir, "benchmark"))


@_tidy
def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by surrogates; all rows stay, equal data get equal surrogates, and texts without any stay as they are."""
    return pii.pseudonymise(docs, pii.setting_key(spark))


@_tidy
def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are tokenised and packed into sequences: one row per piece, with its token ids. A null or empty text is one piece of its end mark."""
    return packing.pack_documents(docs)


STAGES = [("quality_rules", good), ("ngram_jaccard_join", single), ("benchmark_decontamination", unspoilt), ("pii", private), ("best_fit_packing", packed)]

#: SQL can't express the stages; tests compare them with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents; each stage's rows are written to the shared folder, and all else that it has written there is deleted."""
    docs = _store.table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        with _store.scope() as made:
            done = _store.materialise(stage(spark, docs, sf_dir), name)
        _store.discard(spark, made, done)
        if number:
            _store.drop(docs)
        docs = done
    return docs
