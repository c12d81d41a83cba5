"""Corpus pipeline: quality rules, line dedup, near duplicates, decontamination and packing over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the next
stage's docs. So the tables that a stage wrote on its way are deleted when the next one begins. All stages but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidewater.llm import decontaminate, line_dedup, ngram_join, packing, quality
from tidewater.llm.queries import table
from tidewater.llm.store import discard, importable, recorded, remove, written
from tidewater.llm.tokens import vocabulary


_left: list[str] = []


def _stage(function):
    """The function as a stage: it first deletes what the stage before has left behind."""

    @wraps(function)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        remove(spark, _left)
        _left.clear()
        with recorded(_left):
            return function(spark, docs, sf_dir)

    return run


@_stage
def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the base rules or fall outside their language's perplexity band go."""
    return quality.kept(docs)


@_stage
def line_deduplication(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later repeats of runs of lines are cut; documents left without words go."""
    return line_dedup.deduplicated(docs)


@_stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each class of similar ones stays."""
    return ngram_join.one_per_class(docs)


@_stage
def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a passage of the benchmark go."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


@_stage
def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their ids, sequence and offset."""
    return packing.pack(docs, vocabulary())


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_deduplication),
    ("ngram_join", near_duplicates),
    ("decontamination", decontamination),
    ("packing", best_fit_packing),
]

#: Perplexity and tokenization have no SQL form; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        last, docs = docs, written(stage(spark, docs, sf_dir), name)
        discard(last)
    remove(spark, _left)
    _left.clear()
    return docs
