"""From raw documents to token ids: five stages, each on all that the one before kept.

A stage's result is written before the next begins, so each first clears the
scratch tables of the stage before it; those of other callers stay.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chatlens.llm import bpe, decontaminate, near_dups, quality, suffix_dedup
from chatlens.llm.common import Scratch, table, written
from chatlens.llm.queries import QUALITY_FOLD, QUALITY_LIMIT, labelled, vocabulary

_scratch = Scratch()


def _stage(run: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    @wraps(run)
    def cleared(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        _scratch.clear()
        with _scratch:
            return run(spark, docs, sf_dir)

    return cleared


@_stage
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    trees = quality.fit(docs, labelled(spark, sf_dir, "quality", *QUALITY_FOLD))
    scored = quality.score(docs, trees, name="__score")
    return scored.where(F.col("__score") >= QUALITY_LIMIT).select(*docs.columns)


@_stage
def near_duplicates_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near duplicates."""
    return near_dups.drop_near_duplicates(docs)


@_stage
def repeats_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that smaller documents have; n_chars follows the text."""
    done = suffix_dedup.remove_repeats(docs, digests=False).select(*docs.columns)
    return done.withColumn("n_chars", F.length("text").cast("bigint")) if "n_chars" in docs.columns else done


@_stage
def contamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item."""
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


@_stage
def tokens_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of ids and decoded texts."""
    encoded = bpe.encode(docs.select("doc_id", "text"), vocabulary(), keep=["doc_id"])
    return bpe.digests(bpe.decode(encoded, vocabulary()))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", quality_stage),
    ("near_duplicates", near_duplicates_stage),
    ("repeats", repeats_stage),
    ("contamination", contamination_stage),
    ("tokens", tokens_stage),
]

#: SQL has neither trees nor sketches nor merges; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name, scratch=False)
    return docs
