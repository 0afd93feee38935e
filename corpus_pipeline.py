"""A training corpus from ``documents`` in five stages.

Language ID drops what has no language, exact dedup drops copies, near-dedup
leaves one document of each group, mixing repeats and drops documents until the
sources have their target weights, and encoding gives the tokens.  Each stage
is written as Parquet and read again as the documents of the next.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from loomline.llm import exact_dedup, langid, mixing, near_dedup, queries, scratch, sentencepiece_bpe

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Tables that the stage before has left in the shared folder, by the session and the folder that the pipeline reads.
_LEFT: dict[tuple[str, str], list] = {}


def _stage(step: Stage) -> Stage:
    """A stage that first deletes what the one before has left: its result is written by then.

    Tables that ``docs`` itself reads stay, as they do if a result was handed on unwritten.
    """

    @wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        own = spark.sparkContext.applicationId, sf_dir
        left = scratch.release_unread(_LEFT.get(own, []), docs)
        since = scratch.mark()
        result = step(spark, docs, sf_dir)
        _LEFT[own] = left + scratch.since(since)
        return result

    return run_step


@_stage
def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: no text (null or empty), no letter, or no script of a learned language.

    Texts in several languages stay, as do repeated rows and rows without an
    id; where no row has a language to learn from, all go.
    """
    return langid.keep_certain(docs, langid.fit(docs))


@_stage
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of those with equal texts; one of those that have no id, or the same, if there is none smaller."""
    return exact_dedup.keep_first(docs)


@_stage
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that with the smallest id; documents without words all stay."""
    return near_dedup.keep_one(docs)


@_stage
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents as the mix takes them, up to three times; those without words are not taken, and a null source is a source."""
    return mixing.repeat_rows(docs)


@_stage
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of the mix's documents, one row for each copy: doc_id (null where it was), n_tokens, ids_sha256, decoded_sha256."""
    return sentencepiece_bpe.encode_rows(docs, queries.tokenizer_path())


STAGES = [("language_id", language_id), ("exact_dedup", exact), ("near_dedup", near), ("mixing", mix), ("sentencepiece", tokens)]

#: Language ID is learned, which SQL can't express; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table ``documents``; what lies between them is written to the shared folder."""
    docs = queries.table(spark, sf_dir, "documents")
    written = None
    for name, step in STAGES[:-1]:
        result = scratch.stage(step(spark, docs, sf_dir), name)
        if written is not None:
            scratch.drop(written)
        docs = written = result
    return STAGES[-1][1](spark, docs, sf_dir)
