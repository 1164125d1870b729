"""From raw documents to token ids: language, near duplicates, benchmark passages, personal data, SentencePiece.

`run` applies the stages to the documents of a data folder. Each stage's result is a Parquet table in the shared
folder, from which the next stage reads, so a lost executor repeats one stage's tasks at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from shoprank.llm import contamination, languages, ngram_join, pieces, pii
from shoprank.llm.common import Scratch
from shoprank.llm.queries import piece_model, table


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognised language."""
    return languages.keep_known(docs, piece_model())


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near duplicates."""
    return ngram_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a window of a benchmark item."""
    return contamination.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data in the texts by its kind."""
    return pii.redact(docs)


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id with the ids of the text, their number and the digests of ids and decoded text."""
    return pieces.encode_texts(docs, piece_model(), ["doc_id"], with_ids=True).drop("decoded")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language ID", known_language),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("PII", personal_data),
    ("SentencePiece encoding and decoding", token_ids),
]

#: a fitted model decides in the first stage, which SQL cannot express; tests/llm holds run() against brute force
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over all documents of `sf_dir`."""
    scratch, docs, before = Scratch(spark), table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir))
        if before is not None:
            scratch.drop(before)
        before = docs
    return docs
