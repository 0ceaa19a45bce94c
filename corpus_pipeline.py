"""The corpus pipeline: five operators in turn, each over all that the one before has kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, exact_dedup, language_id, sentencepieces, simhash
from quadrille.llm.shared import staged, table

#: Below this posterior no language is taken as found.
LEAST_SCORE = 0.5


def stage_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which a language is found, learned from those outside the held-out third.

    Null texts and texts without a letter go, empty ones with them; so does what scores less than LEAST_SCORE in
    every language. Ties go to the first language by name; repeated rows are judged alike. If no row has a language,
    none stays. An empty table stays empty. Columns of any name are kept.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    return language_id.keep(docs, model, LEAST_SCORE)


def stage_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the one with the largest doc_id.

    A null text is an empty one. Null doc_ids lose to any other; of rows equal in id and text one stays. An empty
    table stays empty. Columns of any name are kept.
    """
    return exact_dedup.deduplicate(docs).select(*docs.columns)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8.

    In order of doc_id each document goes that is like one that stays; null doc_ids come last. Null and word-less
    texts are alike. Rows equal in id and text stay or go together. An empty table stays empty. Columns of any name are kept.
    """
    return simhash.deduplicate(docs).select(*docs.columns)


def stage_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that share no passage with the benchmark.

    Null texts and texts of fewer than ten tokens share none. Rows are judged by their own text, also if several
    have one id or none. An empty table stays empty, and with an empty benchmark every row stays. Columns of any name are kept.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def stage_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each document's ids and of what they decode to.

    A null text is an empty one, of one token, the end. Each row gives a row, repeated ones and those without an id
    too. An empty table gives an empty report.
    """
    return sentencepieces.digests(docs, public_tokenizers.path("piece_bpe_32k.model"))


STAGES = [("language", stage_language), ("exact_dedup", stage_exact), ("near_dedup", stage_near), ("decontaminate", stage_benchmark), ("sentencepiece", stage_encode)]

#: Fingerprints, the language model and byte-pair encoding are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
