"""A training-corpus pipeline: language ID, near-dedup, decontamination, mixing, token output.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame that run() writes to the shared folder
and rereads, so a lost executor costs at most its stage's tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from planlake.llm import decontaminate, langid, mixing, simhash, tokenfiles
from planlake.llm._io import table, written


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that have a language; what it learns from is the same split as the query's."""
    return langid.identified(docs, langid.fit(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of every group of near duplicates (five-word shingles, a similarity of 0.8)."""
    return simhash.keep_one_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take every document as often as the mix does."""
    return mixing.mixed_documents(docs)


def token_files(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Write token ids and return, read back, what was written of each document."""
    return tokenfiles.round_trip(docs)


STAGES = [("language_id", language), ("simhash_near_dedup", near_dedup), ("benchmark_decontamination", decontamination), ("source_mix", source_mix), ("token_output", token_files)]

#: Trained models and pivotal draws have no SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        now = written(stage(spark, docs, sf_dir), name)
        if last:
            last.drop()
        docs, last = now.df, now
    return last.leave()
