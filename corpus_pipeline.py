"""A corpus pipeline of five stages, each calling one operator of codestrata.llm.

Every stage takes any table with the columns of ``documents``. Null texts count as
empty and null ids as ids; an empty table passes through all stages; rows alike
are treated alike; very long texts are read whole. All stages but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from codestrata.llm import mixing, ngram_join, packing, quality_rules, suffix_dedup
from codestrata.llm.shared import stored


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null or empty text is not one of them."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.kept_documents(docs, labels)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that the n-gram join links, at the usual five words and 0.8 (op8's contract has three and 0.9).

    Of a group the document with the least id stays, of ids that tie the text with
    the least hash; documents without words link with nothing and stay.
    """
    return ngram_join.one_of_each(docs, words=5, num=80, den=100)


def repeated_text_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings that occur more than once, in passages of 240 bytes: 51 words seldom have fewer (op4's contract has 400).

    Null texts stay null; a text that is repeated as a whole becomes empty.
    """
    return suffix_dedup.stripped_documents(docs, length=suffix_dedup.PASSAGE)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, each as often as it is taken; null sources are one source, documents without words are never taken."""
    return mixing.mixed_documents(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document goes; documents without words have none."""
    return packing.pack(docs)


STAGES = [
    ("quality_rules", quality_stage),
    ("ngram_jaccard_join", near_duplicate_stage),
    ("suffix_dedup", repeated_text_stage),
    ("source_mixing", mixing_stage),
    ("best_fit_packing", packing_stage),
]
#: The stages hash as DuckDB cannot; tests hold the pipeline against a plain Python version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written and read again for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
