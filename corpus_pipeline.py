"""The corpus pipeline: documents through five corpus operators, each stage working on all that the one before it kept.

Defined cases, of every stage: documents are rows, told apart by id and text. Null ids and texts, empty texts and repeated
rows pass as the operators say: a null or empty text is never toxic, a copy or a leak, and has no passages; rows of null id are
kept by near_dedup and substring_dedup, judged like others by toxicity and decontamination, and packed. Of rows that repeat
an id, each is judged by its own text. An empty table gives no rows, and further columns, whatever their names, are kept until
packing, which gives its pieces alone.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from tessitura.llm.common import materialize, table
from tessitura.llm.decontam import without_leaks
from tessitura.llm.near_dup import first_of_each
from tessitura.llm.packing import pack_documents
from tessitura.llm.substring import cut_repeats
from tessitura.llm.toxicity import reject_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    return reject_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document of smallest id stays."""
    return first_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that a document of smaller id has are cut; a text that loses none keeps its form."""
    return cut_repeats(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left becomes sequences."""
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxicity), ("near_dedup", near_dedup), ("substring_dedup", substring_dedup), ("decontamination", decontamination), ("packing", packing)]
ORACLE_SQL = None  # models, tokenizers and components are beyond SQL; the stages are tested against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
