"""The corpus pipeline: documents to packed training sequences, one operator per stage.

Every stage is written as Parquet in the shared checkpoint folder and read again as the next one's input, so a lost
executor repeats work of one stage only.

Every stage takes an empty table (and gives one), null and repeated doc_ids, null and empty texts, texts of any length, and columns beside
those of ``documents``, whatever their names; all but the last return the columns they got.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from cloakwork.llm import decontaminate, language, packing, simhash, substring
from cloakwork.llm.common import fold, read_table, shared_folder
from cloakwork.llm.queries import tokenizer_file

#: Byte-identical rows for run() cannot be had in SQL (profiles, hashes and a tokenizer decide); tests use brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in one of the languages of the labelled ones; texts that are null, have no letters or are like no profile go. Each row is
    judged by its text alone, repeated rows alike."""
    return language.keep_identified(docs, fold("doc_id", 3) == 1)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest doc_id. Wordless texts, null ones too, are near copies of each
    other. Rows are judged by their texts, so rows that repeat a doc_id, or have none, stay unless they are near copies; those without an id come last
    in their group."""
    return simhash.keep_one_of_each_group(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with the words left that no earlier passage repeats; untouched texts, null ones too, stay as they are. Rows that repeat a
    doc_id, or have none, are documents of their own, unless their texts are equal; null doc_ids come before all others."""
    return substring.keep_first_passages(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the contamination rule clears of the benchmark. Null and wordless texts are clear; each row is judged by its own
    text."""
    return decontaminate.drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents and their places in the training sequences. A null or empty text is its end token alone."""
    return packing.pack(docs, tokenizer_file("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("substring_dedup", substring_dedup),
    ("decontamination", decontamination),
    ("best_fit_packing", best_fit_packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the last one's rows."""
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for number, (name, stage) in enumerate(STAGES):
        place = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(place)
        docs = spark.read.parquet(place)
    return docs
