"""The registered queries of this subpackage: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, decontaminate, language, language_model, neighbours, packing, periodic, quality, simhash, spelling, substring, token_counts, toxicity
from .common import fold, read_table


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file on this machine; a cluster passes its own path to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(read_table(spark, sf_dir, "documents"), fold("doc_id", 3) == 1)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(read_table(spark, sf_dir, "documents"), tokenizer_file("piece_bpe_32k.model"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    planted = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(chat.PLANTED).alias("text"))
    rows = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digest(chat.render(chat.messages(chat.as_events(rows))))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.digest(substring.remove_repeats(read_table(spark, sf_dir, "documents")))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"))


def op6_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_model.score(read_table(spark, sf_dir, "documents"), fold("doc_id", 7) == 2)


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark")))


def op8_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.search(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold("doc_id", 3) == 1)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicate_groups(read_table(spark, sf_dir, "documents"))


def planted_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words with the contract's periodic end, if the id's hash calls for one; rows without an id stay as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    at = g % n
    period = 1 + (n - at) // (3 + g % 8)
    return words[:at] + (words[at : at + period] * (-(-(n - at) // period)))[: n - at]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.find_runs(read_table(spark, sf_dir, "documents"), change=planted_repeats)


def op12_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"), fold("doc_id", 5) == 0)


def planted_misspelling(doc_id: int | None, word: str) -> str:
    """The word without one code point, if the hash of the id and the word calls for it; rows without an id stay as they are."""
    h = zlib.crc32(f"{doc_id}:{word}".encode()) if doc_id is not None else 1
    return word if h % 199 else word[: h % len(word)] + word[h % len(word) + 1 :]


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_groups(read_table(spark, sf_dir, "documents"), change=planted_misspelling)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_language_id": op1_language_id,
        "op2_token_counts": op2_token_counts,
        "op3_chat_formatting": op3_chat_formatting,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_lm_scoring": op6_lm_scoring,
        "op7_decontamination": op7_decontamination,
        "op8_neighbours": op8_neighbours,
        "op9_toxicity": op9_toxicity,
        "op10_simhash": op10_simhash,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_quality": op12_quality,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_language_id": language.ORACLE_SQL,
        "op3_chat_formatting": chat.ORACLE_SQL,
        "op4_substring_dedup": substring.ORACLE_SQL,
        "op7_decontamination": decontaminate.ORACLE_SQL,
        "op13_spelling_variants": spelling.ORACLE_SQL,
    }
