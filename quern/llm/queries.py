"""The registered queries of the operators, with production parameters over whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import context_mixing, decontaminate, host_rules, language_id, secrets, sentence_spans, simhash, toxicity
from quern.llm.common import fold, read
from quern.llm.piece_bpe import encode_pieces
from quern.llm.token_counts import count_tokens

TOKEN_LIMIT = 1024


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 3, 1)
    found = language_id.label_spans(docs, language_id.train(docs, ~held_out))
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", F.size("spans").alias("n_spans"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = host_rules.judge(read(spark, sf_dir, "documents"))
    return kept.withColumn("host_rate", F.round("host_rate", 9))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digests(secrets.scan_secrets(read(spark, sf_dir, "documents")))


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = fold("doc_id", 7, 2)
    found = context_mixing.score_texts(read(spark, sf_dir, "documents"), ~held_out)
    return found.select(
        "doc_id",
        held_out.alias("held_out"),
        "n_tokens",
        "n_known",
        "train_tokens",
        "base_score",
        "score",
        (F.col("bits") / F.col("n_coded")).alias("bits_per_byte"),
    )


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_spans.drop_repeated_spans(read(spark, sf_dir, "documents"))
    cut = F.aggregate("removed", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", F.size("removed").alias("n_spans"), cut.alias("n_removed_chars"), "text")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > TOKEN_LIMIT)


def op9_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return piece_digests(encode_pieces(read(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = fold("doc_id", 4, 2)
    langs = language_id.train(docs, ~held_out, most_docs=math.inf)
    model = toxicity.train(docs, read(spark, sf_dir, "labels"), ~held_out, langs)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= toxicity.CUT).cast("int").alias("predicted"))


def piece_digests(encoded: DataFrame) -> DataFrame:
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_language_id, op2_quality_rules, op3_secret_scan, op4_decontamination, op5_lm_scoring, op6_substring_dedup, op7_simhash, op8_token_counts, op9_sentencepiece, op10_toxicity]
    return {query.__name__: query for query in found}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": host_rules.oracle_sql(), "op3_secret_scan": secrets.oracle_sql()}
