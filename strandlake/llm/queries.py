"""The operators' queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers

from . import bpe, chat, divergence, exact_dedup, importance, lm, mixing, quality, sharding, simhash, suffix, toxicity, transducer
from .common import documents

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")


def benchmark(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/benchmark.parquet")


def conversations(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/conversations.parquet")


def labels(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


QUERIES = {
    "op1_quality": lambda spark, d: quality.report(documents(spark, d)),
    "op2_simhash": lambda spark, d: simhash.report(documents(spark, d)),
    "op3_sharding": lambda spark, d: sharding.report(documents(spark, d)),
    "op4_lm": lambda spark, d: lm.report(documents(spark, d)),
    "op5_exact_dedup": lambda spark, d: exact_dedup.decisions(documents(spark, d)),
    "op6_toxicity": lambda spark, d: toxicity.report(documents(spark, d), labels(spark, d)),
    "op7_suffix": lambda spark, d: suffix.report(documents(spark, d)),
    "op8_bpe": lambda spark, d: bpe.report(documents(spark, d), VOCABULARY),
    "op9_mixing": lambda spark, d: mixing.mixed(documents(spark, d)).drop("rid"),
    "op10_chat": lambda spark, d: chat.report(conversations(spark, d)),
    "op11_importance": lambda spark, d: importance.report(documents(spark, d), benchmark(spark, d)),
    "op12_divergence": lambda spark, d: divergence.audit(documents(spark, d)),
    "op13_transducer": lambda spark, d: transducer.report(documents(spark, d), RANKS, public_tokenizers.PATTERN),
}

SQL = {"op1_quality": quality.SQL, "op5_exact_dedup": exact_dedup.SQL, "op10_chat": chat.SQL, "op11_importance": importance.SQL, "op12_divergence": divergence.SQL}
