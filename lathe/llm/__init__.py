"""Operators for large training-data pipelines; nothing else in the library imports this."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lathe.llm import exact_dedup, huffman, media, mixing, ngram_join, packing, pii, quality, toxicity, warc


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_mixing": mixing.query,
        "op2_token_files": huffman.query,
        "op3_packing": packing.query,
        "op4_toxicity": toxicity.query,
        "op5_ngram_join": ngram_join.query,
        "op6_exact_dedup": exact_dedup.query,
        "op7_pii": pii.query,
        "op8_media": media.query,
        "op9_warc": warc.query,
        "op10_quality": quality.query,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing.SQL, "op5_ngram_join": ngram_join.SQL, "op6_exact_dedup": exact_dedup.SQL}
