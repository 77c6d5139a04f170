"""Operators of a training-data pipeline, and their registered queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import collocations, exact_dedup, hard_negatives, langid, ngram_join, packing, pii, quality, sentencepiece_codec, sharding, suffix_dedup, topk_search, warc

_MODULES = (sentencepiece_codec, exact_dedup, topk_search, warc, sharding, ngram_join, langid, packing, pii, quality, suffix_dedup, collocations, hard_negatives)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """name -> query: every function of the operators' modules named op<N>_..."""
    return {n: f for m in _MODULES for n, f in vars(m).items() if n.startswith("op") and n[2:3].isdigit()}


def oracle_sql() -> dict[str, str]:
    return {n: q for m in _MODULES for n, q in m.ORACLE.items()}
