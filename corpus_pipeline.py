"""A training-data pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on everything its predecessor
kept; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import exact_dedup, langid, ngram_join, packing, pii
from marketloom.llm.common import discard, only_results, spare_name, written


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no learned language is recognised go: those without a letter, and those whose best label has less than half of the probability."""
    found = langid.identify_languages(docs, F.lit(True), keep=docs.columns)
    return found.where((F.col("lang_pred") != langid.UNKNOWN) & (F.col("score") >= 0.5)).select(*docs.columns)


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the largest doc_id stays; of rows that repeat it, one."""
    decided = exact_dedup.content_sort_dedup(docs, keep="largest").select("doc_id", "text_sha256", "kept")
    pairs = decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("rows"))
    gone = pairs.where(~F.col("stays")).select("doc_id", "text_sha256")
    repeated = pairs.where("stays AND rows > 1").select("doc_id", "text_sha256")

    code = spare_name(docs, "text_sha256")
    coded = docs.withColumn(code, F.sha2(exact_dedup.normalised(F.col("text")), 256))

    def joined(left: DataFrame, right: DataFrame, how: str) -> DataFrame:
        r = right.select(F.col("doc_id").alias("__id"), F.col("text_sha256").alias("__code"))
        return left.join(r, (F.col(code) == F.col("__code")) & F.col("doc_id").eqNullSafe(F.col("__id")), how)

    once = joined(joined(coded, gone, "left_anti"), repeated, "left_anti")
    return once.unionByName(joined(coded, repeated, "left_semi").dropDuplicates(["doc_id", code])).select(*docs.columns)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents that links connect, the one with the smallest doc_id stays."""
    found = ngram_join.ngram_jaccard_components(docs)
    gone = found.where("component_id != doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def private_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data and secrets become surrogates; n_chars follows the new text."""
    out = pii.with_surrogates(docs, pii.session_key(spark), spans=False)
    return out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType))) if "n_chars" in docs.columns else out


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 1024."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language ID", language_stage),
    ("exact dedup", exact_stage),
    ("n-gram Jaccard join", near_stage),
    ("PII surrogates", private_stage),
    ("best-fit packing", packing_stage),
]

#: Tokens, surrogates and language models can't be had in SQL; the tests compare the stages with plain ones.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order on ``documents``; each one's result is written as Parquet and read again.

    A stage's input and the tables that it wrote on the way are deleted when it is done or has failed, so only the last result stays.
    """
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        try:
            with only_results(spark) as keep:
                after = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
                keep.append(after)
        finally:
            discard(docs)
        docs = after
    return docs
