"""Documents to training tokens in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from roadlens.llm import bpe, line_dedup, mixing, ngram_join, toxicity
from roadlens.llm.common import durable, table


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity model rejects go. Null and empty texts have the bias's score and stay; repeated rows share their fate."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines equal or alike only the first stays; texts and their lengths change, no row goes. A null text stays null, repeated rows stay equal."""
    deduped = line_dedup.dedup_lines(docs)
    length = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return deduped.withColumn("n_chars", length).select(*[f"`{c}`" for c in docs.columns])


def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component stays, that of the smallest doc_id; documents without words are near to none and stay, of rows that repeat id and text one."""
    return ngram_join.keep_one(docs).select(*[f"`{c}`" for c in docs.columns])


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them; those without words once, a null source is a source of its own."""
    return mixing.mix(docs).select(*[f"`{c}`" for c in docs.columns])


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document taken, with digests of the ids and of the text they decode to; a null text is an empty one."""
    encoded = bpe.encode(docs.select("doc_id", "source", "text"))
    return bpe.decode(encoded).select(
        "doc_id",
        "source",
        F.size("ids").cast("long").alias("n_tokens"),
        "ids",
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", ngram_join_stage),
    ("mixing sources", mixing_stage),
    ("BPE", bpe_stage),
]

#: The stages fit a model and solve a convex problem; tests hold them against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = durable(docs, "stage")
    return docs
