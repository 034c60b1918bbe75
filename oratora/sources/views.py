"""The speech table as a view of the local test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def speeches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as speeches: language is the party, language and source the speaker, length modulo 8 the topic."""
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.col("doc_id").alias("speech_id"),
        "text",
        F.col("text").alias("cleaned_text"),
        F.col("lang").alias("group"),
        F.concat_ws("_", "lang", "source").alias("deputy"),
        (F.col("n_chars") % 8).cast("int").alias("cluster"),
        F.date_add(F.lit("2022-10-13").cast("date"), (F.col("doc_id") * 37 % 800).cast("int")).alias("date"),
        F.when(F.col("doc_id") % 2 == 0, "camera").otherwise("senate").alias("source"),
    )


def embedded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Speeches with a vector; its label is the topic."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("speech_id"), "embedding", F.col("label").alias("cluster"))
    return speeches(spark, sf_dir).drop("cluster").join(e, "speech_id")
