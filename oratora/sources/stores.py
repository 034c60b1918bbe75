"""Stored tables: speeches as JSON arrays or Parquet, embeddings by id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import EMBEDDING_SCHEMA, SPEECH_SCHEMA, conform


def read_json_speeches(spark: SparkSession, path: str, source: str | None = None) -> DataFrame:
    """A JSON array of speeches under the speech schema."""
    df = spark.read.schema(SPEECH_SCHEMA).json(path, multiLine=True)
    return df.withColumn("source", F.lit(source)) if source else df


def read_speeches(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path))


def write_speeches(df: DataFrame, path: str) -> None:
    """Parquet, a folder a source, so that a source is read alone."""
    df.write.mode("overwrite").partitionBy("source").parquet(path)


def read_embeddings(spark: SparkSession, path: str) -> DataFrame:
    return conform(spark.read.parquet(path), EMBEDDING_SCHEMA, ("speech_id", "embedding"))


def write_embeddings(df: DataFrame, path: str) -> None:
    df.select("speech_id", "embedding").write.mode("overwrite").parquet(path)


def union_sources(tables: dict[str, DataFrame]) -> DataFrame:
    """All sources in one table, each row tagged; missing columns become null."""
    tagged = [df.withColumn("source", F.lit(name)) for name, df in tables.items()]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
