"""Clustering and projection by Spark ML."""

from __future__ import annotations

from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import Columns
from .prepare import COLS


def _vectors(df: DataFrame, cols: Columns) -> DataFrame:
    return df.withColumn("__v", array_to_vector(F.col(cols.embedding).cast("array<double>")))


def kmeans(df: DataFrame, k: int, seed: int = 42, starts: int = 10, cols: Columns = COLS) -> DataFrame:
    """``df`` with ``cluster``: the cheapest of several k-means runs."""
    rows = _vectors(df, cols).persist()
    try:
        models = [KMeans(k=k, seed=seed + i, featuresCol="__v", predictionCol=cols.topic).fit(rows) for i in range(starts)]
    finally:
        rows.unpersist()
    best = min(models, key=lambda m: m.summary.trainingCost)
    return best.transform(_vectors(df.drop(cols.topic), cols)).drop("__v")


def pca_2d(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """``df`` with ``x`` and ``y``: the first two principal components of the centred vectors; no rows give none."""
    rows = _vectors(df, cols)
    first = rows.agg(Summarizer.mean(F.col("__v")).alias("m"), F.count("*").alias("n")).first()
    if not first["n"]:
        return df.withColumns({"x": F.lit(0.0), "y": F.lit(0.0)})
    model = PCA(k=2, inputCol="__v", outputCol="__xy").fit(rows)
    shift = [float(v) for v in first["m"].toArray() @ model.pc.toArray()]  # the projection itself doesn't centre
    xy = vector_to_array("__xy")
    return model.transform(rows).withColumns({"x": xy[0] - shift[0], "y": xy[1] - shift[1]}).drop("__v", "__xy")
