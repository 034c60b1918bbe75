"""What a reader of the results asks: searches, lists and rankings over the metrics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..schemas import Columns
from . import counts
from .counts import first_limit, top_by
from .embeddings import with_sides
from .prepare import COLS


def search(df: DataFrame, query: str, columns: list[str], order: list[Column], k: int = 10) -> DataFrame:
    """The first ``k`` rows with the text in any of the columns, case ignored."""
    hit = reduce(lambda a, b: a | b, [F.coalesce(F.contains(F.lower(F.col(c)), F.lit(query.lower())), F.lit(False)) for c in columns])
    return first_limit(df.filter(hit), order, k)


def party_counts(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    return df.groupBy(cols.party).agg(F.count("*").alias("n"))


def party_distribution(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Whole percentages of each party's speeches by topic, all topics present."""
    c = df.groupBy(cols.party, cols.topic).agg(F.count("*").alias("c"))
    total = c.groupBy(cols.party).agg(F.sum("c").alias("n"))
    grid = total.withColumn("one", F.lit(1)).join(c.select(cols.topic).distinct().withColumn("one", F.lit(1)), "one").drop("one")  # two small dimensions
    return grid.join(c, [cols.party, cols.topic], "left").select(cols.party, cols.topic, F.coalesce("c", F.lit(0)).alias("n"), F.round(100 * F.coalesce("c", F.lit(0)) / F.col("n"), 0).cast("long").alias("pct"))


def rebel_severity(rebels: DataFrame, cols: Columns = COLS, over: float = 30) -> DataFrame:
    return rebels.filter(F.col("rebel_pct") > over).select(cols.speaker, cols.party, "rebel_pct", F.round(100 - F.col("rebel_pct"), 1).alias("in_line_pct"), T.ladder(F.col("rebel_pct"), [(60, "Alto"), (40, "Medio")], "Moderato").alias("severity"))


def generalists(df: DataFrame, cols: Columns = COLS, least: int = 5, k: int = 10) -> DataFrame:
    """The ten broadest and the ten narrowest speakers."""
    g = counts.generalism(df, cols.speaker, cols, least).withColumn("all", F.lit(1))
    top = top_by(g, ["all"], [F.desc("score"), F.asc(cols.speaker)], k).withColumn("side", F.lit("generalists"))
    low = top_by(g, ["all"], [F.asc("score"), F.asc(cols.speaker)], k).withColumn("side", F.lit("specialists"))
    return top.unionByName(low).drop("all")


def ranked(df: DataFrame, score: str, key: str, k: int, ascending: bool = False) -> DataFrame:
    """The first ``k`` rows by a score, with their ranks."""
    return top_by(df.withColumn("all", F.lit(1)), ["all"], [F.asc(score) if ascending else F.desc(score), F.asc(key)], k).drop("all")


def bipartisan_lists(overlaps: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Topics by what left and right have in common: most first, and least first."""
    most = ranked(overlaps, "overlap", cols.topic, 1000).withColumn("list", F.lit("bipartisan"))
    least = ranked(overlaps, "overlap", cols.topic, 1000, ascending=True).withColumn("list", F.lit("polarized"))
    return most.unionByName(least).select("list", "rank", cols.topic, "overlap", "type")


def bridge_pairs(pairs: DataFrame, k: int = 10, side=T.coalition) -> DataFrame:
    crossing = with_sides(pairs, side).filter("crosses_divide")
    return first_limit(crossing, [F.desc("similarity"), F.asc("speaker1"), F.asc("speaker2")], k).drop("crosses_divide")


def word_cloud(keywords: DataFrame, most: int = 50) -> DataFrame:
    """Weights that fall by rank."""
    return keywords.filter(F.col("rank") <= most).withColumn("weight", F.round(F.pow(F.lit(0.85), F.col("rank") - 1), 6))


def radar(linguistic: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Each rate as a share of the highest, 100 at most."""
    rates = ["question_rate", "self_reference_rate", "negation_rate", "data_rate"]
    top = linguistic.agg(*[F.max(c).alias(f"max_{c}") for c in rates])
    joined = linguistic.withColumn("one", F.lit(1)).join(F.broadcast(top.withColumn("one", F.lit(1))), "one")  # one row
    return joined.select(cols.speaker, *[F.round(F.least(F.lit(100.0), F.coalesce(100 * F.col(c) / F.nullif(F.col(f"max_{c}"), F.lit(0.0)), F.lit(0.0))), 1).alias(c) for c in rates])


def projection(df: DataFrame, i: int, j: int, cols: Columns = COLS) -> DataFrame:
    """Two topic scores as coordinates."""
    return df.select(cols.id, F.get("topic_scores", F.lit(i)).alias("x"), F.get("topic_scores", F.lit(j)).alias("y"))


def points_by(df: DataFrame, by: str, cols: Columns = COLS) -> DataFrame:
    """Points under their topic or party, numbered within it."""
    return df.select(by, cols.id, "x", "y", F.row_number().over(Window.partitionBy(by).orderBy(cols.id)).alias("place"))


def speech_export(df: DataFrame, rebels: DataFrame, cols: Columns = COLS, raw_text: str = "text", length: int = 500) -> DataFrame:
    """The exported fields of each speech; ``rebel_pct`` is 0 for those without one."""
    joined = df.join(rebels.select(cols.speaker, "rebel_pct"), cols.speaker, "left")
    more = [F.transform("topic_scores", lambda s: F.round(s, 3)).alias("topic_scores")] if "topic_scores" in df.columns else []
    keep = [c for c in (cols.id, cols.speaker, cols.party, cols.topic, cols.date, cols.source, cols.role, "url", "x", "y") if c in df.columns]
    return joined.select(*keep, F.substring(F.col(cols.text), 1, length).alias("excerpt"), F.col(raw_text).alias("snippet"), F.coalesce("rebel_pct", F.lit(0.0)).alias("rebel_pct"), *more)


def with_label(df: DataFrame, labels: dict[int, str], topic: str, fallback: str = "Cluster ") -> DataFrame:
    """Topic names from a small table, with a fallback."""
    if not labels:
        return df.withColumn("label", F.concat(F.lit(fallback), F.col(topic).cast("string")))
    table = F.create_map(*[F.lit(x) for p in labels.items() for x in p])
    return df.withColumn("label", F.coalesce(F.try_element_at(table, F.col(topic)), F.concat(F.lit(fallback), F.col(topic).cast("string"))))


def unknown_as(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Missing parties under their one name."""
    return df.withColumn(cols.party, F.when(T.known_party(F.col(cols.party)), F.col(cols.party)).otherwise(L.UNKNOWN_PARTY))
