"""Metrics over time: trends, topic surfing, activity patterns, periods."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import lexicons as L
from ..schemas import Columns
from .counts import top_by
from .prepare import COLS, with_time


def with_period(df: DataFrame, cols: Columns = COLS, granularity: str = "month") -> DataFrame:
    """Rows with a date, and their period key."""
    return df.withColumn("period", dates.period_key(dates.as_date(df, cols.date), granularity)).filter("period is not null")


def trends(df: DataFrame, cols: Columns = COLS, granularity: str = "month", by_party: bool = False) -> DataFrame:
    rows = with_period(df, cols, granularity)
    keys = ["period", cols.topic]
    if by_party:
        rows, keys = rows.filter(F.col(cols.party) != L.UNKNOWN_PARTY), [cols.party, *keys]
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def dense_trends(df: DataFrame, cols: Columns = COLS, granularity: str = "month") -> DataFrame:
    """Every period with every topic, 0 where nothing was said."""
    t = trends(df, cols, granularity)
    periods, topics = t.select("period").distinct().withColumn("one", F.lit(1)), t.select(cols.topic).distinct().withColumn("one", F.lit(1))
    grid = periods.join(topics, "one").drop("one")  # two small dimensions
    return grid.join(t, ["period", cols.topic], "left").select("period", cols.topic, F.coalesce("n", F.lit(0)).alias("n"))


def monthly_topics(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Dominant topic of each speaker in each active month."""
    c = with_period(df, cols).groupBy(cols.speaker, "period", cols.topic).agg(F.count("*").alias("c"))
    return c.groupBy(cols.speaker, "period").agg(F.sum("c").alias("n"), F.min(F.struct((-F.col("c")).alias("m"), F.col(cols.topic).alias("t"))).alias("b")).select(cols.speaker, "period", "n", F.col("b.t").alias("topic"))


def surfing_timeline(df: DataFrame, cols: Columns = COLS, least: int = 5, least_dated: int = 3) -> DataFrame:
    """Months of the speakers with enough speeches, each with its topic and whether it changed."""
    enough = df.groupBy(cols.speaker).agg(F.count("*").alias("rows")).filter(F.col("rows") >= least)
    dated = monthly_topics(df, cols)
    n = dated.groupBy(cols.speaker).agg(F.sum("n").alias("dated")).filter(F.col("dated") >= least_dated)
    w = Window.partitionBy(cols.speaker).orderBy("period")  # one row a month
    return dated.join(enough, cols.speaker, "left_semi").join(n, cols.speaker, "left_semi").withColumn("previous", F.lag("topic").over(w)).select(cols.speaker, "period", "topic", F.coalesce(F.col("topic") != F.col("previous"), F.lit(False)).alias("changed"))


def surfing(df: DataFrame, cols: Columns = COLS, least: int = 5, least_dated: int = 3) -> DataFrame:
    """How often a speaker's monthly topic changes, and where to most."""
    t = surfing_timeline(df, cols, least, least_dated)
    s = t.groupBy(cols.speaker).agg(F.count("*").alias("n_periods"), F.sum(F.col("changed").cast("int")).alias("changes"))
    to = t.filter("changed").groupBy(cols.speaker, "topic").agg(F.count("*").alias("c")).groupBy(cols.speaker).agg(F.min(F.struct((-F.col("c")).alias("m"), F.col("topic").alias("t"))).alias("b")).select(cols.speaker, F.col("b.t").alias("top_destination"))
    most = F.col("n_periods") - 1
    score = F.when(F.col("n_periods") > 1, (most - F.col("changes")) / F.nullif(most, F.lit(0)) * 100).otherwise(100.0)
    return s.join(to, cols.speaker, "left").select(cols.speaker, "n_periods", "changes", F.round(score, 1).alias("consistency"), "top_destination")


def top_surfers(df: DataFrame, cols: Columns = COLS, least_changes: int = 2, k: int = 15, least_periods: int = 3, k_steady: int = 10) -> DataFrame:
    s = surfing(df, cols).withColumn("all", F.lit(1))
    moving = top_by(s.filter(F.col("changes") >= least_changes), ["all"], [F.desc("changes"), F.asc(cols.speaker)], k).withColumn("kind", F.lit("surfer"))
    steady = top_by(s.filter(F.col("n_periods") >= least_periods), ["all"], [F.desc("consistency"), F.asc(cols.speaker)], k_steady).withColumn("kind", F.lit("steady"))
    return moving.unionByName(steady).drop("all")


def interventions(df: DataFrame, cols: Columns = COLS, least: int = 3) -> DataFrame:
    """Activity per active month, its regularity, its peak, and the share of months with any."""
    d = dates.as_date(df, cols.date) if dict(df.dtypes)[cols.date] != "string" else dates.parse_month_date(F.col(cols.date))
    months = df.withColumn("period", F.date_format(d, "yyyy-MM")).filter("period is not null").groupBy(cols.speaker, "period").agg(F.count("*").alias("c"))
    every = months.agg(F.countDistinct("period").alias("months"))
    s = months.groupBy(cols.speaker).agg(F.sum("c").alias("n"), F.count("*").alias("active_months"), F.avg("c").alias("m"), F.stddev_pop("c").alias("sd"), F.max("c").alias("top")).filter(F.col("n") >= least)
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    one = F.col("active_months") == 1
    joined = s.withColumn("one", F.lit(1)).join(F.broadcast(every.withColumn("one", F.lit(1))), "one")  # one row
    return joined.select(
        cols.speaker,
        "n",
        "active_months",
        F.round("m", 2).alias("avg_per_month"),
        F.round(F.when(one, 50.0).otherwise(clamp((1 - F.col("sd") / F.col("m")) * 100)), 1).alias("regularity"),
        F.round(F.when(one, 100.0).otherwise(100 * F.col("top") / F.col("n")), 1).alias("burst"),
        F.round(100 * F.col("active_months") / F.col("months"), 1).alias("activity_ratio"),
    )


def period_filter(df: DataFrame, year: int | None = None, month: int | None = None, cols: Columns = COLS, least: int = 5) -> DataFrame:
    """Speakers of one year or month with at least so many speeches, and their counts."""
    rows = with_time(df, cols)
    if year is not None:
        rows = rows.filter(F.col("year") == year)
    if month is not None:
        rows = rows.filter(F.month("parsed_date") == month)
    return rows.groupBy(cols.speaker, cols.party).agg(F.count("*").alias("n_speeches")).filter(F.col("n_speeches") >= least)


def available_periods(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    t = with_time(df, cols).filter("year is not null")
    return t.select(F.lit("year").alias("grain"), F.col("year").cast("string").alias("period")).distinct().unionByName(t.select(F.lit("month").alias("grain"), F.col("month").alias("period")).distinct())
