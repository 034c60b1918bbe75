"""Whole records: everything known about a speaker in one row, for all time or a period."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import Columns
from .counts import speaker_aggregates
from .prepare import COLS
from .temporal import with_time
from .views import with_label


def speaker_record(tables: dict[str, DataFrame], cols: Columns = COLS) -> DataFrame:
    """One row per speaker: each table's columns as a struct under its name, null where it has no row.

    All tables have one row per speaker, so the joins are of equal keys and small.
    """
    packed = [t.select(cols.speaker, F.struct(*[c for c in t.columns if c != cols.speaker]).alias(name)) for name, t in tables.items()]
    return reduce(lambda a, b: a.join(b, cols.speaker, "full"), packed)


def in_periods(df: DataFrame, cols: Columns = COLS, year_rows: int = 10, month_rows: int = 5) -> DataFrame:
    """Each row under all time, its year and its month, with ``grain`` and ``period``; years and months need enough rows."""
    timed = with_time(df, cols).withColumn("__year", F.col("year").cast("string"))
    grains = F.array(*[F.struct(F.lit(g).alias("grain"), p.alias("period")) for g, p in (("global", F.lit("")), ("year", F.col("__year")), ("month", F.col("month")))])
    every = timed.select(*df.columns, F.explode(grains).alias("__g")).select(*df.columns, "__g.grain", "__g.period").filter("period is not null")
    sizes = every.groupBy("grain", "period").agg(F.count("*").alias("__size"))
    enough = sizes.filter(F.when(F.col("grain") == "year", F.col("__size") >= year_rows).when(F.col("grain") == "month", F.col("__size") >= month_rows).otherwise(True))
    return every.join(enough, ["grain", "period"], "left_semi")


def deputy_records(df: DataFrame, rebels: DataFrame, labels: dict[int, str] | None = None, cols: Columns = COLS, least: int = 1, year_rows: int = 10, month_rows: int = 5) -> DataFrame:
    """The full record of each speaker in each period.

    Key, plain name, party, usual role (empty if there is no role), source, speech count, dominant topic and
    its label, ``rebel_pct`` (0 without one), and, where the rows have them, the mean ``x``, ``y`` and topic scores.
    """
    keys = ("grain", "period")
    rows = in_periods(df, cols, year_rows, month_rows)
    out = speaker_aggregates(rows, cols, least, keys)
    if "topic_scores" in df.columns:
        k = [cols.speaker, *keys]
        parts = rows.select(*k, F.posexplode("topic_scores").alias("pos", "v")).groupBy(*k, "pos").agg(F.round(F.avg("v"), 3).alias("v"))
        means = parts.groupBy(*k).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias("topic_scores"))  # as many as topics
        out = out.join(means, k, "left")
    if "role" not in out.columns:
        out = out.withColumn("role", F.lit(""))
    out = with_label(out, labels or {}, "cluster").withColumnRenamed("label", "cluster_label")
    joined = out.join(rebels.select(cols.speaker, "rebel_pct"), cols.speaker, "left")
    more = [c for c in ("x", "y", "topic_scores") if c in joined.columns]
    return joined.select(*keys, cols.speaker, T.clean_name(F.col(cols.speaker)).alias("name"), cols.party, F.coalesce("role", F.lit("")).alias("role"), cols.source, "n_speeches", "cluster", "cluster_label", F.coalesce("rebel_pct", F.lit(0.0)).alias("rebel_pct"), *more)
