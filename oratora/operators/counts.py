"""Counts by topic: generalism, rebels, composition, overlap, aggregates per speaker."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..schemas import Columns
from .prepare import COLS, with_time

TINY = 1e-10


def top_by(df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group; the order must end in a key, so that ties are settled."""
    w = Window.partitionBy(*keys).orderBy(*order) if keys else Window.orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def first_limit(df: DataFrame, order: list[Column], k: int) -> DataFrame:
    """The first ``k`` rows of all; a top-k, not a sort of everything."""
    return df.orderBy(*order).limit(k)


def dominant(df: DataFrame, key: str, topic: str, name: str = "dominant") -> DataFrame:
    """Most frequent topic of each key; of equals the smallest."""
    counts = df.groupBy(key, topic).agg(F.count("*").alias("n"))
    return counts.groupBy(key).agg(F.min(F.struct((-F.col("n")).alias("m"), F.col(topic).alias("t"))).alias("b")).select(key, F.col("b.t").alias(name), (-F.col("b.m")).alias("n_dominant"))


def first_party(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """A speaker's party: the one of the first row."""
    return df.groupBy(cols.speaker).agg(F.min_by(cols.party, cols.id).alias(cols.party))


def generalism(df: DataFrame, by: str, cols: Columns = COLS, least: int = 2, skip_unknown: bool = False) -> DataFrame:
    """Topic entropy of each speaker or party, as a share of the most that the corpus' topics allow."""
    rows = df.filter(T.known_party(F.col(by))) if skip_unknown else df
    counts = rows.groupBy(by, cols.topic).agg(F.count("*").alias("c"))
    n_topics = df.agg(F.countDistinct(cols.topic).alias("k"))
    total = counts.groupBy(by).agg(F.sum("c").alias("n_speeches"), F.count("*").alias("n_topics"), F.min(F.struct((-F.col("c")).alias("m"), F.col(cols.topic).alias("t"))).alias("b"))
    share = counts.join(total, by).withColumn("p", F.col("c") / F.col("n_speeches"))
    entropy = share.groupBy(by, "n_speeches", "n_topics", F.col("b.t").alias("dominant_cluster")).agg((-F.sum(F.col("p") * F.log2(F.col("p") + TINY))).alias("h"))
    most = F.when(F.col("k") > 1, F.log2(F.col("k").cast("double"))).otherwise(F.lit(1.0))
    score = 100 * F.col("h") / most
    return (
        entropy.crossJoin(F.broadcast(n_topics))  # one row
        .filter(F.col("n_speeches") >= least)
        .select(by, F.round(score, 1).alias("score"), "dominant_cluster", "n_topics", "n_speeches", T.ladder(score, [(70, "generalista")], "bilanciato").alias("_g"), score.alias("_s"))
        .select(by, "score", F.when(F.col("_s") > 70, "generalista").when(F.col("_s") < 30, "specialista").otherwise("bilanciato").alias("label"), "dominant_cluster", "n_topics", "n_speeches")
    )


def rebel_scores(df: DataFrame, cols: Columns = COLS, least: int = 3) -> DataFrame:
    """Share of a speaker's speeches outside the main topic of the party."""
    known = df.filter(F.col(cols.party) != L.UNKNOWN_PARTY)
    main = dominant(known, cols.party, cols.topic, "main_cluster").select(cols.party, "main_cluster")
    per = df.groupBy(cols.speaker, cols.topic).agg(F.count("*").alias("c"))
    party = first_party(df, cols)
    joined = per.join(party, cols.speaker).join(main, cols.party)
    out = joined.groupBy(cols.speaker, cols.party, "main_cluster").agg(F.sum("c").alias("total"), F.sum(F.when(F.col(cols.topic) == F.col("main_cluster"), F.col("c")).otherwise(0)).alias("in_main"))
    return out.filter(F.col("total") >= least).select(cols.speaker, cols.party, "main_cluster", "total", F.round((F.col("total") - F.col("in_main")) / F.col("total") * 100, 1).alias("rebel_pct"))


def rebel_distributions(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Per speaker the counts by topic, per party the percentages, as maps."""
    speaker = df.groupBy(F.lit("speaker").alias("kind"), F.col(cols.speaker).alias("key"), F.col(cols.topic).alias("t")).agg(F.count("*").cast("double").alias("v"))
    parties = df.filter(F.col(cols.party) != L.UNKNOWN_PARTY).groupBy(F.lit("party").alias("kind"), F.col(cols.party).alias("key"), F.col(cols.topic).alias("t")).agg(F.count("*").alias("c"))
    totals = parties.groupBy("key").agg(F.sum("c").alias("n"))
    shares = parties.join(totals, "key").select("kind", "key", "t", F.round(F.col("c") / F.col("n") * 100, 1).alias("v"))
    return speaker.unionByName(shares).groupBy("kind", "key").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("t", "v")))).alias("distribution"))


def top_rebels(df: DataFrame, cols: Columns = COLS, over: float = 30, k: int = 15) -> DataFrame:
    """Per source the speakers most often off their party's topic."""
    source = df.groupBy(cols.speaker).agg(F.max_by(cols.source, cols.id).alias(cols.source))
    return top_by(rebel_scores(df, cols).filter(F.col("rebel_pct") > over).join(source, cols.speaker), [cols.source], [F.desc("rebel_pct"), F.asc(cols.speaker)], k)


def composition(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Parties of each topic and how mixed they are: entropy over the most possible."""
    counts = df.filter(F.col(cols.party) != L.UNKNOWN_PARTY).groupBy(cols.topic, cols.party).agg(F.count("*").alias("c"))
    total = counts.groupBy(cols.topic).agg(F.sum("c").alias("n_speeches"), F.count("*").alias("n_parties"))
    p = F.col("c") / F.col("n_speeches")
    h = counts.join(total, cols.topic).groupBy(cols.topic, "n_speeches", "n_parties").agg((-F.sum(p * F.log(p + TINY))).alias("h"))
    return h.select(cols.topic, "n_speeches", "n_parties", F.when(F.col("n_parties") > 1, F.round(F.col("h") / F.log(F.col("n_parties").cast("double")), 4)).otherwise(0.0).alias("mixing"))


def transversal(df: DataFrame, cols: Columns = COLS, parties: int = 3, mixing: float = 0.5) -> DataFrame:
    return composition(df, cols).filter((F.col("n_parties") >= parties) & (F.col("mixing") >= mixing))


def overlap(df: DataFrame, cols: Columns = COLS, side: Column | None = None) -> DataFrame:
    """Left and right shares of each topic, and what they have in common."""
    side = T.coalition(F.col(cols.party)) if side is None else side
    n = df.withColumn("side", side).groupBy(cols.topic).agg(F.count("*").alias("n_speeches"), *[F.sum(F.when(F.col("side") == s, 1).otherwise(0)).alias(s) for s in ("left", "right", "center")])
    pct = {s: 100 * F.col(s) / F.col("n_speeches") for s in ("left", "right", "center")}
    both = 2 * F.least(pct["left"], pct["right"])
    kind = F.when(both > 40, "bipartisan").when(pct["left"] > 60, "left-dominated").when(pct["right"] > 60, "right-dominated").otherwise("mixed")
    return n.select(cols.topic, "n_speeches", *[F.round(v, 1).alias(f"{s}_pct") for s, v in pct.items()], F.round(both, 1).alias("overlap"), kind.alias("type"))


def speaker_aggregates(df: DataFrame, cols: Columns = COLS, least: int = 1, keys: tuple[str, ...] = ()) -> DataFrame:
    """Per speaker (and further keys): party and source of the first row, count, dominant topic, usual role."""
    k = [cols.speaker, *keys]
    base = df.groupBy(*k).agg(F.min_by(cols.party, cols.id).alias(cols.party), F.min_by(cols.source, cols.id).alias(cols.source), F.count("*").alias("n_speeches"))
    topics = df.groupBy(*k, cols.topic).agg(F.count("*").alias("c")).groupBy(*k).agg(F.min(F.struct((-F.col("c")).alias("m"), F.col(cols.topic).alias("t"))).alias("b")).select(*k, F.col("b.t").alias("cluster"))
    out = base.join(topics, k)
    if cols.role in df.columns:
        roles = df.filter(F.coalesce(cols.role, F.lit("")) != "").groupBy(*k, cols.role).agg(F.count("*").alias("c")).groupBy(*k).agg(F.min(F.struct((-F.col("c")).alias("m"), F.col(cols.role).alias("r"))).alias("b")).select(*k, F.col("b.r").alias("role"))
        out = out.join(roles, k, "left")
    for c in ("x", "y"):
        if c in df.columns:
            out = out.join(df.groupBy(*k).agg(F.avg(c).alias(c)), k)
    return out.filter(F.col("n_speeches") >= least)


def mean_topic_scores(df: DataFrame, cols: Columns = COLS, scores: str = "topic_scores") -> DataFrame:
    """Mean score vector of each speaker, rounded to three places."""
    parts = df.select(cols.speaker, F.posexplode(scores).alias("pos", "v")).groupBy(cols.speaker, "pos").agg(F.round(F.avg("v"), 3).alias("v"))
    return parts.groupBy(cols.speaker).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "v"))), lambda s: s["v"]).alias(scores))


def aggregates_by_period(df: DataFrame, cols: Columns = COLS, year_rows: int = 10, month_rows: int = 5) -> DataFrame:
    """Speech counts and dominant topics per speaker for all time, each year and each month with enough rows.

    One pass with grouping sets instead of one per period.
    """
    timed = with_time(df, cols).withColumn("year", F.col("year").cast("string"))
    sets = timed.select(cols.speaker, cols.topic, F.explode(F.array(F.struct(F.lit("global").alias("grain"), F.lit("").alias("period")), F.struct(F.lit("year").alias("grain"), F.col("year").alias("period")), F.struct(F.lit("month").alias("grain"), F.col("month").alias("period")))).alias("g")).select(cols.speaker, cols.topic, "g.*").filter("period is not null")
    counts = sets.groupBy("grain", "period", cols.speaker, cols.topic).agg(F.count("*").alias("c"))
    sizes = counts.groupBy("grain", "period").agg(F.sum("c").alias("size"))
    enough = sizes.filter(F.when(F.col("grain") == "year", F.col("size") >= year_rows).when(F.col("grain") == "month", F.col("size") >= month_rows).otherwise(True))
    per = counts.groupBy("grain", "period", cols.speaker).agg(F.sum("c").alias("n_speeches"), F.min(F.struct((-F.col("c")).alias("m"), F.col(cols.topic).alias("t"))).alias("b"))
    return per.join(enough, ["grain", "period"], "left_semi").select("grain", "period", cols.speaker, "n_speeches", F.col("b.t").alias("dominant_cluster"))


def topic_meta(df: DataFrame, labels: dict[int, str] | None = None, cols: Columns = COLS) -> DataFrame:
    """Rows per source and topic, and over all sources, with labels."""
    counts = df.cube(cols.source, cols.topic).agg(F.count("*").alias("n"), F.grouping(cols.topic).alias("g")).filter("g = 0").select(F.coalesce(cols.source, F.lit("all")).alias(cols.source), cols.topic, "n")
    table = F.create_map(*[F.lit(x) for p in (labels or {-1: ""}).items() for x in p])
    return counts.select(cols.source, cols.topic, F.coalesce(F.try_element_at(table, F.col(cols.topic)), F.concat(F.lit("Cluster "), F.col(cols.topic).cast("string"))).alias("label"), "n")


def source_stats(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    return df.groupBy(cols.source).agg(
        F.count("*").alias("n_speeches"), F.countDistinct(cols.speaker).alias("n_deputies"), F.countDistinct(F.when(F.col(cols.party) != L.UNKNOWN_PARTY, F.col(cols.party))).alias("n_parties"), F.countDistinct(cols.topic).alias("n_clusters")
    )


def distinct_counts(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    return df.agg(*[F.countDistinct(c).alias(f"n_{c}") for c in (cols.speaker, cols.party, cols.topic, cols.source)])
