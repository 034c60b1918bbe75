"""Metrics over speech embeddings: cohesion, affinity, pairs, conformity, fingerprints, consistency, drift, topics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import lexicons as L
from ..functions import text as T
from ..functions.vectors import cosine, cosine_eps, distance, mean_vectors
from ..schemas import Columns
from .counts import first_limit, first_party, top_by
from .prepare import COLS, with_time


def _known(df: DataFrame, cols: Columns) -> DataFrame:
    return df.filter(F.col(cols.party) != L.UNKNOWN_PARTY)


def small_join(left: DataFrame, right: DataFrame, condition: Column | None = None) -> DataFrame:
    """Every row of ``left`` with the few rows of a dimension (topics or parties), sent to all tasks."""
    one = left.withColumn("__one", F.lit(1)).join(F.broadcast(right.withColumn("__two", F.lit(1))), F.col("__one") == F.col("__two")).drop("__one", "__two")
    return one if condition is None else one.filter(condition)


def party_centroids(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    return mean_vectors(_known(df, cols), [cols.party], cols.embedding, "centroid")


def topic_centroids(df: DataFrame, cols: Columns = COLS, n_topics: int | None = None, size: int | None = None) -> DataFrame:
    """Mean vector by topic; with ``n_topics`` and ``size`` empty topics get a zero vector."""
    found = mean_vectors(df, [cols.topic], cols.embedding, "centroid")
    if n_topics is None:
        return found
    ids = df.sparkSession.range(n_topics).select(F.col("id").cast("int").alias(cols.topic))
    return ids.join(found, cols.topic, "left").select(cols.topic, F.coalesce("centroid", F.array_repeat(F.lit(0.0), size or 0)).alias("centroid"), F.coalesce("n", F.lit(0)).alias("n"))


def cohesion(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """How close a party's speeches lie to its centroid."""
    rows = _known(df, cols).join(F.broadcast(party_centroids(df, cols).drop("n")), cols.party)  # parties are few
    d = rows.select(cols.party, distance(F.col(cols.embedding).cast("array<double>"), F.col("centroid")).alias("d"))
    s = d.groupBy(cols.party).agg(F.avg("d").alias("m"), F.stddev_pop("d").alias("sd"), F.count("*").alias("n"))
    c = 1 / (1 + F.col("m"))
    return s.select(cols.party, F.round("m", 4).alias("mean_distance"), F.round("sd", 4).alias("std_distance"), F.round(c, 4).alias("cohesion"), F.when(c > 0.7, "compatto").when(c < 0.4, "frammentato").otherwise("moderato").alias("label"), "n")


def affinity(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Cosine of each pair of party centroids, each pair once."""
    a = party_centroids(df, cols).select(F.col(cols.party).alias("party1"), F.col("centroid").alias("c1"))
    b = a.select(F.col("party1").alias("party2"), F.col("c1").alias("c2"))
    return small_join(a, b, F.col("party1") < F.col("party2")).select("party1", "party2", F.round(cosine(F.col("c1"), F.col("c2")), 4).alias("affinity"))


def affinity_matrix(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """The whole symmetric matrix in long form, ones on the diagonal."""
    pairs = affinity(df, cols)
    back = pairs.select(F.col("party2").alias("party1"), F.col("party1").alias("party2"), "affinity")
    own = _known(df, cols).select(F.col(cols.party).alias("party1"), F.col(cols.party).alias("party2"), F.lit(1.0).alias("affinity")).distinct()
    return pairs.unionByName(back).unionByName(own)


def speaker_vectors(df: DataFrame, cols: Columns = COLS, least: int = 3, known: bool = True) -> DataFrame:
    rows = mean_vectors(df, [cols.speaker], cols.embedding, "v").filter(F.col("n") >= least)
    joined = rows.join(first_party(df, cols), cols.speaker)
    return _known(joined, cols) if known else joined


def cross_party_pairs(df: DataFrame, cols: Columns = COLS, k: int = 20, least: int = 3) -> DataFrame:
    """Most similar speakers of different parties.

    Speakers are compared party by party: one speaker against a party's array
    of speakers, so the rows between stay at speakers times parties.
    """
    v = speaker_vectors(df, cols, least).select(F.col(cols.speaker).alias("speaker1"), F.col(cols.party).alias("party1"), F.col("v").alias("v1"))
    w = v.select(F.col("speaker1").alias("speaker2"), F.col("party1").alias("party2"), F.col("v1").alias("v2"))
    parties = v.select(F.col("party1").alias("party2")).distinct()
    tagged = small_join(v, parties, F.col("party1") != F.col("party2"))
    pairs = tagged.join(w, "party2").filter(F.col("speaker1") < F.col("speaker2"))
    scored = pairs.select("speaker1", "party1", "speaker2", "party2", F.round(cosine_eps(F.col("v1"), F.col("v2")), 4).alias("similarity"))
    return first_limit(scored, [F.desc("similarity"), F.asc("speaker1"), F.asc("speaker2")], k)


def unusual_pairs(df: DataFrame, cols: Columns = COLS, k: int = 10) -> DataFrame:
    return cross_party_pairs(df, cols, k)


def with_sides(pairs: DataFrame, side=T.coalition) -> DataFrame:
    """Pairs with both coalitions and whether they cross the divide."""
    s = pairs.withColumns({"side1": side(F.col("party1")), "side2": side(F.col("party2"))})
    return s.withColumn("crosses_divide", ((F.col("side1") == "left") & (F.col("side2") == "right")) | ((F.col("side1") == "right") & (F.col("side2") == "left")))


def left_right_alliances(df: DataFrame, cols: Columns = COLS, among: int = 50, k: int = 10, side=T.coalition) -> DataFrame:
    """Of the first ``among`` pairs those across the divide; the limit comes before the filter."""
    crossing = with_sides(cross_party_pairs(df, cols, among), side).filter("crosses_divide")
    return first_limit(crossing, [F.desc("similarity"), F.asc("speaker1"), F.asc("speaker2")], k).drop("crosses_divide")


def whole(c: str) -> Column:
    """A value rounded to four places, in ten-thousandths, so that sums don't depend on their order."""
    return F.round(F.col(c) * 10_000).cast("long")


def mean_of_places(c: str) -> Column:
    return F.round(F.sum(whole(c)) / F.count(c)) / 10_000


def conformity(df: DataFrame, cols: Columns = COLS, least: int = 1) -> DataFrame:
    """A speaker's distance to the own party's centroid and to the nearest other one."""
    v = speaker_vectors(df, cols, least, known=False)
    parties = party_centroids(df, cols).select(F.col(cols.party).alias("other"), "centroid")
    d = small_join(v, parties).select(cols.speaker, cols.party, F.col("n"), "other", distance(F.col("v"), F.col("centroid")).alias("d"))
    own = F.min(F.when(F.col("other") == F.col(cols.party), F.col("d")))
    away = F.min(F.when(F.col("other").eqNullSafe(F.col(cols.party)), None).otherwise(F.struct("d", "other")))
    s = d.groupBy(cols.speaker, cols.party, "n").agg(own.alias("own"), away.alias("away"))
    conf = F.coalesce(1 / (1 + F.col("own")), F.lit(0.0))
    cross = F.coalesce(1 / (1 + F.col("away.d")), F.lit(0.0))
    return s.select(cols.speaker, cols.party, F.round(conf, 4).alias("conformity"), F.round(cross, 4).alias("cross_affinity"), F.col("away.other").alias("nearest_other"), F.when(conf > 0.7, "mainstream").when(cross > conf, "bridge").otherwise("maverick").alias("faction"))


def factions(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Per party the mean conformity and the speakers of each kind; one row a speaker stays in arrays of a party's size."""
    c = _known(conformity(df, cols), cols)
    names = lambda kind: F.array_sort(F.collect_list(F.when(F.col("faction") == kind, F.col(cols.speaker)))).alias(kind)
    return c.groupBy(cols.party).agg(F.count("*").alias("n_speakers"), mean_of_places("conformity").alias("mean_conformity"), names("mainstream"), names("bridge"), names("maverick"))


def fingerprint(df: DataFrame, by: str, centroids: DataFrame | None = None, cols: Columns = COLS) -> DataFrame:
    """Cosine of each speaker's or party's mean vector with each topic centroid."""
    rows = _known(df, cols) if by == cols.party else df
    centroids = topic_centroids(df, cols) if centroids is None else centroids
    v = mean_vectors(rows, [by], cols.embedding, "v")
    return small_join(v.drop("n"), centroids.select(cols.topic, "centroid")).select(by, cols.topic, F.round(cosine(F.col("v"), F.col("centroid")), 4).alias("similarity"))


def topic_leadership(df: DataFrame, centroids: DataFrame | None = None, cols: Columns = COLS, least: int = 2) -> DataFrame:
    """Each speaker's closest topic; of equals the smallest."""
    centroids = topic_centroids(df, cols) if centroids is None else centroids
    v = mean_vectors(df, [cols.speaker], cols.embedding, "v").filter(F.col("n") >= least)
    s = small_join(v, centroids.select(cols.topic, "centroid")).select(cols.speaker, F.col("n"), cols.topic, F.round(cosine(F.col("v"), F.col("centroid")), 4).alias("s"))
    best = s.groupBy(cols.speaker, "n").agg(F.min(F.struct((-F.col("s")).alias("m"), F.col(cols.topic).alias("t"))).alias("b"))
    return best.select(cols.speaker, F.col("b.t").alias(cols.topic), (-F.col("b.m")).alias("similarity"), F.col("n").alias("n_speeches"))


def topic_leaders(df: DataFrame, centroids: DataFrame | None = None, cols: Columns = COLS, k: int = 5) -> DataFrame:
    return top_by(topic_leadership(df, centroids, cols), [cols.topic], [F.desc("similarity"), F.asc(cols.speaker)], k)


def consistency(df: DataFrame, cols: Columns = COLS, least: int = 3) -> DataFrame:
    """Variance of a speaker's speeches against the corpus' variance, both averaged over dimensions."""
    parts = df.select(cols.speaker, F.posexplode(F.col(cols.embedding).cast("array<double>")).alias("pos", "x"))
    overall = parts.groupBy("pos").agg(F.var_pop("x").alias("v")).agg(F.avg("v").alias("g"))
    own = parts.groupBy(cols.speaker, "pos").agg(F.var_pop("x").alias("v"), F.count("*").alias("n")).groupBy(cols.speaker).agg(F.avg("v").alias("v"), F.max("n").alias("n_speeches")).filter(F.col("n_speeches") >= least)
    s = F.when(F.col("g") == 0, F.lit(50.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), (1 - F.col("v") / F.nullif(F.col("g"), F.lit(0.0))) * 100 + 50)))
    return small_join(own, overall).select(cols.speaker, F.round(s, 1).alias("consistency"), F.round("v", 6).alias("variance"), "n_speeches", T.ladder(s, [(70, "very_consistent"), (50, "consistent"), (30, "variable")], "inconsistent").alias("label"))


def drift(df: DataFrame, cols: Columns = COLS, least: int = 5) -> DataFrame:
    """Steps between a party's centroids of consecutive years that have enough speeches."""
    v = mean_vectors(with_time(_known(df, cols), cols).filter("year is not null"), [cols.party, "year"], cols.embedding, "v").filter(F.col("n") >= least)
    w = Window.partitionBy(cols.party).orderBy("year")  # one row a year
    steps = v.withColumns({"from_year": F.lag("year").over(w), "pv": F.lag("v").over(w)}).filter("from_year is not null")
    return steps.select(cols.party, "from_year", F.col("year").alias("to_year"), F.round(distance(F.col("pv"), F.col("v")), 4).alias("distance"))


def drift_totals(df: DataFrame, cols: Columns = COLS, least: int = 5) -> DataFrame:
    """Sum and mean of the rounded steps."""
    return drift(df, cols, least).groupBy(cols.party).agg((F.sum(whole("distance")) / 10_000).alias("total_drift"), mean_of_places("distance").alias("avg_drift"), F.count("*").alias("n_steps"))


def assign_topics(df: DataFrame, topics: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Closest topic by cosine and the whole score vector; ``topics`` has ``topic`` (from 0) and ``vector``."""
    packed = topics.agg(F.transform(F.array_sort(F.collect_list(F.struct("topic", "vector"))), lambda s: s["vector"]).alias("__topics"))
    scores = F.transform("__topics", lambda t: cosine(F.col(cols.embedding).cast("array<double>"), t))
    out = small_join(df, packed).withColumn("topic_scores", scores)
    return out.withColumn(cols.topic, (F.array_position("topic_scores", F.array_max("topic_scores")) - 1).cast("int")).drop("__topics")
