"""Rosters: union, and names resolved against them."""

from __future__ import annotations

from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

SKIP = ("PRESIDENTE", "PRESIDENTESSA")


def union(rosters: list[DataFrame]) -> DataFrame:
    """One row per name: rows with a party come first, then the earlier roster."""
    tagged = [r.withColumn("__order", F.lit(i)) for i, r in enumerate(rosters)]
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tagged)
    w = Window.partitionBy("full_name").orderBy((F.coalesce("party", F.lit("")) == "").cast("int"), "__order")
    return every.withColumn("__n", F.row_number().over(w)).filter("__n = 1").drop("__n", "__order")


def resolve(names: DataFrame, roster: DataFrame, key: str, make_key: bool = False) -> DataFrame:
    """``names`` (with ``name`` and ``party``) and what the roster has: ``matched``, ``roster_party``, ``profile_url``.

    Tried in order: the exact name, without case, the surname alone or given
    name and surname swapped.  Of several that fit, one whose party contains
    the given one comes first, then the smallest name.  Distinct names are resolved once.
    """
    who = names.select("name", F.coalesce("party", F.lit("")).alias("given")).distinct().filter(~F.upper("name").isin(*SKIP))
    plain = T.normalise_name(F.col("name"))
    parts = F.split(F.lower(plain), " ")
    # up to four look-up keys of a name, each with its rank
    keys = F.array(
        F.struct(F.lit(1).alias("rank"), F.concat(F.lit("="), plain).alias("k")),
        F.struct(F.lit(2).alias("rank"), F.concat(F.lit("~"), F.lower(plain)).alias("k")),
        F.struct(F.lit(3).alias("rank"), F.when(F.size(parts) == 1, F.concat(F.lit("1"), parts[0])).alias("k")),
        F.struct(F.lit(3).alias("rank"), F.when(F.size(parts) >= 2, F.concat(F.lit("2"), F.try_element_at(parts, F.lit(-1)), F.lit("|"), parts[0])).alias("k")),
        F.struct(F.lit(3).alias("rank"), F.when(F.size(parts) >= 2, F.concat(F.lit("2"), parts[0], F.lit("|"), F.try_element_at(parts, F.lit(-1)))).alias("k")),
    )
    asked = who.select("name", "given", F.explode(keys).alias("q")).select("name", "given", "q.rank", "q.k").filter("k is not null")
    own = F.split(F.lower("full_name"), r"\s+")
    held = roster.select("full_name", F.col("party").alias("roster_party"), "profile_url", F.explode(F.array(F.concat(F.lit("="), "full_name"), F.concat(F.lit("~"), F.lower("full_name")), F.concat(F.lit("1"), own[0]), F.when(F.size(own) >= 2, F.concat(F.lit("2"), own[0], F.lit("|"), F.get(own, F.lit(1)))))).alias("k")).filter("k is not null")
    hit = asked.join(held, "k")
    party_hit = (F.col("given") != "") & F.contains(F.lower(F.coalesce("roster_party", F.lit(""))), F.lower("given"))
    best = hit.groupBy("name", "given").agg(F.min(F.struct("rank", (~party_hit).cast("int").alias("miss"), F.col("full_name").alias("matched"), "roster_party", "profile_url")).alias("b")).select(F.col("name").alias("__name"), F.col("given").alias("__given"), "b.matched", "b.roster_party", F.col("b.profile_url").alias("profile_url"))
    return names.join(best, (F.col("name") == F.col("__name")) & (F.coalesce("party", F.lit("")) == F.col("__given")), "left").drop("__name", "__given")


def fresh(roster: DataFrame, legislature: int, today=None, days: int = 30) -> DataFrame:
    """Rows of a stored roster that are recent and of the same legislature."""
    today = F.current_timestamp() if today is None else today
    return roster.filter((F.datediff(today, F.to_timestamp("timestamp")) <= days) & (F.col("legislature") == legislature))


def save(roster: DataFrame, path: str, legislature: int, now=None) -> None:
    """Write a roster in the order of its names, with the time and legislature that ``fresh`` reads."""
    now = F.current_timestamp() if now is None else now
    stamped = roster.withColumns({"timestamp": F.date_format(now, "yyyy-MM-dd'T'HH:mm:ss"), "legislature": F.lit(legislature)})
    stamped.orderBy("full_name").write.mode("overwrite").parquet(path)


def load(spark, path: str, legislature: int, today=None, days: int = 30) -> DataFrame | None:
    """A stored roster that is still fresh, else None."""
    try:
        found = fresh(spark.read.parquet(path), legislature, today, days)
    except AnalysisException:
        return None
    return None if found.isEmpty() else found


def links(pages: DataFrame, member: str, party: str, source: str, html: str = "html") -> DataFrame:
    """Members from a roster page: a link with ``member`` in its address is the name, the next with ``party`` the group."""
    pattern = r"(?is)<a\b[^>]*href\s*=\s*[\"']([^\"']*" + member + r"[^\"']*)[\"'][^>]*>(.*?)</a>(?:(?!<a\b[^>]*" + member + r").)*?(?:<a\b[^>]*" + party + r"[^>]*>(.*?)</a>|(?=<a\b[^>]*" + member + r")|$)"
    plain = lambda c: F.trim(F.regexp_replace(F.regexp_replace(c, "<[^>]*>", " "), r"\s+", " "))
    rows = pages.select(F.explode(F.arrays_zip(*[F.regexp_extract_all(html, F.lit(pattern), i).alias(n) for i, n in ((1, "url"), (2, "name"), (3, "party"))])).alias("m"))
    return rows.select(T.normalise_name(plain(F.col("m.name"))).alias("full_name"), plain(F.col("m.party")).alias("party"), F.col("m.url").alias("profile_url"), F.lit(source).alias("source")).filter("full_name <> ''")


def chamber_roster(pages: DataFrame, html: str = "html") -> DataFrame:
    return links(pages, "schedaDeputato", "gruppo", "camera", html)


def senate_roster(pages: DataFrame, html: str = "html") -> DataFrame:
    return links(pages, r"scheda-attivita\?did=", "composizione", "senate", html)
