"""Who names whom: mention edges and degrees."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..schemas import Columns
from .counts import top_by
from .prepare import COLS


def surnames(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """``(speaker, surname)``: the first word of the name if it has three or more letters, all capitals."""
    first = F.split(T.clean_name(F.col(cols.speaker)), r"\s+")[0]
    return df.select(cols.speaker, first.alias("s")).distinct().filter((F.length("s") >= 3) & (F.col("s") == F.upper("s")) & F.col("s").rlike(r"\p{L}")).select(cols.speaker, F.lower("s").alias("surname"))


def mention_edges(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """``(src, dst, weight)``: how often speeches of one speaker name another.

    An equi-join of the texts' words with the surnames, counted by speaker and
    word first.  Speakers who share a surname all get the mention.  A surname with
    an apostrophe or hyphen is found as the run of its parts: where its first part
    stands, the words from there on are counted too, and compared whole.
    """
    plain = surnames(df, cols).select(F.trim(F.regexp_replace("surname", r"[^\p{L}\p{N}_]+", " ")).alias("name"), F.col(cols.speaker).alias("dst")).withColumn("parts", F.split("name", " "))
    several = plain.filter(F.size("parts") > 1).agg(F.collect_set(F.col("parts")[0]).alias("firsts"), F.max(F.size("parts")).alias("longest"))  # one row, empty if all are single words
    words = df.select(F.col(cols.speaker).alias("src"), F.split(F.lower(F.coalesce(F.col(cols.text), F.lit(""))), r"[^\p{L}\p{N}_]+").alias("words"))
    # the words are a column of their own below the join and lambdas take them one by one: else each word costs as much as the text
    texts = words.crossJoin(F.broadcast(several))
    run = lambda i: F.array_join(F.transform(F.sequence(i, F.least(i + F.col("longest"), F.size("words")) - 1), lambda j: F.get("words", j)), " ")
    runs = lambda here: F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(here, w), run(i))), lambda r: F.contains(r, F.lit(" ")))
    found = F.flatten(F.transform(F.array(F.array_intersect("firsts", "words")), runs))  # an array of one, so that what is here is found once a text
    keys = texts.select("src", F.when(F.size("firsts") > 0, F.concat("words", found)).otherwise(F.col("words")).alias("keys"))
    said = keys.select("src", F.explode("keys").alias("key")).filter("key != ''").groupBy("src", "key").agg(F.count("*").alias("c"))
    named = F.when(F.size("parts") == 1, F.col("key") == F.col("name")).otherwise(F.startswith(F.concat("key", F.lit(" ")), F.concat("name", F.lit(" "))))
    hit = said.join(plain, (F.substring_index("key", " ", 1) == F.col("parts")[0]) & named)
    return hit.filter(F.col("src") != F.col("dst")).groupBy("src", "dst").agg(F.sum("c").alias("weight"))


def mention_network(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Totals and degrees of every speaker, zeros included; each edge is dealt to both its ends, so the texts are read once."""
    no = F.lit(0).cast("long")
    end = lambda who, made, received: F.struct(F.col(who).alias(cols.speaker), made.alias("made"), received.alias("received"))
    ends = mention_edges(df, cols).select(F.inline(F.array(end("src", F.col("weight"), no), end("dst", no, F.col("weight")))))
    sums = {"mentions_made": F.sum("made"), "out_degree": F.count_if(F.col("made") > 0), "mentions_received": F.sum("received"), "in_degree": F.count_if(F.col("received") > 0)}
    totals = ends.groupBy(cols.speaker).agg(*[v.alias(k) for k, v in sums.items()])
    return df.select(cols.speaker).distinct().join(totals, cols.speaker, "left").select(cols.speaker, *[F.coalesce(k, F.lit(0)).alias(k) for k in sums])


def top_mentions(df: DataFrame, cols: Columns = COLS, k: int = 5) -> DataFrame:
    """Whom each speaker names most, and who names the speaker most; each edge is dealt to both its ends, so the texts are read once."""
    end = lambda who, other, direction: F.struct(F.col(who).alias(cols.speaker), F.col(other).alias("other"), F.col("weight"), F.lit(direction).alias("direction"))
    ends = mention_edges(df, cols).select(F.inline(F.array(end("src", "dst", "mentions"), end("dst", "src", "mentioned_by"))))
    top = top_by(ends, ["direction", cols.speaker], [F.desc("weight"), F.asc("other")], k)
    return top.select(cols.speaker, "other", "weight", "rank", "direction")
