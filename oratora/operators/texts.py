"""Text metrics over speech features: sentiment, readability, polarization, rhetoric, crisis, verbosity, vocabulary, keywords."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import lexicons as L
from ..functions import text as T
from ..schemas import Columns
from .counts import top_by
from .prepare import COLS

RHETORIC = ("populist", "anti_establishment", "emotional", "institutional")


def _known(df: DataFrame, cols: Columns) -> DataFrame:
    return df.filter(F.col(cols.party) != L.UNKNOWN_PARTY)


def mean_of_tenths(c: str) -> Column:
    """Mean of scores with one decimal, summed as whole tenths so that no order of rows changes it."""
    return F.sum(F.round(F.col(c) * 10).cast("long")) / (10 * F.count("*"))


# --- sentiment ------------------------------------------------------------------------------------------------


def sentiment_label(score: Column) -> Column:
    return F.when(score > 0.1, "positivo").when(score < -0.1, "negativo").otherwise("neutro")


def speech_sentiment(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    return f.select(cols.id, "n_pos", "n_neg", F.round("sentiment", 6).alias("sentiment"))


def sentiment_by(f: DataFrame, keys: list[str], cols: Columns = COLS) -> DataFrame:
    """Mean sentiment by speaker or party and topic; unknown parties are left out of party rows."""
    rows = _known(f, cols) if cols.party in keys else f
    return rows.groupBy(*keys).agg(F.avg("sentiment").alias("m"), F.count("*").alias("n")).select(*keys, F.round("m", 3).alias("score"), sentiment_label(F.col("m")).alias("label"), "n")


def sentiment_by_topic(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    pos, neg = F.col("sentiment") > 0.1, F.col("sentiment") < -0.1
    pct = lambda c: F.round(100 * F.sum(F.when(c, 1).otherwise(0)) / F.count("*"), 1)
    return f.groupBy(cols.topic).agg(F.round(F.avg("sentiment"), 3).alias("score"), pct(pos).alias("positive_pct"), pct(neg).alias("negative_pct"), pct(~pos & ~neg).alias("neutral_pct"), F.count("*").alias("n"))


def party_topic_matrix(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Every known party with every topic; 0 where they never meet."""
    cells = sentiment_by(f, [cols.party, cols.topic], cols).select(cols.party, cols.topic, "score")
    parties, topics = _known(f, cols).select(cols.party).distinct(), f.select(cols.topic).distinct()
    grid = parties.withColumn("one", F.lit(1)).join(topics.withColumn("one", F.lit(1)), "one").drop("one")  # parties by topics: both small dimensions
    return grid.join(cells, [cols.party, cols.topic], "left").select(cols.party, cols.topic, F.coalesce("score", F.lit(0.0)).alias("score"))


def sentiment_rankings(f: DataFrame, cols: Columns = COLS, k: int = 10) -> DataFrame:
    """Per topic the speakers of highest and lowest mean sentiment; the party is that of the last row."""
    means = f.groupBy(cols.topic, cols.speaker).agg(F.round(F.avg("sentiment"), 3).alias("score"), F.max_by(cols.party, cols.id).alias(cols.party), F.count("*").alias("n"))
    top = top_by(means, [cols.topic], [F.desc("score"), F.asc(cols.speaker)], k).withColumn("side", F.lit("top"))
    low = top_by(means, [cols.topic], [F.asc("score"), F.asc(cols.speaker)], k).withColumn("side", F.lit("bottom"))
    return top.unionByName(low)


# --- readability and polarization -----------------------------------------------------------------------------


def readability_speech(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    return f.select(cols.id, "gulpease", "readability", "n_sentences", F.col("g_words").alias("n_words"), F.col("g_letters").alias("n_letters"))


def readability_by(f: DataFrame, key: str, cols: Columns = COLS) -> DataFrame:
    """Mean of the rounded scores and its class."""
    rows = _known(f, cols) if key == cols.party else f
    m = rows.groupBy(key).agg(mean_of_tenths("gulpease").alias("m"), F.count("*").alias("n"))
    return m.select(key, F.round("m", 1).alias("score"), T.ladder(F.col("m"), [(55, "difficile"), (80, "medio")], "facile", above=False).alias("label"), "n")


def readability_distribution(f: DataFrame) -> DataFrame:
    return f.groupBy("readability").agg(F.count("*").alias("n"))


def polarization_speech(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    return f.select(cols.id, "n_pronouns", "n_adversatives", "n_patterns", "polarization", F.col("polarization_level").alias("level"))


def polarization_by(f: DataFrame, key: str, cols: Columns = COLS, least: int = 3) -> DataFrame:
    rows = _known(f, cols) if key == cols.party else f
    m = rows.groupBy(key).agg(mean_of_tenths("polarization").alias("m"), F.count("*").alias("n"))
    m = m.filter(F.col("n") >= least) if key == cols.speaker else m
    return m.select(key, F.round("m", 1).alias("score"), T.ladder(F.col("m"), [(20, "bassa"), (50, "media")], "alta", above=False).alias("level"), "n")


def top_polarizers(f: DataFrame, cols: Columns = COLS, k: int = 10) -> DataFrame:
    """The most and the least polarizing speakers."""
    m = polarization_by(f, cols.speaker, cols).withColumn("all", F.lit(1))
    top = top_by(m, ["all"], [F.desc("score"), F.asc(cols.speaker)], k).withColumn("side", F.lit("top"))
    low = top_by(m, ["all"], [F.asc("score"), F.asc(cols.speaker)], k).withColumn("side", F.lit("least"))
    return top.unionByName(low).drop("all")


# --- rhetoric -------------------------------------------------------------------------------------------------


def rhetoric_speech(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    return f.select(cols.id, *[F.round(k, 6).alias(k) for k in RHETORIC], "style")


def rhetoric_style_counts(f: DataFrame) -> DataFrame:
    return f.groupBy("style").agg(F.count("*").alias("n"))


def rhetoric_by(f: DataFrame, key: str, cols: Columns = COLS, least: int = 3, features: tuple[str, ...] = RHETORIC) -> DataFrame:
    rows = _known(f, cols) if key == cols.party else f
    m = rows.groupBy(key).agg(F.count("*").alias("n"), *[F.round(F.avg(k), 2).alias(k) for k in features])
    return m.filter(F.col("n") >= least) if key == cols.speaker else m


def rhetoric_rankings(f: DataFrame, cols: Columns = COLS, k: int = 10) -> DataFrame:
    """Per kind of rhetoric the ten speakers with the highest rounded mean."""
    m = rhetoric_by(f, cols.speaker, cols)
    long = m.select(cols.speaker, F.explode(F.array(*[F.struct(F.lit(x).alias("kind"), F.col(x).alias("score")) for x in RHETORIC])).alias("e")).select(cols.speaker, "e.*")
    return top_by(long, ["kind"], [F.desc("score"), F.asc(cols.speaker)], k)


# --- crisis ---------------------------------------------------------------------------------------------------


def crisis_by_period(f: DataFrame, cols: Columns = COLS, granularity: str = "month") -> DataFrame:
    rows = f.withColumn("period", dates.period_key(dates.as_date(f, cols.date), granularity)).filter("period is not null")
    return rows.groupBy("period").agg(F.sum("n_crisis").alias("crisis_words"), F.sum("n_words").alias("n_words")).select("period", "crisis_words", "n_words", F.coalesce(F.round(1000 * F.col("crisis_words") / F.nullif(F.col("n_words"), F.lit(0)), 2), F.lit(0.0)).alias("rate"))


def crisis_by_topic(f: DataFrame, cols: Columns = COLS, granularity: str = "month") -> DataFrame:
    """Here the rate is per speech."""
    rows = f.withColumn("period", dates.period_key(dates.as_date(f, cols.date), granularity)).filter("period is not null")
    return rows.groupBy(cols.topic, "period").agg(F.sum("n_crisis").alias("crisis_words"), F.count("*").alias("n_speeches")).withColumn("rate", F.round(F.col("crisis_words") / F.col("n_speeches"), 2))


# --- verbosity, language --------------------------------------------------------------------------------------


def text_metrics(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    return f.select(cols.id, "n_words", "n_sentences", F.round(F.col("n_words") / F.col("n_sentences"), 4).alias("words_per_sentence"), "n_questions", "n_self", "n_negation", "n_future", "n_past", "n_numeric")


def verbosity(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    return f.groupBy(cols.speaker).agg(
        F.count("*").alias("n_speeches"),
        F.sum("n_words").alias("total_words"),
        F.round(F.avg("n_words"), 1).alias("avg_words"),
        F.round(F.avg("n_sentences"), 1).alias("avg_sentences"),
        F.round(F.avg(F.col("n_words") / F.col("n_sentences")), 1).alias("avg_words_per_sentence"),
    )


def linguistic(f: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Rates per 1000 words and where in time a speaker looks."""
    kinds = {"question_rate": "n_questions", "self_reference_rate": "n_self", "negation_rate": "n_negation", "future_rate": "n_future", "past_rate": "n_past", "data_rate": "n_numeric"}
    s = f.groupBy(cols.speaker).agg(F.sum("n_words").alias("w"), *[F.sum(c).alias(c) for c in kinds.values()])
    rate = lambda c: F.coalesce(F.round(1000 * F.col(c) / F.nullif(F.col("w"), F.lit(0)), 2), F.lit(0.0))
    lean = F.coalesce((F.col("n_future") - F.col("n_past")) / F.nullif(F.col("n_future") + F.col("n_past"), F.lit(0)), F.lit(0.0))
    label = F.when(F.col("w") == 0, "n/a").when(lean > 0.2, "futuro").when(lean < -0.2, "passato").otherwise("neutro")
    return s.select(cols.speaker, *[rate(c).alias(k) for k, c in kinds.items()], F.round(lean, 3).alias("temporal_orientation"), label.alias("orientation"))


# --- vocabulary and keywords ----------------------------------------------------------------------------------


def vocabulary(df: DataFrame, cols: Columns = COLS, least_speeches: int = 2, least_tokens: int = 50, tokens: Column | None = None) -> DataFrame:
    """Type-token and hapax ratios per speaker."""
    tokens = T.tokens_ws(F.col(cols.text)) if tokens is None else tokens
    counts = df.select(cols.speaker, F.explode(tokens).alias("t")).groupBy(cols.speaker, "t").agg(F.count("*").alias("c"))
    speeches = df.groupBy(cols.speaker).agg(F.count("*").alias("n_speeches")).filter(F.col("n_speeches") >= least_speeches)
    v = counts.groupBy(cols.speaker).agg(F.sum("c").alias("total_words"), F.count("*").alias("vocabulary_size"), F.sum(F.when(F.col("c") == 1, 1).otherwise(0)).alias("hapax")).filter(F.col("total_words") >= least_tokens)
    ttr = F.col("vocabulary_size") / F.col("total_words")
    return v.join(speeches, cols.speaker).select(cols.speaker, "n_speeches", "total_words", "vocabulary_size", F.round(ttr, 4).alias("ttr"), F.round(F.col("hapax") / F.col("vocabulary_size"), 4).alias("hapax_ratio"), T.ladder(ttr, [(0.3, "ricco"), (0.2, "medio")], "ripetitivo").alias("label"))


def tfidf(df: DataFrame, key: str, k: int, cols: Columns = COLS, stopwords=(), blacklist=(), least_keys: int = 1) -> DataFrame:
    """Top words of each group by tf-idf, each group being one document."""
    words = df.select(key, F.explode(T.tokens_keyword(F.col(cols.text), stopwords, blacklist)).alias("word"))
    counts = words.groupBy(key, "word").agg(F.count("*").alias("c"))
    sizes = counts.groupBy(key).agg(F.sum("c").alias("n"))
    df_of = counts.groupBy("word").agg(F.count("*").alias("d"))
    groups = sizes.agg(F.count("*").alias("groups"))
    score = F.col("c") / F.col("n") * (F.log(F.col("groups") / (F.col("d") + 1)) + 1)
    scored = counts.join(sizes, key).join(df_of, "word").crossJoin(F.broadcast(groups)).filter(F.col("groups") >= least_keys).select(key, "word", "c", F.round(score, 6).alias("tfidf"))  # one row of groups
    return top_by(scored, [key], [F.desc("tfidf"), F.asc("word")], k)


def party_keywords(df: DataFrame, cols: Columns = COLS, k: int = 50, stopwords=(), blacklist=L.KEYWORD_BLACKLIST) -> DataFrame:
    return tfidf(_known(df, cols), cols.party, k, cols, stopwords, blacklist, least_keys=2)


def topic_sample(df: DataFrame, cols: Columns = COLS, most: int = 500) -> DataFrame:
    """At most so many speeches a topic, drawn by hash."""
    return top_by(df, [cols.topic], [F.xxhash64(cols.id), F.asc(cols.id)], most).drop("rank")


def topic_keywords(df: DataFrame, cols: Columns = COLS, k: int = 5, most: int = 500, stopwords=()) -> DataFrame:
    return tfidf(topic_sample(df, cols, most), cols.topic, k, cols, stopwords)


def topic_labels(keywords: DataFrame, cols: Columns = COLS, k: int = 3) -> DataFrame:
    """Topic names from their first keywords."""
    first = F.transform(F.slice(F.array_sort(F.collect_list(F.struct("rank", "word"))), 1, k), lambda s: F.initcap(s["word"]))
    return keywords.groupBy(cols.topic).agg(F.array_join(first, " / ").alias("l")).select(cols.topic, F.when(F.col("l") == "", "Unknown").otherwise(F.col("l")).alias("label"))
