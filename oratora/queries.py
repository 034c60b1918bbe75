"""Registered queries over the test tables, each with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import dates
from .functions import text as T
from .functions.lexicons import LexiconSet
from .operators import counts, embeddings, network, prepare, temporal, texts, views
from .schemas import Columns
from .sources import html_sessions, roster
from .sources.views import embedded, speeches, table

COLS = Columns()
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: Frequent words of the test tables stand in for the Italian lists, which would find nothing there.
LEX = LexiconSet(
    positive=frozenset("that with pour sich para".split()),
    negative=frozenset("from this dans nicht una".split()),
    pronouns=frozenset("the les die las".split()),
    adversatives=frozenset("by sur mit con".split()),
    us_them=("of the", "de la", "in der"),
    crisis=frozenset("is est ist es".split()),
    self_reference=frozenset("to un ein se".split()),
    negation=frozenset("it pas den no".split()),
    future=frozenset("and et und y".split()),
    past=frozenset("are que von por".split()),
    rhetoric={"populist": frozenset("the le der el".split()), "anti_establishment": frozenset("a une das los".split()), "emotional": frozenset("was qui sie lo".split()), "institutional": frozenset("as par im del".split())},
)
KEYWORD_STOP = ("that", "with", "this", "from")
LABELS = {0: "Zero", 1: "One", 2: "Two"}


def side(party: Column) -> Column:
    return T.coalition(party, left={"fr", "es"}, right={"en"}, center={"de"})


# --- SQL parts ------------------------------------------------------------------------------------------------

S = """s AS (SELECT doc_id AS speech_id, text, text AS cleaned_text, lang AS "group", lang || '_' || source AS deputy, CAST(n_chars % 8 AS INTEGER) AS cluster,
 CAST(DATE '2022-10-13' + CAST(doc_id * 37 % 800 AS INTEGER) AS DATE) AS date, CASE WHEN doc_id % 2 = 0 THEN 'camera' ELSE 'senate' END AS source FROM documents)"""
E = """e AS (SELECT s.speech_id, s."group", s.deputy, s.date, s.source, label AS cluster, embedding FROM s JOIN embeddings ON vec_id = speech_id)"""
X = """x AS (SELECT speech_id, "group", deputy, cluster, date, generate_subscripts(embedding, 1) AS pos, CAST(unnest(embedding) AS DOUBLE) AS x FROM e)"""
P = "list_filter(regexp_split_to_array(regexp_replace(lower(cleaned_text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"
W = "list_filter(regexp_split_to_array(lower(cleaned_text), '\\s+'), lambda t: t <> '')"


def _in(words) -> str:
    return ", ".join(quoted(w) for w in sorted(words))


def quoted(word: str) -> str:
    return "'" + word.replace("'", "''") + "'"


def _count(tokens: str, words) -> str:
    return f"CAST(len(list_filter({tokens}, lambda t: t IN ({_in(words)}))) AS BIGINT)"


_SIDE = """CASE WHEN {c} IN ('fr', 'es') THEN 'left' WHEN {c} IN ('en') THEN 'right' WHEN {c} IN ('de') THEN 'center' ELSE 'other' END"""
T0 = f"t0 AS (SELECT *, {P} AS p, {W} AS w FROM s)"


def feature_counts(lex: LexiconSet) -> str:
    return (
    "f0 AS (SELECT *, CAST(len(p) AS BIGINT) AS n_tokens, CAST(len(w) AS BIGINT) AS n_words, "
    + ", ".join(f"{_count('p', v)} AS {k}" for k, v in {"n_pos": lex.positive, "n_neg": lex.negative, "n_pronouns": lex.pronouns, "n_adversatives": lex.adversatives, **{f"n_{k}": v for k, v in lex.rhetoric.items()}}.items())
    + ", "
    + ", ".join(f"{_count('w', v)} AS {k}" for k, v in {"n_self": lex.self_reference, "n_negation": lex.negation, "n_future": lex.future, "n_past": lex.past, "n_crisis": lex.crisis}.items())
    + ", "
    + " + ".join(f"CAST(contains(lower(cleaned_text), {quoted(x)}) AS BIGINT)" for x in lex.us_them)
    + " AS n_patterns, greatest(1, CAST(len(list_filter(regexp_split_to_array(cleaned_text, '[.!?]+'), lambda z: regexp_matches(z, '\\S'))) AS BIGINT)) AS n_sentences, "
    + "CAST(length(cleaned_text) - length(replace(cleaned_text, '?', '')) AS BIGINT) AS n_questions, "
    + "CAST(len(regexp_extract_all(cleaned_text, '(?i)\\d+%|€\\s?\\d+|\\d+\\s?euro|\\d+\\s?(?:milioni|miliardi)|\\d{4}|\\d+[\\.,]\\d+')) AS BIGINT) AS n_numeric, "
    + "CAST(len(regexp_extract_all(cleaned_text, '[\\p{L}\\p{N}_]+')) AS BIGINT) AS g_words, CAST(length(regexp_replace(cleaned_text, '[^\\p{L}]', '', 'g')) AS BIGINT) AS g_letters FROM t0)"
    )


F0 = feature_counts(LEX)
F1 = """f1 AS (SELECT *, coalesce(CAST(n_pos - n_neg AS DOUBLE) / nullif(n_pos + n_neg, 0), 0.0e0) AS sentiment,
 CASE WHEN g_words = 0 THEN 0.0e0 ELSE greatest(0.0e0, least(100.0e0, 89 + CAST(300 * n_sentences - 10 * g_letters AS DOUBLE) / nullif(g_words, 0))) END AS gulpease_raw,
 greatest(0.0e0, least(100.0e0, CAST(n_pronouns + 2 * n_adversatives + 3 * n_patterns AS DOUBLE) / greatest(n_tokens, 1) * 500)) AS polarization_raw,
 CAST(100 * n_populist AS DOUBLE) / greatest(n_tokens, 1) AS populist, CAST(100 * n_anti_establishment AS DOUBLE) / greatest(n_tokens, 1) AS anti_establishment,
 CAST(100 * n_emotional AS DOUBLE) / greatest(n_tokens, 1) AS emotional, CAST(100 * n_institutional AS DOUBLE) / greatest(n_tokens, 1) AS institutional FROM f0)"""
FF = """f AS (SELECT *, round(gulpease_raw, 1) AS gulpease, CASE WHEN g_words = 0 THEN 'n/a' WHEN gulpease_raw < 55 THEN 'difficile' WHEN gulpease_raw < 80 THEN 'medio' ELSE 'facile' END AS readability,
 round(polarization_raw, 1) AS polarization, CASE WHEN polarization_raw < 20 THEN 'bassa' WHEN polarization_raw < 50 THEN 'media' ELSE 'alta' END AS polarization_level,
 CASE WHEN greatest(populist, anti_establishment, emotional, institutional) < 0.2 THEN 'neutrale' WHEN populist = greatest(populist, anti_establishment, emotional, institutional) THEN 'populist'
  WHEN anti_establishment = greatest(populist, anti_establishment, emotional, institutional) THEN 'anti_establishment' WHEN emotional = greatest(populist, anti_establishment, emotional, institutional) THEN 'emotional' ELSE 'institutional' END AS style FROM f1)"""
SPEECHES = f"WITH {S} "
FEATURES = f"WITH {S}, {T0}, {F0}, {F1}, {FF} "
VECTORS = f"WITH {S}, {E}, {X} "


def query(name: str, sql: str | None = None):
    """Register a query, with its SQL where there is one."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLE_SQL[name] = sql
        return f

    return keep


def over_speeches(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql and SPEECHES + sql)(lambda spark, d: f(speeches(spark, d)))


def over_features(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql and FEATURES + sql)(lambda spark, d: f(prepare.speech_features(speeches(spark, d), LEX)))


def over_vectors(name: str, f: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    query(name, sql and VECTORS + sql)(lambda spark, d: f(embedded(spark, d)))


# --- counts ---------------------------------------------------------------------------------------------------


def _generalism_sql(by: str, least: int = 2, more: str = "") -> str:
    return f"""{more} c AS (SELECT {by} AS k, cluster, count(*) AS c FROM s GROUP BY ALL), n AS (SELECT k, sum(c) AS n, count(*) AS t FROM c GROUP BY k),
 h AS (SELECT c.k, n.n, n.t, -sum((c.c / n.n) * log2(c.c / n.n + 1e-10)) AS h, arg_min(cluster, {{'a': -c.c, 'b': cluster}}) AS d FROM c JOIN n USING (k) GROUP BY c.k, n.n, n.t),
 z AS (SELECT k, n, t, d, 100 * h / (SELECT CASE WHEN count(DISTINCT cluster) > 1 THEN log2(count(DISTINCT cluster)) ELSE 1.0 END FROM s) AS sc FROM h WHERE n >= {least}),
 g AS (SELECT k AS {by}, round(sc, 1) + 0.0e0 AS score, CASE WHEN sc > 70 THEN 'generalista' WHEN sc < 30 THEN 'specialista' ELSE 'bilanciato' END AS label, d AS dominant_cluster, CAST(t AS BIGINT) AS n_topics, CAST(n AS BIGINT) AS n_speeches FROM z)"""


over_speeches("generalism_by_speaker", lambda s: counts.generalism(s, COLS.speaker), _generalism_sql("deputy", more=",") + " SELECT * FROM g")
over_speeches("generalism_by_party", lambda s: counts.generalism(s, COLS.party, skip_unknown=True), _generalism_sql('"group"', more=",") + " SELECT * FROM g")

_REBELS = """, mc AS (SELECT "group", cluster, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT "group", arg_min(cluster, {'a': -c, 'b': cluster}) AS main_cluster FROM mc GROUP BY "group"),
 r AS (SELECT deputy, "group", main_cluster, count(*) AS total, sum(CASE WHEN cluster = main_cluster THEN 1 ELSE 0 END) AS i FROM s JOIN m USING ("group") GROUP BY ALL),
 rb AS (SELECT deputy, "group", main_cluster, CAST(total AS BIGINT) AS total, round(CAST(total - i AS DOUBLE) / total * 100, 1) AS rebel_pct FROM r WHERE total >= 3)"""
over_speeches("rebel_scores", counts.rebel_scores, _REBELS + " SELECT * FROM rb")
over_speeches(
    "top_rebels",
    counts.top_rebels,
    _REBELS + """, so AS (SELECT deputy, arg_max(source, speech_id) AS source FROM s GROUP BY deputy)
 SELECT rb.*, source, CAST(row_number() OVER (PARTITION BY source ORDER BY rebel_pct DESC, deputy) AS INTEGER) AS rank FROM rb JOIN so USING (deputy) WHERE rebel_pct > 30 QUALIFY rank <= 15""",
)
over_speeches(
    "rebel_distributions",
    lambda s: counts.rebel_distributions(s).select("kind", "key", F.explode("distribution").alias("cluster", "value")),
    """SELECT 'speaker' AS kind, deputy AS key, cluster, CAST(count(*) AS DOUBLE) AS value FROM s GROUP BY ALL UNION ALL
 SELECT 'party', "group", cluster, round(100.0e0 * count(*) / sum(count(*)) OVER (PARTITION BY "group"), 1) FROM s GROUP BY "group", cluster""",
)
over_speeches("rebel_severity", lambda s: views.rebel_severity(counts.rebel_scores(s)), _REBELS + """ SELECT deputy, "group", rebel_pct, round(100 - rebel_pct, 1) AS in_line_pct, CASE WHEN rebel_pct > 60 THEN 'Alto' WHEN rebel_pct > 40 THEN 'Medio' ELSE 'Moderato' END AS severity FROM rb WHERE rebel_pct > 30""")
_COMP = """, c AS (SELECT cluster, "group", count(*) AS c FROM s GROUP BY ALL), n AS (SELECT cluster, sum(c) AS n, count(*) AS k FROM c GROUP BY cluster),
 cc AS (SELECT cluster, CAST(n AS BIGINT) AS n_speeches, CAST(k AS BIGINT) AS n_parties, CASE WHEN k > 1 THEN round(-sum(c.c / n * ln(c.c / n + 1e-10)) / ln(k), 4) + 0.0e0 ELSE 0.0e0 END AS mixing FROM c JOIN n USING (cluster) GROUP BY cluster, n, k)"""
over_speeches("cluster_composition", counts.composition, _COMP + " SELECT * FROM cc")
over_speeches("transversal_clusters", counts.transversal, _COMP + " SELECT * FROM cc WHERE n_parties >= 3 AND mixing >= 0.5")
_OVER = f""", o AS (SELECT cluster, count(*) AS n, sum(CASE WHEN sd = 'left' THEN 1 ELSE 0 END) AS l, sum(CASE WHEN sd = 'right' THEN 1 ELSE 0 END) AS r, sum(CASE WHEN sd = 'center' THEN 1 ELSE 0 END) AS c FROM (SELECT cluster, {_SIDE.format(c='"group"')} AS sd FROM s) GROUP BY cluster),
 ov AS (SELECT cluster, CAST(n AS BIGINT) AS n_speeches, round(100.0e0 * l / n, 1) AS left_pct, round(100.0e0 * r / n, 1) AS right_pct, round(100.0e0 * c / n, 1) AS center_pct, round(200.0e0 * least(l, r) / n, 1) AS overlap,
 CASE WHEN 200.0e0 * least(l, r) / n > 40 THEN 'bipartisan' WHEN 100.0e0 * l / n > 60 THEN 'left-dominated' WHEN 100.0e0 * r / n > 60 THEN 'right-dominated' ELSE 'mixed' END AS type FROM o)"""
over_speeches("thematic_overlap", lambda s: counts.overlap(s, side=side(F.col("group"))), _OVER + " SELECT * FROM ov")
over_speeches("overlap_lists", lambda s: views.bipartisan_lists(counts.overlap(s, side=side(F.col("group")))), _OVER + " SELECT 'bipartisan' AS list, CAST(row_number() OVER (ORDER BY overlap DESC, cluster) AS INTEGER) AS rank, cluster, overlap, type FROM ov UNION ALL SELECT 'polarized', CAST(row_number() OVER (ORDER BY overlap, cluster) AS INTEGER), cluster, overlap, type FROM ov")
_DEP = """ SELECT deputy, arg_min("group", speech_id) AS "group", arg_min(source, speech_id) AS source, CAST(count(*) AS BIGINT) AS n_speeches, min(b.cluster) AS cluster FROM s JOIN b USING (deputy) GROUP BY deputy"""
over_speeches("deputy_aggregates", counts.speaker_aggregates, ", t AS (SELECT deputy, cluster, count(*) AS c FROM s GROUP BY ALL), b AS (SELECT deputy, arg_min(cluster, {'a': -c, 'b': cluster}) AS cluster FROM t GROUP BY deputy)" + _DEP)
over_speeches(
    "deputies_by_period",
    counts.aggregates_by_period,
    """, g AS (SELECT deputy, cluster, 'global' AS grain, '' AS period FROM s UNION ALL SELECT deputy, cluster, 'year', CAST(year(date) AS VARCHAR) FROM s UNION ALL SELECT deputy, cluster, 'month', strftime(date, '%Y-%m') FROM s),
 c AS (SELECT grain, period, deputy, cluster, count(*) AS c FROM g GROUP BY ALL), z AS (SELECT grain, period, sum(c) AS size FROM c GROUP BY ALL)
 SELECT grain, period, deputy, CAST(sum(c) AS BIGINT) AS n_speeches, arg_min(cluster, {'a': -c, 'b': cluster}) AS dominant_cluster FROM c JOIN z USING (grain, period) WHERE grain = 'global' OR (grain = 'year' AND size >= 10) OR (grain = 'month' AND size >= 5) GROUP BY grain, period, deputy""",
)
over_speeches("cluster_meta", lambda s: counts.topic_meta(s, LABELS), """, c AS (SELECT coalesce(source, 'all') AS source, cluster, count(*) AS n FROM s GROUP BY GROUPING SETS ((source, cluster), (cluster)))
 SELECT source, cluster, CASE cluster WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' WHEN 2 THEN 'Two' ELSE 'Cluster ' || cluster END AS label, CAST(n AS BIGINT) AS n FROM c""")
over_speeches("source_stats", counts.source_stats, """ SELECT source, count(*) AS n_speeches, count(DISTINCT deputy) AS n_deputies, count(DISTINCT "group") AS n_parties, count(DISTINCT cluster) AS n_clusters FROM s GROUP BY source""")
over_speeches("distinct_counts", counts.distinct_counts, """ SELECT count(DISTINCT deputy) AS n_deputy, count(DISTINCT "group") AS n_group, count(DISTINCT cluster) AS n_cluster, count(DISTINCT source) AS n_source FROM s""")
over_speeches("party_counts", views.party_counts, ' SELECT "group", count(*) AS n FROM s GROUP BY "group"')
over_speeches("party_distribution", views.party_distribution, """, c AS (SELECT "group", cluster, count(*) AS c FROM s GROUP BY ALL), n AS (SELECT "group", sum(c) AS n FROM c GROUP BY "group"), k AS (SELECT DISTINCT cluster FROM s)
 SELECT n."group", k.cluster, CAST(coalesce(c.c, 0) AS BIGINT) AS n, CAST(round(100.0e0 * coalesce(c.c, 0) / n.n, 0) AS BIGINT) AS pct FROM n CROSS JOIN k LEFT JOIN c ON c."group" = n."group" AND c.cluster = k.cluster""")
over_speeches("generalists", views.generalists, _generalism_sql("deputy", 5, ",") + """ SELECT *, CAST(row_number() OVER (ORDER BY score DESC, deputy) AS INTEGER) AS rank, 'generalists' AS side FROM g QUALIFY rank <= 10 UNION ALL SELECT *, CAST(row_number() OVER (ORDER BY score, deputy) AS INTEGER) AS rank, 'specialists' FROM g QUALIFY rank <= 10""")
over_speeches("speaker_search", lambda s: views.search(counts.speaker_aggregates(s), "SRC1", ["deputy", "group"], [F.asc("deputy")]), ", t AS (SELECT deputy, cluster, count(*) AS c FROM s GROUP BY ALL), b AS (SELECT deputy, arg_min(cluster, {'a': -c, 'b': cluster}) AS cluster FROM t GROUP BY deputy), q AS (" + _DEP + """) SELECT * FROM q WHERE contains(lower(deputy), 'src1') OR contains(lower("group"), 'src1') ORDER BY deputy LIMIT 10""")

# --- preparation ----------------------------------------------------------------------------------------------

_PHRASES = (r"that\s*the", "of the", r"de[,]?\s*la", "und die")
over_speeches("clean_text", lambda s: s.select("speech_id", T.clean_text(F.col("text"), _PHRASES).alias("cleaned")), " SELECT speech_id, trim(regexp_replace(" + "regexp_replace(" * len(_PHRASES) + "lower(text)" + "".join(f", '{p}', '', 'g')" for p in _PHRASES) + r", '\s+', ' ', 'g'), ' ') AS cleaned FROM s")
over_speeches("min_words", lambda s: prepare.min_words(s).select("speech_id", T.n_words(F.col("cleaned_text")).alias("n_words")), f" SELECT speech_id, CAST(len({W}) AS INTEGER) AS n_words FROM s WHERE len({W}) >= 30")
over_speeches("drop_presidency", lambda s: prepare.drop_presidency(s.withColumn("deputy", F.when(F.col("cluster") == 3, F.concat(F.lit("Presidente "), "deputy")).otherwise(F.col("deputy"))).withColumn("group", F.when(F.col("cluster") == 5, "Presidenza").otherwise(F.col("group")))).groupBy("cluster").agg(F.count("*").alias("n")), " SELECT cluster, count(*) AS n FROM s WHERE cluster NOT IN (3, 5) GROUP BY cluster")
over_speeches("known_parties", lambda s: prepare.known_parties(s.withColumn("group", F.when(F.col("cluster") == 1, "?").when(F.col("cluster") == 2, None).when(F.col("cluster") == 3, "Unknown Group").otherwise(F.col("group")))).groupBy("cluster", "group").agg(F.count("*").alias("n")), ' SELECT cluster, "group", count(*) AS n FROM s WHERE cluster NOT IN (1, 2, 3) GROUP BY ALL')
over_speeches("party_normalisation", lambda s: s.select("speech_id", T.normalise_party(F.col("group"), {"en": "English", "fr": "Français"}).alias("party"), side(F.col("group")).alias("coalition")), f""" SELECT speech_id, CASE "group" WHEN 'en' THEN 'English' WHEN 'fr' THEN 'Français' ELSE "group" END AS party, {_SIDE.format(c='"group"')} AS coalition FROM s""")
over_speeches("group_and_key", lambda s: s.select("speech_id", F.when(F.col("cluster") > 2, F.col("group")).alias("p"), F.when(F.col("cluster") == 1, "governo").when(F.col("cluster") == 2, "presidenza").alias("c"), "deputy").select("speech_id", prepare.derive_group(F.col("p"), F.col("c")).alias("derived"), prepare.speaker_key(F.col("deputy"), F.col("p"), prepare.derive_group(F.col("p"), F.col("c"))).alias("key")), """ SELECT speech_id, CASE WHEN cluster > 2 THEN "group" WHEN cluster = 1 THEN 'Governo' WHEN cluster = 2 THEN 'Presidenza' ELSE 'Unknown Group' END AS derived, CASE WHEN cluster > 2 THEN deputy || ' [' || "group" || ']' ELSE deputy END AS key FROM s""")
over_speeches("names_and_roles", lambda s: s.select("speech_id", F.concat("deputy", F.lit(" ["), "group", F.lit("]")).alias("n"), F.when(F.col("cluster") == 0, " Vice Ministro").when(F.col("cluster") == 1, "Presidente").when(F.col("cluster") == 2, "relatrice").otherwise("membro").alias("r")).select("speech_id", T.clean_name(F.col("n")).alias("name"), T.party_from_name(F.col("n")).alias("party"), T.normalise_role(F.col("r")).alias("role"), T.role_category(F.col("r")).alias("category")), """ SELECT speech_id, deputy AS name, "group" AS party, CASE cluster WHEN 0 THEN 'vice ministro' WHEN 1 THEN 'presidente' WHEN 2 THEN 'relatrice' ELSE 'membro' END AS role, CASE cluster WHEN 0 THEN 'governo' WHEN 1 THEN 'presidenza' WHEN 2 THEN 'ufficio' ELSE 'altro' END AS category FROM s""")
_EXPORT_SQL = _REBELS + """ SELECT speech_id, s.deputy, s."group", cluster, date, source, substr(cleaned_text, 1, 500) AS excerpt, text AS snippet, coalesce(rebel_pct, 0.0e0) AS rebel_pct FROM s LEFT JOIN rb ON rb.deputy = s.deputy"""
over_speeches("speech_export", lambda s: views.speech_export(s, counts.rebel_scores(s)), _EXPORT_SQL)
over_speeches("source_union", lambda s: s.filter("source = 'camera'").unionByName(s.filter("source = 'senate'")).groupBy("source").agg(F.count("*").alias("n"), F.max("speech_id").alias("last")), " SELECT source, count(*) AS n, max(speech_id) AS last FROM s GROUP BY source")
over_speeches("lexicon_scores", lambda s: prepare.lexicon_scores(s, {"a": frozenset({"the", "of"}), "b": frozenset({"les", "pour"})}), f", q AS (SELECT speech_id, {P} AS p FROM s) SELECT speech_id, round(100.0e0 * len(list_filter(p, lambda t: t IN ('the', 'of'))) / greatest(len(p), 1), 3) AS a, round(100.0e0 * len(list_filter(p, lambda t: t IN ('les', 'pour'))) / greatest(len(p), 1), 3) AS b FROM q")

# --- texts ----------------------------------------------------------------------------------------------------

_LABEL = "CASE WHEN {m} > 0.1e0 THEN 'positivo' WHEN {m} < -0.1e0 THEN 'negativo' ELSE 'neutro' END"


def _sent_by(keys: str) -> str:
    return f"SELECT {keys}, round(avg(sentiment), 3) + 0.0e0 AS score, {_LABEL.format(m='avg(sentiment)')} AS label, count(*) AS n FROM f GROUP BY {keys}"


over_features("speech_sentiment", texts.speech_sentiment, "SELECT speech_id, n_pos, n_neg, round(sentiment, 6) + 0.0e0 AS sentiment FROM f")
over_features("sentiment_speaker_topic", lambda f: texts.sentiment_by(f, ["deputy", "cluster"]), _sent_by("deputy, cluster"))
over_features("sentiment_party_topic", lambda f: texts.sentiment_by(f, ["group", "cluster"]), _sent_by('"group", cluster'))
over_features("sentiment_topic", texts.sentiment_by_topic, "SELECT cluster, round(avg(sentiment), 3) + 0.0e0 AS score, round(100.0e0 * sum(CASE WHEN sentiment > 0.1e0 THEN 1 ELSE 0 END) / count(*), 1) AS positive_pct, round(100.0e0 * sum(CASE WHEN sentiment < -0.1e0 THEN 1 ELSE 0 END) / count(*), 1) AS negative_pct, round(100.0e0 * sum(CASE WHEN sentiment BETWEEN -0.1e0 AND 0.1e0 THEN 1 ELSE 0 END) / count(*), 1) AS neutral_pct, count(*) AS n FROM f GROUP BY cluster")
over_features("topic_sentiment_ranking", lambda f: views.ranked(texts.sentiment_by_topic(f).select("cluster", "score"), "score", "cluster", 100), "SELECT cluster, round(avg(sentiment), 3) + 0.0e0 AS score, CAST(row_number() OVER (ORDER BY round(avg(sentiment), 3) DESC, cluster) AS INTEGER) AS rank FROM f GROUP BY cluster")
over_features("party_topic_matrix", texts.party_topic_matrix, """SELECT p."group", k.cluster, coalesce(round(avg(sentiment), 3) + 0.0e0, 0.0e0) AS score FROM (SELECT DISTINCT "group" FROM f) p CROSS JOIN (SELECT DISTINCT cluster FROM f) k LEFT JOIN f ON f."group" = p."group" AND f.cluster = k.cluster GROUP BY ALL""")
over_features("sentiment_rankings", texts.sentiment_rankings, """, m AS (SELECT cluster, deputy, round(avg(sentiment), 3) + 0.0e0 AS score, arg_max("group", speech_id) AS "group", count(*) AS n FROM f GROUP BY ALL)
 SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score DESC, deputy) AS INTEGER) AS rank, 'top' AS side FROM m QUALIFY rank <= 10 UNION ALL SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY score, deputy) AS INTEGER) AS rank, 'bottom' FROM m QUALIFY rank <= 10""")
_READ = "round((sum(CAST(round(gulpease * 10) AS BIGINT)) / (10.0e0 * count(*))), 1) AS score, CASE WHEN (sum(CAST(round(gulpease * 10) AS BIGINT)) / (10.0e0 * count(*))) < 55 THEN 'difficile' WHEN (sum(CAST(round(gulpease * 10) AS BIGINT)) / (10.0e0 * count(*))) < 80 THEN 'medio' ELSE 'facile' END AS label, count(*) AS n FROM f GROUP BY"
over_features("readability_speech", texts.readability_speech, "SELECT speech_id, gulpease, readability, n_sentences, g_words AS n_words, g_letters AS n_letters FROM f")
over_features("readability_speaker", lambda f: texts.readability_by(f, "deputy"), f"SELECT deputy, {_READ} deputy")
over_features("readability_party", lambda f: texts.readability_by(f, "group"), f'SELECT "group", {_READ} "group"')
over_features("readability_distribution", texts.readability_distribution, "SELECT readability, count(*) AS n FROM f GROUP BY readability")
_POL = "round((sum(CAST(round(polarization * 10) AS BIGINT)) / (10.0e0 * count(*))), 1) AS score, CASE WHEN (sum(CAST(round(polarization * 10) AS BIGINT)) / (10.0e0 * count(*))) < 20 THEN 'bassa' WHEN (sum(CAST(round(polarization * 10) AS BIGINT)) / (10.0e0 * count(*))) < 50 THEN 'media' ELSE 'alta' END AS level, count(*) AS n FROM f GROUP BY"
over_features("polarization_speech", texts.polarization_speech, "SELECT speech_id, n_pronouns, n_adversatives, n_patterns, polarization, polarization_level AS level FROM f")
over_features("polarization_speaker", lambda f: texts.polarization_by(f, "deputy"), f"SELECT deputy, {_POL} deputy HAVING count(*) >= 3")
over_features("polarization_party", lambda f: texts.polarization_by(f, "group"), f'SELECT "group", {_POL} "group"')
over_features("top_polarizers", texts.top_polarizers, f""", m AS (SELECT deputy, {_POL} deputy HAVING count(*) >= 3)
 SELECT *, CAST(row_number() OVER (ORDER BY score DESC, deputy) AS INTEGER) AS rank, 'top' AS side FROM m QUALIFY rank <= 10 UNION ALL SELECT *, CAST(row_number() OVER (ORDER BY score, deputy) AS INTEGER) AS rank, 'least' FROM m QUALIFY rank <= 10""")
over_features("polarization_ranking", lambda f: views.ranked(texts.polarization_by(f, "group"), "score", "group", 12), f""", m AS (SELECT "group", {_POL} "group") SELECT *, CAST(row_number() OVER (ORDER BY score DESC, "group") AS INTEGER) AS rank FROM m QUALIFY rank <= 12""")
over_features("readability_ranking", lambda f: views.ranked(texts.readability_by(f, "group"), "score", "group", 12), f""", m AS (SELECT "group", {_READ} "group") SELECT *, CAST(row_number() OVER (ORDER BY score DESC, "group") AS INTEGER) AS rank FROM m QUALIFY rank <= 12""")
_KINDS = ("populist", "anti_establishment", "emotional", "institutional")
_RH = ", ".join(f"round(avg({k}), 2) AS {k}" for k in _KINDS)
over_features("rhetoric_speech", texts.rhetoric_speech, "SELECT speech_id, " + ", ".join(f"round({k}, 6) AS {k}" for k in _KINDS) + ", style FROM f")
over_features("rhetoric_style", texts.rhetoric_style_counts, "SELECT style, count(*) AS n FROM f GROUP BY style")
over_features("rhetoric_speaker", lambda f: texts.rhetoric_by(f, "deputy"), f"SELECT deputy, count(*) AS n, {_RH} FROM f GROUP BY deputy HAVING count(*) >= 3")
over_features("rhetoric_party", lambda f: texts.rhetoric_by(f, "group"), f'SELECT "group", count(*) AS n, {_RH} FROM f GROUP BY "group"')
over_features("rhetoric_rankings", texts.rhetoric_rankings, f", m AS (SELECT deputy, {_RH} FROM f GROUP BY deputy HAVING count(*) >= 3), l AS (" + " UNION ALL ".join(f"SELECT deputy, '{k}' AS kind, {k} AS score FROM m" for k in _KINDS) + ") SELECT *, CAST(row_number() OVER (PARTITION BY kind ORDER BY score DESC, deputy) AS INTEGER) AS rank FROM l QUALIFY rank <= 10")
over_features("crisis_global", texts.crisis_by_period, "SELECT strftime(date, '%Y-%m') AS period, CAST(sum(n_crisis) AS BIGINT) AS crisis_words, CAST(sum(n_words) AS BIGINT) AS n_words, coalesce(round(1000.0e0 * sum(n_crisis) / nullif(sum(n_words), 0), 2), 0.0e0) AS rate FROM f GROUP BY 1")
over_features("crisis_by_cluster", texts.crisis_by_topic, "SELECT cluster, strftime(date, '%Y-%m') AS period, CAST(sum(n_crisis) AS BIGINT) AS crisis_words, count(*) AS n_speeches, round(CAST(sum(n_crisis) AS DOUBLE) / count(*), 2) AS rate FROM f GROUP BY 1, 2")
over_features("text_metrics", texts.text_metrics, "SELECT speech_id, n_words, n_sentences, round(CAST(n_words AS DOUBLE) / n_sentences, 4) AS words_per_sentence, n_questions, n_self, n_negation, n_future, n_past, n_numeric FROM f")
over_features("verbosity_speaker", texts.verbosity, "SELECT deputy, count(*) AS n_speeches, CAST(sum(n_words) AS BIGINT) AS total_words, round(avg(n_words), 1) AS avg_words, round(avg(n_sentences), 1) AS avg_sentences, round(avg(CAST(n_words AS DOUBLE) / n_sentences), 1) AS avg_words_per_sentence FROM f GROUP BY deputy")
_RATES = {"question_rate": "n_questions", "self_reference_rate": "n_self", "negation_rate": "n_negation", "future_rate": "n_future", "past_rate": "n_past", "data_rate": "n_numeric"}
_LEAN = "coalesce(CAST(sum(n_future) - sum(n_past) AS DOUBLE) / nullif(sum(n_future) + sum(n_past), 0), 0.0e0)"
_LING = "SELECT deputy, " + ", ".join(f"coalesce(round(1000.0e0 * sum({c}) / nullif(sum(n_words), 0), 2), 0.0e0) AS {k}" for k, c in _RATES.items()) + f", round({_LEAN}, 3) + 0.0e0 AS temporal_orientation, CASE WHEN sum(n_words) = 0 THEN 'n/a' WHEN {_LEAN} > 0.2e0 THEN 'futuro' WHEN {_LEAN} < -0.2e0 THEN 'passato' ELSE 'neutro' END AS orientation FROM f GROUP BY deputy"
over_features("linguistic_speaker", texts.linguistic, _LING)
over_features("linguistic_radar", lambda f: views.radar(texts.linguistic(f)), f", l AS ({_LING}) SELECT deputy, " + ", ".join(f"round(least(100.0e0, coalesce(100 * {c} / nullif((SELECT max({c}) FROM l), 0), 0.0e0)), 1) AS {c}" for c in ("question_rate", "self_reference_rate", "negation_rate", "data_rate")) + " FROM l")
over_features("most_verbose", lambda f: views.ranked(texts.verbosity(f).select("deputy", "avg_words"), "avg_words", "deputy", 10), ", v AS (SELECT deputy, round(avg(n_words), 1) AS avg_words FROM f GROUP BY deputy) SELECT *, CAST(row_number() OVER (ORDER BY avg_words DESC, deputy) AS INTEGER) AS rank FROM v QUALIFY rank <= 10")
_VOC = f""", k AS (SELECT deputy, unnest({W}) AS t FROM s), c AS (SELECT deputy, t, count(*) AS c FROM k GROUP BY ALL), n AS (SELECT deputy, count(*) AS n_speeches FROM s GROUP BY deputy),
 vo AS (SELECT deputy, n_speeches, CAST(sum(c) AS BIGINT) AS total_words, count(*) AS vocabulary_size, round(count(*) / sum(c), 4) AS ttr, round(sum(CASE WHEN c = 1 THEN 1 ELSE 0 END) / count(*), 4) AS hapax_ratio, CASE WHEN count(*) / sum(c) > 0.3e0 THEN 'ricco' WHEN count(*) / sum(c) > 0.2e0 THEN 'medio' ELSE 'ripetitivo' END AS label
 FROM c JOIN n USING (deputy) WHERE n_speeches >= 2 GROUP BY deputy, n_speeches HAVING sum(c) >= 50)"""
over_speeches("vocabulary_speaker", texts.vocabulary, _VOC + " SELECT * FROM vo")
over_speeches("richest_vocabulary", lambda s: views.ranked(texts.vocabulary(s).select("deputy", "ttr"), "ttr", "deputy", 10), _VOC + " SELECT deputy, ttr, CAST(row_number() OVER (ORDER BY ttr DESC, deputy) AS INTEGER) AS rank FROM vo QUALIFY rank <= 10")


def _tfidf_sql(key: str, k: int, source: str = "s") -> str:
    return f""" k AS (SELECT {key} AS g, unnest(list_filter({P}, lambda t: regexp_full_match(t, '\\p{{L}}{{4,}}') AND t NOT IN ({_in(KEYWORD_STOP)}))) AS word FROM {source}), c AS (SELECT g, word, count(*) AS c FROM k GROUP BY ALL),
 n AS (SELECT g, sum(c) AS n FROM c GROUP BY g), d AS (SELECT word, count(*) AS d FROM c GROUP BY word), w AS (SELECT c.g AS {key}, word, CAST(c.c AS BIGINT) AS c, round(c.c / n.n * (ln((SELECT count(*) FROM n) / (d.d + 1)) + 1), 6) AS tfidf FROM c JOIN n USING (g) JOIN d USING (word)),
 kw AS (SELECT *, CAST(row_number() OVER (PARTITION BY {key} ORDER BY tfidf DESC, word) AS INTEGER) AS rank FROM w QUALIFY rank <= {k})"""


over_speeches("party_keywords", lambda s: texts.party_keywords(s, stopwords=KEYWORD_STOP, blacklist=()), "," + _tfidf_sql('"group"', 50) + " SELECT * FROM kw")
over_speeches("word_cloud", lambda s: views.word_cloud(texts.party_keywords(s, stopwords=KEYWORD_STOP, blacklist=())).select("group", "word", "rank", "weight"), "," + _tfidf_sql('"group"', 50) + ' SELECT "group", word, rank, round(pow(0.85e0, rank - 1), 6) AS weight FROM kw')
over_speeches("cluster_keywords", lambda s: texts.topic_keywords(s, most=10**9, stopwords=KEYWORD_STOP), "," + _tfidf_sql("cluster", 5) + " SELECT * FROM kw")
over_speeches("cluster_labels", lambda s: texts.topic_labels(texts.topic_keywords(s, most=10**9, stopwords=KEYWORD_STOP)), "," + _tfidf_sql("cluster", 5) + " SELECT cluster, string_agg(upper(word[1]) || word[2:], ' / ' ORDER BY rank) AS label FROM kw WHERE rank <= 3 GROUP BY cluster")
over_speeches("cluster_keywords_sampled", lambda s: texts.topic_keywords(s, stopwords=KEYWORD_STOP))

# --- vectors --------------------------------------------------------------------------------------------------

_PC = """, pc AS (SELECT "group", pos, avg(x) AS c FROM x GROUP BY ALL)"""
_TC = """, tc AS (SELECT cluster, pos, avg(x) AS c FROM x GROUP BY ALL)"""
_SV = """, sn AS (SELECT deputy, min("group") AS "group", count(*) AS n FROM e GROUP BY deputy), sv AS (SELECT deputy, pos, avg(x) AS v FROM x GROUP BY ALL)"""
over_vectors("party_centroids", lambda e: embeddings.party_centroids(e).select("group", "n", F.posexplode("centroid").alias("pos", "c")).select("group", "n", "pos", F.round("c", 6).alias("c")), """SELECT "group", count(*) AS n, CAST(pos - 1 AS INTEGER) AS pos, round(avg(x), 6) + 0.0e0 AS c FROM x GROUP BY "group", pos""")
over_vectors("party_cohesion", embeddings.cohesion, _PC + """, d AS (SELECT speech_id, x."group", sqrt(sum((x - c) * (x - c))) AS d FROM x JOIN pc ON pc."group" = x."group" AND pc.pos = x.pos GROUP BY ALL), q AS (SELECT "group", avg(d) AS m, stddev_pop(d) AS sd, count(*) AS n FROM d GROUP BY "group")
 SELECT "group", round(m, 4) AS mean_distance, round(sd, 4) AS std_distance, round(1 / (1 + m), 4) AS cohesion, CASE WHEN 1 / (1 + m) > 0.7e0 THEN 'compatto' WHEN 1 / (1 + m) < 0.4e0 THEN 'frammentato' ELSE 'moderato' END AS label, n FROM q""")
_AFF = _PC + """, af AS (SELECT a."group" AS party1, b."group" AS party2, round(sum(a.c * b.c) / (sqrt(sum(a.c * a.c)) * sqrt(sum(b.c * b.c))), 4) + 0.0e0 AS affinity FROM pc a JOIN pc b ON a.pos = b.pos AND a."group" < b."group" GROUP BY ALL)"""
over_vectors("party_affinity", embeddings.affinity, _AFF + " SELECT * FROM af")
over_vectors("affinity_matrix", embeddings.affinity_matrix, _AFF + """ SELECT * FROM af UNION ALL SELECT party2, party1, affinity FROM af UNION ALL SELECT DISTINCT "group", "group", 1.0e0 FROM e""")


def _pairs_sql(k: int, least: int = 3) -> str:
    return f"""{_SV}, pv AS (SELECT sv.*, sn."group" AS g FROM sv JOIN sn USING (deputy) WHERE n >= {least}), pr AS (SELECT a.deputy AS speaker1, a.g AS party1, b.deputy AS speaker2, b.g AS party2, round(sum(a.v * b.v) / (sqrt(sum(a.v * a.v)) * sqrt(sum(b.v * b.v)) + 1e-10), 4) + 0.0e0 AS similarity FROM pv a JOIN pv b ON a.pos = b.pos AND a.deputy < b.deputy AND a.g <> b.g GROUP BY ALL ORDER BY similarity DESC, speaker1, speaker2 LIMIT {k})"""


_CROSS = f"({_SIDE.format(c='party1')} = 'left' AND {_SIDE.format(c='party2')} = 'right' OR {_SIDE.format(c='party1')} = 'right' AND {_SIDE.format(c='party2')} = 'left')"
_SIDED = f"SELECT *, {_SIDE.format(c='party1')} AS side1, {_SIDE.format(c='party2')} AS side2 FROM pr WHERE {_CROSS} ORDER BY similarity DESC, speaker1, speaker2 LIMIT 10"
over_vectors("cross_party_pairs", embeddings.cross_party_pairs, _pairs_sql(20) + " SELECT * FROM pr")
over_vectors("unusual_pairs", embeddings.unusual_pairs, _pairs_sql(10) + " SELECT * FROM pr")
over_vectors("left_right_alliances", lambda e: embeddings.left_right_alliances(e, side=side), _pairs_sql(50) + " " + _SIDED)
over_vectors("bridge_pairs", lambda e: views.bridge_pairs(embeddings.cross_party_pairs(e), side=side), _pairs_sql(20) + " " + _SIDED)
_CONF = _SV + _PC + """, d AS (SELECT sv.deputy, sn."group", pc."group" AS other, sqrt(sum((v - c) * (v - c))) AS d FROM sv JOIN sn USING (deputy) JOIN pc ON pc.pos = sv.pos GROUP BY ALL),
 q AS (SELECT deputy, "group", min(CASE WHEN other = "group" THEN d END) AS own, min(CASE WHEN other <> "group" THEN d END) AS away, arg_min(CASE WHEN other <> "group" THEN other END, CASE WHEN other <> "group" THEN d END) AS nearest FROM d GROUP BY ALL),
 cf AS (SELECT deputy, "group", round(1 / (1 + own), 4) AS conformity, round(1 / (1 + away), 4) AS cross_affinity, nearest AS nearest_other, CASE WHEN 1 / (1 + own) > 0.7e0 THEN 'mainstream' WHEN 1 / (1 + away) > 1 / (1 + own) THEN 'bridge' ELSE 'maverick' END AS faction FROM q)"""
over_vectors("conformity", embeddings.conformity, _CONF + " SELECT * FROM cf")
over_vectors("factions_by_party", lambda e: embeddings.factions(e).select("group", "n_speakers", "mean_conformity", *[F.array_join(k, ",").alias(k) for k in ("mainstream", "bridge", "maverick")]), _CONF + """ SELECT "group", count(*) AS n_speakers, round(CAST(sum(CAST(round(conformity * 10000) AS BIGINT)) AS DOUBLE) / count(*)) / 10000 AS mean_conformity, """ + ", ".join(f"coalesce(string_agg(CASE WHEN faction = '{k}' THEN deputy END, ',' ORDER BY deputy), '') AS {k}" for k in ("mainstream", "bridge", "maverick")) + ' FROM cf GROUP BY "group"')


def _finger_sql(by: str) -> str:
    return f"""{_TC}, m AS (SELECT {by}, pos, avg(x) AS v FROM x GROUP BY ALL), fp AS (SELECT m.{by}, tc.cluster, round(coalesce(sum(v * c) / nullif(sqrt(sum(v * v)) * sqrt(sum(c * c)), 0), 0), 4) + 0.0e0 AS similarity FROM m JOIN tc USING (pos) GROUP BY ALL)"""


over_vectors("fingerprint_speaker", lambda e: embeddings.fingerprint(e, "deputy"), _finger_sql("deputy") + " SELECT * FROM fp")
over_vectors("fingerprint_party", lambda e: embeddings.fingerprint(e, "group"), _finger_sql('"group"') + " SELECT * FROM fp")
_LEAD = _finger_sql("deputy") + """, n AS (SELECT deputy, count(*) AS n FROM e GROUP BY deputy), ld AS (SELECT deputy, arg_min(cluster, {'a': -similarity, 'b': cluster}) AS cluster, max(similarity) AS similarity, n AS n_speeches FROM fp JOIN n USING (deputy) WHERE n >= 2 GROUP BY deputy, n)"""
over_vectors("topic_leadership", embeddings.topic_leadership, _LEAD + " SELECT * FROM ld")
over_vectors("topic_leaders", embeddings.topic_leaders, _LEAD + " SELECT *, CAST(row_number() OVER (PARTITION BY cluster ORDER BY similarity DESC, deputy) AS INTEGER) AS rank FROM ld QUALIFY rank <= 5")
_CONS = """, gv AS (SELECT avg(v) AS g FROM (SELECT pos, var_pop(x) AS v FROM x GROUP BY pos)), o AS (SELECT deputy, avg(v) AS v, max(n) AS n FROM (SELECT deputy, pos, var_pop(x) AS v, count(*) AS n FROM x GROUP BY ALL) GROUP BY deputy HAVING max(n) >= 3),
 cn AS (SELECT deputy, v, n, CASE WHEN g = 0 THEN 50.0e0 ELSE greatest(0.0e0, least(100.0e0, (1 - v / g) * 100 + 50)) END AS c FROM o CROSS JOIN gv)"""
over_vectors("consistency_index", embeddings.consistency, _CONS + " SELECT deputy, round(c, 1) AS consistency, round(v, 6) AS variance, n AS n_speeches, CASE WHEN c > 70 THEN 'very_consistent' WHEN c > 50 THEN 'consistent' WHEN c > 30 THEN 'variable' ELSE 'inconsistent' END AS label FROM cn")
over_vectors("most_consistent", lambda e: views.ranked(embeddings.consistency(e).select("deputy", "consistency"), "consistency", "deputy", 10), _CONS + " SELECT deputy, round(c, 1) AS consistency, CAST(row_number() OVER (ORDER BY round(c, 1) DESC, deputy) AS INTEGER) AS rank FROM cn QUALIFY rank <= 10")
_DRIFT = """, yc AS (SELECT "group", year(date) AS y, pos, avg(x) AS v, count(*) AS n FROM x GROUP BY ALL HAVING count(*) >= 5), ys AS (SELECT "group", y, lag(y) OVER (PARTITION BY "group" ORDER BY y) AS py FROM (SELECT DISTINCT "group", y FROM yc)),
 dr AS (SELECT ys."group", CAST(py AS INTEGER) AS from_year, CAST(ys.y AS INTEGER) AS to_year, round(sqrt(sum((a.v - b.v) * (a.v - b.v))), 4) AS distance FROM ys JOIN yc a ON a."group" = ys."group" AND a.y = ys.y JOIN yc b ON b."group" = ys."group" AND b.y = ys.py AND a.pos = b.pos GROUP BY ALL)"""
over_vectors("semantic_drift", embeddings.drift, _DRIFT + " SELECT * FROM dr")
over_vectors("drift_totals", embeddings.drift_totals, _DRIFT + """ SELECT "group", CAST(sum(CAST(round(distance * 10000) AS BIGINT)) AS DOUBLE) / 10000 AS total_drift, round(CAST(sum(CAST(round(distance * 10000) AS BIGINT)) AS DOUBLE) / count(*)) / 10000 AS avg_drift, count(*) AS n_steps FROM dr GROUP BY "group" """)
over_vectors("topic_centroids", lambda e: embeddings.topic_centroids(e, n_topics=12, size=64).select("cluster", "n", F.posexplode("centroid").alias("pos", "c")).select("cluster", "n", "pos", F.round("c", 6).alias("c")), """, i AS (SELECT CAST(r AS INTEGER) AS cluster, CAST(q AS INTEGER) AS pos FROM range(12) t(r), range(64) u(q)), c AS (SELECT cluster, pos - 1 AS pos, avg(x) AS c, count(*) AS n FROM x GROUP BY ALL)
 SELECT i.cluster, coalesce(n, 0) AS n, i.pos, round(coalesce(c, 0), 6) + 0.0e0 AS c FROM i LEFT JOIN c ON c.cluster = i.cluster AND c.pos = i.pos""")
over_vectors("topic_assignment", lambda e: embeddings.assign_topics(e.drop("cluster"), embeddings.topic_centroids(e).select(F.col("cluster").alias("topic"), F.col("centroid").alias("vector"))).select("speech_id", "cluster", F.round(F.array_max("topic_scores"), 4).alias("score")), _TC + """, sc AS (SELECT speech_id, tc.cluster, coalesce(sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0), 0) AS s FROM x JOIN tc USING (pos) GROUP BY ALL)
 SELECT speech_id, arg_max(cluster, s) AS cluster, round(max(s), 4) + 0.0e0 AS score FROM sc GROUP BY speech_id""")

# --- time -----------------------------------------------------------------------------------------------------

_FORMS = ["yyyy-MM-dd", "d/M/yyyy", "dd-MM-yyyy", "yyyy/MM/dd"]
over_speeches("parse_dates", lambda s: s.withColumn("t", F.when(F.col("cluster") == 0, F.date_format("date", _FORMS[0])).when(F.col("cluster") == 1, F.date_format("date", _FORMS[1])).when(F.col("cluster") == 2, F.date_format("date", _FORMS[2])).when(F.col("cluster") == 3, F.date_format("date", _FORMS[3])).when(F.col("cluster") == 4, F.date_format("date", "d MMMM yyyy")).when(F.col("cluster") == 5, "seduta del 3 Marzo 2024").otherwise("ieri")).select("speech_id", dates.parse_date(F.col("t")).alias("parsed"), dates.period_key(dates.parse_date(F.col("t")), "week").alias("week")), " SELECT speech_id, p AS parsed, CAST(year(p) AS VARCHAR) || '-W' || lpad(CAST(week(p) AS VARCHAR), 2, '0') AS week FROM (SELECT speech_id, CASE WHEN cluster < 5 THEN date WHEN cluster = 5 THEN DATE '2024-03-03' END AS p FROM s)")
over_speeches("topic_trends", temporal.trends, " SELECT strftime(date, '%Y-%m') AS period, cluster, count(*) AS n FROM s GROUP BY ALL")
over_speeches("topic_trends_week", lambda s: temporal.trends(s, granularity="week"), " SELECT CAST(year(date) AS VARCHAR) || '-W' || lpad(CAST(week(date) AS VARCHAR), 2, '0') AS period, cluster, count(*) AS n FROM s GROUP BY ALL")
over_speeches("topic_trends_party", lambda s: temporal.trends(s, by_party=True), """ SELECT "group", strftime(date, '%Y-%m') AS period, cluster, count(*) AS n FROM s GROUP BY ALL""")
over_speeches("dense_trends", temporal.dense_trends, """, t AS (SELECT strftime(date, '%Y-%m') AS period, cluster FROM s) SELECT p.period, k.cluster, count(t.cluster) AS n FROM (SELECT DISTINCT period FROM t) p CROSS JOIN (SELECT DISTINCT cluster FROM t) k LEFT JOIN t ON t.period = p.period AND t.cluster = k.cluster GROUP BY ALL""")
_SURF = """, c AS (SELECT deputy, strftime(date, '%Y-%m') AS period, cluster, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT deputy, period, sum(c) AS n, arg_min(cluster, {'a': -c, 'b': cluster}) AS topic FROM c GROUP BY ALL), en AS (SELECT deputy FROM m GROUP BY deputy HAVING sum(n) >= 5),
 tl AS (SELECT deputy, period, topic, coalesce(topic <> lag(topic) OVER (PARTITION BY deputy ORDER BY period), false) AS changed FROM m SEMI JOIN en USING (deputy)),
 dc AS (SELECT deputy, topic, count(*) AS c FROM tl WHERE changed GROUP BY ALL), de AS (SELECT deputy, arg_min(topic, {'a': -c, 'b': topic}) AS d FROM dc GROUP BY deputy),
 sf AS (SELECT deputy, count(*) AS n_periods, CAST(sum(CAST(changed AS INTEGER)) AS BIGINT) AS changes, round(CASE WHEN count(*) > 1 THEN CAST(count(*) - 1 - sum(CAST(changed AS INTEGER)) AS DOUBLE) / (count(*) - 1) * 100 ELSE 100.0e0 END, 1) AS consistency, min(d) AS top_destination FROM tl LEFT JOIN de USING (deputy) GROUP BY deputy)"""
over_speeches("surfing_timeline", temporal.surfing_timeline, _SURF + " SELECT * FROM tl")
over_speeches("topic_surfing", temporal.surfing, _SURF + " SELECT * FROM sf")
over_speeches("top_surfers", temporal.top_surfers, _SURF + " SELECT *, CAST(row_number() OVER (ORDER BY changes DESC, deputy) AS INTEGER) AS rank, 'surfer' AS kind FROM sf WHERE changes >= 2 QUALIFY rank <= 15 UNION ALL SELECT *, CAST(row_number() OVER (ORDER BY consistency DESC, deputy) AS INTEGER) AS rank, 'steady' FROM sf WHERE n_periods >= 3 QUALIFY rank <= 10")
_INT = """, m AS (SELECT deputy, strftime(date, '%Y-%m') AS period, count(*) AS c FROM s GROUP BY ALL), a AS (SELECT count(DISTINCT period) AS months FROM m), q AS (SELECT deputy, sum(c) AS n, count(*) AS k, avg(c) AS m, stddev_pop(c) AS sd, max(c) AS t FROM m GROUP BY deputy HAVING sum(c) >= 3),
 iv AS (SELECT deputy, CAST(n AS BIGINT) AS n, k AS active_months, round(q.m, 2) AS avg_per_month, round(CASE WHEN k = 1 THEN 50.0e0 ELSE greatest(0.0e0, least(100.0e0, (1 - sd / q.m) * 100)) END, 1) AS regularity, round(CASE WHEN k = 1 THEN 100.0e0 ELSE 100.0e0 * t / n END, 1) AS burst, round(100.0e0 * k / months, 1) AS activity_ratio FROM q CROSS JOIN a)"""
over_speeches("intervention_patterns", temporal.interventions, _INT + " SELECT * FROM iv")
over_speeches("most_active", lambda s: views.ranked(temporal.interventions(s).select("deputy", "avg_per_month"), "avg_per_month", "deputy", 10), _INT + " SELECT deputy, avg_per_month, CAST(row_number() OVER (ORDER BY avg_per_month DESC, deputy) AS INTEGER) AS rank FROM iv QUALIFY rank <= 10")
over_speeches("period_filter", lambda s: temporal.period_filter(s, 2023), """ SELECT deputy, "group", count(*) AS n_speeches FROM s WHERE year(date) = 2023 GROUP BY ALL HAVING count(*) >= 5""")
over_speeches("available_periods", temporal.available_periods, " SELECT DISTINCT 'year' AS grain, CAST(year(date) AS VARCHAR) AS period FROM s UNION ALL SELECT DISTINCT 'month', strftime(date, '%Y-%m') FROM s")

# --- network, parsing, rosters --------------------------------------------------------------------------------


def _named(s: DataFrame) -> DataFrame:
    """Speakers under names that occur in the texts."""
    return s.withColumn("deputy", F.concat(F.when(F.col("cluster") % 4 == 0, "THE").when(F.col("cluster") % 4 == 1, "LES").when(F.col("cluster") % 4 == 2, "UND").otherwise("PARA"), F.lit(" "), "deputy"))


_NAMED = """, nm AS (SELECT speech_id, cleaned_text, CASE cluster % 4 WHEN 0 THEN 'THE' WHEN 1 THEN 'LES' WHEN 2 THEN 'UND' ELSE 'PARA' END || ' ' || deputy AS deputy FROM s), sn AS (SELECT DISTINCT deputy AS dst, lower(split_part(deputy, ' ', 1)) AS k FROM nm),
 sa AS (SELECT deputy AS src, unnest(regexp_split_to_array(lower(cleaned_text), '[^\\p{L}\\p{N}_]+')) AS k FROM nm), sc AS (SELECT src, k, count(*) AS c FROM sa GROUP BY ALL), ed AS (SELECT src, dst, CAST(sum(c) AS BIGINT) AS weight FROM sc JOIN sn USING (k) WHERE src <> dst GROUP BY ALL)"""
over_speeches("mention_edges", lambda s: network.mention_edges(_named(s)), _NAMED + " SELECT * FROM ed")
over_speeches("mention_network", lambda s: network.mention_network(_named(s)), _NAMED + """, o AS (SELECT src AS deputy, sum(weight) AS mm, count(*) AS od FROM ed GROUP BY src), i AS (SELECT dst AS deputy, sum(weight) AS mr, count(*) AS id FROM ed GROUP BY dst)
 SELECT deputy, CAST(coalesce(mm, 0) AS BIGINT) AS mentions_made, coalesce(od, 0) AS out_degree, CAST(coalesce(mr, 0) AS BIGINT) AS mentions_received, coalesce(id, 0) AS in_degree FROM (SELECT DISTINCT deputy FROM nm) LEFT JOIN o USING (deputy) LEFT JOIN i USING (deputy)""")
over_speeches("top_mentions", lambda s: network.top_mentions(_named(s)), _NAMED + """ SELECT src AS deputy, dst AS other, weight, CAST(row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS INTEGER) AS rank, 'mentions' AS direction FROM ed QUALIFY rank <= 5
 UNION ALL SELECT dst, src, weight, CAST(row_number() OVER (PARTITION BY dst ORDER BY weight DESC, src) AS INTEGER) AS rank, 'mentioned_by' FROM ed QUALIFY rank <= 5""")


@query("paragraphs", r"""WITH p AS (SELECT page_id, unnest(regexp_split_to_array(html, '(?i)<p(?:\s[^>]*)?>')[2:]) AS h FROM pages), t AS (SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(h, '(?is)</p>.*', ''), '<[^>]*>', '', 'g'), '\s+', ' ', 'g')) AS paragraph FROM p)
 SELECT page_id, paragraph FROM t WHERE length(paragraph) >= 10""")
def paragraphs(spark: SparkSession, d: str) -> DataFrame:
    return html_sessions.paragraphs(table(spark, d, "pages"), "page_id").select("page_id", "paragraph")


@query("roster_match", """WITH r AS (SELECT c_name AS full_name, c_mktsegment AS party FROM customer), n AS (SELECT doc_id AS speech_id, CASE WHEN doc_id % 3 = 0 THEN 'Customer#' || lpad(CAST(1 + doc_id % 2000 AS VARCHAR), 9, '0') WHEN doc_id % 3 = 1 THEN 'customer#' || lpad(CAST(1 + doc_id % 2000 AS VARCHAR), 9, '0') ELSE 'PRESIDENTE' END AS name FROM documents)
 SELECT speech_id, name, full_name AS matched, party FROM n LEFT JOIN r ON lower(n.name) = lower(r.full_name)""")
def roster_match(spark: SparkSession, d: str) -> DataFrame:
    people = table(spark, d, "customer").select(F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("party"), F.lit("").alias("profile_url"))
    number = F.lpad((1 + F.col("doc_id") % 2000).cast("string"), 9, "0")
    name = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("Customer#"), number)).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("customer#"), number)).otherwise("PRESIDENTE")
    names = table(spark, d, "documents").select(F.col("doc_id").alias("speech_id"), name.alias("name"), F.lit("").alias("party"))
    found = roster.resolve(names, people, key="speech_id")
    return found.select("speech_id", "name", "matched", F.col("roster_party").alias("party"))


@query("roster_union", """WITH u AS (SELECT c_name AS n, c_mktsegment AS p, 0 AS o FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_name, '', 1 FROM customer) SELECT n AS full_name, arg_min(p, {'a': CASE WHEN p = '' THEN 1 ELSE 0 END, 'b': o}) AS party FROM u GROUP BY n""")
def roster_union(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "customer")
    first = c.filter("c_custkey % 2 = 0").select(F.col("c_name").alias("full_name"), F.col("c_mktsegment").alias("party"), F.lit("a").alias("source"))
    second = c.select(F.col("c_name").alias("full_name"), F.lit("").alias("party"), F.lit("b").alias("source"))
    return roster.union([first, second]).select("full_name", "party")


@query("speaking_turns", "SELECT role, count(*) AS n_turns, sum(CASE WHEN switched THEN 1 ELSE 0 END)::BIGINT AS switches FROM (SELECT role, coalesce(role <> lag(role) OVER (PARTITION BY conv_id ORDER BY turn), false) AS switched FROM conversations) GROUP BY role")
def speaking_turns(spark: SparkSession, d: str) -> DataFrame:
    """Turns by role and how often the role changes; the turn before comes by an equi-join on its number."""
    c = table(spark, d, "conversations").select("conv_id", "turn", "role")
    before = c.select("conv_id", (F.col("turn") + 1).alias("turn"), F.col("role").alias("previous"))
    joined = c.join(before, ["conv_id", "turn"], "left").withColumn("switched", F.coalesce(F.col("role") != F.col("previous"), F.lit(False)))
    return joined.groupBy("role").agg(F.count("*").alias("n_turns"), F.sum(F.col("switched").cast("long")).alias("switches"))


@query("order_generalism", """WITH s AS (SELECT o_custkey AS k, o_orderpriority AS t, count(*) AS c FROM orders GROUP BY ALL), n AS (SELECT k, sum(c) AS n, count(*) AS q FROM s GROUP BY k), m AS (SELECT count(DISTINCT o_orderpriority) AS m FROM orders)
 SELECT s.k AS customer, round(100 * -sum(c / n * log2(c / n + 1e-10)) / log2(min(m)), 1) + 0.0e0 AS score, CAST(min(q) AS BIGINT) AS n_topics, CAST(min(n) AS BIGINT) AS n_speeches FROM s JOIN n USING (k) CROSS JOIN m WHERE n >= 2 GROUP BY s.k""")
def order_generalism(spark: SparkSession, d: str) -> DataFrame:
    """The same metric over other column names: customers as speakers, priorities as topics."""
    cols = Columns(id="o_orderkey", speaker="customer", topic="o_orderpriority")
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_custkey").alias("customer"), "o_orderpriority")
    return counts.generalism(o, "customer", cols).select("customer", "score", "n_topics", "n_speeches")


@query("kmeans")
def kmeans(spark: SparkSession, d: str) -> DataFrame:
    from .operators import ml

    return ml.kmeans(embedded(spark, d).drop("cluster"), 10).select("speech_id", "cluster")


@query("pca_2d")
def pca_2d(spark: SparkSession, d: str) -> DataFrame:
    from .operators import ml

    return ml.pca_2d(embedded(spark, d)).select("speech_id", "x", "y")


from . import list_queries as _  # noqa: E402, F401 - registers the queries over the real lists and whole records
