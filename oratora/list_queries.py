"""Queries over whole records, and over texts that are made of the real lists: lexicons, phrases, aliases, roles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import lexicons as L
from .functions import text as T
from .operators import counts, embeddings, network, prepare, records, temporal, texts, views
from .queries import COLS, F1, FF, LABELS, LEX, ORACLE_SQL, T0, E, S, X, feature_counts, over_speeches, over_vectors, query, quoted
from .queries import _named as named_as_members
from .sources import html_sessions
from .sources.views import embedded, speeches, table

# --- real lists -----------------------------------------------------------------------------------------------

REAL = L.LexiconSet()
LISTS = (REAL.positive, REAL.negative, REAL.pronouns, REAL.adversatives, REAL.crisis, REAL.self_reference, REAL.negation, REAL.future, REAL.past, *REAL.rhetoric.values(), *L.LEXICONS.values())
ALL_WORDS = sorted(frozenset().union(*LISTS))


def _pick(words: list[str], step: int) -> Column:
    return F.get(F.array(*map(F.lit, words)), (F.col("speech_id") * step % len(words)).cast("int"))


def _pick_sql(words: list[str], step: int) -> str:
    return f"[{', '.join(map(quoted, words))}][CAST(speech_id * {step} % {len(words)} AS INTEGER) + 1]"


def _text(pick) -> list:
    us_them = list(REAL.us_them)
    return [pick(ALL_WORDS, 7), pick(ALL_WORDS, 13), pick(ALL_WORDS, 31), pick(us_them, 1), pick(ALL_WORDS, 17), pick(ALL_WORDS, 101)]


def italian(s: DataFrame) -> DataFrame:
    """Speeches whose texts are words and phrases of all lists, by their number."""
    a, b, c, d, e, f = _text(_pick)
    made = F.concat(F.lit("Io penso: "), a, F.lit(" e "), b, F.lit(". Non "), c, F.lit(", "), d, F.lit("! "), F.initcap(e), F.lit(" "), f, F.when(F.col("speech_id") % 3 == 0, F.lit("? Il 12% di 3,5 milioni nel 2023")).otherwise(F.lit("...")))
    return s.withColumn(COLS.text, made)


_A, _B, _C, _D, _E5, _F6 = _text(_pick_sql)
#: Capitals after blanks only, as the engine's function makes them.
_INITCAP = f"array_to_string(list_transform(string_split({_E5}, ' '), lambda z: upper(z[1]) || lower(z[2:])), ' ')"
ITALIAN = f"""WITH s0 AS (SELECT doc_id AS speech_id, lang AS "group", source AS src FROM documents), s AS (SELECT speech_id, "group", "group" || '_' || src AS deputy,
 'Io penso: ' || {_A} || ' e ' || {_B} || '. Non ' || {_C} || ', ' || {_D} || '! ' || {_INITCAP} || ' ' || {_F6} || CASE WHEN speech_id % 3 = 0 THEN '? Il 12% di 3,5 milioni nel 2023' ELSE '...' END AS cleaned_text FROM s0)"""
_FEATURES = f"{ITALIAN}, {T0}, {feature_counts(REAL)}, {F1}, {FF} "
_KEPT = "n_pos n_neg n_pronouns n_adversatives n_patterns n_words n_sentences n_questions n_self n_negation n_future n_past n_numeric n_crisis n_populist n_anti_establishment n_emotional n_institutional".split()


@query("italian_features", _FEATURES + f"SELECT speech_id, {', '.join(_KEPT)}, round(sentiment, 4) AS sentiment, gulpease, readability, polarization, polarization_level, style FROM f")
def italian_features(spark: SparkSession, d: str) -> DataFrame:
    f = prepare.speech_features(italian(speeches(spark, d)), REAL)
    return f.select("speech_id", *[F.col(c).cast("long").alias(c) for c in _KEPT], F.round("sentiment", 4).alias("sentiment"), "gulpease", "readability", "polarization", "polarization_level", "style")


_PLAIN = "list_filter(regexp_split_to_array(regexp_replace(lower(cleaned_text), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+'), lambda t: t <> '')"


def _score_sql(words) -> str:
    """Hits per 100 tokens; phrases by occurrence, between blanks that stand double."""
    one = [w for w in words if " " not in w]
    hits = [f"len(list_filter(p, lambda t: t IN ({', '.join(map(quoted, sorted(one)))})))"]
    hits += [f"(length(x) - length(replace(x, {quoted(f' {w} '.replace(' ', '  ')[1:-1])}, ''))) / {len(w.replace(' ', '  ')) + 2}" for w in sorted(set(words) - set(one))]
    return f"round(100.0e0 * ({' + '.join(hits)}) / greatest(len(p), 1), 3)"


@query(
    "italian_lexicons",
    ITALIAN + f", q AS (SELECT speech_id, {_PLAIN} AS p, '  ' || regexp_replace(lower(cleaned_text), '[^\\p{{L}}\\p{{N}}_]', '  ', 'g') || '  ' AS x FROM s) SELECT speech_id, " + ", ".join(f"{_score_sql(w)} AS {k}" for k, w in L.LEXICONS.items()) + " FROM q",
)
def italian_lexicons(spark: SparkSession, d: str) -> DataFrame:
    return prepare.lexicon_scores(italian(speeches(spark, d)), L.LEXICONS).select("speech_id", *L.LEXICONS)


#: A text for each formal phrase, as its pattern allows.
SAID = (
    "Grazie, Presidente", "signora Presidente", "ho facoltà di parlare", "Dichiaro aperta la seduta", "dichiaro chiusa la seduta", "La seduta è aperta", "la seduta è chiusa", "Prego, onorevole",
    "Onorevoli colleghi", "Colleghe e colleghi", "la parola all onorevole", "Passiamo al punto successivo", "Do lettura del", "procediamo con la votazione",
)
_SPOKEN = f"{_pick_sql(list(SAID), 1)} || ', inizio con ' || {_pick_sql(ALL_WORDS, 3)} || '.  ' || {_pick_sql(list(SAID), 5)} || ' e basta'"


@query("italian_cleaning", f"WITH s AS (SELECT doc_id AS speech_id FROM documents) SELECT speech_id, trim(regexp_replace({'regexp_replace(' * len(L.PROCEDURAL)}lower({_SPOKEN})" + "".join(f", {quoted(p)}, '', 'g')" for p in L.PROCEDURAL) + r", '\s+', ' ', 'g')) AS cleaned FROM s")
def italian_cleaning(spark: SparkSession, d: str) -> DataFrame:
    said = list(SAID)
    spoken = F.concat(_pick(said, 1), F.lit(", inizio con "), _pick(ALL_WORDS, 3), F.lit(".  "), _pick(said, 5), F.lit(" e basta"))
    return speeches(spark, d).select("speech_id", T.clean_text(spoken).alias("cleaned"))


PARTIES = sorted({*L.PARTY_ALIASES, *L.PARTY_ALIASES.values(), *L.LEFT, *L.RIGHT, *L.CENTER, *L.UNKNOWN_PARTIES, "Un altro gruppo"})
_PARTY = _pick_sql(PARTIES, 1)


def _listed(words) -> str:
    return ", ".join(map(quoted, sorted(words)))


@query(
    "italian_parties",
    f"WITH s AS (SELECT doc_id AS speech_id FROM documents), p AS (SELECT speech_id, {_PARTY} AS party FROM s) SELECT speech_id, CASE party " + " ".join(f"WHEN {quoted(a)} THEN {quoted(b)}" for a, b in L.PARTY_ALIASES.items()) + f""" ELSE party END AS normal,
 CASE WHEN party IN ({_listed(L.LEFT)}) THEN 'left' WHEN party IN ({_listed(L.RIGHT)}) THEN 'right' WHEN party IN ({_listed(L.CENTER)}) THEN 'center' ELSE 'other' END AS coalition, party NOT IN ('?', 'Unknown Group', '') AS known FROM p""",
)
def italian_parties(spark: SparkSession, d: str) -> DataFrame:
    p = speeches(spark, d).select("speech_id", _pick(PARTIES, 1).alias("party"))
    return p.select("speech_id", T.normalise_party(F.col("party")).alias("normal"), T.coalition(F.col("party")).alias("coalition"), T.known_party(F.col("party")).alias("known"))


ROLES = sorted(L.ROLES)
_ROLE = _pick_sql([r.title() for r in ROLES], 1)


def _category_sql(role: str) -> str:
    cases = " ".join(f"WHEN {' OR '.join(f'contains({role}, {quoted(r)})' for r in sorted(roles))} THEN '{name}'" for name, roles in L.ROLE_CATEGORIES.items())
    return f"CASE {cases} ELSE 'altro' END"


@query("italian_roles", f"WITH s AS (SELECT doc_id AS speech_id FROM documents), p AS (SELECT speech_id, lower({_ROLE}) AS role FROM s) SELECT speech_id, role, {_category_sql('role')} AS category FROM p")
def italian_roles(spark: SparkSession, d: str) -> DataFrame:
    p = speeches(spark, d).select("speech_id", _pick([r.title() for r in ROLES], 1).alias("r"))
    return p.select("speech_id", T.normalise_role(F.col("r")).alias("role"), T.role_category(F.col("r")).alias("category"))


# --- session pages --------------------------------------------------------------------------------------------

#: A page of one paragraph per document, in the four forms of a senate transcript.
_SAID = "regexp_replace(lower(text), '[^a-z ]+', ' ', 'g')"


@query(
    "senate_pages",
    f"""WITH t AS (SELECT doc_id, {_SAID} AS said FROM documents), c AS (SELECT doc_id, trim(regexp_replace(said, '\\s+', ' ', 'g')) AS said FROM t), l AS (SELECT * FROM c WHERE length(said) > 0)
 SELECT doc_id AS page_id, CASE doc_id % 4 WHEN 0 THEN 'ROSSI' WHEN 1 THEN 'PRESIDENTE' WHEN 2 THEN 'DE BIANCHI' ELSE 'VERDI' END AS speaker, CASE doc_id % 4 WHEN 0 THEN 'PD-IDP' ELSE '' END AS party,
 CASE doc_id % 4 WHEN 1 THEN 'presidente' WHEN 2 THEN 'ministro' ELSE '' END AS role, CASE doc_id % 4 WHEN 1 THEN 'presidenza' WHEN 2 THEN 'governo' ELSE '' END AS role_category, said AS text FROM l WHERE length(said) > 30""",
)
def senate_pages(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    said = F.regexp_replace(F.lower("text"), "[^a-z ]+", " ")
    i = F.col("doc_id") % 4
    opening = F.when(i == 0, "ROSSI (<b>PD-IDP</b>). ").when(i == 1, "PRESIDENTE. ").when(i == 2, "DE BIANCHI, <i>ministro</i> dell&#39;interno. ").otherwise("VERDI. ")
    pages = docs.select(F.col("doc_id").cast("string").alias("url"), F.lit("2024-01-01").alias("date"), F.concat(F.lit('<html><div class="ressten"><P CLASS="x">'), opening, said, F.lit(" (Applausi)</p><p>no</p></div></html>")).alias("html"))
    return html_sessions.senate_speeches(pages).select(F.col("url").cast("long").alias("page_id"), "speaker", "party", "role", "role_category", "text")


# --- whole records --------------------------------------------------------------------------------------------


def _vectors_of(e: DataFrame) -> dict[str, DataFrame]:
    return {"consistency": embeddings.consistency(e), "leadership": embeddings.topic_leadership(e)}


@query(
    "speaker_record",
    f"""SELECT deputy, v.total_words, v.avg_words, l.question_rate, l.orientation, c.consistency, c.label AS consistency_label, t.cluster AS leading_cluster, t.similarity, i.active_months, i.avg_per_month, i.regularity, o.vocabulary_size, o.ttr
 FROM ({ORACLE_SQL["verbosity_speaker"]}) v FULL JOIN ({ORACLE_SQL["linguistic_speaker"]}) l USING (deputy) FULL JOIN ({ORACLE_SQL["consistency_index"]}) c USING (deputy) FULL JOIN ({ORACLE_SQL["topic_leadership"]}) t USING (deputy)
 FULL JOIN ({ORACLE_SQL["intervention_patterns"]}) i USING (deputy) FULL JOIN ({ORACLE_SQL["vocabulary_speaker"]}) o USING (deputy)""",
)
def speaker_record(spark: SparkSession, d: str) -> DataFrame:
    s = speeches(spark, d)
    f = prepare.speech_features(s, LEX)
    whole = records.speaker_record({"v": texts.verbosity(f), "l": texts.linguistic(f), **{k[0]: t for k, t in _vectors_of(embedded(spark, d)).items() if k == "consistency"}, "t": embeddings.topic_leadership(embedded(spark, d)), "i": temporal.interventions(s), "o": texts.vocabulary(s)})
    return whole.select(
        "deputy", "v.total_words", "v.avg_words", "l.question_rate", "l.orientation", "c.consistency", F.col("c.label").alias("consistency_label"), F.col("t.cluster").alias("leading_cluster"), "t.similarity", "i.active_months", "i.avg_per_month", "i.regularity", "o.vocabulary_size", "o.ttr"
    )


over_speeches(
    "deputy_records",
    lambda s: records.deputy_records(s.withColumn("role", F.when(F.col("speech_id") % 3 == 0, "").when(F.col("speech_id") % 3 == 1, "ministro").otherwise("questore")).withColumn("x", (F.col("speech_id") % 10).cast("double")).withColumn("y", -(F.col("speech_id") % 7).cast("double")), counts.rebel_scores(s), LABELS),
    """, g AS (SELECT *, 'global' AS grain, '' AS period FROM s UNION ALL SELECT *, 'year', CAST(year(date) AS VARCHAR) FROM s UNION ALL SELECT *, 'month', strftime(date, '%Y-%m') FROM s),
 z AS (SELECT grain, period, count(*) AS size FROM g GROUP BY ALL), r AS (SELECT g.* FROM g JOIN z USING (grain, period) WHERE grain = 'global' OR (grain = 'year' AND size >= 10) OR (grain = 'month' AND size >= 5)),
 t AS (SELECT grain, period, deputy, cluster, count(*) AS c FROM r GROUP BY ALL), b AS (SELECT grain, period, deputy, arg_min(cluster, {'a': -c, 'b': cluster}) AS cluster FROM t GROUP BY grain, period, deputy),
 ro AS (SELECT grain, period, deputy, CASE speech_id % 3 WHEN 1 THEN 'ministro' ELSE 'questore' END AS role, count(*) AS c FROM r WHERE speech_id % 3 <> 0 GROUP BY ALL), rr AS (SELECT grain, period, deputy, arg_min(role, {'a': -c, 'b': role}) AS role FROM ro GROUP BY grain, period, deputy),
 mc AS (SELECT "group", cluster, count(*) AS c FROM s GROUP BY ALL), m AS (SELECT "group", arg_min(cluster, {'a': -c, 'b': cluster}) AS main FROM mc GROUP BY "group"),
 rb AS (SELECT deputy, round(CAST(sum(CASE WHEN cluster = main THEN 0 ELSE 1 END) AS DOUBLE) / count(*) * 100, 1) AS rebel_pct FROM s JOIN m USING ("group") GROUP BY deputy HAVING count(*) >= 3),
 a AS (SELECT grain, period, deputy, arg_min("group", speech_id) AS "group", arg_min(source, speech_id) AS source, count(*) AS n_speeches, CAST(sum(speech_id % 10) AS DOUBLE) / count(*) AS x, CAST(-sum(speech_id % 7) AS DOUBLE) / count(*) + 0.0e0 AS y FROM r GROUP BY grain, period, deputy)
 SELECT grain, period, deputy, deputy AS name, "group", coalesce(role, '') AS role, source, n_speeches, b.cluster, CASE b.cluster WHEN 0 THEN 'Zero' WHEN 1 THEN 'One' WHEN 2 THEN 'Two' ELSE 'Cluster ' || b.cluster END AS cluster_label, coalesce(rebel_pct, 0.0e0) AS rebel_pct, x, y
 FROM a JOIN b USING (grain, period, deputy) LEFT JOIN rr USING (grain, period, deputy) LEFT JOIN rb USING (deputy)""",
)

# --- searches, rankings, projections --------------------------------------------------------------------------

query("speaker_stats_search", f"SELECT * FROM ({ORACLE_SQL['verbosity_speaker']}) WHERE contains(lower(deputy), 'en_') ORDER BY avg_words DESC, deputy LIMIT 20")(
    lambda spark, d: views.search(texts.verbosity(prepare.speech_features(speeches(spark, d), LEX)), "EN_", ["deputy"], [F.desc("avg_words"), F.asc("deputy")], 20)
)
over_vectors("cohesion_ranking", lambda e: views.ranked(embeddings.cohesion(e).select("group", "cohesion"), "cohesion", "group", 20), f"""SELECT "group", cohesion, CAST(row_number() OVER (ORDER BY cohesion DESC, "group") AS INTEGER) AS rank FROM ({ORACLE_SQL["party_cohesion"]})""")
ORACLE_SQL["cohesion_ranking"] = ORACLE_SQL["cohesion_ranking"].removeprefix(f"WITH {S}, {E}, {X} ")
over_vectors(
    "topic_projection",
    lambda e: views.projection(embeddings.assign_topics(e.drop("cluster"), embeddings.topic_centroids(e).select(F.col("cluster").alias("topic"), F.col("centroid").alias("vector"))), 0, 3).select("speech_id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y")),
    """, tc AS (SELECT cluster, pos, avg(x) AS c FROM x GROUP BY ALL), sc AS (SELECT speech_id, tc.cluster, coalesce(sum(x * c) / nullif(sqrt(sum(x * x)) * sqrt(sum(c * c)), 0), 0) AS s FROM x JOIN tc USING (pos) GROUP BY ALL)
 SELECT speech_id, round(max(CASE WHEN cluster = 0 THEN s END), 4) + 0.0e0 AS x, round(max(CASE WHEN cluster = 3 THEN s END), 4) + 0.0e0 AS y FROM sc GROUP BY speech_id""",
)
over_speeches("points_by_group", lambda s: views.points_by(s.withColumn("x", F.col("speech_id") % 10).withColumn("y", F.col("speech_id") % 7), COLS.party), """ SELECT "group", speech_id, speech_id % 10 AS x, speech_id % 7 AS y, CAST(row_number() OVER (PARTITION BY "group" ORDER BY speech_id) AS INTEGER) AS place FROM s""")
