"""Hand-computed cases: thresholds, ties, names, dates, parsing."""

import datetime as dt
import time

import pytest
from pyspark.sql import functions as F

from oratora.functions import dates, text as T
from oratora.functions.lexicons import LexiconSet
from oratora.operators import counts, embeddings, network, prepare, temporal, texts
from oratora.schemas import SPEECH_SCHEMA, conform
from oratora.sources import html_sessions, roster


def values(df, column, name):
    return [r[0] for r in df.select(column.alias("c")).collect()] if name is None else None


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t"))).first()[0]


def times_split(df):
    """How often the plan splits the lower-cased texts."""
    return df._jdf.queryExecution().optimizedPlan().toString().count("split(lower(coalesce(cleaned_text")


def speeches(spark, rows):
    return spark.createDataFrame(rows, "speech_id long, deputy string, `group` string, cluster int, date string, cleaned_text string")


@pytest.mark.parametrize("text,want", [("Grazie, Presidente. Dico  questo.", ". dico questo."), (None, ""), ("", ""), ("La seduta è aperta", "")])
def test_clean_text(spark, text, want):
    assert one(spark, text, T.clean_text) == want


def test_two_tokenisers(spark):
    assert one(spark, "La crisi, l'élite!", T.tokens_punct) == ["la", "crisi", "l", "élite"]
    assert one(spark, "La crisi, ora", T.tokens_ws) == ["la", "crisi,", "ora"]
    assert one(spark, "  ", T.tokens_ws) == []


@pytest.mark.parametrize("text,want", [("a. b! c?", 3), ("", 1), ("...", 1), ("uno", 1)])
def test_sentences(spark, text, want):
    assert one(spark, text, T.n_sentences) == want


@pytest.mark.parametrize(
    "text,want",
    [("2024-03-09", dt.date(2024, 3, 9)), ("9/3/2024", dt.date(2024, 3, 9)), ("09-03-2024", dt.date(2024, 3, 9)), ("2024/3/9", dt.date(2024, 3, 9)), ("9 March 2024", dt.date(2024, 3, 9)), ("9 mar 2024", dt.date(2024, 3, 9)), ("seduta del 9 marzo 2024", dt.date(2024, 3, 9)), ("31/02/2024", None), ("ieri", None), (None, None)],
)
def test_dates(spark, text, want):
    assert one(spark, text, dates.parse_date) == want


def test_week_key_has_the_calendar_year(spark):
    assert one(spark, "2024-12-30", lambda c: dates.period_key(dates.parse_date(c), "week")) == "2024-W01"


@pytest.mark.parametrize("text,want", [("ROSSI  MARIO", "Rossi Mario"), ("de Luca", "de Luca"), ("Rossi", "Rossi")])
def test_names(spark, text, want):
    assert one(spark, text, T.normalise_name) == want


@pytest.mark.parametrize("text,want", [("Ministro della salute", "governo"), ("presidente", "presidenza"), ("Presidente del Consiglio", "governo"), ("relatore", "ufficio"), ("altro", "altro"), (None, "altro")])
def test_role_category(spark, text, want):
    assert one(spark, text, T.role_category) == want


def test_longest_role_first():
    pattern = T.role_pattern()
    assert pattern.index(r"presidente\s+del\s+consiglio\s+dei") < pattern.index("|presidente|")


def test_features_by_hand(spark):
    s = speeches(spark, [(1, "A", "P", 0, "2024-01-01", "Noi e loro: crescita, crescita e crisi. Nessuno?"), (2, "A", "P", 0, "2024-01-02", "")])
    f = {r.speech_id: r for r in prepare.speech_features(s).collect()}
    a, empty = f[1], f[2]
    assert (a.n_pos, a.n_neg, a.n_pronouns, a.n_patterns, a.n_questions) == (2, 1, 2, 1, 1)
    assert a.sentiment == pytest.approx(1 / 3)
    assert a.polarization == 100.0  # (2 + 3) / 9 * 500, cut at 100
    assert a.n_crisis == 0 and a.n_negation == 0  # punctuation stays on in the plain tokeniser
    assert (empty.sentiment, empty.gulpease, empty.readability, empty.style) == (0.0, 0.0, "n/a", "neutrale")


def test_numeric_hits_leftmost(spark):
    s = speeches(spark, [(1, "A", "P", 0, None, "Nel 2024 il 30% di 5 milioni, 3,5 e € 7")])
    assert prepare.speech_features(s).first().n_numeric == 5


def test_generalism_bounds(spark):
    rows = [(i, "A", "P", i % 4, None, "x") for i in range(8)] + [(10 + i, "B", "P", 0, None, "x") for i in range(3)] + [(20, "C", "P", 1, None, "x")]
    got = {r.deputy: r for r in counts.generalism(speeches(spark, rows), "deputy").collect()}
    assert got["A"].score == 100.0 and got["A"].label == "generalista"
    assert got["B"].score == 0.0 and got["B"].label == "specialista"
    assert "C" not in got  # one speech is too few


def test_rebel_needs_three_speeches_and_a_known_party(spark):
    rows = [(i, "A", "P", 0, None, "x") for i in range(4)] + [(10 + i, "B", "P", 1, None, "x") for i in range(3)] + [(20 + i, "C", "Unknown Group", 1, None, "x") for i in range(3)]
    got = {r.deputy: r.rebel_pct for r in counts.rebel_scores(speeches(spark, rows)).collect()}
    assert got == {"A": 0.0, "B": 100.0}


def test_overlap_types(spark):
    rows = [(i, "A", p, c, None, "x") for i, (p, c) in enumerate([("PD", 0), ("Lega", 0), ("PD", 1), ("PD", 1), ("Governo", 2), ("Altri", 3)])]
    got = {r.cluster: r.type for r in counts.overlap(speeches(spark, rows)).collect()}
    assert got == {0: "bipartisan", 1: "left-dominated", 2: "right-dominated", 3: "mixed"}


def test_surfing_by_hand(spark):
    rows = [(i, "A", "P", c, f"2024-{m:02d}-01", "x") for i, (m, c) in enumerate([(1, 0), (1, 0), (2, 1), (3, 1), (4, 0)])]
    r = temporal.surfing(speeches(spark, rows)).first()
    assert (r.n_periods, r.changes, r.consistency, r.top_destination) == (4, 2, 33.3, 0)


def test_mentions(spark):
    rows = [(1, "ROSSI Mario [P]", "P", 0, None, "Dico a Bianchi, e a BIANCHI. Rossi sono io"), (2, "BIANCHI Anna [Q]", "Q", 0, None, "rossi sbaglia"), (3, "D'ALEMA M", "Q", 0, None, "niente"), (4, "BIANCHI Anna [Q]", "Q", 0, None, "come D'Alema")]
    got = {(r.src, r.dst): r.weight for r in network.mention_edges(speeches(spark, rows)).collect()}
    assert got == {("ROSSI Mario [P]", "BIANCHI Anna [Q]"): 2, ("BIANCHI Anna [Q]", "ROSSI Mario [P]"): 1, ("BIANCHI Anna [Q]", "D'ALEMA M"): 1}


def test_mentions_of_a_surname_of_many_parts(spark):
    rows = [(1, "ROSSI M", "P", 0, None, "a-b-c-d, A B C D; a b c. Verdi? A-B-C-D"), (2, "A-B-C-D X", "Q", 0, None, "rossi d'alema rossi-verdi a"), (3, "ROSSI-VERDI Y", "Q", 0, None, ""), (4, "D'ALEMA M", "Q", 0, None, None)]
    got = {(r.src, r.dst): r.weight for r in network.mention_edges(speeches(spark, rows)).collect()}
    assert got == {("ROSSI M", "A-B-C-D X"): 3, ("A-B-C-D X", "ROSSI M"): 2, ("A-B-C-D X", "ROSSI-VERDI Y"): 1, ("A-B-C-D X", "D'ALEMA M"): 1}


def test_mentions_in_a_long_text_take_time_in_proportion(spark):
    rows = [(1, "ROSSI M", "P", 0, None, "parola d'alema bianchi " * 5_000), (2, "BIANCHI A", "Q", 0, None, ""), (3, "D'ALEMA M", "Q", 0, None, "")]
    began = time.time()
    got = {(r.src, r.dst): r.weight for r in network.mention_edges(speeches(spark, rows)).collect()}
    assert got == {("ROSSI M", "BIANCHI A"): 5_000, ("ROSSI M", "D'ALEMA M"): 5_000}
    assert time.time() - began < 30  # several minutes if the text is split again at each word


def test_mention_network_by_hand_reads_the_texts_once(spark):
    rows = [(1, "ROSSI M", "P", 0, None, "bianchi verdi bianchi"), (2, "BIANCHI A", "Q", 0, None, "rossi"), (3, "VERDI G", "Q", 0, None, "verdi"), (4, "NERI L", "Q", 0, None, None)]
    df = network.mention_network(speeches(spark, rows))
    assert {tuple(r) for r in df.collect()} == {("ROSSI M", 3, 2, 1, 1), ("BIANCHI A", 1, 1, 2, 1), ("VERDI G", 0, 0, 1, 1), ("NERI L", 0, 0, 0, 0)}
    assert times_split(df) == 1


def test_top_mentions_by_hand_read_the_texts_once(spark):
    rows = [(1, "ROSSI M", "P", 0, None, "bianchi verdi bianchi neri"), (2, "BIANCHI A", "Q", 0, None, "verdi"), (3, "VERDI G", "Q", 0, None, ""), (4, "NERI L", "Q", 0, None, None)]
    df = network.top_mentions(speeches(spark, rows), k=2)
    assert {tuple(r) for r in df.collect()} == {
        ("ROSSI M", "BIANCHI A", 2, 1, "mentions"), ("ROSSI M", "NERI L", 1, 2, "mentions"), ("BIANCHI A", "VERDI G", 1, 1, "mentions"),
        ("BIANCHI A", "ROSSI M", 2, 1, "mentioned_by"), ("VERDI G", "BIANCHI A", 1, 1, "mentioned_by"), ("VERDI G", "ROSSI M", 1, 2, "mentioned_by"), ("NERI L", "ROSSI M", 1, 1, "mentioned_by"),
    }
    assert times_split(df) == 1


def test_affinity_is_symmetric(spark):
    df = spark.createDataFrame([(i, f"S{i % 4}", f"P{i % 3}", i % 2, "2024-01-01", [float(i), 1.0, float(i % 5)]) for i in range(30)], "speech_id long, deputy string, `group` string, cluster int, date string, embedding array<double>")
    m = {(r.party1, r.party2): r.affinity for r in embeddings.affinity_matrix(df).collect()}
    assert len(m) == 9 and all(m[a, b] == m[b, a] for a, b in m) and all(m[p, p] == 1 for p, _ in m)
    assert all(-1 <= r.similarity <= 1 for r in embeddings.fingerprint(df, "deputy").collect())


def test_zero_centroid_of_an_empty_topic(spark):
    df = spark.createDataFrame([(1, "A", "P", 0, [1.0, 0.0])], "speech_id long, deputy string, `group` string, cluster int, embedding array<double>")
    got = {r.cluster: r.centroid for r in embeddings.topic_centroids(df, n_topics=2, size=2).collect()}
    assert got == {0: [1.0, 0.0], 1: [0.0, 0.0]}


def test_gulpease_of_a_tie_is_half_up(spark):
    rows = [(1, "A", "P", 0, None, "abcdef " * 199 + "x" * 95)]  # 89 + (300 - 12890) / 200 = 26.05, as a double 26.049999999999997
    r = texts.readability_speech(prepare.speech_features(speeches(spark, rows))).first()
    assert (r.n_sentences, r.n_words, r.n_letters, r.gulpease) == (1, 200, 1289, 26.1)


def test_vocabulary_thresholds(spark):
    rows = [(1, "A", "P", 0, None, " ".join(f"w{i}" for i in range(30))), (2, "A", "P", 0, None, " ".join(f"w{i}" for i in range(30))), (3, "B", "P", 0, None, "pochi")]
    got = texts.vocabulary(speeches(spark, rows)).collect()
    assert [(r.deputy, r.ttr, r.hapax_ratio, r.label) for r in got] == [("A", 0.5, 0.0, "ricco")]


SENATE = "<div class='ressten'><p>ROSSI (PD-IDP). Signor Presidente, intervengo su questo importante provvedimento (Applausi) oggi.</p><p>PRESIDENTE. Ha facoltà di parlare il senatore che ne ha fatto richiesta.</p><p>NORDIO, ministro della giustizia. Rispondo volentieri alle domande poste dai senatori.</p><p>breve</p></div>"


def test_senate_page(spark):
    pages = spark.createDataFrame([("u", SENATE, "2024-01-01")], "url string, html string, date string")
    got = html_sessions.senate_speeches(pages).orderBy("number").collect()
    assert [(r.speaker, r.party, r.role_category) for r in got] == [("ROSSI", "PD-IDP", ""), ("PRESIDENTE", "", "presidenza"), ("NORDIO", "", "governo")]
    assert got[0].notes == ["Applausi"] and "(" not in got[0].text
    table = html_sessions.as_speech_table(html_sessions.senate_speeches(pages), "senate").collect()
    assert {(r.deputy, r.group) for r in table} == {("ROSSI [PD-IDP]", "PD-IDP"), ("NORDIO", "Governo")}


def test_senate_page_with_roster(spark):
    pages = spark.createDataFrame([("u", SENATE, "2024-01-01")], "url string, html string, date string")
    people = spark.createDataFrame([("Rossi Mario", "PD", "http://x")], "full_name string, party string, profile_url string")
    got = {r.speaker: r.party for r in html_sessions.senate_speeches(pages, people).collect()}
    assert got == {"Rossi Mario": "PD", "PRESIDENTE": "", "NORDIO": ""}


def test_chamber_page(spark):
    html = "<div class='sezione'><p><a href='x'>Mario Rossi</a> (PD). Onorevoli colleghi, questo provvedimento (Applausi) va approvato subito.</p><p>SISTO, Sottosegretario di Stato per la giustizia. Il parere del Governo è favorevole.</p><p>Concludo dicendo, ministro della giustizia. Questo non è un intervento.</p></div>"
    got = html_sessions.chamber_speeches(spark.createDataFrame([("u", html, "2024-01-01")], "url string, html string, date string")).orderBy("number").collect()
    assert [(r.speaker, r.party, r.role_category) for r in got] == [("Mario Rossi", "PD", ""), ("SISTO", "", "governo")]


def test_empty_pages(spark):
    pages = spark.createDataFrame([("u", "", "2024-01-01"), ("v", None, None)], "url string, html string, date string")
    assert html_sessions.senate_speeches(pages).count() == 0 and html_sessions.chamber_speeches(pages).count() == 0


def test_sessions(spark):
    html = "<a href='/show-doc?tipodoc=Resaula&id=12'>Seduta n. 3 del 9 marzo 2024</a> <a href='/show-doc?tipodoc=Resaula&id=12'>di nuovo</a> del 9 marzo 2024 <a href='/x?idSeduta=0007'>seduta</a>"
    pages = spark.createDataFrame([(html,)], "html string")
    assert sorted((r.id, r.date) for r in html_sessions.senate_sessions(pages).collect()) == [("12", "2024-03-09"), ("12", "2024-03-09")]
    assert [r.id for r in html_sessions.chamber_sessions(pages).collect()] == ["0007"]
    kept = html_sessions.date_window(spark.createDataFrame([("2020-01-01",), ("Unknown",), ("2024-03-01",)], "date string"), 1, F.lit("2024-03-09").cast("date"))
    assert {r.date for r in kept.collect()} == {"Unknown", "2024-03-01"}


def test_roster(spark):
    people = spark.createDataFrame([("Conte Giuseppe", "M5S", "u1"), ("Rossi Mario", "PD", "u2"), ("Rossi Anna", "Lega", "u3")], "full_name string, party string, profile_url string")
    names = spark.createDataFrame([(1, "Giuseppe Conte", ""), (2, "ROSSI", "Lega"), (3, "ROSSI", ""), (4, "PRESIDENTE", ""), (5, "rossi mario", ""), (6, "Verdi", "")], "k long, name string, party string")
    got = {r.k: r.matched for r in roster.resolve(names, people, "k").collect()}
    assert got == {1: "Conte Giuseppe", 2: "Rossi Anna", 3: "Rossi Anna", 4: None, 5: "Rossi Mario", 6: None}


def test_roster_pages(spark):
    html = "<a href='schedaDeputato?id=1'>ROSSI MARIO</a><a href='gruppo?x'>PD</a><a href='schedaDeputato?id=2'>BIANCHI ANNA</a>"
    got = sorted((r.full_name, r.party) for r in roster.chamber_roster(spark.createDataFrame([(html,)], "html string")).collect())
    assert got == [("Bianchi Anna", ""), ("Rossi Mario", "PD")]


def test_conform(spark):
    df = conform(spark.createDataFrame([("x",)], "text string"))
    assert df.columns == SPEECH_SCHEMA.names and df.first().role is None
    with pytest.raises(ValueError):
        conform(spark.createDataFrame([("x",)], "other string"))


def test_lexicons_are_parameters(spark):
    s = speeches(spark, [(1, "A", "P", 0, None, "alfa beta")])
    assert prepare.speech_features(s, LexiconSet(positive=frozenset({"alfa"}))).first().n_pos == 1


def test_kmeans_keeps_the_cheapest_of_its_starts(spark, sf_dir):
    import numpy as np

    from oratora.operators import ml
    from oratora.sources.views import embedded

    rows = embedded(spark, sf_dir).drop("cluster")

    def cost(starts):
        found = ml.kmeans(rows, 5, starts=starts).select("embedding", "cluster").collect()
        x, c = np.array([r.embedding for r in found]), np.array([r.cluster for r in found])
        assert set(c) <= set(range(5)) and len(found) == rows.count()
        return sum(((x[c == k] - x[c == k].mean(0)) ** 2).sum() for k in set(c))

    assert cost(4) <= cost(1) * (1 + 1e-9)


def test_projection_is_centred_and_uncorrelated(spark, sf_dir):
    import numpy as np

    from oratora.operators import ml
    from oratora.sources.views import embedded

    found = ml.pca_2d(embedded(spark, sf_dir)).select("embedding", "x", "y").collect()
    xy, x = np.array([(r.x, r.y) for r in found]), np.array([r.embedding for r in found], float)
    assert np.allclose(xy.mean(0), 0, atol=1e-6) and abs(np.corrcoef(xy.T)[0, 1]) < 1e-6
    top = np.sort(np.linalg.eigvalsh(np.cov(x.T)))[::-1][:2]
    assert np.allclose(xy.var(0, ddof=1), top, rtol=1e-6)


def test_stopwords_are_function_words(tmp_path):
    from oratora.functions import lexicons as L

    assert {"della", "negli", "sono", "che", "avrebbero"} <= L.LexiconSet().stopwords and "governo" not in L.LexiconSet().stopwords
    (tmp_path / "own.txt").write_text("Parola, altra  # remark\n\nTerza", encoding="utf-8")
    assert L.read_words(str(tmp_path / "own.txt")) == {"parola", "altra", "terza"}


def test_character_references(spark):
    import html

    from pyspark.sql import functions as F

    from oratora.sources import html_sessions as H

    texts = ["perch&eacute; l&#39;Italia &amp;agrave; &Egrave; &#x20AC; 5", "&#128512; &hellip;", "a & b &unknownname; &amp;", "", "citt&agrave;&nbsp;&laquo;s&igrave;&raquo;", "&lt;p&gt; &#0; x;y"]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(H.unescape(F.col("t"))).collect()]
    assert got[:2] + got[3:5] == [html.unescape(t).replace("\xa0", " ") for t in texts[:2] + texts[3:5]]
    assert got[2] == "a & b &unknownname; &" and got[5] == "<p> &#0; x;y"


def test_roster_is_stored_and_fresh(spark, tmp_path):
    from pyspark.sql import functions as F

    from oratora.sources import roster

    df = spark.createDataFrame([("Rossi Anna", "PD", "u", "camera"), ("Bianchi Ugo", "", "v", "senate")], "full_name string, party string, profile_url string, source string")
    path = str(tmp_path / "roster")
    assert roster.load(spark, path, 19) is None
    roster.save(df, path, 19)
    assert sorted(r.full_name for r in roster.load(spark, path, 19).collect()) == ["Bianchi Ugo", "Rossi Anna"]
    assert roster.load(spark, path, 18) is None
    assert roster.load(spark, path, 19, today=F.date_add(F.current_timestamp(), 31)) is None
