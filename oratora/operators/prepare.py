"""From raw speeches to the analysis table: filters, cleaning, party names, shared feature columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import lexicons as L
from ..functions import text as T
from ..schemas import Columns

COLS = Columns()


def drop_presidency(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Without rows of the presidency: by party, then by PRESIDENTE in the name; null names stay."""
    return df.filter(F.coalesce(F.col(cols.party), F.lit("")) != "Presidenza").filter(~F.coalesce(F.contains(F.upper(cols.speaker), F.lit("PRESIDENTE")), F.lit(False)))


def min_words(df: DataFrame, least: int = 30, cols: Columns = COLS) -> DataFrame:
    return df.filter(T.n_words(F.col(cols.text)) >= least)


def known_parties(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    return df.filter(T.known_party(F.col(cols.party)))


def derive_group(party: Column, category: Column) -> Column:
    """The party; without one Governo for government roles, Presidenza for any other role, else unknown."""
    none = F.coalesce(party, F.lit("")) == ""
    return F.when(~none, party).when(category == "governo", "Governo").when(F.coalesce(category, F.lit("")) != "", "Presidenza").otherwise(L.UNKNOWN_PARTY)


def speaker_key(speaker: Column, party: Column, group: Column) -> Column:
    """``speaker [party]`` unless the party is missing or the group is Presidenza or Governo."""
    return F.when((F.coalesce(party, F.lit("")) != "") & ~group.isin("Presidenza", "Governo"), F.concat(speaker, F.lit(" ["), party, F.lit("]"))).otherwise(speaker)


def prepare(df: DataFrame, raw_text: str = "text", least_words: int = 30, cols: Columns = COLS) -> DataFrame:
    """The whole preparation: presidency out, text cleaned, short and partyless speeches out, party names unified."""
    kept = drop_presidency(df, cols).withColumn(cols.text, T.clean_text(F.col(raw_text)))
    return known_parties(min_words(kept, least_words, cols), cols).withColumn(cols.party, T.normalise_party(F.col(cols.party)))


def with_time(df: DataFrame, cols: Columns = COLS) -> DataFrame:
    """Adds the parsed date and the keys year, month and week."""
    d = dates.as_date(df, cols.date)
    return df.withColumn("parsed_date", d).withColumns({"year": F.year("parsed_date"), "month": dates.period_key(F.col("parsed_date")), "week": dates.period_key(F.col("parsed_date"), "week")})


def speech_features(df: DataFrame, lexicons: L.LexiconSet | None = None, cols: Columns = COLS) -> DataFrame:
    """One row per speech with every per-speech text measure; what the text metrics group.

    Both token arrays are made once and read by all counts.
    """
    x = lexicons or L.LexiconSet()
    text = F.col(cols.text)
    base = df.withColumns({"__p": T.tokens_punct(text), "__w": T.tokens_ws(text)})
    p, w = F.col("__p"), F.col("__w")
    counts = {
        "n_tokens": F.size(p), "n_pos": T.lexicon_count(p, x.positive), "n_neg": T.lexicon_count(p, x.negative),
        "n_pronouns": T.lexicon_count(p, x.pronouns), "n_adversatives": T.lexicon_count(p, x.adversatives), "n_patterns": T.contains_any(text, x.us_them),
        "n_words": F.size(w), "n_sentences": T.n_sentences(text), "n_questions": F.length(F.coalesce(text, F.lit(""))) - F.length(F.replace(F.coalesce(text, F.lit("")), F.lit("?"), F.lit(""))),
        "n_self": T.lexicon_count(w, x.self_reference), "n_negation": T.lexicon_count(w, x.negation), "n_future": T.lexicon_count(w, x.future), "n_past": T.lexicon_count(w, x.past),
        "n_numeric": F.regexp_count(F.coalesce(text, F.lit("")), F.lit("(?i)" + L.NUMERIC)), "n_crisis": T.lexicon_count(w, x.crisis),
        "g_words": F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"[\p{L}\p{N}_]+")), "g_letters": T.n_letters(text),
        **{f"n_{k}": T.lexicon_count(p, v) for k, v in x.rhetoric.items()},
    }
    out = base.withColumns(counts)
    sentiment = F.coalesce((F.col("n_pos") - F.col("n_neg")) / F.nullif(F.col("n_pos") + F.col("n_neg"), F.lit(0)), F.lit(0.0))
    gulpease = 89 + (300 * F.col("n_sentences") - 10 * F.col("g_letters")) / F.nullif(F.col("g_words"), F.lit(0))
    raw = F.col("n_pronouns") + 2 * F.col("n_adversatives") + 3 * F.col("n_patterns")
    clamp = lambda c: F.greatest(F.lit(0.0), F.least(F.lit(100.0), c))
    per = lambda k: 100 * F.col(f"n_{k}") / F.greatest(F.col("n_tokens"), F.lit(1))
    out = out.withColumns({
        "sentiment": sentiment,
        "gulpease_raw": F.when(F.col("g_words") == 0, F.lit(0.0)).otherwise(clamp(gulpease)),
        "polarization_raw": clamp(raw / F.greatest(F.col("n_tokens"), F.lit(1)) * 500),
        **{k: per(k) for k in x.rhetoric},
    })
    top = F.greatest(*[F.col(k) for k in x.rhetoric])
    style = F.lit("neutrale")
    for k in reversed(["populist", "anti_establishment", "emotional", "institutional"]):
        style = F.when(F.col(k) == top, k).otherwise(style)
    return out.withColumns({
        "gulpease": F.round(F.col("gulpease_raw") * 10) / 10,  # round(x, 1) goes by the decimals of x and takes 26.049999999999997, which stands for 26.05, down
        "readability": F.when(F.col("g_words") == 0, "n/a").otherwise(T.ladder(F.col("gulpease_raw"), [(55, "difficile"), (80, "medio")], "facile", above=False)),
        "polarization": F.round("polarization_raw", 1),
        "polarization_level": T.ladder(F.col("polarization_raw"), [(20, "bassa"), (50, "media")], "alta", above=False),
        "style": F.when(top < 0.2, "neutrale").otherwise(style),
    }).drop("__p", "__w")


def lexicon_scores(df: DataFrame, lexicons: dict[str, frozenset[str]] | None = None, cols: Columns = COLS) -> DataFrame:
    """Hits of further lists per 100 tokens; phrases count by occurrence in the text."""
    lists = L.LEXICONS if lexicons is None else lexicons
    base = df.withColumn("__p", T.tokens_punct(F.col(cols.text)))
    text = F.lower(F.coalesce(F.col(cols.text), F.lit("")))

    def hits(entries) -> Column:
        words = [e for e in entries if " " not in e]
        out = T.lexicon_count(F.col("__p"), words)
        for phrase in sorted(set(entries) - set(words)):
            out = out + F.regexp_count(text, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){phrase}(?![\p{{L}}\p{{N}}_])"))
        return F.round(100 * out / F.greatest(F.size("__p"), F.lit(1)), 3)

    return base.select(cols.id, *[hits(v).alias(k) for k, v in lists.items()])
