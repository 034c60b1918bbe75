"""Session pages: links to sessions with their dates, and pages parsed into speeches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates
from ..functions import text as T
from ..functions.lexicons import MONTHS
from ..operators.prepare import derive_group, speaker_key
from . import roster as R

NAME = r"[A-Z][A-Z\-']+"


def strip_tags(html: Column) -> Column:
    """The text of a fragment: tags go without a blank in their place, runs of blanks become one."""
    return F.trim(F.regexp_replace(F.regexp_replace(html, r"<[^>]*>", ""), r"\s+", " "))


#: Latin letters with their marks, as character references name them; marks in the order of ``MARKS``.
MARKS = {"grave": "àèìòùÀÈÌÒÙ", "acute": "áéíóúÁÉÍÓÚ", "circ": "âêîôûÂÊÎÔÛ", "uml": "äëïöüÄËÏÖÜ"}
NAMED = {f"{plain}{mark}": letter for mark, letters in MARKS.items() for plain, letter in zip("aeiouAEIOU", letters)} | {
    "nbsp": " ", "quot": '"', "apos": "'", "lt": "<", "gt": ">", "ccedil": "ç", "ntilde": "ñ", "euro": "€", "laquo": "«", "raquo": "»", "ldquo": "“", "rdquo": "”",
    "lsquo": "‘", "rsquo": "’", "ndash": "–", "mdash": "—", "hellip": "…", "deg": "°", "agrave": "à", "middot": "·", "bull": "•", "copy": "©", "amp": "&",
}


def unescape(text: Column) -> Column:
    """Character references, numbered in either base and named, decoded in one pass from the left.

    Unknown names stay as they are.
    """
    pieces = F.split(text, r"(?=&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z]{2,8});)|(?<=;)")
    names = F.create_map(*[F.lit(x) for pair in NAMED.items() for x in pair])

    def one(piece: Column) -> Column:
        inner = F.substring(piece, F.lit(2), F.length(piece) - 2)
        digits = F.when(inner.rlike("^#[0-9]{1,7}$"), F.substring(inner, F.lit(2), F.lit(7)).cast("int")).when(inner.rlike("^#[xX][0-9a-fA-F]{1,6}$"), F.conv(F.substring(inner, F.lit(3), F.lit(6)), 16, 10).cast("int"))
        # a code point as UTF-32, so that those beyond the first plane are right as well
        coded = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
        valid = digits.isNotNull() & digits.between(1, 0x10FFFF) & ~digits.between(0xD800, 0xDFFF)
        named = F.try_element_at(names, inner)
        return F.when(~piece.rlike("^&[^&;]+;$"), piece).when(valid, coded).otherwise(F.coalesce(named, piece))

    return F.array_join(F.transform(pieces, one), "")


def paragraphs(pages: DataFrame, *keep: str, html: str = "html", least: int = 10) -> DataFrame:
    """One row per ``<p>`` with at least so many characters of text: its number and ``paragraph``.

    An unclosed paragraph ends where the next one or the page does.
    """
    pieces = F.split(F.col(html), r"(?i)<p(?:\s[^>]*)?>")
    found = pages.select(*keep, F.posexplode(F.slice(pieces, F.lit(2), F.size(pieces))).alias("number", "inner"))
    inner = F.regexp_replace("inner", r"(?is)</p>.*", "")
    return found.withColumn("paragraph", strip_tags(inner)).drop("inner").filter(F.length("paragraph") >= least)


def notes_and_text(text: Column) -> tuple[Column, Column]:
    """What stands in parentheses, and the text without it."""
    return F.regexp_extract_all(text, F.lit(r"\(([^)]+)\)"), 1), F.trim(F.regexp_replace(text, r"\([^)]+\)", ""))


def senate_speeches(pages: DataFrame, roster: DataFrame | None = None, html: str = "html", least_chars: int = 30) -> DataFrame:
    """Speeches from senate pages ``(url, html, date)``.

    A paragraph is tried as ``NAME (PARTY). text``, ``PRESIDENTE. text``,
    ``NAME, role ... . text`` and ``NAME. text``, in this order; short speeches go.  With a
    roster, names must be on it, except the presidency's and government roles.
    """
    p = paragraphs(pages.withColumn("paragraph_date", F.col("date")), "url", "paragraph_date", html=html).withColumn("t", unescape(F.col("paragraph")))
    t = F.col("t")
    party = rf"(?s)^({NAME}(?:\s+{NAME})?)\s*\(([^)]+)\)\.\s+(.+)"
    presidency = r"(?s)^(PRESIDENTE|PRESIDENTESSA)\.\s+(.+)"
    role = rf"(?is)^({NAME}(?:\s+{NAME})?),\s*({T.role_pattern()})[^.]*\.\s*(.+)"
    simple = rf"(?s)^({NAME}(?:\s+{NAME}){{0,2}})\.\s+(.+)"
    get = lambda pattern, i: F.trim(F.regexp_extract(t, pattern, i))
    none = F.lit(None).cast("string")
    parsed = F.when(t.rlike(party), F.struct(get(party, 1).alias("speaker"), get(party, 2).alias("party"), F.lit("").alias("role"), get(party, 3).alias("said")))
    parsed = parsed.when(t.rlike(presidency), F.struct(get(presidency, 1).alias("speaker"), F.lit("").alias("party"), F.lit("presidente").alias("role"), get(presidency, 2).alias("said")))
    parsed = parsed.when(t.rlike(role), F.struct(get(role, 1).alias("speaker"), F.lit("").alias("party"), F.lower(get(role, 2)).alias("role"), get(role, 3).alias("said")))
    short = t.rlike(simple) & (F.length(get(simple, 1)) <= 30)
    parsed = parsed.when(short, F.struct(get(simple, 1).alias("speaker"), F.lit("").alias("party"), F.lit("").alias("role"), get(simple, 2).alias("said"))).otherwise(F.struct(none.alias("speaker"), none.alias("party"), none.alias("role"), none.alias("said")))
    rows = p.select("url", "number", F.col("paragraph_date").alias("date"), parsed.alias("s")).select("url", "number", "date", "s.*").filter("speaker is not null and speaker <> '' and said <> ''")
    return _finish(rows, roster, least_chars)


def chamber_speeches(pages: DataFrame, roster: DataFrame | None = None, html: str = "html", least_chars: int = 20) -> DataFrame:
    """Speeches from chamber pages ``(url, html, date)``.

    A paragraph with a linked name is that speaker's, with party and role read
    after the link; else it is tried as ``NAME, role ... . text`` in capitals, then as
    ``NAME (PARTY). text``.
    """
    blocks = F.regexp_extract_all(F.col(html), F.lit(r"(?is)<(?:p|div)\b[^>]*>((?:(?!<(?:p|div)\b).)*?)</(?:p|div)>"), 1)
    p = pages.select("url", "date", F.posexplode(blocks).alias("number", "inner"))
    t = unescape(strip_tags(F.col("inner")))
    link = r"(?is)<a\b[^>]*>(.*?)</a>"
    name = unescape(strip_tags(F.regexp_extract("inner", link, 1)))
    rest = unescape(strip_tags(F.regexp_extract("inner", r"(?is)<a\b[^>]*>.*?</a>(.*)$", 1)))
    rows = p.select("url", "date", "number", t.alias("t"), name.alias("name"), rest.alias("rest")).filter(F.length("t") >= 30)
    party = F.regexp_extract("rest", r"^\s*\(([^)]+)\)", 1)
    after = F.trim(F.regexp_replace("rest", r"^\s*\([^)]+\)", ""))
    role = F.regexp_extract(after, rf"(?i)^\s*,\s*({T.role_pattern()})[^.]*", 1)
    said = F.trim(F.regexp_replace(F.trim(F.regexp_replace(after, rf"(?i)^\s*,\s*({T.role_pattern()})[^.]*", "")), r"^[.,:]\s*", ""))
    linked = (F.length("name") >= 3) & F.col("name").rlike(r"^\p{Lu}") & (F.length(said) > 30)
    fall_role = rf"(?s)^({NAME}(?:\s+{NAME})?),\s*(?i:({T.role_pattern()}))[^.]*\.\s*(.+)"
    fall_party = rf"(?s)^({NAME}(?:\s+{NAME})?)\s*\(([^)]+)\)\.\s+(.+)"
    get = lambda pattern, i: F.trim(F.regexp_extract("t", pattern, i))
    president = F.upper(F.col("name")) == "PRESIDENTE"

    def record(speaker, party, role, said) -> Column:
        return F.struct(speaker.alias("speaker"), party.alias("party"), role.alias("role"), said.alias("said"))

    none = F.lit(None).cast("string")
    parsed = F.when(linked, record(F.when(president, F.lit("PRESIDENTE")).otherwise(F.col("name")), party, F.when(president, F.lit("presidente")).otherwise(F.lower(role)), said))
    parsed = parsed.when(F.col("t").rlike(fall_role), record(get(fall_role, 1), F.lit(""), F.lower(get(fall_role, 2)), get(fall_role, 3)))
    parsed = parsed.when(F.col("t").rlike(fall_party), record(get(fall_party, 1), get(fall_party, 2), F.lit(""), get(fall_party, 3))).otherwise(record(none, none, none, none))
    found = rows.select("url", "number", "date", parsed.alias("s")).select("url", "number", "date", "s.*").filter("speaker is not null")
    return _finish(found, roster, least_chars)


def _finish(rows: DataFrame, roster: DataFrame | None, least_chars: int) -> DataFrame:
    notes, clean = notes_and_text(F.col("said"))
    out = rows.select("url", "number", "date", "speaker", "party", "role", F.when(F.col("role") == "", F.lit("")).otherwise(T.role_category(F.col("role"))).alias("role_category"), notes.alias("notes"), clean.alias("text")).filter(F.length("text") > least_chars)
    if roster is None:
        return out.withColumn("profile_url", F.lit(""))
    found = R.resolve(out.withColumn("name", F.col("speaker")), roster, key="__key", make_key=True)
    keep = F.col("matched").isNotNull() | F.col("role_category").isin("presidenza", "governo")
    return found.filter(keep).select(
        "url", "number", "date", F.coalesce("matched", "speaker").alias("speaker"), F.when(F.coalesce("roster_party", F.lit("")) != "", F.col("roster_party")).otherwise(F.col("party")).alias("party"), "role", "role_category", "notes", "text", F.coalesce("profile_url", F.lit("")).alias("profile_url")
    )


def as_speech_table(parsed: DataFrame, source: str) -> DataFrame:
    """The speech table's columns: group and unique speaker key derived, the presidency dropped."""
    group = derive_group(F.col("party"), F.col("role_category"))
    g = parsed.withColumn("group", group).filter(F.col("group") != "Presidenza")
    return g.select("date", speaker_key(F.col("speaker"), F.col("party"), F.col("group")).alias("deputy"), F.col("speaker").alias("speaker_base"), "group", "text", F.lit(source).alias("source"), "url", "role", "role_category", "profile_url")


def session_links(pages: DataFrame, pattern: str, html: str = "html", distinct: bool = False) -> DataFrame:
    """``(id, url, title, date)`` of links whose address has the session id; dates come from title or context."""
    anchors = F.regexp_extract_all(F.col(html), F.lit(r"(?is)(<a\b[^>]*>.*?</a>[^<]*)"), 1)
    a = pages.select(F.explode(anchors).alias("a"))
    href = F.regexp_extract("a", r"(?i)href\s*=\s*[\"']([^\"']+)", 1)
    rows = a.select(F.regexp_extract(href, pattern, 1).alias("id"), href.alias("url"), unescape(strip_tags(F.regexp_extract("a", r"(?is)<a\b[^>]*>(.*?)</a>", 1))).alias("title"), unescape(strip_tags(F.col("a"))).alias("context")).filter("id <> ''")
    out = rows.select("id", "url", "title", "context", F.coalesce(date_in_context(F.col("title")), date_in_context(F.col("context")), F.lit("Unknown")).alias("date"))
    if not distinct:
        return out.drop("context")
    # of links to one session the one with the earliest date holds, a known date before none
    best = out.groupBy("id").agg(F.min(F.struct((F.col("date") == "Unknown").alias("no_date"), "date", "url", "title", "context")).alias("b"))
    return best.select("id", "b.url", "b.title", "b.context", "b.date").select("id", "url", "title", "date")


def senate_sessions(pages: DataFrame, html: str = "html") -> DataFrame:
    """Links to stenographic reports; repeated ones stay."""
    rows = session_links(pages, r"id=(\d+)", html)
    return rows.filter(F.contains("url", F.lit("show-doc")) & F.contains("url", F.lit("Resaula")))


def chamber_sessions(pages: DataFrame, html: str = "html") -> DataFrame:
    return session_links(pages, r"idSeduta=(\d+)", html, distinct=True).orderBy("date", "id")


def date_in_context(text: Column) -> Column:
    """``yyyy-MM-dd`` of an Italian long date in the text, else null."""
    long = F.regexp_extract(text, r"(?i)(\d{1,2}\s+(?:" + "|".join(MONTHS) + r")\s+\d{4})", 1)
    return F.date_format(dates.parse_date(F.when(long != "", long)), "yyyy-MM-dd")


def chamber_day(title: Column, context: Column, year: Column, month: Column) -> Column:
    """Date of a chamber session on a month page: a trailing day in the title, else weekday and day around it, else the first."""
    week = r"(?i)(?:luned[iì]|marted[iì]|mercoled[iì]|gioved[iì]|venerd[iì]|sabato|domenica)\s+(\d{1,2})"
    a, b = F.regexp_extract(title, r"(\d{1,2})\s*$", 1), F.regexp_extract(context, week, 1)
    day = F.when(a != "", a).when(b != "", b).otherwise("1")
    return F.concat_ws("-", year.cast("string"), F.lpad(month.cast("string"), 2, "0"), F.lpad(day, 2, "0"))


def date_window(sessions: DataFrame, months_back: int, today: Column | None = None) -> DataFrame:
    """Sessions of the last months of 30 days; those without a readable date stay."""
    d = dates.parse_date(F.col("date"))
    return sessions.filter(d.isNull() | (d >= F.date_sub(today if today is not None else F.current_date(), 30 * months_back)))
