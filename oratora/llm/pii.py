"""Personal data: fixed patterns, and terms that corpus co-occurrence shows to give a protected value away."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, maybe_broadcast, words

KINDS = ("email", "ip", "card", "phone")
TERM = "term"

# Linear forms of the four patterns: possessive where giving back can't help, and anchored so that a run
# is entered at its start or where the last match ended (\G), which is where the leftmost match begins.
_LOCAL = "[A-Za-z0-9._%+-]"
PATTERNS = {
    "email": f"(?:\\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\\.[A-Za-z0-9-]++)++",
    "ip": "(?:\\G|(?<![0-9]))[0-9]++(?:\\.[0-9]++){3}",
    "card": "[0-9](?:[\\x20-]?[0-9])++",
    "phone": "\\+[0-9][\\x20().0-9-]+[0-9]",
}
#: A character that a match can't do without, to pass over texts quickly.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
IP_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})"

#: A protected value must be in so many distinct texts, and a term in so many of these.
MIN_SUPPORT = 3
#: Share of a value's information that a term may disclose; from the second threshold on the term goes altogether.
GENERALISE, REMOVE = 0.75, 0.95
#: Share of a term's texts that must hold the value.
CERTAIN = 0.5
#: Near copies are one witness: of the texts that share a term and a value, so large a share must differ from the others,
#: by MinHash values of their five-word shingles.  Copies at a similarity of 0.8 differ by 0.1 to 0.2.
WITNESSES, SHINGLE, HASHES = 0.3, 5, 16

#: What stands between words.
WORD_ENDS = "[^\\p{L}\\p{M}]+"

BLOCK = 512


def _prefix_sums(a: Column) -> Column:
    """Running totals of an array of ints, in blocks, so that long arrays stay cheap."""

    def grow(acc: Column, x: Column) -> Column:
        return F.concat(acc, F.array(F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit(0)) + x))

    def run(values: Column) -> Column:
        return F.aggregate(values, F.array().cast("array<int>"), grow)

    def last(block: Column) -> Column:
        return F.try_element_at(block, F.lit(-1))

    def of(a: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(a), F.lit(1)), F.lit(BLOCK))
        return let(F.transform(starts, lambda s: run(F.slice(a, s, F.lit(BLOCK)))), lambda blocks: let(run(F.transform(blocks, last)), lambda ends: F.flatten(F.transform(blocks, lambda b, i: F.transform(b, lambda x: x + F.coalesce(F.get(ends, i - 1), F.lit(0)))))))

    return F.when(F.size(a) == 0, F.array().cast("array<int>")).otherwise(let(a, of))


def _passes(kind: str, m: Column) -> Column:
    digits = F.regexp_replace(m, "[^0-9]", "")
    n = F.length(digits)
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return m.rlike(f"^{IP_PART}(?:\\.{IP_PART}){{3}}$")
    if kind == "phone":
        return n.between(9, 15)

    def luhn(d: Column) -> Column:
        def value(i: Column) -> Column:
            v = F.substring(d, i, F.lit(1)).cast("int")
            twice = F.when((F.length(d) - i) % 2 == 1, v * 2).otherwise(v)
            return F.when(twice > 9, twice - 9).otherwise(twice)

        return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(d)), value), F.lit(0), lambda a, b: a + b) % 10 == 0

    return F.when(n.between(13, 19), let(digits, luhn)).otherwise(F.lit(False))


def _span(start: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"), value.alias("value"))


_EMPTY = "array<struct<start:int,end:int,value:string>>"


def base_spans(text: Column, kind: str) -> Column:
    """Spans ``(start, end, value)`` of one kind in code points, leftmost first and without overlap.

    The pieces between the matches come from a split by the same pattern, so
    positions are running totals of lengths.
    """
    pattern = PATTERNS[kind]

    def locate(text: Column, found: Column) -> Column:
        pieces = F.split(text, pattern, -1)
        steps = F.zip_with(F.slice(pieces, F.lit(1), F.size(found)), found, lambda p, m: F.length(p) + F.length(m))
        return let(_prefix_sums(steps), lambda ends: F.zip_with(found, ends, lambda m, e: _span(e - F.length(m), e, m)))

    def search(t: Column) -> Column:
        return let(F.regexp_extract_all(t, F.lit(pattern), 0), lambda found: F.when(F.size(found) == 0, F.array().cast(_EMPTY)).otherwise(F.filter(locate(t, found), lambda s: _passes(kind, s["value"]))))

    t = F.coalesce(text, F.lit(""))
    has = F.instr(t, NEEDS[kind]) > 0 if NEEDS[kind] else t.rlike("[0-9][\\x20-]?[0-9]")
    return F.when(has, search(t)).otherwise(F.array().cast(_EMPTY))


def with_base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with one array of spans per kind, in columns ``__email`` and so on."""
    return docs.select("*", *[base_spans(F.col(text_col), k).alias(f"__{k}") for k in KINDS])


def _key(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _word_spans(text: Column) -> Column:
    """Spans of the words of a text, with the lower-cased word as value."""
    pattern = "[\\p{L}\\p{M}]{3,}"

    def locate(words: Column) -> Column:
        steps = F.zip_with(F.slice(F.split(text, pattern, -1), F.lit(1), F.size(words)), words, lambda g, w: F.length(g) + F.length(w))
        return let(_prefix_sums(steps), lambda ends: F.zip_with(words, ends, lambda w, e: _span(e - F.length(w), e, F.lower(w))))

    return let(F.regexp_extract_all(text, F.lit(pattern), 0), locate)


def _clear(word: Column, spans: list[Column]) -> Column:
    """Whether a word is outside all base spans."""
    hit = F.lit(False)
    for s in spans:
        hit = hit | F.exists(s, lambda x: (x["start"] < word["end"]) & (word["start"] < x["end"]))
    return ~hit


def _sketch(text: Column) -> Column:
    """``HASHES`` MinHash values of the shingles of a text; fewer words are one shingle."""

    def of(w: Column) -> Column:
        last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
        hashed = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.array_join(F.slice(w, i + 1, F.lit(SHINGLE)), " ")))
        return let(hashed, lambda h: F.array(*[F.array_min(F.transform(h, lambda x: F.xxhash64(x, F.lit(j)))) for j in range(HASHES)]))

    return let(words(text), of)


def term_occurrences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(key, entities, terms, sketch)`` of each distinct text with protected values: these, the distinct
    words of the whole text outside all base spans, and its MinHash values."""
    t = F.coalesce(F.col(text_col), F.lit(""))
    spanned = docs.select(t.alias("text")).select("*", *[base_spans(F.col("text"), k).alias(f"__{k}") for k in KINDS])
    spans = [F.col(f"__{k}") for k in KINDS]

    def entity(kind: str) -> Column:
        return F.transform(f"__{kind}", lambda s: F.concat(F.lit(f"{kind}:"), F.lower(s["value"])))

    held = spanned.filter(F.concat_ws("", *[F.size(x) for x in spans]) != "0" * len(spans))
    found = F.filter(_word_spans(F.col("text")), lambda w: _clear(w, spans))
    return held.select(
        _key(F.col("text")).alias("key"),
        F.array_distinct(F.concat(*[entity(k) for k in KINDS])).alias("entities"),
        F.array_distinct(F.transform(found, lambda w: w["value"])).alias("terms"),
        _sketch(F.col("text")).alias("sketch"),
    ).dropDuplicates(["key"])


def disclosures(docs: DataFrame, occurrences: DataFrame, text_col: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``(entity, term, disclosure)`` of the terms that give away too much.

    The disclosure is PMI(entity; term) over the information content of the
    entity, ``log(p(e, t) / (p(e) p(t))) / -log p(e)``: 1 if every document
    with the term has the value.  Probabilities are shares of the distinct
    texts of the corpus.  Half of the term's texts at least must hold the
    value, so that a large corpus doesn't make the measure lenient, and the texts
    with both must be witnesses of their own, not near copies of each other.
    """
    t = F.coalesce(F.col(text_col), F.lit(""))
    total = docs.select(_key(t).alias("key")).distinct().count()
    seen = occurrences.select("key", F.explode("entities").alias("entity"))
    entities = cut(seen.groupBy("entity").agg(F.count("*").alias("with_entity")).filter(F.col("with_entity") >= min_support))
    n, most = entities.agg(F.count("*"), F.max("with_entity")).first()
    # both are at most with_entity: a term in more texts than this can't be certain enough
    unique = docs.select(_key(t).alias("key"), t.alias("text")).dropDuplicates(["key"])
    each = unique.select(F.explode(F.array_distinct(F.split(F.lower("text"), WORD_ENDS))).alias("term"))
    if not n:
        each = each.limit(0)
    with_term = cut(each.groupBy("term").agg(F.count("*").alias("with_term")).filter(F.col("with_term").between(min_support, (most or 0) / CERTAIN) & (F.length("term") >= 3)))
    valued = seen.join(maybe_broadcast(entities, n), "entity")
    termed = occurrences.join(valued.select("key").distinct(), "key", "left_semi").select("key", F.explode("terms").alias("term")).join(maybe_broadcast(with_term, with_term.count()), "term")
    pairs = cut(valued.join(termed, "key").filter(F.col("with_term") <= F.col("with_entity") / CERTAIN).select("entity", "term", "with_entity", "with_term", "key"))
    counted = pairs.groupBy("entity", "term", "with_entity", "with_term").agg(F.count("*").alias("n_both")).filter((F.col("n_both") >= min_support) & (F.col("n_both") >= F.col("with_term") * CERTAIN))
    pe, pt, both = F.col("with_entity") / total, F.col("with_term") / total, F.col("n_both") / total
    share = F.when(pe >= 1, F.lit(0.0)).otherwise(F.log(both / (pe * pt)) / -F.log(pe))
    telling = cut(counted.select("entity", "term", "n_both", share.alias("disclosure")).filter(F.col("disclosure") >= generalise))
    sketched = pairs.select("entity", "term", "key").join(telling.select("entity", "term"), ["entity", "term"]).join(occurrences.select("key", "sketch"), "key")
    values = sketched.select("entity", "term", F.posexplode("sketch").alias("j", "h")).distinct()
    differ = values.groupBy("entity", "term").agg(F.count("*").alias("n_values"))
    witnessed = (F.col("n_values") / HASHES - 1) / (F.col("n_both") - 1) >= WITNESSES
    return telling.join(differ, ["entity", "term"]).filter(witnessed).select("entity", "term", "disclosure")


def term_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_support: int = MIN_SUPPORT, generalise: float = GENERALISE) -> DataFrame:
    """``(key, found)``: per text the disclosing terms that it has, with their disclosure.

    A term that gives a value away does so wherever it stands, so texts
    without the value are looked at too.
    """
    occurrences = cut(term_occurrences(docs, id_col, text_col))
    bad = cut(disclosures(docs, occurrences, text_col, min_support, generalise).groupBy("term").agg(F.max("disclosure").alias("disclosure")))
    n = bad.count()
    t = F.coalesce(F.col(text_col), F.lit(""))
    texts = docs.select(_key(t).alias("key"), t.alias("text")) if n else docs.limit(0).select(_key(t).alias("key"), t.alias("text"))
    each = texts.select("key", F.explode(F.array_distinct(F.split(F.lower("text"), WORD_ENDS))).alias("term"))
    hits = each.join(maybe_broadcast(bad, n), "term").distinct()
    return hits.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "disclosure"))).alias("found"))


def _found_spans(text: Column, found: Column) -> Column:
    """All occurrences of the found terms in a text, outside its base spans."""
    spans = [F.col(f"__{k}") for k in KINDS]

    def of(f: Column) -> Column:
        named = F.transform(_word_spans(F.coalesce(text, F.lit(""))), lambda w: F.struct(w["start"].alias("start"), w["end"].alias("end"), F.try_element_at(f, w["value"]).alias("disclosure")))
        return F.filter(named, lambda w: w["disclosure"].isNotNull() & _clear(w, spans))

    return F.when(found.isNull(), F.array().cast("array<struct<start:int,end:int,disclosure:double>>")).otherwise(let(found, of))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep_text: bool = False, **kw) -> DataFrame:
    """Per row: id, spans of each base kind (``email``, ``ip``, ``card``, ``phone``) and ``terms``.

    With ``keep_text`` all columns of ``docs`` stay beside ``__email`` and so
    on.  Null and empty texts have no spans; repeated rows get the same spans
    each; a null id is an id like others; columns of ``docs`` are ignored
    (with ``keep_text`` kept), whatever their names; no rows give no rows.
    """
    added = cut(term_spans(docs, id_col, text_col, **kw))
    if keep_text:
        base, keep = docs, [F.col(c) for c in docs.columns]
    else:
        base, keep = docs.select(F.col(id_col).alias("__id"), F.col(text_col)), [F.col("__id")]
    # all entries count, so that the size of what is broadcast is known
    entries = added.agg(F.sum(F.size("found"))).first()[0] or 0
    named = maybe_broadcast(added.select(F.col("key").alias("__key"), F.col("found").alias("__found")), entries)
    joined = with_base_spans(base.join(named, _key(F.col(text_col)) == F.col("__key"), "left"), text_col)
    return joined.select(*keep, *[f"__{k}" for k in KINDS], _found_spans(F.col(text_col), F.col("__found")).alias("__terms"))


def as_text(kinds: dict[str, Column]) -> Column:
    """``kind:start:end`` by kind, then start, comma-joined."""

    def part(kind: str, spans: Column) -> Column:
        return F.transform(spans, lambda s: F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")))

    return F.array_join(F.concat(*[part(k, spans) for k, spans in kinds.items()]), ",")


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", remove: float = REMOVE, **kw) -> DataFrame:
    """``docs`` with personal data replaced: base spans and disclosing terms.

    A base span becomes its kind in brackets, ``[EMAIL]``; a term is
    generalised to ``[TERM]``, or removed if it discloses ``remove`` or more.
    Where spans of different kinds overlap, the one that starts first (then the longer) holds.
    ``n_chars``, if there, follows the text.  Other columns and null texts stay.
    """
    spanned = find(docs, id_col, text_col, keep_text=True, **kw)

    def edits(column: str, by) -> Column:
        return F.transform(column, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("neg_end"), by(s).alias("by")))

    def label(kind: str):
        return lambda s: F.lit(f"[{kind.upper()}]")

    base = [edits(f"__{k}", label(k)) for k in KINDS]
    terms = edits("__terms", lambda s: F.when(s["disclosure"] >= remove, "").otherwise("[TERM]"))
    # an edit holds if it starts at or after the end of all that hold before it
    ordered = F.array_sort(F.concat(*base, terms))
    state = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))

    def step(acc: Column, e: Column) -> Column:
        piece = F.substring(F.col(text_col), acc["at"] + 1, e["start"] - acc["at"])
        return F.when(e["start"] >= acc["at"], F.struct((-e["neg_end"]).alias("at"), F.concat(acc["out"], F.array(piece, e["by"])).alias("out"))).otherwise(acc)

    def rest(acc: Column) -> Column:
        return F.concat(F.array_join(acc["out"], ""), F.substring(F.col(text_col), acc["at"] + 1, F.length(F.col(text_col))))

    clean = F.when(F.col(text_col).isNull() | (F.size("__edits") == 0), F.col(text_col)).otherwise(F.aggregate("__edits", state, step, rest))
    out = spanned.select("*", ordered.alias("__edits")).withColumn("__clean", clean)
    cols = [F.col("__clean").alias(c) if c == text_col else F.length("__clean").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*cols)
