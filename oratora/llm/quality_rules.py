"""Quality rules as a short-circuit cascade, ordered by rejection per cost."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, let, stored, words

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
#: Words in which distinct ones are counted at once.
WINDOW = 200
#: Rows of the sample on which costs and selectivities are estimated (about so many; it never changes a verdict).
SAMPLE_ROWS = 2_000


# --- measures -------------------------------------------------------------------------------------------------


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


def word_chars(text: Column) -> Column:
    """Code points in words, that is all but the blanks."""
    return F.length(F.translate(F.coalesce(text, F.lit("")), BLANKS, "")).cast("long")


def n_chars_of(text: Column, chars: str) -> Column:
    text = F.coalesce(text, F.lit(""))
    return (F.length(text) - F.length(F.translate(text, chars, ""))).cast("long")


def _lines(text: Column) -> Column:
    """Lines, split at \\n, that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: F.btrim(x, F.lit(BLANKS)) != "")


def n_lines(text: Column) -> Column:
    return F.size(_lines(text)).cast("long")


def n_dup_lines(text: Column) -> Column:
    """Lines with a word that equal an earlier line."""
    return let(_lines(text), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long")


def n_repeat_words(text: Column, size: int = 3, w: Column | None = None) -> Column:
    """Words inside windows of ``size`` words that occur twice or more, the first occurrence included.

    Sorts one long per window (hash above, position below) and compares the
    words of neighbours.  Where neighbours agree in the hash but not in the
    words, a repeat could hide between them: such a text is done over by its words.
    """

    def of(w: Column) -> Column:
        last = F.size(w) - size
        # as many low bits as the positions need
        return F.when(last < 1, F.lit(0)).otherwise(let((F.expr("1L") * F.pow(F.lit(2.0), F.length(F.bin(F.size(w))))).cast("long") - 1, lambda mask: marked(w, last, mask)))

    def marked(w: Column, last: Column, mask: Column) -> Column:
        def key(i: Column) -> Column:
            return F.xxhash64(*[F.get(w, i + j) for j in range(size)]).bitwiseAND(F.bitwise_not(mask)).bitwiseOR(i.cast("long"))

        def place(s: Column, k: Column) -> Column:
            return F.get(s, k).bitwiseAND(mask).cast("int")

        def agree(s: Column, k: Column) -> Column:
            """0: another hash than the one before, 1: the same window, 2: the hash only."""
            x = F.get(s, k).bitwiseXOR(F.get(s, k - 1))
            words = F.lit(True)
            for j in range(size):
                words = words & (F.get(w, place(s, k) + j) == F.get(w, place(s, k - 1) + j))
            return F.when((x > mask) | (x < 0), 0).when(words, 1).otherwise(2)

        def exact(_: Column) -> Column:
            named = F.array_sort(F.transform(F.sequence(F.lit(0), last), lambda i: F.struct(F.concat_ws(" ", *[F.get(w, i + j) for j in range(size)]).alias("s"), i.alias("i"))))
            return let(named, lambda n: covered(F.transform(n, lambda x, k: F.when(k == 0, 0).otherwise((x["s"] == F.get(n, k - 1)["s"]).cast("int"))), F.transform(n, lambda x: x["i"])))

        def hashed(s: Column) -> Column:
            codes = F.transform(F.sequence(F.lit(0), last), lambda k: F.when(k == 0, 0).otherwise(agree(s, k)))
            return let(codes, lambda c: F.when(~F.array_contains(c, 1) & ~F.array_contains(c, 2), F.lit(0)).when(F.array_contains(c, 2), exact(c)).otherwise(covered(c, F.transform(s, lambda x: x.bitwiseAND(mask).cast("int")))))

        return let(F.sort_array(F.transform(F.sequence(F.lit(0), last), key)), hashed)

    def covered(codes: Column, places: Column) -> Column:
        """Words covered by the windows whose code, or the next one's, is 1."""
        twice = F.filter(F.transform(places, lambda p, k: F.when((F.get(codes, k) == 1) | (F.coalesce(F.get(codes, k + 1), F.lit(0)) == 1), p)), lambda p: p.isNotNull())

        def total(t: Column) -> Column:
            steps = F.transform(t, lambda x, j: F.least(F.lit(size), F.coalesce(F.get(t, j + 1), x + size) - x))
            return F.aggregate(steps, F.lit(0), lambda a, b: a + b)

        return let(F.sort_array(twice), total)

    return (let(words(text), of) if w is None else let(w, of)).cast("long")


def n_distinct_words(text: Column, w: Column | None = None) -> Column:
    """Distinct words of each ``WINDOW`` words, summed over the text, so that long texts compare with short ones."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) > 0, F.sequence(F.lit(1), F.size(w), F.lit(WINDOW))).otherwise(F.array().cast("array<int>"))
        return F.aggregate(F.transform(starts, lambda i: F.size(F.array_distinct(F.slice(w, i, F.lit(WINDOW))))), F.lit(0), lambda a, b: a + b)

    return let(words(text) if w is None else w, of).cast("long")


def measures(text: Column, w: Column | None = None) -> dict[str, Column]:
    w = words(text) if w is None else w
    return {"n_words": F.size(w).cast("long"), "word_chars": word_chars(text), "n_symbols": n_chars_of(text, SYMBOLS), "n_dup_lines": n_dup_lines(text), "n_repeat_words": n_repeat_words(text, w=w)}


# --- rules ----------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Rule:
    """``rejects`` is true for a text to reject."""

    name: str
    rejects: Column


def production_rules(text: Column, w: Column | None = None, known: dict[str, Column] | None = None) -> list[Rule]:
    """The base rules, then rules on symbols, capitals, odd word lengths, repeated lines and few distinct words.

    ``w`` are the text's words and ``known`` its measures by name, where they are columns already.
    """
    w = words(text) if w is None else w
    t, known = F.coalesce(text, F.lit("")), known or {}
    n = known.get("n_words", F.size(w).cast("long"))
    chars = known.get("word_chars", word_chars(t))
    lines = _lines(t)
    return [
        Rule("too_short", n < MIN_WORDS),
        Rule("repetitive", 100 * known.get("n_repeat_words", n_repeat_words(t, w=w)) > 50 * n),
        Rule("symbols", known.get("n_symbols", n_chars_of(t, SYMBOLS)) * 10 > n * 3),
        Rule("capitals", n_chars_of(t, "ABCDEFGHIJKLMNOPQRSTUVWXYZ") * 2 > chars),
        Rule("word_length", (chars > 12 * n) | (2 * chars < 5 * n)),
        Rule("repeated_lines", let(lines, lambda x: (F.size(x) >= 4) & (10 * F.size(F.array_distinct(x)) < 5 * F.size(x)))),
        Rule("few_words", 10 * n_distinct_words(t, w) < n),
    ]


def sample_of(docs: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """About ``rows`` rows of ``docs``, written once, so that rules are timed on rows at hand."""
    total = docs.count()
    return stored(docs.sample(min(1.0, rows / total), seed=7) if total else docs)


def order_rules(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, sample: DataFrame | None = None) -> list[tuple[Rule, float, float]]:
    """Rules with their estimated rejection rate and cost, best rejection per cost first.

    Each rule is run over a sample of about ``sample_rows`` rows by itself; its cost
    is the time that takes, less that of a rule that does nothing, the best of three
    runs, and a hundredth of a millisecond at least.  Ties go by cost, then by name.  The order decides
    which rule is named and how much work is done, never the verdict, so
    that clocks differ changes no result.
    """
    sample = sample_of(docs, sample_rows) if sample is None else sample

    def run(rejects: Column) -> tuple[float, float]:
        began = time.perf_counter()
        share = sample.agg(F.avg(F.coalesce(rejects, F.lit(False)).cast("double"))).first()[0]
        return time.perf_counter() - began, share or 0.0

    nothing = min(run(F.lit(False))[0] for _ in range(3))
    rated = []
    for r in rules:
        runs = [run(r.rejects) for _ in range(3)]  # the first ones compile
        rated.append((r, runs[0][1], max(1e-5, min(seconds for seconds, _ in runs) - nothing)))
    return sorted(rated, key=lambda x: (-x[1] / x[2], x[2], x[0].name))


def cascade(rules: list[Rule]) -> Column:
    """Name of the first rule that rejects, in the given order, else null; later rules are not evaluated."""
    out = F.lit(None).cast("string")
    for r in reversed(rules):
        out = F.when(r.rejects, F.lit(r.name)).otherwise(out)
    return out


def _split(docs: DataFrame, text_col: str) -> DataFrame:
    """``docs`` with the text's words, which all rules share, in ``__w``."""
    return docs.withColumn("__w", words(F.col(text_col)))


def rejected_by(docs: DataFrame, text_col: str = "text", rules: list[Rule] | None = None, name: str = "rejected_by") -> DataFrame:
    """``docs`` with the rule that rejects each row, or null.

    Null and empty texts have no words and fall to a rule at least (``too_short``).  All rows
    and columns stay, repeated rows too; a column called ``name`` is replaced.  No rows give no rows.
    """
    split = _split(docs, text_col)
    rules = production_rules(F.col(text_col), F.col("__w")) if rules is None else rules
    order = [r for r, _, _ in order_rules(split, rules, sample=_split(sample_of(docs.select(text_col)), text_col))]
    return split.withColumn(name, cascade(order)).drop("__w")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Rows that no rule rejects, with their columns."""
    found = rejected_by(docs, text_col, name="__rejected_by")
    return found.filter(F.col("__rejected_by").isNull()).select(*docs.columns)


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, the measures, ``base_failed``, ``kept`` and ``rejected_by``.

    All rules, the base ones included, go through the cascade.  The measures
    are returned for every row, so rules on them cost next to nothing and come
    early; the others aren't evaluated for rows that are rejected before.
    Null texts have no words; repeated rows each get a row; other columns are
    ignored, whatever their names; no rows give no rows.
    """

    def measured(rows: DataFrame) -> DataFrame:
        split = rows.select("__id", "__text", words(F.col("__text")).alias("__w"))
        return split.select("*", *[c.alias(k) for k, c in measures(F.col("__text"), F.col("__w")).items()])

    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    found = measured(rows)
    known = {k: F.col(k) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")}
    rules = production_rules(F.col("__text"), F.col("__w"), known)
    # timed where the measures are columns already, as they are in the cascade
    order = [r for r, _, _ in order_rules(found, rules, sample=stored(measured(sample_of(rows))))]
    by = {r.name: r.rejects for r in rules}
    base = by["too_short"] | by["repetitive"]
    judged = found.select(F.col("__id").alias(id_col), *known, base.alias("base_failed"), cascade(order).alias("rejected_by"))
    return judged.select(id_col, *known, "base_failed", F.col("rejected_by").isNull().alias("kept"), "rejected_by")
