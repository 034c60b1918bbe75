"""Text expressions: cleaning, the two tokenisers, counters."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import lexicons as L

#: Letters, digits and underscore of any script; Java's own \w is ASCII.
NOT_WORD = r"[^\p{L}\p{N}_\s]"


def lexicon_count(tokens: Column, lexicon: Iterable[str]) -> Column:
    """How many tokens are in the list."""
    entries = sorted(lexicon)
    return F.size(F.filter(tokens, lambda t: t.isin(entries))) if entries else F.lit(0)


def _split(c: Column) -> Column:
    return F.filter(F.split(c, r"\s+"), lambda t: t != "")


def tokens_punct(text: Column) -> Column:
    """Lower-cased tokens with punctuation taken out."""
    return _split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))


def tokens_ws(text: Column) -> Column:
    """Lower-cased tokens between blanks; punctuation stays on."""
    return _split(F.lower(F.coalesce(text, F.lit(""))))


def tokens_keyword(text: Column, stopwords: Iterable[str] = (), blacklist: Iterable[str] = ()) -> Column:
    """Keyword tokens: four or more letters, all alphabetic, neither stop word nor blacklisted."""
    drop = sorted({*stopwords, *blacklist})

    def wanted(t: Column) -> Column:
        ok = t.rlike(r"^\p{L}{4,}$")
        return ok & ~t.isin(drop) if drop else ok

    return F.filter(tokens_punct(text), wanted)


def clean_text(text: Column, phrases: Iterable[str] = L.PROCEDURAL) -> Column:
    """Lower-case, delete the formal phrases in order, collapse blanks; null gives an empty text."""
    cleaned = reduce(lambda c, p: F.regexp_replace(c, f"(?i){p}", ""), phrases, F.lower(F.coalesce(text, F.lit(""))))
    return F.trim(F.regexp_replace(cleaned, r"\s+", " "))


def n_sentences(text: Column) -> Column:
    """Pieces between sentence marks that aren't blank, one at least."""
    return F.greatest(F.size(F.filter(F.split(F.coalesce(text, F.lit("")), "[.!?]+"), lambda s: s.rlike(r"\S"))), F.lit(1))


def n_words(text: Column) -> Column:
    return F.size(tokens_ws(text))


def n_letters(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", ""))


def contains_any(text: Column, phrases: Iterable[str]) -> Column:
    """How many phrases occur in the lower-cased text, each at most once."""
    low = F.lower(F.coalesce(text, F.lit("")))
    return reduce(lambda n, p: n + F.contains(low, F.lit(p)).cast("int"), phrases, F.lit(0))


def ladder(value: Column, steps: list[tuple[float, str]], rest: str, above: bool = True) -> Column:
    """Label by thresholds in order: over each (or under, with ``above`` false), else ``rest``."""
    out = F.lit(rest)
    for limit, label in reversed(steps):
        out = F.when(value > limit if above else value < limit, label).otherwise(out)
    return out


def clean_name(name: Column) -> Column:
    """What stands before the first bracket."""
    return F.trim(F.split(name, r"\[")[0])


def party_from_name(name: Column) -> Column:
    """The first bracketed part, else the unknown party."""
    found = F.regexp_extract(F.coalesce(name, F.lit("")), r"\[([^\]]+)\]", 1)
    return F.when(found == "", L.UNKNOWN_PARTY).otherwise(found)


def normalise_name(name: Column) -> Column:
    """Blanks collapsed; title case only if all capitals."""
    plain = F.trim(F.regexp_replace(name, r"\s+", " "))
    return F.when((plain == F.upper(plain)) & plain.rlike(r"\p{L}"), F.initcap(F.lower(plain))).otherwise(plain)


def normalise_role(role: Column) -> Column:
    return F.trim(F.lower(role))


def role_category(role: Column) -> Column:
    """governo, presidenza, ufficio or altro: the first category of which a role occurs."""
    low = normalise_role(role)
    out = F.lit("altro")
    for name, roles in reversed(L.ROLE_CATEGORIES.items()):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(low, F.lit(r)) for r in sorted(roles)]), name).otherwise(out)
    return F.when(role.isNull(), F.lit("altro")).otherwise(out)


def role_pattern() -> str:
    """Alternation of all roles, longest first so that a longer role is never cut short."""
    return "|".join(r.replace(" ", r"\s+") for r in sorted(L.ROLES, key=lambda r: (-len(r), r)))


def normalise_party(party: Column, aliases: dict[str, str] | None = None) -> Column:
    """One name per party; unlisted ones stay."""
    aliases = L.PARTY_ALIASES if aliases is None else aliases
    if not aliases:
        return party
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return F.coalesce(F.try_element_at(table, party), party)


def coalition(party: Column, left=L.LEFT, right=L.RIGHT, center=L.CENTER) -> Column:
    """left, right, center or other; the first that lists the party."""
    return F.when(party.isin(sorted(left)), "left").when(party.isin(sorted(right)), "right").when(party.isin(sorted(center)), "center").otherwise("other")


def known_party(party: Column) -> Column:
    """True for a party that is neither null nor one of the unknown marks."""
    return party.isNotNull() & ~party.isin(*L.UNKNOWN_PARTIES)
