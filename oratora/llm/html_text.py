"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import send_by_value

send_by_value(__name__)

#: Elements whose content is no text of the page.
RAW = frozenset("script style template noscript iframe svg math object textarea title head xmp noembed noframes".split())
#: Elements that are never part of the main text.
ASIDE = frozenset("nav footer aside form button select menu dialog label input fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes if open, and the elements past which it doesn't look.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
P_SCOPES = frozenset("article section div body td li blockquote main aside nav footer form".split())
#: Elements that hold parts of a page; two of the same name under one parent have paths of their own.
CONTAINERS = frozenset("div section article td center".split())
HOMES = CONTAINERS | {"html", "body", "main"}
#: Elements that speak for what is in them, and names of classes, ids and roles that speak against it: as one word of a
#: name, or as the whole name.  They weigh the ratios of paths and decide nothing by themselves.
MAIN = frozenset("article main".split())
AGAINST = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer gdpr login masthead menu modal nav navbar navigation newsletter pager pagination popup promo recommended recommendations related share sharing sidebar sidebars signup skip sponsor sponsored subscribe toolbar".split()
)
AGAINST_WHOLE = frozenset("alert discussion header notice notices overlay pageheader promotion replies reply search side siteheader social widget".split())
MAIN_FACTOR, AGAINST_FACTOR, WHOLE_FACTOR = 1.5, 0.05, 0.25
#: A path is chosen from this share of the best path's ratio, and this share of the standard deviation.
LEAST_SHARE, DEVIATIONS = 0.2, 0.5

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|</?[A-Za-z](?:[^>\"']|\"[^\"]*\"|'[^']*')*+>|</?[A-Za-z][^>]*>", re.S)
NAME = re.compile(r"</?([A-Za-z][^\s/>]*)")
ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…、。，！？]")
WORD = re.compile(r"[a-z]+")
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
BLANK = re.compile(r"\s+")


class Element:
    """A block element: its parent's number, tag, and what its names say for or against its text."""

    __slots__ = ("parent", "tag", "label", "factor")

    def __init__(self, parent: int, tag: str, label: str, factor: float):
        self.parent, self.tag, self.label, self.factor = parent, tag, label, factor


class Node:
    """One stretch of text: the block element and the block that it is in."""

    __slots__ = ("element", "text", "block", "heading", "linked", "path")

    def __init__(self, element: int, text: str, block: int, heading: bool, linked: bool):
        self.element, self.text, self.block, self.heading, self.linked, self.path = element, text, block, heading, linked, 0


def attributes(token: str) -> dict[str, str]:
    """Names and values of a start tag's attributes; of a repeated name the first holds."""
    found: dict[str, str] = {}
    for name, *values in ATTRIBUTE.findall(token, NAME.match(token).end(), len(token) - 1):
        found.setdefault(name.lower(), next((v for v in values if v), ""))
    return found


def _factor(names: list[str]) -> float:
    factor = 1.0
    for name in names:
        parts = WORD.findall(CAMEL.sub(" ", name).lower())
        if not AGAINST.isdisjoint(parts):
            return AGAINST_FACTOR
        if "".join(parts) in AGAINST_WHOLE:
            factor = WHOLE_FACTOR
    return factor


def parse(page: str) -> tuple[list[Node], list[Element]]:
    """Text nodes in page order, and the block elements (0 is the page), parents first.

    Unclosed and stray tags are taken as browsers take them, roughly.  Time is
    linear in the page, however deep it nests.
    """
    nodes: list[Node] = []
    elements = [Element(0, "", "", 1.0)]
    # tag, no part of the text, in the article, block element, heading, linked
    stack: list[tuple[str, bool, bool, int, bool, bool]] = []
    outermost = ("", False, False, 0, False, False)
    is_open: dict[str, int] = {}
    block, at, end = 0, 0, len(page)

    def add(raw: str) -> None:
        if not raw or raw.isspace():
            if raw and nodes and nodes[-1].block == block:
                nodes[-1].text += " "
            return
        _, aside, _, element, heading, linked = stack[-1] if stack else outermost
        if not aside:
            nodes.append(Node(element, html.unescape(raw), block, heading, linked))

    def cut_to(i: int) -> None:
        for tag, *_ in stack[i:]:
            is_open[tag] -= 1
        del stack[i:]

    def close(tags, scopes) -> None:
        if not any(is_open.get(t) for t in tags):
            return
        for i in range(len(stack) - 1, -1, -1):
            if stack[i][0] in tags:
                cut_to(i)
                return
            if stack[i][0] in scopes:
                return

    while at < end:
        m = TOKEN.search(page, at)
        if not m:
            add(page[at:])
            break
        add(page[at : m.start()])
        at, token = m.end(), m[0]
        if token[1] in "!?":
            continue
        tag = NAME.match(token)[1].lower()
        if token[1] == "/":
            if is_open.get(tag):
                i = len(stack) - 1
                while stack[i][0] != tag:
                    i -= 1
                cut_to(i)
            if tag in BLOCKS:
                block += 1
            continue
        if tag in RAW:
            if not token.endswith("/>"):
                # "</head" may be missing; its text elements are raw themselves
                if tag == "head":
                    continue
                stop = re.compile(rf"</{re.escape(tag)}\b[^>]*>", re.I).search(page, at)
                at = stop.end() if stop else end
            continue
        if tag == "br":
            add(" ")
            continue
        if tag in BLOCKS:
            block += 1
            if tag not in CLOSES:  # an open p ends where a block begins
                close(("p",), P_SCOPES)
        if tag in CLOSES:
            close(CLOSES[tag], SCOPES[tag])
        if tag in VOID or token.endswith("/>"):
            continue
        _, aside, inside, element, heading, linked = stack[-1] if stack else outermost
        aside = aside or tag in ASIDE or tag == "header" and not inside
        inside = inside or tag in MAIN
        factor, names = 1.0, ""
        if not aside and len(token) > len(tag) + 2:
            found = attributes(token)
            aside = "hidden" in found or bool(HIDDEN.search(found.get("style", "")))
            names = " ".join(found.get(k, "") for k in ("class", "id", "role")).split()
            factor = _factor(names)
        if tag in BLOCKS or factor < 1.0:
            own = elements[element].factor * factor
            # in the article elements count for the text once
            elements.append(Element(element, tag, ".".join([tag, *sorted(names)]), own * MAIN_FACTOR if tag in MAIN and not (stack and stack[-1][2]) else own))
            element = len(elements) - 1
        stack.append((tag, aside, inside, element, heading or tag in HEADINGS, linked or tag == "a"))
        is_open[tag] = is_open.get(tag, 0) + 1
    return nodes, elements


def set_paths(nodes: list[Node], elements: list[Element]) -> tuple[list[float], list[bool]]:
    """Number the root-to-leaf paths of all nodes; the factor of each path, and whether each element holds others with text.

    A path is the tags with their names.  Containers that hold others are told
    apart by their place among those of the same parent and label.
    """
    outer = [False] * len(elements)
    for n in nodes:
        at = n.element
        while at and not outer[elements[at].parent]:
            at = elements[at].parent
            outer[at] = True
    numbers: dict[tuple[int, str, int], int] = {}
    places: dict[tuple[int, str], int] = {}
    path, factors = [0] * len(elements), [1.0]
    for i, e in enumerate(elements[1:], 1):
        place = 0
        if outer[i] and e.tag in CONTAINERS:
            place = places[e.parent, e.label] = places.get((e.parent, e.label), 0) + 1
        key = (path[e.parent], e.label, place)
        if key not in numbers:
            numbers[key] = len(factors)
            factors.append(e.factor)
        path[i] = numbers[key]
    for n in nodes:
        n.path = path[n.element]
    return factors, outer


def _smooth(values: list[float], radius: int = 1) -> list[float]:
    """Gaussian smoothing over neighbours in page order."""
    kernel = [math.exp(-(d * d) / 2) for d in range(-radius, radius + 1)]
    out = []
    for i in range(len(values)):
        total = weight = 0.0
        for d, k in zip(range(-radius, radius + 1), kernel):
            if 0 <= i + d < len(values):
                total += k * values[i + d]
                weight += k
        out.append(total / weight)
    return out


def content_paths(nodes: list[Node], factors: list[float]) -> set[int]:
    """Paths whose fused, smoothed ratios reach the threshold.

    A path's text ratio is the mean length of its nodes, its punctuation
    ratio the mean number of marks; linked text counts for nothing.  Their
    fusion is the geometric mean times the path's factor, given to each node, smoothed in page order,
    averaged over the path again, and held against shares of the standard
    deviation of all nodes and of the best path.
    """
    stats: dict[int, list[float]] = {}
    for n in nodes:
        s = stats.setdefault(n.path, [0, 0.0, 0.0])
        s[0] += 1
        if not n.linked:
            s[1] += len(n.text.strip())
            s[2] += len(PUNCTUATION.findall(n.text))
    fused = {p: factors[p] * math.sqrt((chars / k) * (1 + marks / k)) if chars else 0.0 for p, (k, chars, marks) in stats.items()}
    smooth = _smooth([fused[n.path] for n in nodes])
    mean_of: dict[int, list[float]] = {}
    for n, v in zip(nodes, smooth):
        mean_of.setdefault(n.path, []).append(v)
    mean = sum(smooth) / len(smooth)
    threshold = DEVIATIONS * math.sqrt(sum((v - mean) ** 2 for v in smooth) / len(smooth))
    best = max(fused.values())
    return {p for p, vs in mean_of.items() if fused[p] and (fused[p] == best or sum(vs) / len(vs) >= threshold and fused[p] >= LEAST_SHARE * best)}


def _container(nodes: list[Node], chosen: set[int], elements: list[Element], home: list[int]) -> int:
    """The deepest element that holds nine tenths of the chosen text, or 0 for the page."""
    held = [0] * len(elements)
    for n in nodes:
        if n.path in chosen:
            held[home[n.element]] += len(n.text)
    for at in range(len(elements) - 1, 0, -1):
        held[elements[at].parent] += held[at]
    # an element's number is above its parent's, so the last of those with the share is the deepest
    return max((at for at, x in enumerate(held) if x and x >= 0.9 * held[0]), default=0)


def main_text(page: str | None) -> str:
    """The article's blocks, one a line; empty if there are none.

    The chosen paths' blocks are the text.  With them stay, in the element around nearly
    all of it, headings, and blocks that aren't links only if they stand with
    chosen text in one element or between chosen blocks.
    """
    if not page:
        return ""
    nodes, elements = parse(page)
    if not nodes:
        return ""
    factors, outer = set_paths(nodes, elements)
    chosen = content_paths(nodes, factors)
    if not chosen:
        return ""
    # an element without others of text in it, as a paragraph, a list or a table is at home in what holds it
    home = [0] * len(elements)
    for i, e in enumerate(elements[1:], 1):
        home[i] = i if outer[i] and e.tag in HOMES else home[e.parent]
    around = _container(nodes, chosen, elements, home)
    inside = [around == 0]
    for at in range(1, len(elements)):
        inside.append(at == around or inside[elements[at].parent])
    homes = {home[n.element] for n in nodes if n.path in chosen}
    places = [i for i, n in enumerate(nodes) if n.path in chosen]
    first, last, least = places[0], places[-1], elements[around].factor

    def stays(i: int, n: Node) -> bool:
        if n.path in chosen:
            return True
        if not inside[n.element] or elements[n.element].factor < least:
            return False
        return n.heading and i < last or not n.linked and (home[n.element] in homes or first < i < last) or n.heading and home[n.element] in homes

    keep = {n.block for i, n in enumerate(nodes) if stays(i, n)}
    blocks: dict[int, list[str]] = {}
    for n in nodes:
        if n.block in keep:
            blocks.setdefault(n.block, []).append(n.text)
    lines = (BLANK.sub(" ", "".join(parts)).strip() for parts in blocks.values())
    return "\n".join(x for x in lines if x)


@F.pandas_udf(StringType())
def main_text_udf(pages: pd.Series) -> pd.Series:
    return pd.Series([main_text(x) for x in pages], dtype="object")


def extract(pages: DataFrame, html_col: str = "html", name: str = "text") -> DataFrame:
    """``pages`` with the main text in ``name``; a column of that name is replaced, all others stay.

    Null and empty pages, and pages without text, give an empty text.  Rows
    are independent: nothing is shuffled, repeated rows get the same text; no rows give no rows.
    """
    return pages.withColumn(name, main_text_column(F.col(html_col)))


def main_text_column(page: Column) -> Column:
    return main_text_udf(page)
