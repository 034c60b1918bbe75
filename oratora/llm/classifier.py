"""Quality classifier from weak labels: EM over heuristic labellers, then a hashed linear scorer."""

from __future__ import annotations

import math
import re
import sys
from dataclasses import dataclass
from functools import cached_property
from operator import eq
from types import ModuleType

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from .common import cut, maybe_broadcast, send_by_value, stored
from .quality_rules import SYMBOLS

send_by_value(__name__)

FEATURES = 1 << 18
#: Rows on which the linear scorer is fitted, at most; everything else uses all rows.
FIT_ROWS = 8_000
#: Score from which a row goes.  On held-out labels of 10,000 documents it keeps 0.99 of the clean rows, and 0.99 of the junk and 0.94 of the toxic ones go.
THRESHOLD = 0.2

#: Insults in three lists, so that labellers overlap without being one rule. Fixed values.
INSULTS = (
    ("idiot", "idiots", "moron", "morons", "stupid", "dumb", "imbecile"),
    ("trash", "garbage", "scum", "filth", "vermin", "worthless"),
    ("pathetic", "disgusting", "loser", "losers", "clown", "clowns", "ugly", "freak"),
)

Votes = tuple[int | None, ...]
"""One entry a labeller: 1 for the class, 0 against it, None to abstain."""

INSULT = [frozenset(x) for x in INSULTS]
LETTERS = re.compile(r"[^\W\d_]+")
#: Words by whose share the lists of insults know their language. Fixed values.
ENGLISH = frozenset("the and of to is that with for was".split())
#: Words in which repeats are looked for at once, so that long texts compare with short ones.
WINDOW = 200


def distinct_share(w: list[str]) -> float:
    """Share of distinct words, the mean over all consecutive windows of the text by their words."""
    return sum(len(set(w[i : i + WINDOW])) for i in range(0, len(w), WINDOW)) / max(1, len(w))


class Reading:
    """What labellers and features look at in a text, each made once."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def words(self) -> list[str]:
        return self.text.split()

    @cached_property
    def letters(self) -> list[str]:
        """Lower-cased runs of letters."""
        return LETTERS.findall(self.text.lower())

    @cached_property
    def data(self) -> bytes:
        return self.text.encode("utf-8", "surrogatepass")

    def count(self, chars: str) -> int:
        """How many of the text's characters are among some of ASCII."""
        return len(self.data) - len(self.data.translate(None, chars.encode()))

    @cached_property
    def symbols(self) -> int:
        return self.count(SYMBOLS)

    @cached_property
    def marks(self) -> int:
        return self.count("!?|")

    @cached_property
    def stops(self) -> int:
        return self.count(".,;:")

    @cached_property
    def capitals(self) -> int:
        return self.count("ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def _read(text: str | Reading) -> Reading:
    return text if isinstance(text, Reading) else Reading(text)


def junk_votes(text: str | Reading) -> Votes:
    """Overlapping signs of text that isn't prose: symbols, capitals, marks and echoes, which abstain where there
    is none; and few distinct words, few words of letters (and a stop), few in small letters, few stops, which also vote against."""
    r = _read(text)
    w = r.words
    n, chars = max(1, len(w)), max(1, sum(map(len, w)))

    def sign(share: float, most: float) -> int | None:
        return 1 if share > most else None

    def measure(share: float, bad: float, good: float) -> int | None:
        return 1 if share < bad else 0 if share > good else None

    return (
        sign(r.symbols / n, 0.25),
        sign(r.capitals / chars, 0.5),
        sign(r.marks / n, 0.25),
        sign(sum(map(eq, w, w[1:])) / n, 0.3),
        measure(distinct_share(w), 0.25, 0.4),
        measure((sum(map(str.isalpha, w)) + r.stops) / n, 0.6, 0.85),
        measure(sum(map(str.islower, w)) / n, 0.35, 0.6),
        measure(r.stops / n, 0.02, 0.04),
    )


def toxic_votes(text: str | Reading) -> Votes:
    """Lists of insults, each alone a weak sign; in texts that aren't English they don't apply."""
    words = _read(text).letters
    found = set(words)
    against = 0 if words and sum(map(ENGLISH.__contains__, words)) >= 0.1 * len(words) else None
    return tuple(against if found.isdisjoint(x) else 1 for x in INSULT)


HEADS = {"junk": junk_votes, "toxic": toxic_votes}
#: Heads whose labellers say something by abstaining; those of the others then don't apply, and that says nothing.
TELLING = frozenset({"junk"})
#: Given labels are one more labeller: column of the labels table, and whether 1 means the class.
GIVEN = {"junk": ("quality", False), "toxic": ("toxic", True)}
#: Its accuracy is estimated like the others', from a first guess that counts as much as all of its votes.
GIVEN_ACCURACY = 0.99


@dataclass
class LabelModel:
    """Per labeller, the chances of the votes 0, 1 and abstention by class; and the class's share."""

    prior: float
    chances: list[dict[int | None, tuple[float, float]]]

    def posterior(self, votes: tuple) -> float:
        log0, log1 = math.log(1 - self.prior), math.log(self.prior)
        for vote, chance in zip(votes, self.chances):
            p0, p1 = chance[vote]
            log0, log1 = log0 + math.log(p0), log1 + math.log(p1)
        return 1 / (1 + math.exp(min(700.0, log0 - log1)))


def fit_label_model(patterns: dict[tuple, int], telling: bool = True, rounds: int = 200) -> LabelModel:
    """Expectation-maximisation over vote patterns and their counts; the last vote is the given label.

    Labellers are independent given the class.  It starts from the given label, else from whether
    any labeller votes for the class; a small prior count keeps chances off 0 and 1 and says that a vote is
    right more often than wrong.  Abstaining is a vote like others if that is ``telling``.
    """
    k = len(next(iter(patterns), ()))
    total = sum(patterns.values())
    if not total:
        return LabelModel(0.5, [{v: (1 / 3, 1 / 3) for v in (0, 1, None)} for _ in range(k)])
    given = sum(n for p, n in patterns.items() if p[-1] is not None)

    def start(votes: tuple) -> float:
        if votes[-1] is not None:
            return GIVEN_ACCURACY if votes[-1] else 1 - GIVEN_ACCURACY
        return 0.9 if 1 in votes else 0.1

    belief = {p: start(p) for p in patterns}
    model = LabelModel(0.5, [])
    for _ in range(rounds):
        ones = sum(belief[p] * n for p, n in patterns.items())
        prior = min(max((ones + 1) / (total + 10), 1e-4), 1 - 1e-4)
        chances = []
        for j in range(k):
            if j == k - 1:
                right, wrong = GIVEN_ACCURACY * given + 1, (1 - GIVEN_ACCURACY) * given + 0.1
                counts = {0: [right, wrong], 1: [wrong, right]}
            else:
                counts = {0: [2.0, 0.5], 1: [0.5, 2.0]} | ({None: [1.0, 1.0]} if telling else {})
            for p, n in patterns.items():
                if p[j] in counts:
                    counts[p[j]][0] += n * (1 - belief[p])
                    counts[p[j]][1] += n * belief[p]
            sums = [sum(c[i] for c in counts.values()) for i in (0, 1)]
            chances.append({None: (1.0, 1.0)} | {v: (c[0] / sums[0], c[1] / sums[1]) for v, c in counts.items()})
        model = LabelModel(prior, chances)
        new = {p: model.posterior(p) for p in patterns}
        moved = max(abs(new[p] - belief[p]) for p in patterns)
        belief = new
        if moved < 1e-6:
            break
    return model


def _code(votes: tuple) -> int:
    return sum((2 if v is None else v) * 3**i for i, v in enumerate(votes))


@F.pandas_udf(ArrayType(IntegerType()))
def vote_codes(texts: pd.Series) -> pd.Series:
    """The votes of each head as one number, base three."""
    return pd.Series([[_code(votes(r)) for votes in HEADS.values()] for r in map(Reading, texts.fillna(""))])


def _decode(code: int, k: int) -> tuple:
    digits = [(code // 3**i) % 3 for i in range(k)]
    return tuple(None if d == 2 else d for d in digits)


# --- features -------------------------------------------------------------------------------------------------

PREFIX = 5
LEVELS = 11
STYLES = ("symbols", "marks", "capitals", "distinct", "stops")
STYLE_AT = FEATURES
SIZE = FEATURES + LEVELS * len(STYLES)
LOW = (1 << 20) - 1
CACHE_WORDS = 300_000


class WordIndex(dict):
    """Word -> its hashed feature and that of its first letters, in one int; emptied when full."""

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = (xxhash.xxh32_intdigest(word) % FEATURES) << 20 | xxhash.xxh32_intdigest("\x02" + word[:PREFIX]) % FEATURES
        return value


def features(text: str | Reading | None, index: WordIndex) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words and their first letters (repeats included), and one style feature per kind."""
    r = _read(text or "")
    found = r.letters
    packed = np.fromiter(map(index.__getitem__, found), np.int64, len(found))
    n, chars = max(1, len(found)), max(1, sum(map(len, found)))
    shares = (r.symbols / n, r.marks / n, r.capitals / chars, distinct_share(found), r.stops / n)
    style = np.array([STYLE_AT + i * LEVELS + min(LEVELS - 1, int(10 * v)) for i, v in enumerate(shares)], np.int64)
    return np.concatenate((packed >> 20, packed & LOW)), style


def margin(weights: np.ndarray, words: np.ndarray, style: np.ndarray) -> list[float]:
    """One margin a head: bias, words over the root of their number, style."""
    root = math.sqrt(max(1, len(words)))
    return [float(w[-1] + np.take(w, words).sum() / root + np.take(w, style).sum()) for w in weights]


def fit_linear(rows: list[tuple[np.ndarray, np.ndarray]], targets: np.ndarray, row_weights: np.ndarray, rounds: int = 150, sparsity: float = 2e-3, least_rows: int = 20) -> np.ndarray:
    """Weights of one logistic scorer on soft targets: sparse, by accelerated proximal gradient with restarts.

    Rows of weight 0 are left out; words of fewer than ``least_rows`` rows only let the fit learn these by heart.
    """
    some = np.flatnonzero(row_weights > 0)
    if not len(some):
        return np.zeros(SIZE + 1, np.float32)
    share, targets = row_weights[some] / row_weights.sum(), targets[some]
    counted = [(*np.unique(rows[i][0], return_counts=True), math.sqrt(max(1, len(rows[i][0]))), rows[i][1]) for i in some]
    sizes = np.array([len(w) + len(s) + 1 for w, _, _, s in counted])
    at = np.concatenate([np.concatenate((w, s, [SIZE])) for w, _, _, s in counted])
    value = np.concatenate([np.concatenate((n / root, np.ones(len(s) + 1))) for _, n, root, s in counted])
    held = (np.bincount(at, minlength=SIZE + 1) >= min(least_rows, len(some)))[at]
    row, at, value = np.repeat(np.arange(len(some)), sizes)[held], at[held], value[held]
    # columns in units of their root mean square
    scale = np.sqrt(np.bincount(at, value**2 * share[row], SIZE + 1))
    scale = np.where(scale > 0, scale, 1)
    value = value / scale[at]

    def scores(weights: np.ndarray) -> np.ndarray:
        return np.bincount(row, weights[at] * value, len(some))

    def back(errors: np.ndarray) -> np.ndarray:
        return np.bincount(at, (errors * share)[row] * value, SIZE + 1)

    # the step is the inverse of the curvature's bound, by power iteration
    along = np.ones(SIZE + 1)
    for _ in range(12):
        further = back(scores(along))
        curvature, along = np.linalg.norm(further) / np.linalg.norm(along), further / np.linalg.norm(further)
    step = 1 / (0.25 * 1.1 * curvature)
    weights, ahead, momentum = np.zeros(SIZE + 1), np.zeros(SIZE + 1), 1.0
    shrink = np.full(SIZE + 1, sparsity)
    shrink[-1] = 0.0
    for _ in range(rounds):
        gradient = back(1 / (1 + np.exp(-np.clip(scores(ahead), -30, 30))) - targets)
        moved = ahead - step * gradient
        moved = np.sign(moved) * np.maximum(np.abs(moved) - step * shrink, 0)
        if ((ahead - moved) * (moved - weights)).sum() > 0:
            momentum = 1.0
        after = (1 + math.sqrt(1 + 4 * momentum**2)) / 2
        ahead, weights, momentum = moved + (momentum - 1) / after * (moved - weights), moved, after
    return (weights / scale).astype(np.float32)


@dataclass
class Scorer:
    head: str
    labels: LabelModel
    patterns: dict[tuple, int]
    weights: np.ndarray | None = None

    def label(self, votes: tuple) -> float:
        """The weak label: the posterior of a text's own votes."""
        return self.labels.posterior((*votes, None))


def draw_shares(sizes: list[int], rows: int) -> list[float]:
    """The share to draw from each stratum, so that ``rows`` come and small strata come whole."""
    left, shares = rows, [1.0] * len(sizes)
    for i, k in zip(sorted(range(len(sizes)), key=lambda i: sizes[i]), range(len(sizes), 0, -1)):
        take = min(sizes[i], left / k)
        shares[i] = take / sizes[i]
        left -= take
    return shares


def train(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", fit_rows: int = FIT_ROWS) -> list[Scorer]:
    """Label models from the votes on all rows, and linear scorers fitted on ``fit_rows`` of them at most.

    The votes of all rows are counted by pattern; ``labels`` (id and
    the columns of ``GIVEN``) vote as one more labeller where they exist.  Rows to
    fit on are drawn one by one, copies too, by a random number from their pattern's
    share, so that rare patterns are there; rows weigh the root of what they stand for, rows without a vote nothing,
    and their targets are posteriors.
    """
    spark = docs.sparkSession
    sizes = {name: len(votes("")) for name, votes in HEADS.items()}
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.withColumn("__key", F.xxhash64("__id", F.coalesce("__text", F.lit(""))))
    if labels is None:
        told = spark.createDataFrame([], "__label_id bigint, __quality int, __toxic int")
    else:
        told = labels.groupBy(F.col(id_col).alias("__label_id")).agg(F.max("quality").alias("__quality"), F.max("toxic").alias("__toxic"))

    def with_given(i: int, name: str) -> Column:
        column, same = GIVEN[name]
        vote = F.col(f"__{column}") if same else 1 - F.col(f"__{column}")
        return (F.coalesce(vote, F.lit(2)).cast("int") * 3 ** sizes[name] + F.get("__votes", F.lit(i))).alias(name)

    coded = rows.select("__id", "__key", F.rand(17).alias("__u"), vote_codes("__text").alias("__votes"))
    voted = stored(coded.join(told, F.col("__id") == F.col("__label_id"), "left").select("__key", "__u", *[with_given(i, name) for i, name in enumerate(HEADS)]))
    counts = voted.groupBy(*HEADS).count().collect()
    out = []
    for name in HEADS:
        patterns: dict[tuple, int] = {}
        for r in counts:
            p = _decode(r[name], sizes[name] + 1)
            patterns[p] = patterns.get(p, 0) + r["count"]
        out.append(Scorer(name, fit_label_model(patterns, name in TELLING), patterns))
    if not counts:
        return out
    shares = draw_shares([r["count"] for r in counts], fit_rows)
    beliefs = [[s.labels.posterior(_decode(r[s.head], sizes[s.head] + 1)) for s in out] for r in counts]
    schema = ", ".join([f"{name} int" for name in HEADS] + ["__share double"] + [f"y{i} double" for i in range(len(out))])
    strata = spark.createDataFrame([(*[r[name] for name in HEADS], share, *ys) for r, share, ys in zip(counts, shares, beliefs)], schema)
    drawn = cut(voted.join(maybe_broadcast(strata, len(counts)), list(HEADS)).orderBy(F.col("__u") / F.col("__share")).limit(fit_rows))
    texts = rows.join(maybe_broadcast(drawn.select("__key").distinct(), fit_rows), "__key", "left_semi").dropDuplicates(["__key"]).select("__key", "__text")
    fit = cut(drawn.join(texts, "__key").orderBy("__u", "__key"))
    # where no labeller votes and that says nothing, a row has no label to learn
    silent = [None if name in TELLING else 3 ** (sizes[name] + 1) - 1 for name in HEADS]
    names = list(HEADS)

    def learn(batch: pd.DataFrame) -> pd.DataFrame:
        index = WordIndex()
        rows = [features(x, index) for x in batch["__text"]]
        weight = (1 / batch["__share"].to_numpy()) ** 0.5
        made = [fit_linear(rows, batch[f"y{i}"].to_numpy(), weight * (batch[name] != silent[i]).to_numpy()) for i, name in enumerate(names)]
        return pd.DataFrame([{"head": i, "weights": w.tobytes()} for i, w in enumerate(made)])

    # the sample is bounded by fit_rows, so one task takes it whole
    for r in fit.groupBy(F.lit(0).alias("all")).applyInPandas(learn, "head int, weights binary").collect():
        out[r["head"]].weights = np.frombuffer(r["weights"], np.float32)
    return out


def classify(docs: DataFrame, labels: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD, scorers: list[Scorer] | None = None) -> DataFrame:
    """Per row: id, and for each head its weak label (``junk_label``), score (``junk_score``), and ``kept``.

    A row is kept if no head's linear score reaches the threshold.  Null and
    empty texts count as texts without words.  Repeated rows get the same
    scores each; null ids are ids like others; extra columns are ignored, whatever their names; no rows give no rows.
    """
    scorers = scorers or train(docs, labels, id_col, text_col)
    made = judged_column(F.col(text_col), scorers)
    out = docs.select(F.col(id_col).alias("__id"), made.alias("__made"))
    columns, kept = [], F.lit(True)
    for i, s in enumerate(scorers):
        label, score = F.get("__made", F.lit(2 * i)), F.get("__made", F.lit(2 * i + 1))
        columns += [F.round(label, 6).alias(f"{s.head}_label"), F.round(score, 6).alias(f"{s.head}_score")]
        kept = kept & (score < threshold)
    return out.select(F.col("__id").alias(id_col), *columns, kept.alias("kept"))


def judged_column(text: Column, scorers: list[Scorer]) -> Column:
    """Per head the weak label and the linear scorer's probability, end to end."""
    weights = np.stack([s.weights if s.weights is not None else np.zeros(SIZE + 1, np.float32) for s in scorers]).astype(np.float64)

    @F.pandas_udf("array<double>")
    def judge(texts: pd.Series) -> pd.Series:
        kept = sys.modules.setdefault("_oratora_worker", ModuleType("_oratora_worker"))
        index = kept.__dict__.setdefault("word_index", WordIndex())
        labels: dict[tuple, float] = {}

        def label(s: Scorer, votes: tuple) -> float:
            key = (s.head, votes)
            if key not in labels:
                labels[key] = s.label(votes)
            return labels[key]

        def one(r: Reading) -> list[float]:
            scores = [1 / (1 + math.exp(-min(30.0, max(-30.0, m)))) for m in margin(weights, *features(r, index))]
            return [v for s, score in zip(scorers, scores) for v in (label(s, HEADS[s.head](r)), score)]

        return pd.Series([one(r) for r in map(Reading, texts.fillna(""))])

    return judge(text)
