"""Places for models that the caller brings: encoders, entity finders, sentiment scorers.

None ships here.  Each is a function that makes the model in the worker, so that it is
loaded once a task and runs on Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import Columns
from .counts import top_by
from .prepare import COLS


def topic_texts(topics: dict[int, tuple[str, list[str]]]) -> dict[int, str]:
    """What is encoded for a topic: its label and keywords."""
    return {i: f"{label}: {', '.join(words)}" if words else label for i, (label, words) in topics.items()}


def embed(df: DataFrame, make: Callable[[], Callable[[list[str]], list[list[float]]]], cols: Columns = COLS) -> DataFrame:
    """``(id, embedding)`` by an encoder of lists of texts."""
    id_col, text_col = cols.id, cols.text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make()
        for b in batches:
            yield pd.DataFrame({"id": b[id_col], "embedding": list(encode(b[text_col].fillna("").tolist()))})

    return df.select(cols.id, cols.text).mapInPandas(run, "id bigint, embedding array<float>").withColumnRenamed("id", cols.id)


def model_sentiment(df: DataFrame, make: Callable[[], Callable[[list[str]], list[float]]], cols: Columns = COLS, length: int = 512, size: int = 32) -> DataFrame:
    """``(id, sentiment)`` by a scorer of batches of texts, cut to a model's length."""
    id_col, text_col = cols.id, cols.text

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        score = make()
        for b in batches:
            texts = b[text_col].fillna("").str.slice(0, length).tolist()
            yield pd.DataFrame({"id": b[id_col], "sentiment": [x for i in range(0, len(texts), size) for x in score(texts[i : i + size])]})

    return df.select(cols.id, cols.text).mapInPandas(run, "id bigint, sentiment double").withColumnRenamed("id", cols.id)


def entity_focus(df: DataFrame, make: Callable[[], Callable[[str], list[tuple[str, str]]]], cols: Columns = COLS, least: int = 3, k: int = 10, length: int = 10_000) -> DataFrame:
    """Most frequent persons, organisations and places of each speaker, by a finder of ``(entity, kind)``."""
    speaker, text = cols.speaker, cols.text
    kinds = {"GPE": "LOC", "PER": "PER", "PERSON": "PER", "ORG": "ORG", "LOC": "LOC"}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        find = make()
        for b in batches:
            rows = [(s, e, kinds[kind]) for s, t in zip(b[speaker], b[text]) for e, kind in find((t or "")[:length]) if kind in kinds]
            yield pd.DataFrame(rows, columns=["speaker", "entity", "kind"])

    enough = df.groupBy(speaker).agg(F.count("*").alias("n")).filter(F.col("n") >= least).select(speaker)
    found = df.join(enough, speaker, "left_semi").select(speaker, text).mapInPandas(run, "speaker string, entity string, kind string").withColumnRenamed("speaker", speaker)
    counts = found.groupBy(speaker, "kind", "entity").agg(F.count("*").alias("n"))
    return top_by(counts, [speaker, "kind"], [F.desc("n"), F.asc("entity")], k)
