"""Results as nested JSON documents, one per source."""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import counts
from ..schemas import Columns
from .orchestrator import Orchestrator
from .registry import Inputs

FILE_NAMES = {"senate": "senato.json", "camera": "camera.json"}


def plain(value):
    """JSON types only."""
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    if isinstance(value, (date, datetime)):
        return value.isoformat()
    return float(value) if isinstance(value, Decimal) else value


def document(speeches: DataFrame, source: str, inputs: dict | None = None, config: dict | None = None, cols: Columns = Columns()) -> dict:  # noqa: B008
    """Everything about one source: statistics, speakers, topics, rebels and all analyzers.

    Only aggregates are collected; the speeches themselves go out by
    ``write_speeches``.
    """
    own = speeches.filter(F.col(cols.source) == source)
    rows = lambda df: [r.asDict(recursive=True) for r in df.collect()]
    return plain({
        "source": source,
        "stats": next(iter(rows(counts.source_stats(own, cols))), {}),
        "deputies": rows(counts.speaker_aggregates(own, cols)),
        "deputies_by_period": rows(counts.aggregates_by_period(own, cols)),
        "clusters": rows(counts.topic_meta(own, (inputs or {}).get("labels"), cols)),
        "rebels": rows(counts.top_rebels(own, cols)),
        "analytics": Orchestrator(Inputs(own, cols=cols, **(inputs or {})), config).run_all(),
    })


def write_document(doc: dict, folder: str) -> str:
    path = Path(folder, FILE_NAMES.get(doc["source"], f"{doc['source']}.json"))
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps(doc, indent=2, ensure_ascii=False), encoding="utf-8")
    return str(path)


def write_speeches(exported: DataFrame, path: str, cols: Columns = Columns()) -> None:  # noqa: B008
    """Speech rows as JSON lines, a folder a source."""
    exported.write.mode("overwrite").partitionBy(cols.source).json(path)
