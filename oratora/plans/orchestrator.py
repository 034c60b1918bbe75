"""Runs analyzers from a configuration, one failing apart from the others."""

from __future__ import annotations

import copy
import json
from pathlib import Path

from pyspark.sql import DataFrame

from . import analyzers as _analyzers  # noqa: F401  registers them
from . import registry
from .cache import ResultCache
from .registry import Inputs

DEFAULTS = {"analyzers": {n: {"enabled": True, "features": {}, "options": {}} for n in registry.names()}, "cache": {"enabled": False, "dir": None}}


def merge(base: dict, over: dict) -> dict:
    """``over`` laid onto a copy of ``base``, level by level."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def load_config(path: str | None = None) -> dict:
    """Defaults with a JSON (or, where a reader is installed, YAML) file laid over; a missing file gives the defaults."""
    if not path or not Path(path).exists():
        return copy.deepcopy(DEFAULTS)
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith(".json"):
        given = json.loads(text)
    else:
        import yaml

        given = yaml.safe_load(text)
    return merge(DEFAULTS, given or {})


def save_config(config: dict, path: str) -> None:
    Path(path).write_text(json.dumps(config, indent=2, ensure_ascii=False), encoding="utf-8")


def lookup(config: dict, dotted: str, default=None):
    at = config
    for part in dotted.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


class Orchestrator:
    """``run`` one analyzer, or ``run_all`` that are enabled and whose inputs are there."""

    def __init__(self, inputs: Inputs, config: dict | None = None, cache: ResultCache | None = None):
        self.inputs, self.config, self.cache = inputs, merge(DEFAULTS, config or {}), cache

    def run(self, name: str) -> dict[str, DataFrame]:
        """Lazy tables of one analyzer; an unknown name is a ValueError."""
        cls = registry.get(name)
        settings = self.config["analyzers"].get(name, {})
        return cls(self.inputs, settings.get("features"), **settings.get("options", {})).compute()

    def run_rows(self, name: str) -> dict[str, list[dict]]:
        """Rows of one analyzer's tables, from the cache where it has them for these very plans."""
        tables = self.run(name)
        if self.cache is None:
            return {k: [r.asDict(recursive=True) for r in t.collect()] for k, t in tables.items()}
        return {k: self.cache.rows(f"{name}_{k}", t) for k, t in tables.items()}

    def run_all(self) -> dict[str, dict]:
        """Rows by analyzer; errors show when rows are made, so they are caught there and reported in place."""
        out: dict[str, dict] = {}
        for name in registry.enabled(self.config):
            needs = registry.get(name).dependencies
            if "embeddings" in needs and not self.inputs.embeddings or "centroids" in needs and self.inputs.centroids is None:
                continue
            try:
                out[name] = self.run_rows(name)
            except Exception as e:
                out[name] = {"error": str(e)}
        return out
