"""Analyzers: named groups of metrics over shared inputs, kept in a registry."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..functions.lexicons import LexiconSet
from ..operators import prepare
from ..schemas import Columns


@dataclass
class Inputs:
    """What analyzers read: the speeches, and what else the caller has."""

    speeches: DataFrame
    embeddings: bool = False
    labels: dict[int, str] = field(default_factory=dict)
    centroids: DataFrame | None = None
    cols: Columns = field(default_factory=Columns)
    lexicons: LexiconSet = field(default_factory=LexiconSet)
    _features: DataFrame | None = None

    @property
    def features(self) -> DataFrame:
        """The feature table, planned once for all analyzers."""
        if self._features is None:
            self._features = prepare.speech_features(self.speeches, self.lexicons, self.cols)
        return self._features


class Analyzer(ABC):
    """``compute()`` gives lazy tables by metric name; features can be switched off."""

    name = ""
    version = "1.0"
    default_features: tuple[str, ...] = ()
    dependencies: tuple[str, ...] = ()

    def __init__(self, inputs: Inputs, features: dict[str, bool] | None = None, **options):
        self.inputs, self.options = inputs, options
        self.features = {f: True for f in self.default_features}
        # features that it doesn't know are passed over
        self.features.update({k: bool(v) for k, v in (features or {}).items() if k in self.features or k in self.optional_features})

    optional_features: tuple[str, ...] = ()

    def is_enabled(self, feature: str) -> bool:
        return self.features.get(feature, False)

    def missing(self) -> list[str]:
        """Declared inputs that are absent."""
        have = {"embeddings": self.inputs.embeddings, "labels": bool(self.inputs.labels), "centroids": self.inputs.centroids is not None}
        return [d for d in self.dependencies if not have[d]]

    @property
    def cache_key(self) -> str:
        return f"{self.name}_v{self.version}"

    @abstractmethod
    def compute(self) -> dict[str, DataFrame]: ...


_REGISTRY: dict[str, type[Analyzer]] = {}


def analyzer(name: str) -> Callable[[type[Analyzer]], type[Analyzer]]:
    """Class decorator that registers under ``name``."""

    def keep(cls: type[Analyzer]) -> type[Analyzer]:
        cls.name = name
        _REGISTRY[name] = cls
        return cls

    return keep


def get(name: str) -> type[Analyzer]:
    if name not in _REGISTRY:
        raise ValueError(f"unknown analyzer {name!r}; there are {', '.join(names())}")
    return _REGISTRY[name]


def names() -> list[str]:
    return list(_REGISTRY)


def all_analyzers() -> dict[str, type[Analyzer]]:
    return dict(_REGISTRY)


def enabled(config: dict) -> list[str]:
    """Names that the configuration doesn't switch off."""
    return [n for n in _REGISTRY if config.get("analyzers", {}).get(n, {}).get("enabled", True)]


def by_dependency(dependency: str) -> list[str]:
    return [n for n, c in _REGISTRY.items() if dependency in c.dependencies]


def clear() -> None:
    _REGISTRY.clear()
