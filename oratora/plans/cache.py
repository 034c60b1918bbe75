"""Result cache in memory and Parquet, and the age rules of stored tables."""

from __future__ import annotations

import fnmatch
import hashlib
from datetime import datetime, timezone
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def key_of(name: str, **params) -> str:
    """One key for a name and its parameters, whatever their order."""
    return "_".join([name, *[f"{k}={params[k]}" for k in sorted(params)]])


def fingerprint(df: DataFrame) -> str:
    """Of the plan and the files it reads, so that new data or a new query never meet an old result."""
    plan = df._jdf.queryExecution().analyzed().semanticHash()
    files = sorted(df.inputFiles())
    stamps = [f"{f}:{Path(f.removeprefix('file://')).stat().st_mtime_ns}" if f.startswith("file:") else f for f in files]
    return hashlib.sha256("\n".join([str(plan), *df.columns, *stamps]).encode()).hexdigest()[:24]


class Folder:
    """A folder on whatever file system Spark reaches: the entries in it, and their removal."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark._jvm
        self.path = jvm.org.apache.hadoop.fs.Path(path)
        self.files = self.path.getFileSystem(spark._jsc.hadoopConfiguration())
        self._child = lambda name: jvm.org.apache.hadoop.fs.Path(self.path, name)

    def names(self) -> list[str]:
        return sorted(s.getPath().getName() for s in self.files.listStatus(self.path)) if self.files.exists(self.path) else []

    def has(self, name: str) -> bool:
        return self.files.exists(self._child(f"{name}/_SUCCESS"))

    def size(self, name: str) -> int:
        return self.files.getContentSummary(self._child(name)).getLength()

    def remove(self, name: str) -> None:
        self.files.delete(self._child(name), True)


class ResultCache:
    """Rows of small results by name and fingerprint, in memory and, with a folder that all share, in Parquet."""

    def __init__(self, folder: str | None = None):
        self.folder, self.memory, self.hits, self.misses = folder, {}, 0, 0

    def _path(self, key: str) -> str:
        return f"{self.folder}/{key}"

    def _disk(self) -> Folder | None:
        return Folder(SparkSession.getActiveSession(), self.folder) if self.folder else None

    def rows(self, name: str, df: DataFrame) -> list[dict]:
        key = key_of(name, plan=fingerprint(df))
        if key in self.memory:
            self.hits += 1
            return self.memory[key]
        if self.folder and Folder(df.sparkSession, self.folder).has(key):
            self.hits += 1
            df = df.sparkSession.read.parquet(self._path(key))
        else:
            self.misses += 1
            if self.folder:
                df.write.mode("overwrite").parquet(self._path(key))
                df = df.sparkSession.read.parquet(self._path(key))
        self.memory[key] = [r.asDict(recursive=True) for r in df.collect()]
        return self.memory[key]

    def _keys(self, pattern: str) -> list[str]:
        disk = self._disk()
        return sorted(k for k in {*self.memory, *(disk.names() if disk else [])} if fnmatch.fnmatch(k, pattern))

    def has(self, pattern: str) -> bool:
        return bool(self._keys(pattern))

    def invalidate(self, pattern: str = "*") -> int:
        """Forget entries by pattern, in memory and on disk; how many there were."""
        gone, disk = self._keys(pattern), self._disk()
        for k in gone:
            self.memory.pop(k, None)
            if disk:
                disk.remove(k)
        return len(gone)

    def clear(self) -> int:
        """Forget everything; how many entries there were."""
        return self.invalidate()

    def info(self) -> dict:
        """Entries in memory and on disk, and the bytes that those take."""
        disk = self._disk()
        names = disk.names() if disk else []
        return {"folder": self.folder, "in_memory": len(self.memory), "on_disk": len(names), "bytes": sum(map(disk.size, names)) if disk else 0, "entries": self._keys("*")}

    def clear_memory(self) -> None:
        self.memory.clear()

    def stats(self) -> dict:
        return {"hits": self.hits, "misses": self.misses, "entries": len(self.memory)}


def metadata(source: str, version: str = "1.0", now: datetime | None = None) -> dict:
    return {"created_at": (now or datetime.now(timezone.utc)).isoformat(), "version": version, "source": source}


def age_days(meta: dict, now: datetime | None = None) -> int | None:
    """Whole days since creation; None without a readable date."""
    try:
        made = datetime.fromisoformat(meta["created_at"])
    except (KeyError, ValueError, TypeError):
        return None
    now = now or datetime.now(timezone.utc)
    if made.tzinfo is None:
        made = made.replace(tzinfo=timezone.utc)
    return (now - made).days


def is_valid(meta: dict, max_age_days: int, now: datetime | None = None) -> bool:
    age = age_days(meta, now)
    return age is not None and age < max_age_days


def missing_embeddings(speeches: DataFrame, stored: DataFrame, key: str = "speech_id") -> DataFrame:
    """Speeches that have no stored vector yet."""
    return speeches.join(stored.select(key), key, "left_anti")
