"""Small helpers shared by the training-data operators."""

from __future__ import annotations

import atexit
import gc
import sys
import tempfile
import time
import uuid
from collections.abc import Callable

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Characters that separate words in the contracts: space and 0x09-0x0D.
BLANKS = " \t\n\x0b\f\r"
BLANK_RUN = "[\\x20\\x09-\\x0D]+"

#: Rows up to which a table may be broadcast; larger ones are joined by shuffle.
BROADCAST_ROWS = 200_000


def send_by_value(module: str) -> None:
    """Ship the Python functions of ``module`` with the job, so executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` with a reliable checkpoint in the folder that all executors share."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Honour ``spark.checkpoint.dir``; only a local master may do without and gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None and not (sc.master == "local" or sc.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="oratora-checkpoint-"))


def scratch(spark: SparkSession) -> str:
    """A new folder among the checkpoints, removed when the driver ends."""
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    return path


def remove(spark: SparkSession, path: str) -> None:
    """Remove a folder by Spark's own file systems; what can't be removed stays."""
    try:
        jvm = spark._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(jvm.org.apache.hadoop.conf.Configuration()).delete(at, True)
    except Exception:  # noqa: BLE001 - the engine may be gone by then
        pass


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """``df`` written as Parquet beside the checkpoints and read again; nothing refers to its shuffles any more."""
    path = path or scratch(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def free_shuffles(spark: SparkSession) -> None:
    """Let the engine's cleaner find the shuffles that nothing refers to any more; plans go one collection before them."""
    gc.collect()
    for _ in range(2):
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.3)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once for use inside ``body``.

    A reference inside a lambda may otherwise be inlined and evaluated again
    for every element; as a lambda variable it is evaluated once per row.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def words(text: Column) -> Column:
    """Words ``[^\\x20\\x09-\\x0D]+`` of a text; null and blank texts have none."""
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, BLANK_RUN))


def maybe_broadcast(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted and is small; otherwise leave the choice to Spark."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
