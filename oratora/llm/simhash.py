"""SimHash near-duplicates by meet-in-the-middle ball hashing."""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import cut, send_by_value
from .graph import connected_components

send_by_value(__name__)

BITS = 64
#: Shingle hashes of one text that are held at a time.
CHUNK = 1 << 15


def fingerprint(text: str | None, size: int = 3, seed: int = 42) -> int:
    """Unsigned SimHash of one text; no words give zero.

    A-Z are lower-cased, words are runs of anything but 0x20 and 0x09-0x0D,
    shingles of ``size`` words count as often as they occur, and fewer words
    form one shingle.  A bit is set if it is set in over half of the hashes.
    """
    if not text:
        return 0
    parts = text.encode("utf-8").lower().split()  # bytes: only A-Z and ASCII blanks are concerned
    if not parts:
        return 0
    joined = b" ".join(parts)
    if len(parts) <= size:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    begin, end = starts[: len(parts) - size + 1].tolist(), ends[size - 1 :].tolist()
    digest, counts, total = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), len(begin)
    for at in range(0, total, CHUNK):
        hashes = np.array([digest(joined[b:e], seed) for b, e in zip(begin[at : at + CHUNK], end[at : at + CHUNK])], dtype="<u8")
        counts += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in np.flatnonzero(2 * counts > total).tolist()))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


@F.pandas_udf(LongType())
def fingerprint_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([_signed(fingerprint(x)) for x in texts], dtype="int64")


def _masks(radius: int) -> list[int]:
    """All ways to flip at most ``radius`` bits."""
    found = {0}
    for _ in range(radius):
        found |= {m ^ (1 << b) for m in found for b in range(BITS)}
    return sorted(_signed(m) for m in found)


def ball_links(prints: DataFrame, radius: int = 2, fp: str = "fp") -> DataFrame:
    """Links ``(a, b)`` that connect all distinct fingerprints at ``radius`` or fewer differing bits.

    Every fingerprint emits all variants within half the radius.  Two
    fingerprints within the radius share a variant, and all that share one lie
    within the radius of each other, so linking each to the smallest of its
    bucket keeps every component without making pairs.  A bucket holds at
    most the ball around its variant (65 for radius 2), whatever the input.
    """
    if radius % 2:
        raise ValueError("the radius must be even: buckets of half the radius then hold only true links")
    masks = F.array([F.lit(m).cast("long") for m in _masks(radius // 2)])
    balls = prints.select(F.col(fp).alias("b"), F.explode(F.transform(masks, lambda m: F.col(fp).bitwiseXOR(m))).alias("variant"))
    low = F.min("b").over(Window.partitionBy("variant"))
    pairs = balls.select(low.alias("a"), "b").filter("a != b")
    return pairs.filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius).distinct()


def _roots(prints: DataFrame, radius: int) -> DataFrame:
    """``(fp, root)`` for each of the distinct fingerprints; fingerprints of one component share the root."""
    roots = connected_components(ball_links(prints, radius), "a", "b")
    return prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row per input row: id, ``fp`` (signed long) and ``component_id``.

    ``component_id`` is the smallest id in the connected component of
    fingerprints at ``radius`` or fewer differing bits.  Null and blank texts
    have fingerprint 0 and link like any other.  Rows may repeat and stay; a
    null id never becomes a component id, so a component of null ids has a
    null one.  Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    printed = cut(docs.select(F.col(id_col).alias("id"), fingerprint_udf(F.col(text_col)).alias("fp")))
    distinct = cut(printed.groupBy("fp").agg(F.min("id").alias("low")))
    rooted = cut(_roots(distinct.select("fp"), radius).join(distinct, "fp"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    classes = cut(rooted.select("fp", "root").join(lowest, "root").select("fp", "component_id"))
    return printed.join(classes, "fp").select(F.col("id").alias(id_col), "fp", "component_id")


def keep_one_per_group(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 2) -> DataFrame:
    """One row of ``docs`` for each group of near-duplicates: that with the smallest id, null ids last.

    Groups are of texts: unlike texts under one id each stay, rows with a
    null id are compared like all others.  Of rows with the group's smallest
    id the one with the smallest hash of its columns stays, so it is the same in
    every run; of rows that are equal throughout, one.  Columns and their order stay; no rows give no rows.
    """
    key = F.xxhash64(*[F.col(c) for c in docs.columns])
    printed = cut(docs.select(F.col(id_col).alias("id"), key.alias("__key"), fingerprint_udf(F.col(text_col)).alias("fp")))
    lowest = cut(printed.groupBy("fp").agg(F.min(F.struct(F.col("id").isNull().alias("last"), "id", "__key")).alias("low")))
    rooted = _roots(lowest.select("fp"), radius).join(lowest, "fp")
    first = cut(rooted.groupBy("root").agg(F.min("low").alias("low")).select("low.__key"))
    return docs.withColumn("__key", key).join(first, "__key", "left_semi").dropDuplicates(["__key"]).select(*docs.columns)
