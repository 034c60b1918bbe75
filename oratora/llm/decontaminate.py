"""Benchmark decontamination: containment search by size-partitioned MinHash sketches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, let, maybe_broadcast

SHINGLE = 5
THRESHOLD = 0.8
SEED = 1_000_003


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    spaced = F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{M}\\p{N}]+", " "))
    return F.when(spaced == "", F.array().cast("array<string>")).otherwise(F.split(spaced, " "))


def _windows(w: Column, size: int, of) -> Column:
    return F.transform(F.sequence(F.lit(0), F.size(w) - size), lambda i: of([F.get(w, i + j) for j in range(size)]))


def shingle_hashes(text: Column, size: int = SHINGLE) -> Column:
    """A hash for each shingle; fewer words form one shingle, no words none."""
    return let(
        plain_words(text),
        lambda w: F.when(F.size(w) >= size, _windows(w, size, lambda x: F.xxhash64(*x)))
        .when(F.size(w) > 0, F.array(F.xxhash64(F.array_join(w, " "))))
        .otherwise(F.array().cast("array<bigint>")),
    )


def shingles(text: Column, size: int = SHINGLE) -> Column:
    """The distinct shingles themselves."""
    return let(
        plain_words(text),
        lambda w: F.when(F.size(w) >= size, F.array_distinct(_windows(w, size, lambda x: F.concat_ws(" ", *x))))
        .when(F.size(w) > 0, F.array(F.array_join(w, " ")))
        .otherwise(F.array().cast("array<string>")),
    )


def sketches(items: DataFrame, item_col: str = "item_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``(item, h)``: each item's bottom MinHash values, as many as its size class needs.

    Items fall into classes by the number of their distinct shingles, powers
    of two.  An item of n shingles that a document contains to ``threshold``
    misses at most (1 - threshold) n of them, so of one more than that
    smallest MinHash values at least one is in the document.  A class takes the number that its
    largest size needs; no contained item is lost.
    """
    hashed = items.select(F.col(item_col).alias("item"), F.array_distinct(shingle_hashes(F.col(text_col))).alias("hs")).filter(F.size("hs") > 0)
    largest = F.pow(F.lit(2.0), F.length(F.bin(F.size("hs")))) - 1
    k = F.floor(largest * (1 - threshold) + 1e-9).cast("int") + 1
    ranked = F.array_sort(F.transform("hs", lambda h: F.struct(F.xxhash64(h, F.lit(SEED)).alias("rank"), h.alias("h"))))
    return hashed.select("item", F.explode(F.slice(ranked, F.lit(1), k)).alias("s")).select("item", "s.h").distinct()


def candidates(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Distinct ``(doc, item)`` whose document holds a sketched shingle of the item."""
    sketched = cut(sketches(items, item_col, item_text_col, threshold))
    held = docs.select(F.col(id_col).alias("doc"), F.explode(shingle_hashes(F.col(text_col))).alias("h"))
    return held.join(maybe_broadcast(sketched, sketched.count()), "h").select("doc", "item").distinct()


def contained_items(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Pairs of a document and a benchmark item that it contains.

    Columns: id, item, ``n_item`` (distinct five-word shingles of the item),
    ``n_shared`` (those that the document has) and ``containment``, at least
    ``threshold``.  Words are lower-cased runs of letters and digits.  An item
    or document of under five words is one shingle; without words it matches
    nothing.  Null ids match nothing.  Rows that repeat an id count as one
    document (the largest containment holds); an empty table gives no rows.
    """
    found = cut(candidates(docs, items, id_col, text_col, item_col, item_text_col, threshold).filter("doc is not null and item is not null"))
    texts = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("doc_text"))
    wanted = items.select(F.col(item_col).alias("item"), shingles(F.col(item_text_col)).alias("wanted"))
    wanted = maybe_broadcast(wanted, wanted.agg(F.sum(F.size("wanted"))).first()[0] or 0)
    # the document's shingles are made once a document, then held against each of its items
    by_doc = found.groupBy("doc").agg(F.collect_set("item").alias("their"))
    per_doc = texts.join(by_doc, "doc").select("doc", shingles(F.col("doc_text")).alias("has"), "their")
    pairs = per_doc.select("doc", "has", F.explode("their").alias("item")).join(wanted, "item")
    shared = F.size(F.array_intersect("wanted", "has")).cast("long")
    counted = pairs.select("doc", "item", F.size("wanted").cast("long").alias("n_item"), shared.alias("n_shared"))
    best = counted.groupBy("doc", "item").agg(F.max("n_item").alias("n_item"), F.max("n_shared").alias("n_shared"))
    return best.withColumn("containment", F.col("n_shared") / F.col("n_item")).filter(F.col("containment") >= threshold - 1e-12).select(F.col("doc").alias(id_col), F.col("item").alias(item_col), "n_item", "n_shared", "containment")


def drop_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **kw) -> DataFrame:
    """The rows of ``docs`` whose text contains no item; columns stay.

    Texts decide, so rows with a null id or with unlike texts under one id are
    judged each by its own.  Null and empty texts contain nothing; an empty table gives no rows.
    """
    key = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumn("__key", key)
    bad = cut(contained_items(keyed.select("__key", F.col(text_col)), items, "__key", text_col, **kw).select("__key").distinct())
    return keyed.join(bad, "__key", "left_anti").select(*docs.columns)
