"""Sequence packing: tokenise, cut, and pack shortest-pack-first over the length histogram."""

from __future__ import annotations

import base64
import bisect
import sys
from collections.abc import Iterator
from types import ModuleType

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, maybe_broadcast, send_by_value

send_by_value(__name__)

CAPACITY = 2048
END_ID = 1
#: Tokenised words that one Python worker remembers (about 100 bytes each).
CACHE_WORDS = 300_000
#: Buckets into which equal lengths are dealt when they are ranked.
BUCKETS = 256

PIECE_SCHEMA = "doc_id bigint, start bigint, length int, doc_tokens bigint, ids binary"


# --- tokens ---------------------------------------------------------------------------------------------------


class WordCache(dict):
    """Space-led word -> its token ids as little-endian unsigned 32-bit bytes; emptied when full."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHE_WORDS:
            self.clear()
        value = self[word] = np.array(self.encode(" " + word), dtype="<u4").tobytes()
        return value


def encoder(vocabulary: str):
    """A function text -> ids for a ``tokenizers`` file, or a rank file (``.tiktoken``) of the same vocabulary.

    Both give the same ids; the rank file is read by a library that is
    several times as fast.  A special token's string in a text is that token.
    """
    if vocabulary.endswith(".tiktoken"):
        import public_tokenizers
        import tiktoken

        with open(vocabulary, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        enc = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={"<|endoftext|>": len(ranks)})
        return lambda text: enc.encode(text, allowed_special="all")
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary)
    return lambda text: tokenizer.encode(text, add_special_tokens=False).ids


def _worker_cache(vocabulary: str) -> WordCache:
    """One cache a worker process, kept between tasks."""
    kept = sys.modules.setdefault("_oratora_worker", ModuleType("_oratora_worker"))
    caches = kept.__dict__.setdefault("caches", {})
    if vocabulary not in caches:
        caches[vocabulary] = WordCache(encoder(vocabulary))
    return caches[vocabulary]


def token_bytes(text: str | None, cache: WordCache) -> bytes:
    """The ids of a text, 4 bytes each.

    Between a non-blank and a single space that leads a non-blank the
    pre-tokeniser always cuts, so such texts are encoded word by word from the
    cache; a text with other blanks at these places is encoded whole there.
    """
    if not text:
        return b""
    first, *rest = text.split(" ")
    if all(rest) and first and not first[-1].isspace() and list(map(str.strip, rest)) == rest:
        return np.array(cache.encode(first), dtype="<u4").tobytes() + b"".join(map(cache.__getitem__, rest))
    return np.array(cache.encode(text), dtype="<u4").tobytes()


def tokenise(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, start, length, doc_tokens, ids``.

    Every document's ids end with ``end_id``; a null or empty text has that one
    only.  ``ids`` are little-endian unsigned 32-bit.  Whole pieces come first,
    the rest is the last piece.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        cache, end = _worker_cache(vocabulary), end_id.to_bytes(4, "little")
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for doc, text in zip(batch["id"], batch["text"]):
                ids = token_bytes(text, cache) + end
                n = len(ids) // 4
                for at in range(0, n, capacity):
                    part = ids[4 * at : 4 * (at + capacity)]
                    rows.append((None if pd.isna(doc) else int(doc), at, len(part) // 4, n, part))
                    held += len(part)
                    if held > 1 << 24:
                        yield _frame(rows)
                        rows, held = [], 0
            if rows:
                yield _frame(rows)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(run, PIECE_SCHEMA)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=["doc_id", "start", "length", "doc_tokens", "ids"])
    out["doc_id"] = out["doc_id"].astype("Int64")
    return out


# --- patterns -------------------------------------------------------------------------------------------------


def shortest_pack_first(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, tuple[int, ...]]]:
    """Packing patterns ``(count, lengths)`` for a histogram of lengths.

    Lengths are placed longest first, all pieces of a length at once.  They go
    to the pattern with the least filled packs that still has room - the most
    room that is left - and where that has more packs than pieces, it is split.
    Pieces that fit nowhere open packs of their own.  Work and patterns are
    bounded by the number of distinct lengths, not by the pieces.
    """
    # patterns by the room that is left, and the rooms in order
    by_room: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, count: int, lengths: tuple[int, ...]) -> None:
        if room not in by_room:
            bisect.insort(rooms, room)
            by_room[room] = []
        same = next((p for p in by_room[room] if p[1] == lengths), None)
        if same:
            same[0] += count
        else:
            by_room[room].append([count, lengths])

    def take(room: int) -> list:
        pattern = by_room[room].pop()
        if not by_room[room]:
            del by_room[room]
            rooms.remove(room)
        return pattern

    for length in sorted((x for x in histogram if histogram[x]), reverse=True):
        left = histogram[length]
        while left:
            if rooms and rooms[-1] >= length:
                room = rooms[-1]
                count, lengths = take(room)
                used = min(count, left)
                if count > used:
                    put(room, count - used, lengths)
                put(room - length, used, (*lengths, length))
                left -= used
            else:
                each = max(1, capacity // length) if length <= capacity // 2 else 1
                full, rest = divmod(left, each)
                if full:
                    put(capacity - each * length, full, (length,) * each)
                if rest:
                    put(capacity - rest * length, 1, (length,) * rest)
                left = 0
    return sorted(((c, lengths) for packs in by_room.values() for c, lengths in packs), key=lambda p: (p[1], p[0]), reverse=True)


def slots(patterns: list[tuple[int, tuple[int, ...]]]) -> list[tuple[int, int, int, int, int]]:
    """Rows ``(length, first_rank, count, first_sequence, offset)``: which ranks of a length go where."""
    next_rank: dict[int, int] = {}
    out, sequence = [], 0
    for count, lengths in patterns:
        offset = 0
        for length in lengths:
            first = next_rank.get(length, 0)
            out.append((length, first, count, sequence, offset))
            next_rank[length] = first + count
            offset += length
        sequence += count
    return out


def rank_in_length(pieces: DataFrame) -> DataFrame:
    """``pieces`` with ``rank``, from 0 without gaps within each length.

    Equal lengths are dealt over buckets, numbered there, and shifted by the
    counts of the buckets before, so a common length is never in one task.
    """
    bucketed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "start"), F.lit(BUCKETS)).cast("int"))
    counts = bucketed.groupBy("length", "bucket").count()
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    shift = counts.select("length", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("shift"))
    number = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "start", "doc_tokens"))
    return bucketed.withColumn("number", number).join(shift, ["length", "bucket"]).withColumn("rank", F.col("number") - 1 + F.col("shift")).drop("number", "shift", "bucket")


def assign(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.

    The histogram (at most ``capacity`` rows) goes to the driver; the slots
    that come back are bounded by the distinct lengths too.
    """
    spark = pieces.sparkSession
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    rows = slots(shortest_pack_first(histogram, capacity))
    table = spark.createDataFrame(rows or [(0, 0, 0, 0, 0)], "length int, first_rank bigint, slots bigint, first_sequence bigint, offset bigint")
    ranked = rank_in_length(pieces)
    found = ranked.join(maybe_broadcast(table, len(rows)), "length").filter((F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("first_rank") + F.col("slots")))
    return found.withColumn("sequence_id", F.col("first_sequence") + F.col("rank") - F.col("first_rank")).select(*pieces.columns, "sequence_id", "offset")


def pack(docs: DataFrame, vocabulary: str, payload: dict[str, Column] | None = None, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All documents as pieces in sequences of at most ``capacity`` tokens.

    Columns: doc_id, start, length, doc_tokens, the payload, sequence_id and
    offset.  ``payload`` names columns derived from a piece, its ``ids``
    included; without one the ids themselves are kept.  Null and empty texts
    hold the end id only; repeated rows and null ids are packed like others;
    no rows give no pieces.
    """
    payload = {"ids": F.col("ids")} if payload is None else payload
    pieces = cut(tokenise(docs, vocabulary, id_col, text_col, capacity, end_id).select("doc_id", "start", "length", "doc_tokens", *[c.alias(k) for k, c in payload.items()]))
    return assign(pieces, capacity).select(F.col("doc_id").alias(id_col), "start", F.col("length").cast("long").alias("length"), "doc_tokens", *payload, "sequence_id", "offset")
