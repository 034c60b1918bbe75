"""Language-model scores: stupid backoff over bigrams, by joins of count tables with exploded n-grams.

Counts and exploded pairs move in packed form: one row holds, as binary
columns, what one stretch of texts has for one hash bucket.  A bucket's rows
meet its part of the count table, so every join is by hash and its size is
bounded by the bucket, and the engine shuffles few large rows instead of one
small row a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_shuffles, send_by_value, stored

send_by_value(__name__)

ALPHA = 0.4
#: Stands before the first word of a document.
START = 0
#: Words with at least this share of all tokens are known to every task; so they are a million at most.
HOT_WORDS = 1_000_000
#: Pairs in at least one of so many documents (of a sample of one in SAMPLE) are counted first and valued where they stand.
HOT_PAIRS, SAMPLE = 1_000, 64
#: Rounds into which the pairs are dealt, so that one round's shuffle is a part of the whole.
ROUNDS = 2
#: Tokens of one bucket, about, and the fewest buckets.
BUCKET_TOKENS, LEAST_BUCKETS = 1_000_000, 128
#: Occurrences of a word whose pairs go into one bucket, about.
SPREAD_TOKENS = 100_000
#: Bytes a token, blanks included, as a rough guide to the number of buckets.
TOKEN_BYTES = 6
#: Bytes of text that are taken at a time.
CHUNK_BYTES = 6_000_000

#: Kinds of packed rows: pairs of words, counts of words and of frequent pairs, words that need their count, and sums of documents.
PAIRS, COUNTS, PAIR_COUNTS, NEEDS, SUMS = range(5)
PACKED = "kind int, bucket int, a binary, b binary, doc binary, tf binary, own_a binary, own_b binary, keys binary"
NAMES = [x.split()[0] for x in PACKED.split(", ")]
_K1, _K2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


# --- texts ----------------------------------------------------------------------------------------------------


def hash_word(word: bytes) -> int:
    """Signed XXH64, as the engine's own function gives it."""
    h = xxhash.xxh64_intdigest(word, 42)
    return h - (1 << 64) if h >> 63 else h


def encode(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The lower-cased (A-Z) words between blanks as codes, their number by text, and the hash of each code."""
    parts = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    lengths = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    coded = parts.flatten().dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    words = coded.dictionary.cast(pa.large_binary()).to_pylist()
    if b"" in words:  # around leading and trailing blanks
        held = codes != words.index(b"")
        lengths = np.bincount(np.repeat(np.arange(len(lengths)), lengths)[held], minlength=len(lengths))
        codes = codes[held]
    return codes, lengths, np.array([hash_word(w) for w in words], dtype=np.int64)


def chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """Document keys and texts, about ``CHUNK_BYTES`` at a time; no text is split."""
    held: list[pa.RecordBatch] = []
    size = 0

    def whole() -> tuple[np.ndarray, pa.Array]:
        return np.concatenate([b.column(0).to_numpy(zero_copy_only=False) for b in held]), pa.concat_arrays([b.column(1) for b in held])

    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 8)
        at, before = 0, 0
        while at < batch.num_rows:
            to = min(batch.num_rows, int(np.searchsorted(ends, before + CHUNK_BYTES - size)) + 1)
            held.append(batch.slice(at, to - at))
            size += int(ends[to - 1]) - before
            at, before = to, int(ends[to - 1])
            if size >= CHUNK_BYTES:
                yield whole()
                held, size = [], 0
    if held:
        yield whole()


def mixed(h: np.ndarray) -> np.ndarray:
    """Hashes spread evenly over 64 bits."""
    u = h.view(np.uint64) * _K1
    return (u ^ (u >> np.uint64(32))) * _K2


def bucket_of(h: np.ndarray, buckets: int) -> np.ndarray:
    return ((mixed(h) >> np.uint64(24)) % np.uint64(buckets)).astype(np.int32)


def pair_hash(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (mixed(a) + b.view(np.uint64)).view(np.int64)


@dataclass
class Known:
    """What every task knows: the frequent words and pairs with their counts, and the sums."""

    words: np.ndarray  # hashes, sorted
    counts: np.ndarray
    pairs: np.ndarray  # hashes, sorted
    pair_counts: np.ndarray
    total: int
    alpha: float
    buckets: int

    @staticmethod
    def look(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """The values of the wanted keys, -1 where there are none."""
        if not len(keys):
            return np.full(len(wanted), -1, np.int64)
        at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
        return np.where(keys[at] == wanted, values[at], -1)

    def word_counts(self, h: np.ndarray) -> np.ndarray:
        return self.look(self.words, self.counts, h)

    def seen(self, tf, elsewhere, n_prev, own_prev) -> np.ndarray:
        """What pairs add that occur elsewhere too."""
        return tf * (np.log(elsewhere) - np.log(n_prev - own_prev))

    def backoff(self, tf, n, own) -> np.ndarray:
        """What pairs add that are nowhere else, by the last word's count."""
        known = n - own
        floor = 2 * math.log(self.alpha) - math.log(max(1, self.total))
        return tf * np.where(known > 0, np.log(self.alpha * np.maximum(known, 1) / max(1, self.total)), floor)


def distinct_pairs(encoded: tuple[np.ndarray, np.ndarray, np.ndarray], part: int = 0, rounds: int = 1) -> dict[str, np.ndarray]:
    """Distinct pairs of each of the encoded texts that belong to a round.

    ``a`` and ``b`` are the hashes of both words, ``doc`` the text, ``tf``
    the pair's count in it, ``own_a`` and ``own_b`` those of its words, ``h``
    the pair's hash.
    """
    codes, lengths, hashes = encoded
    size, n = len(hashes) + 1, len(lengths)
    hashes = np.append(hashes, START)
    w = np.insert(codes, np.cumsum(lengths) - lengths, size - 1)
    doc = np.repeat(np.arange(n), lengths + 1)
    _, inverse, counts = np.unique(doc * size + w, return_inverse=True, return_counts=True)
    own = counts[inverse].astype(np.int32)
    at = np.flatnonzero(doc[:-1] == doc[1:])
    h = pair_hash(hashes[w[at]], hashes[w[at + 1]])
    if rounds > 1:
        here = (h.view(np.uint64) >> np.uint64(7)) % np.uint64(rounds) == part
        at, h = at[here], h[here]
    code = (w[at] * size + w[at + 1]) * n + doc[at]
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.append(True, code[1:] != code[:-1])) if len(code) else np.zeros(0, np.int64)
    tf = np.diff(np.append(first, len(code))).astype(np.int32)
    pick = at[order[first]]
    return {"a": hashes[w[pick]], "b": hashes[w[pick + 1]], "doc": doc[pick].astype(np.int32), "tf": tf, "own_a": own[pick], "own_b": own[pick + 1], "h": h[order[first]]}


# --- packed rows ----------------------------------------------------------------------------------------------


def packed(kind: int, bucket: np.ndarray, columns: dict[str, np.ndarray], keys: np.ndarray | None = None) -> pa.RecordBatch:
    """One row a bucket, its columns compressed.  With ``keys`` the column ``doc`` points into them; each row gets the keys it needs."""
    order = np.argsort(bucket, kind="stable")
    bucket = bucket[order]
    columns = {k: v[order] for k, v in columns.items()}
    starts = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])) if len(bucket) else np.zeros(0, np.int64)
    rows: dict[str, list] = {name: [] for name in NAMES}
    press = zstandard.ZstdCompressor(level=1).compress
    for s, e in zip(starts.tolist(), [*starts[1:].tolist(), len(bucket)]):
        rows["kind"].append(kind)
        rows["bucket"].append(int(bucket[s]))
        for name in NAMES[2:-1]:
            if name == "doc" and keys is not None:
                used, index = np.unique(columns["doc"][s:e], return_inverse=True)
                rows["keys"].append(press(keys[used].tobytes()))
                rows["doc"].append(press(index.astype(np.int32).tobytes()))
            else:
                rows[name].append(press(columns[name][s:e].tobytes()) if name in columns else None)
        if keys is None:
            rows["keys"].append(None)
    types = [pa.int32(), pa.int32()] + [pa.binary()] * (len(NAMES) - 2)
    return pa.RecordBatch.from_arrays([pa.array(rows[name], t) for name, t in zip(NAMES, types)], NAMES)


def sums_row(keys: np.ndarray, values: np.ndarray, n_words: np.ndarray, buckets: int) -> pa.RecordBatch:
    """Sums of documents: ``a`` the keys, ``b`` the values, ``own_a`` the numbers of words."""
    return packed(SUMS, bucket_of(keys, buckets), {"a": keys, "b": values, "own_a": n_words.astype(np.int64)})


def unpacked(table: pa.Table, kind: int) -> dict[str, np.ndarray]:
    """The columns of all rows of a kind, end to end; ``doc`` points into ``keys``."""
    rows = table.filter(pc.equal(table.column("kind"), kind))
    types = {"a": np.int64, "b": np.float64 if kind == SUMS else np.int64, "doc": np.int32, "tf": np.int32, "own_a": np.int64 if kind == SUMS else np.int32, "own_b": np.int32, "keys": np.int64}
    unpress = zstandard.ZstdDecompressor().decompress
    out = {name: [np.frombuffer(unpress(x.as_buffer()), t) for x in rows.column(name) if x.is_valid] for name, t in types.items()}
    shift = 0
    for i, k in enumerate(out["keys"]):
        out["doc"][i] = out["doc"][i].astype(np.int64) + shift
        shift += len(k)
    return {name: np.concatenate(x) if x else np.zeros(0, types[name]) for name, x in out.items()}


def summed(keys: np.ndarray, values: np.ndarray, n_words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    found, index = np.unique(keys, return_inverse=True)
    return found, np.bincount(index, values, len(found)), np.bincount(index, n_words, len(found)).astype(np.int64)


def count(batches: Iterator[pa.RecordBatch], pairs: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """Counts of each chunk's words, the start mark included (once a document), and of the given pairs."""
    with np.errstate(over="ignore"):
        for _, texts in chunks(batches):
            codes, lengths, hashes = encode(texts)
            counts = np.append(np.bincount(codes, minlength=len(hashes)), len(lengths))
            hashes = np.append(hashes, START)
            some = counts > 0
            yield packed(COUNTS, bucket_of(hashes[some], buckets), {"a": hashes[some], "b": counts[some].astype(np.int64)})
            if len(pairs):
                w = hashes[np.insert(codes, np.cumsum(lengths) - lengths, len(hashes) - 1)]
                inner = np.ones(len(w), bool)
                inner[np.cumsum(lengths + 1) - 1] = False  # a document's last word leads no pair
                at = Known.look(pairs, np.arange(len(pairs)), pair_hash(w[:-1], w[1:])[inner[:-1]])
                n = np.bincount(at[at >= 0], minlength=len(pairs)).astype(np.int64)
                yield packed(PAIR_COUNTS, bucket_of(pairs[n > 0], buckets), {"a": pairs[n > 0], "b": n[n > 0]})


def deal_pairs(batches: Iterator[pa.RecordBatch], known: Known, part: int, rounds: int) -> Iterator[pa.RecordBatch]:
    """Each chunk's pairs by bucket; frequent pairs are valued at once and leave as sums.

    A pair is dealt by its first word, so that word's count is at hand; the
    pairs of a frequent word, whose count is known anyway, over several buckets.
    """
    with np.errstate(over="ignore"):
        for keys, texts in chunks(batches):
            encoded = encode(texts)
            found = distinct_pairs(encoded, part, rounds)
            n_pair = known.look(known.pairs, known.pair_counts, found["h"])
            hot = n_pair >= 0
            x = {k: v[hot] for k, v in found.items()}
            elsewhere = n_pair[hot] - x["tf"]
            n_a, n_b = known.word_counts(x["a"]), known.word_counts(x["b"])
            value = np.where(elsewhere > 0, known.seen(x["tf"], np.maximum(elsewhere, 1), np.maximum(n_a, x["own_a"] + 1), x["own_a"]), known.backoff(x["tf"], n_b, x["own_b"]))
            yield sums_row(keys, np.bincount(x["doc"], value, len(keys)), encoded[1] * (part == 0), known.buckets)
            found = {k: v[~hot] for k, v in found.items()}
            spread = 1 + np.maximum(known.word_counts(found["a"]), 0) // SPREAD_TOKENS
            bucket = bucket_of(found["a"], known.buckets).astype(np.int64) + (mixed(found.pop("h")) >> np.uint64(33)).astype(np.int64) % spread
            yield packed(PAIRS, (bucket % known.buckets).astype(np.int32), found, keys)


def meet(table: pa.Table, known: Known) -> Iterator[pa.RecordBatch]:
    """A bucket's pairs against its counts: sums of documents, and what still needs the count of a rare word.

    Sums that come along pass through."""
    with np.errstate(over="ignore"):
        yield from table.filter(pc.equal(table.column("kind"), SUMS)).to_batches()
        x, counts = unpacked(table, PAIRS), unpacked(table, COUNTS)
        h = pair_hash(x["a"], x["b"])
        _, index = np.unique(h, return_inverse=True)
        elsewhere = np.bincount(index, x["tf"]).astype(np.int64)[index] - x["tf"] if len(h) else h
        n_a = known.word_counts(x["a"])
        rare = n_a < 0
        n_a[rare] = known.look(counts["a"], counts["b"], x["a"][rare])
        n_b = known.word_counts(x["b"])
        seen = elsewhere > 0
        value = np.zeros(len(h))
        value[seen] = known.seen(x["tf"][seen], elsewhere[seen], n_a[seen], x["own_a"][seen])
        here = ~seen & (n_b >= 0)
        value[here] = known.backoff(x["tf"][here], n_b[here], x["own_b"][here])
        keys, doc = np.unique(x["keys"], return_inverse=True)
        if len(keys):
            yield sums_row(keys, np.bincount(doc[x["doc"]], value, len(keys)), np.zeros(len(keys)), known.buckets)
        more = ~seen & (n_b < 0)
        if more.any():
            yield packed(NEEDS, bucket_of(x["b"][more], known.buckets), {"a": x["b"][more], "doc": doc[x["doc"][more]].astype(np.int32), "tf": x["tf"][more], "own_a": x["own_b"][more]}, keys)


def look_up(table: pa.Table, known: Known) -> Iterator[pa.RecordBatch]:
    """A bucket's rare words against its counts; sums that pass through are added up."""
    with np.errstate(over="ignore"):
        x, counts, sums = unpacked(table, NEEDS), unpacked(table, COUNTS), unpacked(table, SUMS)
        value = known.backoff(x["tf"], known.look(counts["a"], counts["b"], x["a"]), x["own_a"])
        keys = np.concatenate((x["keys"][x["doc"]], sums["a"]))
        if len(keys):
            yield sums_row(*summed(keys, np.concatenate((value, sums["b"])), np.concatenate((np.zeros(len(value)), sums["own_a"]))), known.buckets)


def _empty() -> pa.RecordBatch:
    return packed(SUMS, np.zeros(0, np.int32), {"a": np.zeros(0, np.int64)})


# --- scores ---------------------------------------------------------------------------------------------------


def doc_key(id_col: str, text_col: str) -> Column:
    """One key for rows that agree in id and text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def count_table(texts: DataFrame, pairs: np.ndarray, buckets: int) -> DataFrame:
    """Packed counts of all words and of the given pairs, one row a bucket and kind, the hashes sorted."""

    def merge(table: pa.Table) -> pa.Table:
        bucket, out = table.column("bucket")[0].as_py(), []
        for kind in (COUNTS, PAIR_COUNTS):
            x = unpacked(table, kind)
            found, index = np.unique(x["a"], return_inverse=True)
            n = np.bincount(index, x["b"], len(found)).astype(np.int64)
            out.append(packed(kind, np.full(len(found), bucket, np.int32), {"a": found, "b": n}))
        return pa.Table.from_batches(out)

    return texts.mapInArrow(lambda batches: count(batches, pairs, buckets), PACKED).groupBy("bucket").applyInArrow(merge, PACKED)


def _listed(counts: DataFrame, kind: int, least: float) -> list:
    """Hashes of a kind with their counts, from a count on, in order."""

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(pa.Table.from_batches([batch]), kind)
            some = x["b"] >= least
            yield pa.RecordBatch.from_arrays([pa.array(x["a"][some]), pa.array(x["b"][some])], ["h", "n"])

    return sorted((r.h, r.n) for r in counts.mapInArrow(pick, "h bigint, n bigint").collect())


def _total(counts: DataFrame) -> int:
    """Number of tokens, without start marks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = unpacked(pa.Table.from_batches([batch]), COUNTS)
            yield pa.RecordBatch.from_arrays([pa.array([int(x["b"][x["a"] != START].sum())], pa.int64())], ["n"])

    return counts.mapInArrow(add, "n bigint").agg(F.sum("n")).first()[0] or 0


def frequent_pairs(texts: DataFrame, rows: int) -> np.ndarray:
    """Hashes of the pairs that many documents of a sample have; which they are changes no result.

    They are ``HOT_PAIRS`` times a document's mean number of pairs at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            for _, some in chunks(batches):
                h, n = np.unique(distinct_pairs(encode(some))["h"], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(n.astype(np.int64))], ["h", "n"])

    often = max(8, rows // SAMPLE // HOT_PAIRS)
    found = texts.sample(1 / SAMPLE, seed=11).mapInArrow(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).filter(F.col("n") >= often)
    return np.array(sorted(r.h for r in found.collect()), dtype=np.int64)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alpha: float = ALPHA, rounds: int = ROUNDS) -> DataFrame:
    """Per row: id, ``n_words``, ``log_score`` (natural logarithm, summed) and ``mean_log_score``.

    A word's score given the one before (or the start) is stupid backoff with the
    document's own counts taken out of the corpus': the pair's count over the
    previous word's if the pair occurs elsewhere, else ``alpha`` times the word's
    share of all tokens, and ``alpha`` squared over all tokens for a word
    that is nowhere else.  So a document doesn't vouch for itself, copies of it
    do.

    Null and blank texts have no words, a log score of 0 and a null mean.
    Rows that agree in id and text each get the score of one; null ids are
    like others; extra columns are ignored, whatever their names; a very long
    text is taken whole by one task; no rows give no rows.
    """
    spark = docs.sparkSession
    keyed = docs.select(F.col(id_col).alias("id"), doc_key(id_col, text_col).alias("doc"), F.col(text_col).alias("text"))
    n_rows, size = keyed.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    texts = keyed.select("doc", "text")
    buckets = max(LEAST_BUCKETS, size // TOKEN_BYTES // BUCKET_TOKENS)
    counts = stored(count_table(texts, frequent_pairs(texts, n_rows), buckets))
    total = _total(counts)
    hot, pair_counts = _listed(counts, COUNTS, max(1, total) / HOT_WORDS), _listed(counts, PAIR_COUNTS, 0)
    counts = counts.filter(F.col("kind") == COUNTS)

    def column(rows: list, i: int) -> np.ndarray:
        return np.array([r[i] for r in rows], dtype=np.int64)

    held = spark.sparkContext.broadcast(Known(column(hot, 0), column(hot, 1), column(pair_counts, 0), column(pair_counts, 1), total, alpha, buckets))

    def by_bucket(rows: DataFrame, of) -> DataFrame:
        def run(table: pa.Table) -> pa.Table:
            return pa.Table.from_batches([_empty(), *of(table, held.value)])

        return rows.groupBy("bucket").applyInArrow(run, PACKED)

    def add_up(table: pa.Table) -> pa.Table:
        x = unpacked(table, SUMS)
        keys, values, n_words = summed(x["a"], x["b"], x["own_a"])
        return pa.table({"doc": keys, "v": values, "n": n_words})

    sums = []
    for part in range(rounds):
        dealt = texts.mapInArrow(lambda batches: deal_pairs(batches, held.value, part, rounds), PACKED)
        met = by_bucket(dealt.unionByName(counts), meet)
        sums.append(stored(by_bucket(met.unionByName(counts), look_up).groupBy("bucket").applyInArrow(add_up, "doc bigint, v double, n bigint")))
        del dealt, met
        free_shuffles(spark)
    each = sums[0]
    for more in sums[1:]:
        each = each.unionByName(more)
    # rows of one key were scored together: each gets its part
    base = keyed.select("id", "doc")
    times = base.groupBy("doc").agg(F.count("*").alias("times"))
    each = each.groupBy("doc").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).join(times, "doc").select("doc", (F.col("v") / F.col("times")).alias("v"), (F.col("n") / F.col("times")).cast("long").alias("n"))
    mean = F.when(F.col("n") > 0, F.round(F.col("v") / F.col("n"), 6))
    return stored(base).join(stored(each), "doc").select(F.col("id").alias(id_col), F.col("n").alias("n_words"), F.round("v", 6).alias("log_score"), mean.alias("mean_log_score"))
