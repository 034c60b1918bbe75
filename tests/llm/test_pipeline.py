"""The pipeline as a whole, against a brute-force version of its first stages and the rules of its last."""

import collections
import re
import zlib

import corpus_pipeline as P
import numpy as np
import public_tokenizers
import pytest
from oratora.llm import pii
from test_operators import EDGE, brute_components, brute_fingerprint, brute_measures, brute_shingles, brute_spans, brute_term_spans, brute_terms


def brute_clean(text, terms):
    """Base spans as their kind, terms generalised or removed; of overlapping ones the first, then the longer."""
    spans = [(a, -b, f"[{k.upper()}]") for k, a, b in brute_spans(text)]
    spans += [(a, -b, "" if terms[text[a:b].lower()] >= pii.REMOVE else "[TERM]") for _, a, b in brute_term_spans(text, terms)]
    out, at = [], 0
    for a, b, by in sorted(spans):
        if a >= at:
            out += [text[at:a], by]
            at = -b
    return "".join(out) + text[at:]


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    items = [brute_shingles(r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    at, kept = docs, {}
    for name, stage in P.STAGES[:4]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
        at = at.persist()
        kept[name] = {r.doc_id: r.text for r in at.collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    base = {i for i, t in texts.items() if (m := brute_measures(t)) and not (m[0] < 50 or 100 * m[4] > 50 * m[0])}
    assert set(kept["quality_rules"]) <= base
    ids = sorted(kept["quality_rules"])
    roots = brute_components([brute_fingerprint(texts[i]) for i in ids])
    low = {}
    for i, r in zip(ids, roots):
        low.setdefault(r, i)
    assert set(kept["simhash_dedup"]) == set(low.values())
    clean = {i for i in low.values() if not any(s and len(s & brute_shingles(texts[i])) / len(s) >= 0.8 for s in items)}
    assert set(kept["decontamination"]) == clean == set(kept["pii"])
    assert not any(re.search(r"[A-Za-z0-9]@[A-Za-z0-9-]+\.[A-Za-z]", t) for t in kept["pii"].values())
    before = kept["decontamination"]
    terms = brute_terms(sorted(before.items()))
    assert kept["pii"] == {i: brute_clean(t, terms) for i, t in before.items()}
    assert {r.doc_id: r.n_chars for r in at.collect()} == {i: len(t) for i, t in kept["pii"].items()}
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: np.array(ref.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in kept["pii"].items()}
    pieces, sequences = collections.Counter(), collections.defaultdict(list)
    for r in P.STAGES[4][1](spark, at, sf_dir).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        pieces[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert pieces == {i: len(x) for i, x in ids.items()}
    for s in sequences.values():
        assert all(a + n == b for (a, n), (b, _) in zip(sorted(s), [*sorted(s)[1:], (sum(n for _, n in s), 0)]))


@pytest.mark.parametrize("name,stage", P.STAGES)
def test_stage_edges(spark, sf_dir, name, stage):
    """Null ids and texts, repeated rows, long texts and no rows at all."""
    rows = [(i, t, None, "x", None if t is None else len(t)) for i, t in EDGE]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = stage(spark, docs, sf_dir)
    assert name == "packing" or got.columns == docs.columns
    kept = collections.Counter((r.doc_id, r.text) for r in got.collect()) if name != "packing" else None
    if name in ("decontamination", "pii"):
        assert kept == collections.Counter(EDGE)
    if name == "simhash_dedup":
        assert max(kept.values()) == 1 and len({brute_fingerprint(t) for _, t in kept}) == len(kept) == len({brute_fingerprint(t) for _, t in EDGE})
    if name == "quality_rules":
        assert all(brute_measures(t)[0] >= 50 for _, t in kept)
    assert stage(spark, docs.limit(0), sf_dir).count() == 0


def test_run(spark, sf_dir):
    rows = P.run(spark, sf_dir).collect()
    sizes = collections.Counter()
    for r in rows:
        sizes[r.sequence_id] += r.length
    assert rows and max(sizes.values()) <= 2048
    by_doc = collections.Counter()
    for r in rows:
        by_doc[r.doc_id] += r.length
    assert all(by_doc[r.doc_id] == r.doc_tokens for r in rows)
