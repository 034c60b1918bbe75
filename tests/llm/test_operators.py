"""Each training-data operator against a brute-force version, and its edge cases."""

import collections
import functools
import hashlib
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from oratora.llm import chat, classifier, decontaminate, graph, html_text, lm, packing, pii, quality_rules, queries, simhash, url_filter

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
EDGE = [(1, None), (2, ""), (3, " \n\t "), (4, "one"), (4, "one"), (5, "one two"), (None, "null id text here"), (6, "a b c " * 400), (7, "Z" * 3000), (8, "é😀 ñ\x0bword\x0cx\r\nend"), (9, "x" + " y" * 5000)]


@pytest.fixture(scope="module")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}


@pytest.fixture(scope="module")
def edge(spark):
    """Nulls, empty and odd texts, repeated rows, and columns whose names clash with what operators make."""
    rows = [(i, t, "x", "y", 1, "z") for i, t in EDGE]
    return spark.createDataFrame(rows, "doc_id long, text string, fp string, component_id string, n_words int, doc string")


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# --- 1 ---


def brute_fingerprint(text):
    w = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(prints, radius=2):
    parent = list(range(len(prints)))

    def find(i):
        while parent[i] != i:
            i = parent[i] = parent[parent[i]]
        return i

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                parent[find(a)] = find(b)
    return [find(i) for i in range(len(prints))]


def test_simhash(docs, texts):
    got = {r.doc_id: r for r in simhash.near_duplicates(docs).collect()}
    ids = sorted(texts)
    prints = [brute_fingerprint(texts[i]) for i in ids]
    assert [got[i].fp & (2**64 - 1) for i in ids] == prints
    roots = brute_components(prints)
    low = {}
    for i, r in zip(ids, roots):
        low[r] = min(low.get(r, i), i)
    assert [got[i].component_id for i in ids] == [low[r] for r in roots]


def test_simhash_links_nothing_is_lost(spark):
    rnd = random.Random(3)
    prints = []
    for _ in range(12):
        x = rnd.getrandbits(64)
        for _ in range(6):
            prints.append(x)
            x ^= sum(1 << b for b in rnd.sample(range(64), rnd.choice([1, 2, 2, 3])))
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    links = simhash.ball_links(spark.createDataFrame([(p,) for p in signed], "fp long"))
    roots = {r.node: r.root for r in graph.connected_components(links, "a", "b").collect()}
    ours = [roots.get(p, p) for p in signed]
    want = brute_components(prints)
    assert len({(a, b) for a, b in zip(ours, want)}) == len(set(ours)) == len(set(want))


def test_simhash_edges(edge, empty):
    got = simhash.near_duplicates(edge).collect()
    assert len(got) == len(EDGE)
    assert {r.component_id for r in got if r.fp == 0} == {1}  # null, empty and blank are one group
    assert simhash.near_duplicates(empty).count() == 0
    kept = simhash.keep_one_per_group(edge)
    assert kept.columns == edge.columns and kept.filter("doc_id = 4").count() == 1 and kept.filter("doc_id is null").count() == 1
    with pytest.raises(ValueError):
        simhash.ball_links(empty.selectExpr("doc_id as fp"), 3)


def test_one_of_each_group_by_text(spark):
    a, b = "some words that are quite long " * 9, "other things stand in this one " * 9
    rows = [(1, a, 5), (1, b, 5), (2, a, 5), (None, b, 5), (None, "alone " * 9, 5), (None, "alone " * 9, 5), (3, "alone " * 9, 7)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars int")
    assert sorted(map(tuple, simhash.keep_one_per_group(df).collect())) == sorted([(1, a, 5), (1, b, 5), (3, "alone " * 9, 7)])


def test_components_of_a_chain_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(7, 7), (None, 3)]
    got = {r.node: r.root for r in graph.connected_components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()}
    assert all(got[i] == 0 for i in range(41)) and all(got[100 + i] == 100 for i in range(200))


# --- 2 ---


def brute_shingles(text):
    w = re.sub(r"[\W_]+", " ", (text or "").lower()).split()
    return {" ".join(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {" ".join(w)} if w else set()


def test_decontamination(spark, docs, texts, sf_dir):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    got = {(r.doc_id, r.item_id): r.containment for r in decontaminate.contained_items(docs, items).collect()}
    of = {r.item_id: brute_shingles(r.text) for r in items.collect()}
    want = {}
    for d, t in texts.items():
        have = brute_shingles(t)
        for i, s in of.items():
            if s and len(s & have) / len(s) >= 0.8:
                want[d, i] = len(s & have) / len(s)
    assert got == pytest.approx(want) and got


def test_decontamination_of_changed_passages(spark):
    rnd = random.Random(1)
    item = [f"w{rnd.randrange(1000)}x" for _ in range(40)]
    rows = []
    for i in range(60):
        t = item[:]
        for at in rnd.sample(range(40), i % 4):
            t[at] = f"changed{i}"
        rows.append((i, " ".join(["Noise,"] * rnd.randrange(300) + [x.upper() + "!" for x in t] + ["tail"] * 50)))
    docs, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(9, " ".join(item))], "item_id long, text string")
    want = {i for i, t in rows if len(brute_shingles(t) & brute_shingles(" ".join(item))) / 36 >= 0.8}
    assert {r.doc_id for r in decontaminate.contained_items(docs, items).collect()} == want and 0 < len(want) < 60


def test_decontamination_edges(spark, edge, empty):
    items = spark.createDataFrame([(1, "one"), (2, None), (3, ""), (4, "one two"), (None, "null id text here")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.contained_items(edge, items).collect()} == {(4, 1), (5, 4)}
    assert decontaminate.contained_items(empty, items).count() == 0 and decontaminate.contained_items(edge, items.limit(0)).count() == 0
    kept = decontaminate.drop_contaminated(edge, items)
    assert kept.columns == edge.columns and kept.count() == len(EDGE) - 3


def test_contaminated_rows_go_by_their_texts(spark):
    item = "what is the capital of that far away country"
    rows = [(None, f"before {item} after"), (None, "clean"), (7, item), (7, "clean too"), (8, None)]
    df, items = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")
    assert sorted(map(str, decontaminate.drop_contaminated(df, items).collect())) == sorted(map(str, df.filter("doc_id = 8 or text like 'clean%'").collect()))


# --- 3 ---


def test_chat(spark):
    rows = [
        (1, 0, "user", "Hello there, how does packing work?\nSecond line of the question."),
        (1, 1, "assistant", "> Hello there, how does packing work?\nIt packs the sequences tightly."),
        (1, 2, "user", "Thanks a lot for everything so far"),
        (1, 3, "user", "On Monday X wrote:\n> It packs  the sequences\n> tightly.\n>> Hello there, how does packing work?\nAnd then what happens?"),
        (1, 4, None, None),
        (None, 1, "user", "x"),
        (2, 0, "user", "> nothing known in here at all\nbody"),
        (2, 0, "user", "> nothing known in here at all\nbody"),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.format_chats(df).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == len(rows)
    assert (by[1, 1].parent_turn, by[1, 1].root_turn, by[1, 1].depth) == (0, 0, 1)
    assert (by[1, 3].parent_turn, by[1, 3].root_turn, by[1, 3].depth) == (1, 0, 2)
    assert by[1, 3].text == "And then what happens?" and by[1, 2].parent_turn == 1 and by[1, 2].depth == 0
    assert by[1, 4].text == "" and by[1, 4].role == "user" and by[2, 0].text == "body"
    assert [t for _, t in sorted((r.reply_key, r.turn) for r in got if r.conv_id == 1)] == [0, 1, 3, 2, 4]
    assert chat.format_chats(df.limit(0)).count() == 0


def test_long_quote_chain(spark):
    says = [f"message number {i} has some words of its own" for i in range(20)]
    rows = [(1, i, "user", (f"> {says[i - 1]}\n" if i else "") + says[i]) for i in range(20)]
    got = {r.turn: (r.root_turn, r.depth) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {i: (0, i) for i in range(20)}


def test_message_before_over_gaps(spark):
    turns = [0, 2, 4, 5, 1022, 1024, 5000, 5001, -3]
    rows = [(c, t, "user", "x") for c in (1, 2) for t in turns[c - 1 :]]
    got = {(r.conv_id, r.turn): r.parent_turn for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {(c, t): p for c in (1, 2) for ts in [sorted(turns[c - 1 :])] for p, t in zip([None, *ts], ts)}
    assert got == want


def test_short_messages_are_linked(spark):
    rows = [
        (1, 0, "user", "Does it work?"),
        (1, 1, "assistant", "Yes!"),
        (1, 2, "user", "Why not?"),
        (1, 3, "user", "Yes"),
        (1, 5, "user", "And a long line that is told here\nYes"),
        (1, 6, "user", "Something else"),
        (1, 7, "user", "> yes\nFine"),
        (1, 8, "user", "> Why not?\nBecause."),
        (1, 9, "user", "yes"),
        (1, 10, "user", "> And a long line that is told here\n> Yes\nSo it is"),
    ]
    got = {r.turn: (r.parent_turn, r.root_turn, r.depth) for r in chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[7] == (5, 5, 1) and got[8] == (2, 2, 1) and got[10] == (5, 5, 1)


def brute_threads(rows):
    """Parent by quote, root and depth of each turn, from the definition, message by message."""

    def norm(x):
        return re.sub(r"[\W_]+", " ", x.lower()).strip()

    def runs(text):
        out, body = [], []
        for line in (text or "").split("\n"):
            m = re.match(r"(?:[ \t]{0,3}>)+ ?", line)
            level, rest = (m[0].count(">"), line[m.end() :]) if m else (0, line)
            if level:
                if out and out[-1][0] == level:
                    out[-1][1].append(rest)
                else:
                    out.append((level, [rest]))
            else:
                out.append((0, [line]))
                body.append(line)
        return [x for x in out if x[0]], "\n".join(body).strip("\n")

    own, quoted = {}, {}
    for conv, turn, text in rows:
        quotes, body = runs(text)
        own[conv, turn] = {norm(p) for p in (body, *re.split(r"\n\s*\n", body), *body.split("\n"))} - {""}
        quoted[conv, turn] = [(level, norm(p), 0 if len(norm(p)) >= 12 else 1 if i == 0 else 2) for level, run in quotes for i, p in enumerate((" ".join(run), *run)) if norm(p)]
    parent = {}
    for (conv, turn), qs in quoted.items():
        hits = []
        for level, p, rank in qs:
            at = [t for (c, t), o in own.items() if c == conv and t < turn and p in o]
            first = [t for (c, t), o in own.items() if c == conv and p in o]
            if rank == 0 and first and min(first) < turn:
                hits.append((level, rank, -min(first)))
            elif rank and at:
                hits.append((level, rank, -max(at)))
        parent[conv, turn] = -min(hits)[2] if hits else None
    out = {}
    for (conv, turn), p in parent.items():
        at, depth = turn, 0
        while parent[conv, at] is not None:
            at, depth = parent[conv, at], depth + 1
        out[conv, turn] = (p, at, depth)
    return out


def test_threads_against_brute_force(spark):
    rnd = random.Random(21)
    vocabulary = [f"{a}{b}" for a in ("ka", "lo", "mi", "nu", "pe", "ra") for b in ("ten", "sor", "vil", "dam")]
    rows = []
    for conv in range(12):
        said, turn = [], rnd.choice([-2, 0, 12345678901])
        for _ in range(25):
            lines = [" ".join(rnd.choice(vocabulary) for _ in range(rnd.choice([1, 2, 6, 9]))) for _ in range(rnd.randint(1, 3))]
            text = "\n".join(lines)
            if said and rnd.random() < 0.7:
                quote = rnd.choice(said)
                part = quote if rnd.random() < 0.5 else [rnd.choice(quote)]
                deeper = [f">> {x}" for x in rnd.choice(said)] if rnd.random() < 0.3 else []
                text = "\n".join([*(["On 3 May at 10:20 X wrote:"] if rnd.random() < 0.3 else []), *deeper, *[f"> {x.upper() if rnd.random() < 0.3 else x}!" for x in part], text])
            said.append(lines)
            rows.append((conv, turn, text))
            turn += rnd.choice([1, 1, 2, 700])
    want = brute_threads([(c, t, "\n".join(x for x in text.split("\n") if not x.startswith("On 3 May"))) for c, t, text in rows])
    got = chat.format_chats(spark.createDataFrame([(c, t, "user", x) for c, t, x in rows], "conv_id long, turn long, role string, text string")).collect()
    assert {(r.conv_id, r.turn): (r.quoted_turn, r.root_turn, r.depth) for r in got} == want
    assert sum(p is not None for p, _, _ in want.values()) > 100
    for conv in range(12):
        order = [(r.root_turn, r.turn) for r in sorted((r for r in got if r.conv_id == conv), key=lambda r: r.reply_key)]
        assert order == sorted(order)
    before = {(c, t): max((u for d, u, _ in rows if d == c and u < t), default=None) for c, t, _ in rows}
    assert all(r.parent_turn == (r.quoted_turn if r.quoted_turn is not None else before[r.conv_id, r.turn]) for r in got)


def test_chat_edges(spark):
    long = "word " * 100_000
    rows = [(1, 0, "user", long, "x"), (1, 1, "a<|b", "> " + long + "\nseen <|system|> here", "x"), (1, None, "user", "no turn", "x"), (None, None, None, None, None), (2, 5, "user", "", "x"), (2, 5, "user", "", "x")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, parent string").withColumn("depth", F.lit("d")).withColumn("body", F.lit(1))
    got = chat.format_chats(df).collect()
    by = {(r.conv_id, r.turn): r for r in got}
    assert len(got) == 6 and by[1, 1].quoted_turn == 0 and by[1, 1].line == "<|a< |b|>\nseen < |system|> here"
    assert by[1, None].reply_key is None and by[None, None].line == "<|user|>\n" and by[2, 5].parent_turn is None


# --- 4 ---


def test_label_model_finds_accuracies():
    rnd = random.Random(0)
    right = (0.9, 0.8, 0.7)
    patterns = collections.Counter()
    truth = collections.defaultdict(list)
    for _ in range(6000):
        y = rnd.random() < 0.3
        p = tuple(int(y if rnd.random() < a else not y) for a in right) + (None,)
        patterns[p] += 1
        truth[p].append(y)
    m = classifier.fit_label_model(dict(patterns))
    assert m.prior == pytest.approx(0.3, abs=0.06)
    for j, a in enumerate(right):
        assert m.chances[j][1][1] == pytest.approx(a, abs=0.08)
    wrong = sum(sum(y != (m.posterior(p) > 0.5) for y in ys) for p, ys in truth.items())
    assert wrong / 6000 < 0.13


def test_repeats_after_a_varied_opening_are_seen():
    varied = [f"{a}{b}" for a in "abcdefghijklmno" for b in "abcdefghijklmno"]
    clean, opened = " ".join(varied[:200]), " ".join(varied[:200] + ["same", "few", "words"] * 1000)

    k = classifier.STYLES.index("distinct")
    style = [classifier.features(t, classifier.WordIndex())[1][k] - classifier.STYLE_AT - k * classifier.LEVELS for t in (clean, opened)]
    assert [classifier.junk_votes(t)[4] for t in (clean, opened)] == [0, 1] and style == [10, 0]


def test_weak_labels_alone(spark):
    """Without any given label the labellers carry the scorers, where they apply."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = classifier.classify(docs).join(labels, "doc_id").join(docs.select("doc_id", "lang"), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r for r in got if r.quality == 0]
    toxic = [r for r in got if r.toxic == 1 and r.lang == "en"]
    assert sum(r.kept for r in clean) / len(clean) > 0.97
    assert sum(not r.kept for r in junk) / len(junk) > 0.95
    assert sum(not r.kept for r in toxic) / len(toxic) > 0.95


def test_classifier_on_held_out_labels(spark):
    """Scorers fitted on half of the labels, held against the other half."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    half = F.xxhash64("doc_id") % 2 == 0
    got = classifier.classify(docs, labels.filter(half)).join(labels.filter(~half), "doc_id").collect()
    clean = [r for r in got if r.quality == 1 and r.toxic == 0]
    junk = [r for r in got if r.quality == 0]
    toxic = [r for r in got if r.toxic == 1]
    assert sum(r.kept for r in clean) / len(clean) > 0.97
    assert sum(not r.kept for r in junk) / len(junk) > 0.85
    assert sum(not r.kept for r in toxic) / len(toxic) > 0.75
    print([sum(r.kept == k for r in x) / len(x) for x, k in ((clean, True), (junk, False), (toxic, False))])


def brute_em(rows, telling):
    """Expectation-maximisation row by row, with the definition's prior counts."""
    votes = np.array([[2 if v is None else v for v in r] for r in rows])
    n, k = votes.shape
    given = (votes[:, -1] < 2).sum()
    y = np.where(votes[:, -1] < 2, np.where(votes[:, -1] == 1, 0.99, 0.01), np.where((votes == 1).any(1), 0.9, 0.1))
    for _ in range(200):
        prior = min(max((y.sum() + 1) / (n + 10), 1e-4), 1 - 1e-4)
        log = np.tile(np.log([1 - prior, prior]), (n, 1))
        for j in range(k):
            add = {0: (2, 0.5), 1: (0.5, 2)} | ({2: (1, 1)} if telling else {})
            if j == k - 1:
                right, wrong = 0.99 * given + 1, 0.01 * given + 0.1
                add = {0: (right, wrong), 1: (wrong, right)}
            for c, weight in ((0, 1 - y), (1, y)):
                sums = {v: add[v][c] + weight[votes[:, j] == v].sum() for v in add}
                for v in sums:
                    log[votes[:, j] == v, c] += math.log(sums[v] / sum(sums.values()))
        new = 1 / (1 + np.exp(np.minimum(700, log[:, 0] - log[:, 1])))
        moved, y = np.abs(new - y).max(), new
        if moved < 1e-6:
            break
    return y


def test_classifier_against_brute_force(spark, docs, texts, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    given = {r.doc_id: r for r in labels.collect()}
    scorers = classifier.train(docs, labels)
    got = {r.doc_id: r for r in classifier.classify(docs, labels, scorers=scorers).collect()}
    ids = sorted(texts)
    for s, votes, telling in zip(scorers, (classifier.junk_votes, classifier.toxic_votes), (True, False)):
        own = [votes(texts[i] or "") for i in ids]
        known = [None if i not in given else 1 - given[i].quality if s.head == "junk" else given[i].toxic for i in ids]
        rows = [(*v, g) for v, g in zip(own, known)]
        assert s.patterns == collections.Counter(rows)
        assert [s.labels.posterior(r) for r in rows] == pytest.approx(list(brute_em(rows, telling)), abs=1e-4)
        for i, v in zip(ids, own):
            words, style = classifier.features(texts[i], classifier.WordIndex())
            dense = np.zeros(classifier.SIZE + 1)
            np.add.at(dense, words, 1 / math.sqrt(max(1, len(words))))
            dense[[*style, -1]] += 1
            assert got[i][f"{s.head}_score"] == pytest.approx(1 / (1 + math.exp(-min(30, max(-30, dense @ s.weights)))), abs=2e-6)
            assert got[i][f"{s.head}_label"] == pytest.approx(s.labels.posterior((*v, None)), abs=1e-6)
    assert all(r.kept == (max(r.junk_score, r.toxic_score) < classifier.THRESHOLD) for r in got.values())


def test_votes():
    prose = "The cat sat on the mat, and that was the end of it. A dog is with us for one day, said my old friend, to the others. "
    assert classifier.junk_votes(prose) == (None, None, None, None, 0, 0, 0, 0)
    assert classifier.junk_votes(prose.replace(" ", "### "))[0] == 1 and classifier.junk_votes(prose.replace(" ", "### "))[5] == 1
    assert classifier.junk_votes(prose.upper())[1] == 1 and classifier.junk_votes(prose.upper())[6] == 1
    assert classifier.junk_votes(" | ".join(prose.split()))[2] == 1
    assert classifier.junk_votes("echo echo " * 50)[3:5] == (1, 1) and classifier.junk_votes("no stops at all " * 9)[7] == 1
    assert classifier.toxic_votes(prose) == (0, 0, 0) and classifier.toxic_votes(prose + "idiot") == (1, 0, 0)
    assert classifier.toxic_votes("Das ist ein Satz") == (None,) * 3 and classifier.toxic_votes("") == (None,) * 3


def test_fit_sample_is_bounded(spark, monkeypatch):
    """Copies of one text under one id are drawn one by one, and never more rows than asked for come."""
    rows = [(7, "same text again and again")] * 3000 + [(i, f"text {i} is a little longer, and it ends.") for i in range(300)]
    seen = []
    monkeypatch.setattr(classifier, "cut", lambda df, real=classifier.cut: seen.append(real(df)) or seen[-1])
    classifier.train(spark.createDataFrame(rows, "doc_id long, text string"), fit_rows=200)
    assert [x.count() for x in seen] == [200, 200] and seen[1].filter("__text like 'same%'").count() > 50


def test_draw_shares():
    shares = classifier.draw_shares([5, 100, 1000], 60)
    assert shares[0] == 1 and sum(s * n for s, n in zip(shares, [5, 100, 1000])) == pytest.approx(60)
    assert classifier.draw_shares([5, 6], 60) == [1, 1]


def test_classifier_edges(edge, empty):
    got = classifier.classify(edge).collect()
    assert len(got) == len(EDGE) and all(0 <= r.junk_score <= 1 for r in got)
    assert classifier.classify(empty).count() == 0


# --- 5 ---


@pytest.mark.parametrize(
    "page,want",
    [
        (None, ""),
        ("", ""),
        ("<p>only", "only"),
        ("<div><script>x<y</script><style>p{}</style></div>", ""),
        ("plain &lt;b&gt; &amp; <b>x</b>", "plain <b> & x"),
        ("<nav><a href=x>Home</a></nav><article><h1>T</h1><p>Some text,  with\n commas.</p><div class='ad'>Buy</div><p>End</p></article><footer>F</footer>", "T\nSome text, with commas.\nEnd"),
        ("<body><header>Site</header><div id=content><h2>T</h2><p>Long text one, with marks. And more of it.</p><ul><li>one<li>two</ul></div><div class='comment-list'><p>Nice, really nice text.</p></div><form>Name</form></body>", "T\nLong text one, with marks. And more of it.\none\ntwo"),
    ],
)
def test_main_text(page, want):
    assert html_text.main_text(page) == want


LONG = "Long words of the main text, with marks. " * 10


@pytest.mark.parametrize(
    "page,want",
    [
        # short blocks beside long paragraphs, in a page of divs only; links beside the container go
        (
            f"<body><div><ul><li><a href=x>Home</a></ul></div><div id=content>Lead<h2>Head</h2><p>{LONG}</p><ul><li>one<li>two</ul><p>{LONG}</p><h3><a href=y>More</a></h3><table><tr><td>4<td>5</table></div><div><a href=z>Z</a></div></body>",
            ["Lead", "Head", LONG.strip(), "one", "two", LONG.strip(), "More", "4", "5"],
        ),
        # one long paragraph holds nearly all text, yet isn't the container; nor are elements with its path
        (f"<body><div><h2>Head</h2><p>{LONG}</p></div><div><span>Note</span></div></body>", ["Head", LONG.strip()]),
        # no container at all
        (f"<h2>Head</h2><p>{LONG}</p>tail", ["Head", LONG.strip(), "tail"]),
    ],
)
def test_main_text_keeps_short_blocks(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_main_text_is_chosen_by_scores_on_pages_with_an_article():
    # a teaser in an article beside the main text
    page = f"<body><div><h1>Head</h1><p>{LONG}</p><p>{LONG}</p></div><article><a href=x>Related story</a></article></body>"
    assert html_text.main_text(page).split("\n") == ["Head", LONG.strip(), LONG.strip()]
    # links in main that are no part of the text
    page = f"<body><div>Site</div><main><ul><li><a href=x>One</a><li><a href=y>Two</a></ul><p>{LONG}</p><h2>Head</h2><p>With <a href=z>a link</a>.</p></main></body>"
    assert html_text.main_text(page).split("\n") == [LONG.strip(), "Head", "With a link."]


@pytest.mark.parametrize(
    "page,want",
    [
        # marked words in values, in names of other attributes and as a part of a longer name
        (f"<body><div><h1>T</h1><p title='the hidden valley'>{LONG}</p><p aria-hidden=false>{LONG}</p><p id=the-other-side>{LONG}</p><p data-role=menu>{LONG}</p></div></body>", ["T"] + [LONG.strip()] * 4),
        # a long paragraph with a name that alone says little stays, a short one goes
        (f"<body><div><p>{LONG}</p><p class=notice>{LONG}</p><p>{LONG}</p><div class=notice>Buy now</div></div></body>", [LONG.strip()] * 3),
        # containers of one tag without names: links and the footer go, the heading stays
        (f"<body><div id=content><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div><a href=x>a</a> <a href=y>b</a></div><div><p>Copyright 2020</p></div></body>", ["T", LONG.strip(), LONG.strip()]),
        (f"<body><div><div><p>Site of ours</p><p>and yours</p></div><div><h1>T</h1><p>{LONG}</p><p>{LONG}</p></div><div><p>Copyright 2020</p><p>All ours</p></div></div></body>", ["T", LONG.strip(), LONG.strip()]),
        # reader comments are long and have marks, but their names speak against them
        (f"<body><div class=post><h1>T</h1><p>{LONG}</p></div><div id=comments><div><p>{LONG}</p></div></div></body>", ["T", LONG.strip()]),
        # names that all text has speak against none of it
        (f"<body class=has-sidebar><div class=menu-page><h1>T</h1><p>{LONG}</p><p>Short.</p></div></body>", ["T", LONG.strip(), "Short."]),
        (f"<body><div hidden><p>{LONG}</p></div><div style='display: none'>{LONG}</div><p>{LONG}</p></body>", [LONG.strip()]),
    ],
)
def test_main_text_without_an_article(page, want):
    assert html_text.main_text(page).split("\n") == want


def test_main_text_comes_from_the_paths(monkeypatch, spark, sf_dir):
    pages = [r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").limit(20).collect()]
    on = [html_text.main_text(p) for p in pages]
    monkeypatch.setattr(html_text, "content_paths", lambda nodes, factors: set())
    assert all(on) and not any(html_text.main_text(p) for p in pages)


def test_deep_nesting_is_linear():
    import time

    def seconds(n, tag, close=True):
        page = f"<{tag}>x" * n + "end" + (f"</{tag}>" * n if close else "")
        began = time.perf_counter()
        text = html_text.main_text(page)
        return time.perf_counter() - began, text

    for tag, close in (("div", True), ("div", False), ("b", True), ("li", False), ("p", False), ("ul", True)):
        seconds(1000, tag, close)
        few, many = seconds(2000, tag, close)[0], seconds(20_000, tag, close)
        assert many[1].endswith("end") and many[0] < 40 * max(few, 0.01)


def test_html_edges(spark):
    df = spark.createDataFrame([(1, None, "kept?"), (1, None, "kept?"), (2, "<p>x", None)], "page_id long, html string, text string")
    assert [tuple(r) for r in html_text.extract(df).orderBy("page_id").collect()] == [(1, None, ""), (1, None, ""), (2, "<p>x", "x")]
    assert html_text.extract(df.limit(0)).count() == 0


def test_main_text_of_the_table(spark, sf_dir):
    import html

    for r in queries.op5_html_text(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = (re.sub(r"\s+", " ", html.unescape(re.sub(r"<[^>]+>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", inner))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


# --- 6 ---


def test_urls(spark):
    rows = [(None, "", "", None), ("", "", "", None), ("no scheme", "", "", None), ("HTTP://WWW.Example.COM", "www.example.com", "", None), ("http://a.net/de/8?x", "a.net", "/de/8", "net/de/"), ("http://example.net/de/8#x", "example.net", "/de/8", "example.net/de/8"), ("a://com/en/", "com", "/en/", "com/en/"), ("http://xcom/en/", "xcom", "/en/", None), ("http://b.example.com/en/7/x://y", "b.example.com", "/en/7/x://y", "example.com/en/7"), ("http://x.org/es", "x.org", "/es", None)]
    got = {r.url: r for r in url_filter.judge(spark.createDataFrame([(u,) for u, *_ in rows], "url string")).collect()}
    assert [(got[u].host, got[u].path, got[u].rule) for u, *_ in rows] == [(h, p, r) for _, h, p, r in rows]
    assert got["http://example.net/de/8#x"].verdict == "block" and got["http://a.net/de/8?x"].verdict == "allow"


def test_url_model_on_unseen_hosts(spark):
    bad, good = ["casino-spins", "cheap-drugs-pills", "best-free-bets", "adult-video-x"], ["thther", "ocean-news", "ththin", "parkland"]
    rows = [(f"https://www.{n}.example.org/fr/{i}", n in bad) for i, n in enumerate(bad + good)]
    got = {r.url: r.verdict for r in url_filter.judge(spark.createDataFrame(rows, "url string, bad boolean")).collect()}
    assert sum((got[u] == "block") == b for u, b in rows) >= 7


def test_url_model_on_held_out_hosts(spark):
    """Fitted on three quarters of the hosts, held against the URLs of the others."""
    held = F.pmod(F.xxhash64(F.split("url", "/")[2]), F.lit(4)) == 0
    table = url_filter.labelled(spark)
    model = url_filter.train(table.filter(~held))
    rows = url_filter.judge(table.filter(held), rules=(), model=model).collect()
    block = [r for r in rows if r.verdict == "block"]
    right = sum(r.label == 1 for r in block)
    print(len(rows), right / len(block), right / sum(r.label == 1 for r in rows))
    assert right / len(block) > 0.9 and right / sum(r.label == 1 for r in rows) > 0.75


def test_verdicts_by_brute_force(spark, sf_dir):
    """Each verdict from its rule, else from the model's weights over hashed n-grams."""
    model = url_filter.train(url_filter.labelled(spark))
    weights, bias = model.coefficients.toArray(), model.intercept
    index = functools.cache(url_filter.HashingTF(numFeatures=url_filter.FEATURES, binary=True).indexOf)
    for r in url_filter.judge(spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url"), model=model).collect():
        found = {f"{tag}:{t[i : i + n]}" for tag, x in (("h", r.host), ("p", r.path)) for t in [f"^{x}$"] for n in url_filter.GRAMS for i in range(len(t) - n + 1)}
        score = 1 / (1 + math.exp(-bias - sum(weights[i] for i in {index(g) for g in found})))
        fits = [(len(x), action, x) for action, x in url_filter.RULES for name, _, rest in [x.partition("/")] if (r.host == name or r.host.endswith("." + name)) and r.path.startswith("/" + rest)]
        assert r.score == pytest.approx(score) and r.rule == (max(fits)[2] if fits else None)
        assert r.verdict == (max(fits)[1] if fits else "block" if score >= 0.5 else "allow")


def test_url_edges(spark, empty):
    df = spark.createDataFrame([(1, None, "a", 2), (1, None, "a", 2), (2, "http://x.org/" + "y" * 100_000, None, 3)], "page_id long, url string, host string, score int").withColumn("label", F.lit("z"))
    got = url_filter.judge(df).collect()
    assert len(got) == 3 and got[0].host == "" and got[0].label == "z" and 0 <= got[0].score <= 1
    assert url_filter.judge(df.limit(0)).count() == 0


# --- 7 ---

PATTERNS = dict(email=r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", ip=r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", card=r"[0-9]([\x20-]?[0-9])+", phone=r"\+[0-9][\x20().0-9-]+[0-9]")


def passes(kind, m):
    d = [int(c) for c in m if c in "0123456789"]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "phone":
        return 9 <= len(d) <= 15
    if kind == "card":
        return 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else 2 * x - 9 * (x > 4) for i, x in enumerate(reversed(d))) % 10 == 0
    return True


def brute_spans(t):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, t or "") if passes(k, m[0])]


def test_base_spans(spark):
    rnd = random.Random(5)
    odd = [None, "", "a@b.c@d.e.f x", "a@b.com%x@y.zz.", "1.2.3.4.5.6.7.8", "300.1.1.1 00000001.2.3.4", "++1 (234) 567-8901- ", "4111 1111 1111 1111 4111-1111-1111-1111", "é€😀 a.b@c.d 😀+12 345 678 90", "x" * 5000 + "@a.b", "1 " * 20000, "9" * 30000, "a@" + "b." * 20000 + "c", "a@b.cd " * 3000]
    odd += ["".join(rnd.choice("a1.@+- ()é%0\n45") for _ in range(rnd.randint(1, 300))) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(odd)), "doc_id long, text string")
    for r in pii.find(df).collect():
        assert [(k, s.start, s.end) for k in pii.KINDS for s in r[f"__{k}"]] == brute_spans(odd[r["__id"]]), odd[r["__id"]][:200]


def test_pii_query(spark, texts, sf_dir):
    for r in queries.op7_pii(spark, sf_dir).collect():
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in brute_spans(texts[r.doc_id]))
        assert r.base_sha256 == hashlib.sha256(base.encode()).hexdigest() and r.spans.startswith(base)


def test_disclosing_terms(spark):
    rows = [(i, f"note {i} the agent Zorblatt writes to zed@corp.example.com about the case {'abcdefghij'[i] * 4}") for i in range(6)]
    rows += [(100 + i, f"the agent case about nothing writes to note {'klmnop'[i % 6] * 3} {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = pii.disclosures(df, pii.term_occurrences(df)).collect()
    n, held, entity = len(rows), {r[0] for r in rows[:6]}, 6
    with_term = {t: {i for i, x in rows if t in re.findall(r"[^\W\d_]+", x.lower())} for t in {w for _, x in rows for w in re.findall(r"[^\W\d_]{3,}", x.lower())}}
    want = {}
    for t, ids in with_term.items():
        both = len(ids & held)
        if both >= 3:
            d = math.log((both / n) / (entity / n * len(ids) / n)) / -math.log(entity / n)
            if d >= pii.GENERALISE and t not in ("zed", "corp", "example", "com"):
                want[t] = d
    assert {r.term: r.disclosure for r in found} == pytest.approx(want) and "zorblatt" in want
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zorblatt" not in clean[0] and "[EMAIL]" in clean[0] and clean[100] == rows[6][1]


def test_disclosing_terms_far_from_the_value(spark):
    pad = "the agent case about nothing writes to note " * 5
    rows = [(i, f"Zorblatt {i} here {pad} {'abcdefghij'[i] * 4} wrote to zed@corp.example.com about {'abcdefghij'[i] * 5} {pad} and ZORBLATT again") for i in range(6)]
    rows += [(100 + i, f"{pad} {'klmnop'[i % 6] * 3} {i}") for i in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.term: r.disclosure for r in pii.disclosures(df, pii.term_occurrences(df)).collect()}
    assert found["zorblatt"] == pytest.approx(1) and "agent" not in found
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert all("zorblatt" not in clean[i].lower() and "[EMAIL]" in clean[i] for i in range(6)) and clean[100] == rows[6][1]


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute_sketch(t):
    w = WORDS.findall(t)
    hs = [xxhash.xxh64_digest(" ".join(w[i : i + 5]).encode(), 42)[::-1] for i in range(max(1, len(w) - 4))]
    return [min(signed(xxhash.xxh64_intdigest(struct.pack("<i", j), xxhash.xxh64_intdigest(h, 42))) for h in hs) for j in range(pii.HASHES)]


def brute_terms(rows, min_support=3, generalise=pii.GENERALISE):
    """Disclosing terms of all texts, from the definition."""
    unique = sorted({t or "" for _, t in rows})
    held, words, free = collections.defaultdict(set), {}, {}
    for k, t in enumerate(unique):
        base = brute_spans(t)
        for kind, a, b in base:
            held[f"{kind}:{t[a:b].lower()}"].add(k)
        words[k] = set(re.findall(r"[^\W\d_]+", t.lower()))
        free[k] = {m[0].lower() for m in re.finditer(r"[^\W\d_]{3,}", t) if not any(a < m.end() and m.start() < b for _, a, b in base)}
    n, df = len(unique), collections.Counter(w for ws in words.values() for w in ws)
    found = {}
    for e, ks in held.items():
        if len(ks) < min_support:
            continue
        for term, both in collections.Counter(w for k in ks for w in free[k]).items():
            if both < min_support or 2 * both < df[term]:
                continue
            share = 0.0 if len(ks) == n else math.log(both / n / (len(ks) / n * df[term] / n)) / -math.log(len(ks) / n)
            if share >= generalise:
                values = [len(set(x)) for x in zip(*[brute_sketch(unique[k]) for k in ks if term in free[k]])]
                if (sum(values) / len(values) - 1) / (both - 1) >= pii.WITNESSES:
                    found[term] = max(share, found.get(term, share))
    return found


def brute_term_spans(t, terms):
    base = brute_spans(t)
    return [("term", m.start(), m.end()) for m in re.finditer(r"[^\W\d_]{3,}", t or "") if m[0].lower() in terms and not any(a < m.end() and m.start() < b for _, a, b in base)]


def planted(texts, seed):
    """The texts with values of people planted, beside an alias each; some aliases stand elsewhere, too."""
    rnd = random.Random(seed)
    rows = {i: t or "" for i, t in texts.items()}
    ids = [i for i, t in rows.items() if len(t) > 300]

    def put(i, what):
        at = rnd.choice([m.start() for m in re.finditer(" ", rows[i])])
        rows[i] = rows[i][:at] + f" {what}" + rows[i][at:]

    aliases = []
    for p in range(20):
        alias = "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
        aliases.append(alias)
        value = rnd.choice([f"p{p}@mail.example.org", f"+1 (555) {200 + p}-{3000 + 7 * p}"])
        for i in rnd.sample(ids, rnd.randint(4, 8)):
            put(i, value)
            put(i, rnd.choice([alias, alias.capitalize(), alias.upper()]))
        for i in rnd.sample(ids, rnd.choice([0, 0, 1])):
            put(i, alias)
    return sorted(rows.items()), aliases


def test_all_spans_with_planted_terms(spark, texts):
    rows, aliases = planted(texts, 12)
    terms = brute_terms(rows)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for r in pii.find(df).collect():
        t = dict(rows)[r["__id"]]
        assert [(k, s.start, s.end) for k in pii.KINDS for s in r[f"__{k}"]] == brute_spans(t)
        assert [("term", s.start, s.end) for s in r["__terms"]] == brute_term_spans(t, terms)
    assert len(set(aliases) & set(terms)) / len(aliases) >= 0.9  # recall
    assert len(set(aliases) & set(terms)) / len(terms) >= 0.9  # precision


def test_near_copies_are_one_witness(spark, texts):
    """Copies of a text with a value, each with some words changed, say nothing about the words that they share."""
    rnd = random.Random(3)
    rows = sorted((i, t or "") for i, t in texts.items())
    w = next(t for _, t in rows if len(t.split()) > 250).split()
    for c in range(7):
        copy = ["someone@mail.example.org", *w]
        for at in rnd.sample(range(1, len(copy)), 4):
            copy[at] = f"word{'abcdefg'[c]}"
        rows.append((90_000 + c, " ".join(copy)))
    assert not [t for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).filter("__id >= 90000").collect() for t in r["__terms"]]


def test_sanitise_edges(edge, empty):
    got = pii.sanitise(edge)
    assert got.columns == edge.columns and sorted(map(str, got.collect())) == sorted(map(str, edge.collect()))
    assert pii.sanitise(empty).count() == 0 and pii.find(empty).count() == 0


# --- 8 ---


def brute_measures(t):
    w = WORDS.findall(t or "")
    c = collections.Counter(zip(w, w[1:], w[2:]))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in (t or "").split("\n") if WORDS.search(x)]
    return len(w), sum(map(len, w)), sum(x in "#*$%&|<>" for x in t or ""), len(lines) - len(set(lines)), len(covered)


def check_measures(rows, texts):
    for r in rows:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute_measures(texts[r.doc_id])
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words) and not (r.base_failed and r.kept)


def test_measures(docs, texts):
    check_measures(quality_rules.judge(docs).collect(), texts)


def test_measures_of_odd_texts(spark, edge, empty):
    check_measures(quality_rules.judge(edge).collect(), dict(EDGE))
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(["a", "b", "c", " ", " ", "\n", "#"]) for _ in range(rnd.randrange(200)))) for i in range(200)]
    check_measures(quality_rules.judge(spark.createDataFrame(rows, "doc_id long, text string")).collect(), dict(rows))
    assert quality_rules.judge(empty).count() == 0


def test_repeats_behind_colliding_hashes(spark, monkeypatch):
    """With next to no hash bits all windows collide, and repeats lie between others."""
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice("abcdef") for _ in range(rnd.randrange(60)))) for i in range(80)] + [(99, "a b c x y z a b c")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    real = F.xxhash64
    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: real(*c) % 2)
    for r in df.select("doc_id", quality_rules.n_repeat_words(F.col("text")).alias("n")).collect():
        assert r.n == brute_measures(dict(rows)[r.doc_id])[4]


def test_verdicts_against_brute_force(docs, texts):
    for r in quality_rules.judge(docs).collect():
        t = texts[r.doc_id] or ""
        n, chars, symbols, dup, repeat = brute_measures(t)
        w, lines = WORDS.findall(t), [x for x in t.split("\n") if WORDS.search(x)]
        distinct = sum(len(set(w[i : i + 200])) for i in range(0, n, 200))
        bad = {
            "too_short": n < 50,
            "repetitive": 100 * repeat > 50 * n,
            "symbols": 10 * symbols > 3 * n,
            "capitals": 2 * sum(x in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for x in t) > chars,
            "word_length": chars > 12 * n or 2 * chars < 5 * n,
            "repeated_lines": len(lines) >= 4 and 2 * len(set(lines)) < len(lines),
            "few_words": 10 * distinct < n,
        }
        assert r.kept == (not any(bad.values())) and (r.kept or bad[r.rejected_by])


def test_costs_are_measured(docs):
    heavy = F.aggregate(F.sequence(F.lit(1), F.lit(20000)), F.length("text").cast("long"), lambda a, x: a + x * x) < 0
    rated = {r.name: cost for r, _, cost in quality_rules.order_rules(docs, [quality_rules.Rule("light", F.length("text") < 0), quality_rules.Rule("heavy", heavy)])}
    assert rated["heavy"] > 3 * rated["light"]


def test_cascade_order_never_changes_a_verdict(docs):
    rules = quality_rules.production_rules(F.col("text"))
    ordered = quality_rules.order_rules(docs, rules)
    ratio = [rejected / cost for _, rejected, cost in ordered]
    assert ratio == sorted(ratio, reverse=True)
    kept = [docs.filter(quality_rules.cascade(x).isNull()).count() for x in (rules, rules[::-1], [r for r, _, _ in ordered])]
    assert len(set(kept)) == 1 and kept[0] == quality_rules.judge(docs).filter("kept").count()


# --- 9 ---


@pytest.mark.parametrize("sample", [lm.SAMPLE, 1])
def test_scores(spark, docs, monkeypatch, sample):
    monkeypatch.setattr(lm, "SAMPLE", sample)  # with all rows in the sample there are pairs that are counted first
    few = docs.select("doc_id", "text").limit(150).unionByName(spark.createDataFrame([(5000, None), (5001, "  "), (5002, "A b a"), (5002, "A b a"), (None, "zzzq the of")], "doc_id long, text string"))
    rows = few.collect()
    seqs = [[None, *(r.text or "").encode().lower().split()] for r in rows]
    c1, c2 = collections.Counter(), collections.Counter()
    for w in seqs:
        c1.update(w)
        c2.update(zip(w, w[1:]))
    total = sum(n for w, n in c1.items() if w is not None)
    want = {}
    for r, w in zip(rows, seqs):
        a, b, s = collections.Counter(w), collections.Counter(zip(w, w[1:])), 0.0
        for p, q in zip(w, w[1:]):
            elsewhere, known = c2[p, q] - b[p, q], c1[q] - a[q]
            s += math.log(elsewhere / (c1[p] - a[p])) if elsewhere else math.log(0.4 * known / total) if known else 2 * math.log(0.4) - math.log(total)
        want[r.doc_id] = (len(w) - 1, s)
    got = lm.score(few).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_words == want[r.doc_id][0] and r.log_score == pytest.approx(want[r.doc_id][1], abs=1e-4)
    assert lm.score(docs.limit(0)).count() == 0


# --- 10 ---


def test_packing(spark, docs, texts):
    from tokenizers import Tokenizer

    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, queries.vocabulary()).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert len(r.ids) == 4 * r.length
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for d, t in texts.items():
        ids = np.array(ref.encode(t, add_special_tokens=False).ids + [1], dtype="<u4").tobytes()
        parts = sorted(pieces[d], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in parts) == ids and {r.doc_tokens for r in parts} == {len(ids) // 4}
        assert [r.start for r in parts] == [sum(p.length for p in parts[:i]) for i in range(len(parts))]
    padding = 0
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    assert padding / sum(r.length for r in rows) < 0.03


def test_ids_of_a_whole_table(spark):
    """The pieces' sums against those of the ``tokenizers`` file, over a whole table."""
    from tokenizers import Tokenizer

    sf = "/root/testdata/sf0.01"
    ref = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids = {r.doc_id: np.array(e.ids + [1], "<u4") for r, e in zip(rows, ref.encode_batch([r.text or "" for r in rows], add_special_tokens=False))}
    for r in queries.op10_packing(spark, sf).collect():
        assert r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())


def test_score_edges(spark):
    rows = [(1, None, "x", 1), (1, None, "x", 1), (None, "a b " * 200_000, "y", 2), (3, "a b", "z", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, doc string, n_words int").withColumn("log_score", F.lit("k"))
    got = lm.score(df).collect()
    assert len(got) == 4 and sorted(r.n_words for r in got) == [0, 0, 2, 400_000]
    assert {r.log_score for r in got if not r.n_words} == {0.0} and {r.mean_log_score for r in got if not r.n_words} == {None}


def test_token_bytes_are_those_of_the_whole_text():
    enc = packing.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    other = packing.encoder(public_tokenizers.path("byte_bpe_50k.json"))
    cache = packing.WordCache(enc)
    rnd = random.Random(4)
    odd = ["a  b", " a", "a ", "a\n b", "a \nb", "x <|endoftext|> y", "it's 12,5 € — ok", "a\u00a0 b", "tab\t t", ""]
    odd += ["".join(rnd.choice(["a", "bc", " ", " ", "\n", "é", "1", "'s", "!", "\t", "中"]) for _ in range(40)) for _ in range(500)]
    for t in odd:
        ids = list(np.frombuffer(packing.token_bytes(t, cache), "<u4"))
        assert ids == list(enc(t)) == list(other(t)), repr(t)


def test_patterns_use_every_piece():
    rnd = random.Random(6)
    for _ in range(40):
        hist = {rnd.randint(1, 2048): rnd.randint(1, 50) for _ in range(rnd.randint(1, 60))}
        patterns = packing.shortest_pack_first(hist)
        used = collections.Counter()
        for n, lengths in patterns:
            assert sum(lengths) <= 2048
            for x in lengths:
                used[x] += n
        assert used == hist
        for length, n in hist.items():
            ranks = sorted(r for ln, first, k, _, _ in packing.slots(patterns) if ln == length for r in range(first, first + k))
            assert ranks == list(range(n))


def test_packing_edges(edge, empty):
    got = packing.pack(edge, queries.vocabulary(), {"ids_crc32": F.crc32("ids")}).collect()
    assert sum(r.start == 0 for r in got) == len(EDGE)
    assert {r.ids_crc32 for r in got if r.doc_tokens == 1} == {zlib.crc32((1).to_bytes(4, "little"))}
    assert packing.pack(empty, queries.vocabulary()).count() == 0
