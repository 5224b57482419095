"""Toxicity, centroid clustering and ranked lexical search: against brute-force versions, and their odd cases."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import centroids, lexical_search, toxicity
from ridgeline.llm.words import CHUNK_BYTES

# 11 ------------------------------------------------------------------------


def brute_kernel(a, b):
    """Shared gapped sequences of three symbols, weighed by what they skip, within REACH."""

    def profile(s):
        s, out = "^" + s, Counter()
        for i in range(len(s)):
            for j in range(i + 1, len(s)):
                for k in range(j + 1, min(len(s), i + toxicity.REACH + 1)):
                    out[s[i] + s[j] + s[k]] += toxicity.DECAY ** (k - i - 2)
        return out

    dot = lambda x, y: sum(v * y[k] for k, v in x.items())
    x, y = profile(a), profile(b)
    return dot(x, y) / math.sqrt(dot(x, x) * dot(y, y))


def named(words):
    found, _ = toxicity.units([w.encode() for w in words])
    return found.take(np.arange(len(words)))


def test_kernel_equals_brute_force():
    words = ["scum", "scuxm", "idiot", "idiotic", "banana", "aaaaa", "lose"]
    got = toxicity.kernel(named(words), named(words[:3]))
    assert got == pytest.approx(np.array([[brute_kernel(a, b) for b in words[:3]] for a in words]))
    assert got[1, 0] > 0.4 > got[4, 0]


def test_units_and_sentences():
    texts = ["You i d i o t!\nSo i.d*iot 1d10t. Yes", "", "!!! ???", "ÉÉ a"]
    found, _ = toxicity.units([t.encode() for t in texts])
    letters = lambda i: "".join(chr(97 + c) if c < 26 else "#" for c in found.symbols[found.at[i] + 1 : found.at[i + 1]])
    assert [letters(i) for i in range(len(found.doc))] == ["you", "idiot", "so", "idiot", "idiot", "yes", "####", "a"]
    assert found.doc.tolist() == [0] * 6 + [3] * 2
    assert [found.sentence[i] == found.sentence[i - 1] for i in range(1, 8)] == [True, False, True, True, False, False, True]
    empty, _ = toxicity.units([])
    assert len(empty.doc) == 0 and toxicity.summary(empty, np.zeros(0), 0).shape == (0, toxicity.FEATURES)


def test_landmarks_fold_into_one_table():
    """A unit's margin by the table is the weighted sum of its kernels with all landmarks."""
    words = ["scum", "moron", "trash", "hello", "world", "table"]
    raw = [named([w])[0].astype(np.uint8).tobytes() for w in words]
    weights, bias = toxicity.train(raw, np.array([9.0, 9, 9, 0, 0, 1]), np.array([0.0, 0, 0, 9, 9, 9]), raw[:5])
    unit, code, value = toxicity.merged(*toxicity.spans(raw[:5]))
    model = toxicity.Model(np.bincount(code, value * weights[unit], minlength=toxicity.SYMBOLS**3), bias, None, 1)
    tried = ["scum", "s.c.u.m", "scumm", "morron", "hello", "tablet", "x"]
    want = [sum(w * brute_kernel(re.sub("[^a-z]", "", t), m) for w, m in zip(weights, words, strict=False)) + bias if len(t) > 1 else bias for t in tried]
    margin = model.margins(*named(tried))
    assert margin == pytest.approx(np.array(want))
    assert (margin[:4] > 0).all() and (margin[4:] < 0).all()
    found, _ = toxicity.units([" ".join(tried * 3).encode()])
    assert model.unit_margins(found)[:14] == pytest.approx(np.concatenate([margin, margin]))


@pytest.fixture(scope="module")
def insults(spark):
    rng = random.Random(4)
    syllables = ["an", "the", "re", "on", "ti", "er", "st", "ou", "ing"]
    word = lambda: "".join(rng.choice(syllables) for _ in range(rng.randint(1, 4)))
    rows, labels = [], []
    for i in range(600):
        bad = i % 5 == 2 or i % 11 == 3
        text = [[word() for _ in range(rng.randint(3, 12))] for _ in range(rng.randint(1, 6))]
        if bad:
            for _ in range(2):
                insult = rng.choice(["scumbag", "moron", "vileman" + word(), "p.a.t.h.e.t.i.c", "di5gusting"])
                at = rng.randrange(len(insult))
                rng.choice(text).append(insult if rng.random() < 0.7 else insult[:at] + rng.choice("xyz") + insult[at:])
        rows.append((i, ". ".join(" ".join(s) for s in text), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    rows += [(700, None, None, None, None), (701, "", "en", "s", 0), (702, "moron " * (CHUNK_BYTES // 5), "en", "s", 1), (None, "no id", "en", "s", 1), rows[3], rows[3]]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    return spark.createDataFrame(rows, schema).repartition(3), spark.createDataFrame(labels + [(None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int"), {i: t for i, _, t in labels}


def test_toxicity_on_held_out_rows(insults):
    documents, labels, want = insults
    rows = toxicity.classify(documents.withColumn("score", F.lit(1)).withColumn("bad", F.lit(True)), labels).collect()
    assert len(rows) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in held]) > 0.93
    by_id = {r.doc_id: r.score for r in rows}
    assert by_id[700] == by_id[701] and by_id[701] < 0.5 < by_id[702]
    assert len({r.score for r in rows if r.doc_id == 3}) == 1


def test_toxic_sentences_name_what_is_toxic(insults):
    documents, labels, _ = insults
    model = toxicity.fit(documents, labels)
    table = documents.sparkSession.createDataFrame([(1, "The rest onti. You m-o-r-o-n there!\nReti st"), (2, "ther an re on"), (3, None)], "doc_id long, text string")
    assert [(r.doc_id, r.sentence) for r in toxicity.toxic_sentences(model, table).collect()] == [(1, "You m-o-r-o-n there!")]


def test_toxicity_without_both_labels(spark, insults, empty):
    documents, labels, _ = insults
    one = labels.where("toxic = 0")
    assert {r.score for r in toxicity.classify(documents.limit(5), one).collect()} == {0.0}
    assert {r.score for r in toxicity.classify(documents.limit(5), labels.limit(0)).collect()} == {0.5}
    assert toxicity.classify(empty, labels).collect() == []


# 12 ------------------------------------------------------------------------


def brute_clusters(rows, clusters, rounds, width, seed=3):
    def ok(v):
        return v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)

    exact = lambda x: math.floor(x * 1024) if abs(x) < 1e300 else int(x) * 1024
    kept = [(i, [float(x) for x in v]) for i, v in rows if ok(v)]
    points = [(i, [exact(x) for x in v]) for i, v in kept]
    start = sorted((i is None, hashlib.sha256(f"{seed}:{i}".encode()).hexdigest() if i is not None else "", v) for i, v in kept)
    centers = [[exact(x) for x in v] for *_, v in start[:clusters]]
    near = lambda p: min((sum((a - b) ** 2 for a, b in zip(p, c, strict=True)), k) for k, c in enumerate(centers))
    for _ in range(rounds):
        groups = {}
        for _, p in points:
            groups.setdefault(near(p)[1], []).append(p)
        centers = [[sum(x) // len(groups[k]) for x in zip(*groups[k], strict=True)] if k in groups else c for k, c in enumerate(centers)]
    out = [(i, *near(p)) for i, p in points]
    inertia = Counter()
    for _, d, k in out:
        inertia[k] += d
    long = lambda v: v if v < 1 << 63 else None
    return [(i, k, long(d), long(inertia[k]), long(sum(inertia.values())), hashlib.sha256(",".join(map(str, centers[k])).encode()).hexdigest()) for i, d, k in out]


def vectors(seed, n=90, width=6, scale=1.0):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(rng.integers(0, 4), 0.3, width) * scale]) for i in range(n)]
    rows += [(n, None), (n + 1, [1.0] * (width - 1)), (n + 2, [1.0] * (width - 1) + [None]), (n + 3, [float("nan")] * width), (n + 4, [float("inf")] + [0.0] * (width - 1)), (n + 5, [0.0] * width)]
    return rows + [rows[4], rows[4], (None, [0.5] * width), (None, [2.5] * width)]


def clustered(spark, rows, **more):
    table = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id long, embedding array<double>, cluster int, distance int").repartition(3)
    return sorted((tuple(r) for r in centroids.cluster(table, **more).collect()), key=repr)


@pytest.mark.parametrize("scale", [1.0, 3e3, 1e5, 1e60, 1e305])
def test_clusters_equal_brute_force(spark, scale):
    """Up to 2^53 by matrix products, beyond by Python integers; 64-bit columns are null where they overflow."""
    rows = vectors(1, scale=scale)
    rows.append((999, [scale * 5e3] * 6 if scale == 1.0 else [1.0] * 6))  # a row over the bound beside small ones
    want = sorted(brute_clusters(rows, 4, 5, 6), key=repr)
    assert clustered(spark, rows, clusters=4, rounds=5, width=6, block=16) == want
    assert (want[0][4] is None) == (scale > 1e6)


def test_clusters_odd_tables(spark):
    few = [(1, [0.0, 1.0]), (2, [0.5, 1.0]), (2, [0.5, 1.0])]
    assert clustered(spark, few, width=2) == sorted(brute_clusters(few, 8, 10, 2), key=repr)
    unnamed = [(None, [1.0, 2.0]), (None, [1.0, 2.0])]
    assert clustered(spark, unnamed, width=2) == sorted(brute_clusters(unnamed, 8, 10, 2), key=repr)
    assert clustered(spark, [(1, None)], width=2) == []
    assert spark.createDataFrame([], "vec_id long, embedding array<float>").transform(centroids.cluster).collect() == []
    ties = [(i, [float(i % 2 * 2), 0.0]) for i in range(6)] + [(7, [1.0, 0.0])]
    assert clustered(spark, ties, clusters=2, rounds=3, width=2, block=2) == sorted(brute_clusters(ties, 2, 3, 2), key=repr)


def test_negative_means_round_down(spark):
    rows = [(1, [-0.001]), (2, [-0.003]), (3, [-0.0005])]
    assert clustered(spark, rows, clusters=1, rounds=2, width=1) == sorted(brute_clusters(rows, 1, 2, 1), key=repr)


# 13 ------------------------------------------------------------------------

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")


def terms(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute_search(documents, items, nearest):
    docs = [(i, Counter(terms(t))) for i, t in documents]
    n_docs, total = sum(bool(c) for _, c in docs), sum(sum(c.values()) for _, c in docs)
    df = Counter(t for _, c in docs for t in c)
    out = []
    for item, text in items:
        found = []
        for i, c in docs:
            if not c:
                continue
            m = 100 - 25 + (25 * sum(c.values()) * n_docs) // total
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t in terms(text) if t in c)
            if score > 0:
                found.append((-score, i is None, i or 0, i))
        out += [(item, k, i, -s) for k, (s, _, _, i) in enumerate(sorted(found, key=lambda x: x[:3])[:nearest], 1)]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark, rows, documents):
    items = [(i, " ".join((rows[3 * i][1] or "").split()[:25])) for i in range(12)] + [(50, "THE the the-an"), (51, None), (52, ""), (53, "...\n!"), (50, "THE the the-an"), (None, "anti é_re on"), (54, "zzz 12")]
    table = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id long, text string, score int").repartition(2)
    want = brute_search([(r[0], r[1]) for r in rows], items, 7)
    for more in ({}, {"block_items": 2, "block_terms": 30}):
        found = lexical_search.search(documents.withColumn("rank", F.lit(1)).withColumn("item", F.lit(2)), table, 7, **more)
        assert found.columns == ["item_id", "rank", "doc_id", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=repr) == want


def test_search_ties_and_odd_tables(spark, documents, empty):
    same = spark.createDataFrame([(i, "Ab c") for i in (9, 4, 7, 4)] + [(None, "ab C"), (1, "d")] + [(i, "x y z w v u t s") for i in range(20, 30)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "ab")], "item_id long, text string")
    found = [(r.rank, r.doc_id) for r in lexical_search.search(same, items, 4).orderBy("rank").collect()]
    assert found == [(1, 4), (2, 4), (3, 7), (4, 9)]
    assert [r.doc_id for r in lexical_search.search(same, items).orderBy("rank").collect()] == [4, 4, 7, 9, None]
    assert lexical_search.search(empty, items).collect() == [] and lexical_search.search(documents, items.limit(0)).collect() == []
    assert lexical_search.search(spark.createDataFrame([(1, None), (2, "?!")], "doc_id long, text string"), items).collect() == []


def test_long_texts_are_searched_whole(spark):
    long = "ab " * (CHUNK_BYTES // 3 + 10) + "needle"
    table = spark.createDataFrame([(1, long), (2, "ab needle"), (3, "ab")] + [(i, "q") for i in range(4, 9)], "doc_id long, text string")
    items = spark.createDataFrame([(1, "Needle ab")], "item_id long, text string")
    found = sorted(tuple(r) for r in lexical_search.search(table, items).collect())
    assert found == brute_search([(r.doc_id, r.text) for r in table.collect()], [(1, "Needle ab")], 20) and {r[2] for r in found} == {1, 2, 3}


def test_radix_order_is_a_stable_sort():
    rng = np.random.default_rng(2)
    for bits in (4, 16, 17, 40):
        keys = rng.integers(0, 1 << bits, 5000).astype(np.uint64)
        assert (lexical_search.radix_order(keys, bits) == np.argsort(keys, kind="stable")).all()
