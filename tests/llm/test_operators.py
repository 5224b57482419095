"""Each operator against a brute-force version, and the odd cases that their docstrings define."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ridgeline.llm import lm_scoring, mixing, packing, permutation_index, quality_classifier, quality_rules, secret_scan, sharding, simhash_dedup, substring_dedup
from ridgeline.llm.components import connected_components
from ridgeline.llm.queries import tokenizer_path
from ridgeline.llm.words import CHUNK_BYTES, Words
from ridgeline.plans.scratch import Scratch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
words = lambda text: WORD.findall(text or "")
fold = lambda text: "".join(c.lower() if c.isascii() else c for c in text or "")


def collected(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_words_equal_the_regular_expression():
    texts = ["", " a", "b\tc\n\x0bd\x0c\r e ", "é\xa0ü  ñ", "one"]
    found = Words([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert [found.word(k).decode() for k in range(found.word_at[i], found.word_at[i + 1])] == words(t)
    same = Words([b"x yy x", b"yy"]).hashes()
    assert same[0] == same[2] and same[1] == same[3] and same[0] != same[1]


# 1 -------------------------------------------------------------------------


def brute_fingerprint(text):
    w = words(fold(text))
    shingles = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] if w else []
    if not shingles:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(points):
    parent = {p: p for p in points}

    def root(p):
        while parent[p] != p:
            p = parent[p]
        return p

    for a in points:
        for b in points:
            if a < b and bin(a ^ b).count("1") <= 2:
                parent[root(a)] = root(b)
    return {p: root(p) for p in points}


@pytest.mark.parametrize("hot", [64, 1])
def test_simhash_components(documents, rows, hot):
    found = simhash_dedup.near_duplicates(documents, hot=hot).collect()
    want = [(r[0], brute_fingerprint(r[1])) for r in rows]
    root = brute_components({fp for _, fp in want})
    least = {}
    for doc, fp in want:
        if doc is not None:
            least[root[fp]] = min(doc, least.get(root[fp], doc))
    expected = Counter((doc, fp, least.get(root[fp])) for doc, fp in want)
    assert Counter((r.doc_id, r.fp % (1 << 64), r.component_id) for r in found) == expected


@pytest.mark.parametrize("hot", [64, 2])
def test_links_reach_all_near_fingerprints(spark, hot):
    rng = np.random.default_rng(1)
    points = set()
    for _ in range(30):
        centre = int(rng.integers(0, 1 << 63))
        points.add(centre)
        for _ in range(12):
            centre ^= sum(1 << int(b) for b in rng.choice(64, int(rng.integers(1, 4)), replace=False))
            points.add(centre)
    signed = lambda p: p - (1 << 64) if p >= 1 << 63 else p
    classes = spark.createDataFrame([(signed(p),) for p in points], "fp long")
    scratch = Scratch(spark, "t")
    parts = {r.node % (1 << 64): r.component for r in connected_components(simhash_dedup.links(classes, scratch, hot), scratch).collect()}
    root = brute_components(points)
    groups, want = defaultdict(set), defaultdict(set)
    for p in points:
        groups[parts.get(p, ("alone", p))].add(p)
        want[root[p]].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    n = 200
    links = spark.createDataFrame([(i * 7 % n, (i + 1) * 7 % n) for i in range(n - 1)], "u long, v long")
    found = connected_components(links, Scratch(spark, "t")).collect()
    assert len(found) == n and {r.component for r in found} == {0}


def brute_near_groups(rows):
    """The rows (doc_id, text) that stay: of each group that a Jaccard similarity of 0.8 of five-word shingles links, the one with the least doc_id, nulls last."""
    sets = []
    for r in rows:
        w = words(fold(r[1]))
        sets.append({tuple(w[i : i + 5]) for i in range(max(len(w) - 4, min(len(w), 1)))})
    root = list(range(len(rows)))

    def top(d):
        while root[d] != d:
            d = root[d]
        return d

    for a in range(len(rows)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                root[top(a)] = top(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[top(i)].append(rows[i])
    return groups


def test_near_dedup_stage_equals_brute_jaccard_groups(spark):
    import corpus_pipeline

    rng = np.random.default_rng(5)
    made = []
    for group in range(25):
        base = [f"w{x}" for x in rng.integers(0, 400, 120)]
        for copy in range(6):
            text = list(base)
            for place in rng.choice(120, copy, replace=False):
                text[place] = f"x{rng.integers(0, 9999)}"
            made.append(" ".join(text))
    # A cluster around one text that few of its members resemble each other in, and texts with a long passage in common.
    centre = [f"c{x}" for x in range(300)]
    for copy in range(40):
        made.append(" ".join(f"y{copy}" if i in set(rng.choice(300, 9, replace=False)) else w for i, w in enumerate(centre)))
    made.append(" ".join(centre))
    made += [" ".join(centre[:100]) + " " + " ".join(f"z{x}" for x in rng.integers(0, 9999, 40)) for _ in range(40)]
    made += ["One two three", "one TWO three", "one two four", "", None, " "]
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(made)]
    # One doc_id for different texts, repeated rows, and copies without a doc_id, with and without one that has it.
    rows += [(3, "quite another text of eight words in all", "en", "s", 0), rows[40], rows[40], (None, made[7], "en", "s", 0), (None, "nobody knows my id at all here", "en", "s", 0), (None, "nobody knows my id at all here", "fr", "s", 0), (9000, "once more the same", "en", "s", 0), (9000, "once more the same", "en", "s", 0)]
    documents = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n", F.lit(1)).withColumn("component", F.lit("clash")).repartition(3)
    kept = corpus_pipeline.near_dedup_stage(spark, documents, "")
    assert kept.columns == documents.columns
    groups = brute_near_groups(rows)
    got = [(r.doc_id, r.text) for r in kept.collect()]
    want = []
    for g in groups.values():
        least = min((r[0] is None, r[0] or 0) for r in g)
        options = {(r[0], r[1]) for r in g if (r[0] is None, r[0] or 0) == least}
        own = [x for x in got if x in options]
        assert len(own) == 1, (options, own)
        want += own
    assert len(got) == len(want)


# 2 -------------------------------------------------------------------------


def test_classifier_learns_from_its_folds_only(spark, documents, labels):
    found = {r.doc_id: r for r in quality_classifier.classify(documents, labels).collect()}
    for doc, r in found.items():
        assert r.held_out == (doc is not None and zlib.crc32(str(doc).encode()) % 3 == 1)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
    wrong = labels.withColumn("quality", F.when(quality_classifier.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality_classifier.classify(documents, wrong).collect()}
    assert all(again[d] == pytest.approx(r.score, abs=1e-6) for d, r in found.items())


def test_classifier_accuracy_on_held_out_rows(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    found = quality_classifier.classify(docs, labels).join(labels, "doc_id").where("held_out").groupBy("quality").agg(F.avg((F.col("predicted") == F.col("quality")).cast("double")).alias("right")).collect()
    assert all(r.right > 0.97 for r in found) and len(found) == 2


def test_classifier_without_labels(documents, labels, empty):
    assert {r.score for r in quality_classifier.classify(documents, labels.limit(0)).collect()} == {0.5}
    assert {r.score for r in quality_classifier.classify(documents, labels.where("quality = 1")).collect()} == {1.0}
    assert quality_classifier.classify(empty, labels).count() == 0
    more = documents.withColumn("score", F.lit("x")).withColumn("_score", F.lit(1))
    assert quality_classifier.keep_good(more, labels).columns == more.columns
    odd = labels.union(labels.where("doc_id = 10")).union(labels.where("doc_id = 10").withColumn("quality", F.lit(None).cast("int")))
    assert quality_classifier.classify(documents, odd).count() == documents.count()


def test_context_sums_and_pooling_equal_brute_force(spark, documents, rows):
    """Context vectors by counting neighbours, and pooled vectors by means over words."""
    vectors = quality_classifier.context_vectors(documents)
    index = np.zeros((quality_classifier.UNITS, quality_classifier.DIMENSION))
    for unit in range(quality_classifier.UNITS):
        for k in range(quality_classifier.NONZERO):
            index[unit, quality_classifier.PLACES[unit, k]] += quality_classifier.SIGNS[unit, k]
    total = np.zeros_like(index)
    for r in rows:
        word, shape, _ = quality_classifier.units(Words([(r[1] or "").encode()]))
        for i in range(len(word)):
            for j in (i - 1, i + 1):
                if 0 <= j < len(word):
                    for unit in (word[i], shape[i]):
                        total[unit] += index[word[j]] + index[shape[j]]
    norm = np.linalg.norm(total, axis=1, keepdims=True)
    assert np.allclose(vectors, total / np.where(norm == 0, 1, norm), atol=1e-6)
    texts = [(r[1] or "").encode() for r in rows[:30]]
    got = quality_classifier.pooled(Words(texts), vectors)
    for i, t in enumerate(texts):
        word, shape, pair = quality_classifier.units(Words([t]))
        want = np.concatenate([vectors[word].sum(axis=0), vectors[shape].sum(axis=0), quality_classifier.SHAPE_INDEX[pair].sum(axis=0)]) / max(len(word), 1)
        assert np.allclose(got[i], want, atol=1e-4)


# 3 -------------------------------------------------------------------------


def brute_nearest(vectors, queries, k=10):
    out = {}
    for q, v in queries:
        scored = sorted((float(np.sqrt(((x - v) ** 2).sum())), i) for i, x in vectors if i != q)
        out[q] = scored[:k]
    return out


@pytest.mark.parametrize("chunk", [700, 8192])
def test_index_recall_and_scores(spark, chunk):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    found = permutation_index.nearest_neighbours(table, F.col("vec_id") % 100 == 0, chunk=chunk, query_block=7).collect()
    vectors = [(r.vec_id, np.array(r.embedding, np.float64)) for r in table.collect()]
    want = brute_nearest(vectors, [(i, v) for i, v in vectors if i % 100 == 0])
    got = defaultdict(list)
    for r in sorted(found, key=lambda r: (r.query_id, r["rank"])):
        got[r.query_id].append((r.score, r.vec_id))
    hits = sum(len({i for _, i in got[q]} & {i for _, i in w}) for q, w in want.items())
    assert hits / sum(map(len, want.values())) >= 0.9
    by_id = dict(vectors)
    for q, rows in got.items():
        assert rows == sorted(rows) and len(rows) == 10
        assert all(s == pytest.approx(np.linalg.norm(by_id[q] - by_id[i]), rel=1e-12) for s, i in rows)


def made_vectors(clusters, n, d=32):
    rng = np.random.default_rng(8)
    centres = rng.normal(0, 1, (clusters, d)) if clusters else np.zeros((1, d))
    return centres[rng.integers(0, len(centres), n)] + rng.normal(0, 0.15 if clusters else 1.0, (n, d))


@pytest.mark.parametrize(("clusters", "least", "most_reranked"), [(0, 0.95, 0.12), (400, 0.95, 0.12), (3000, 0.95, 0.12)])
def test_index_recall_where_the_cut_binds(clusters, least, most_reranked):
    """50,000 vectors in chunks of the production size: recall, and the work of footrule ranking."""
    vectors = made_vectors(clusters, 50_000)
    rng = np.random.default_rng(1)
    points = vectors[rng.choice(len(vectors), permutation_index.PIVOTS, replace=False)]
    order = permutation_index.orders(vectors, points, permutation_index.PREFIX)
    asked = rng.choice(len(vectors), 40, replace=False)
    best, visited, reranked = defaultdict(list), 0, 0
    for a in range(0, len(vectors), permutation_index.CHUNK):
        part = np.arange(a, min(a + permutation_index.CHUNK, len(vectors)))
        which, near, score = permutation_index.search_chunk(part, part, vectors[part], order[part], asked, vectors[asked], order[asked], len(points), 10, permutation_index.CUT)
        for q, i, s in zip(which, part[near], score, strict=True):
            best[q].append((s, i))
        files, most = permutation_index.Postings(order[part], len(points)), int(np.ceil(permutation_index.CUT * len(part))) + 10 * permutation_index.AMPLIFY
        for q in asked:
            visited += (files.footrule(order[q]) < files.prefix * (files.prefix + 1)).sum()
            reranked += len(permutation_index.candidates(files, order[q], np.arange(len(part)), most))
    hits = 0
    for q, i in enumerate(asked):
        apart = np.sqrt(((vectors - vectors[i]) ** 2).sum(axis=1))
        apart[i] = np.inf
        hits += len({j for _, j in sorted(best[q])[:10]} & set(np.argsort(apart, kind="stable")[:10].tolist()))
    pairs = len(asked) * len(vectors)
    print(f"clusters {clusters}: recall {hits / 400:.3f}, visited {visited / pairs:.2f}, reranked {reranked / pairs:.2f}")
    assert hits / 400 >= least and reranked / pairs <= most_reranked


def test_index_odd_vectors_and_ties(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, float(i % 3)]) for i in range(0, 40)] + [(100, [1.0, 0.0]), (200, None), (300, [0.0, 0.0]), (400, [nan, 1.0]), (500, [inf, 1.0]), (600, [None, 1.0]), (700, [1.0]), (None, [1.0, 1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("label", F.lit(1)).withColumn("vector", F.lit("clash"))
    found = permutation_index.nearest_neighbours(table, F.col("vec_id") % 100 == 0).orderBy("query_id", "rank").collect()
    assert {r.query_id for r in found} == {0, 100}
    assert [r.vec_id for r in found if r.query_id == 100] == list(range(0, 30, 3))
    assert permutation_index.nearest_neighbours(table.limit(0), F.lit(True)).count() == 0
    same = spark.createDataFrame([(100, [1.0, 2.0]), (100, [1.0, 2.0]), (101, [1.0, 2.5])], "vec_id long, embedding array<double>")
    found = permutation_index.nearest_neighbours(same, F.col("vec_id") % 100 == 0).collect()
    assert Counter((r.query_id, r["rank"], r.vec_id, r.score) for r in found) == {(100, 1, 100, 0.0): 2, (100, 2, 101, 0.5): 2}
    few = permutation_index.nearest_neighbours(table.where("vec_id in (0, 1, 100)"), F.col("vec_id") % 100 == 0).collect()
    assert Counter(r.query_id for r in few) == {0: 2, 100: 2}


# 4 -------------------------------------------------------------------------

ASSIGN = re.compile(r"((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def brute_secrets(text):
    text = text or ""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(spans)


def test_secrets(spark, documents, rows):
    odd = ["é api-key api_KEY='aaaaaa' APIKEY : bbbbbbb=", "token=abc token=abcdef", "AKIA" + "A" * 15, "xAKIA" + "A" * 16, "0" * 24 + "g" + "a" * 23, "ſecret=abcdef", "ghp_" + "a" * 36, "-----BEGIN RSA PRIVATE KEY-----", "xoxb-1234567890ab", "eyJhbGciOiJIUz.eyJzdWIiOiIxMjM.abcdefghijkl"]
    docs = documents.union(spark.createDataFrame([(1000 + i, t, "en", "s", 1) for i, t in enumerate(odd)], documents.schema))
    found = {(r.doc_id): r for r in secret_scan.find_secrets(docs).collect()}
    names = [r.kind for r in secret_scan.BASE_RULES]
    for doc, text in [(r[0], r[1]) for r in rows] + [(1000 + i, t) for i, t in enumerate(odd)]:
        spans = brute_secrets(text)
        named = [f"{names[k]}:{a}:{b}" for a, k, b in spans]
        r = found[doc]
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r.base_sha256 == hashlib.sha256(",".join(named).encode()).hexdigest()
        assert set(named) <= set(r.spans.split(",")) or not named
    more = [found[1000 + i].spans.split(":")[0] for i in (6, 7, 8, 9)]
    assert more == ["github", "pem", "slack", "jwt"]


def test_trigram_queries_hold_for_every_match():
    import random

    rng = random.Random(5)
    for rule in secret_scan.RULES:
        scanner = secret_scan.Scanner((rule,))
        pattern = re.compile(rule.pattern)
        for _ in range(300):
            text = "".join(rng.choice(["password", "passwd", "SECRET", "ToKen", "api", "_", "key", "=", " ", ":", '"', "AKIA", "QWERTY0123456789", "deadbeefdeadbeef01234567", "x", "é", "-----BEGIN ", "PRIVATE KEY-----", "ghp_", "a" * 40, "xoxb-", "eyJ", "."]) for _ in range(8))
            want = [(m.start(), m.end()) for m in pattern.finditer(text) if m.end(rule.group) - m.start(rule.group) >= rule.least]
            assert [(a, b) for a, _, b in scanner.scan([b"none", text.encode()])[1]] == want
    assert secret_scan.trigram_query("[0-9a-f]+") is True
    assert secret_scan.trigram_query("AKIA[A-Z0-9]+") == ("and", (b"aki", b"kia"))


def test_redaction_keeps_clean_documents(documents, rows):
    out = {r.doc_id: r for r in secret_scan.redact(documents).collect()}
    for r in rows:
        if brute_secrets(r[1]):
            assert not brute_secrets(out[r[0]].text) and out[r[0]].n_chars == len(out[r[0]].text)
        elif r[0] is not None:
            assert out[r[0]].text == r[1] and out[r[0]].n_chars == r[4]


# 5 -------------------------------------------------------------------------


def brute_removal(rows, width):
    texts = [words(r[1]) for r in rows]
    seen = Counter(tuple(w[i : i + width]) for w in texts for i in range(len(w) - width + 1))
    out = []
    for r, w in zip(rows, texts, strict=True):
        gone = {i + k for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for k in range(width)}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((r[0], len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [35, 5])
def test_substring_removal(documents, rows, width, monkeypatch):
    assert collected(substring_dedup.removal_report(documents, width)) == brute_removal(rows, width)
    monkeypatch.setattr(substring_dedup, "BLOCK_WINDOWS", 500)
    assert collected(substring_dedup.removal_report(documents, width)) == brute_removal(rows, width)


def test_substring_removal_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [tuple(r) for r in docs.select("doc_id", "text").collect()]
    assert collected(substring_dedup.removal_report(docs)) == brute_removal(rows, 35)
    first = docs.limit(1).collect()[0]
    kept = {r.doc_id: r.text for r in substring_dedup.remove_repeats(docs).collect()}
    assert set(words(kept[first.doc_id])) <= set(words(first.text))


def test_substring_packing():
    for places in ([], [0], [3, 4, 300, 301, 100_000], [254, 255, 510]):
        assert substring_dedup.unpack(substring_dedup.pack(np.array(places, np.int64))).tolist() == places


# 6 -------------------------------------------------------------------------


def test_shards_fit_and_split_only_when_they_must(documents, rows):
    limit = 20_000
    found = sharding.extendible_shards(documents, limit).collect()
    assert len(found) == len(rows)
    size, count = Counter(), Counter()
    for r in found:
        size[r.shard] += r.n_bytes
        count[r.shard] += 1
        assert r.depth == len(r.shard)
    assert all(size[s] <= limit or count[s] == 1 for s in size)
    shards = set(size)
    assert not any(a != b and b.startswith(a) for a in shards for b in shards)
    for s in shards - {""}:  # the parent was over the limit
        assert sum(n for t, n in size.items() if t.startswith(s[:-1])) > limit


def test_shards_of_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(7, "x" * 100)] * 50, "doc_id long, text string")
    found = sharding.extendible_shards(docs, 1000).collect()
    size = Counter()
    for r in found:
        size[r.shard] += r.n_bytes
    assert len(found) == 50 and max(size.values()) <= 1000


def test_written_shards_hold_every_row_once(spark, tmp_path):
    rows = [(7, "x" * 100, i) for i in range(50)] + [(None, "y" * 100, i) for i in range(50)] + [(i, None, i) for i in range(5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place int").repartition(4)
    sharding.write_shards(docs, str(tmp_path / "out"), 1000)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert Counter((r.doc_id, r.text, r.place) for r in back.collect()) == Counter(rows)
    assert max(r.n for r in back.groupBy("shard").agg(F.sum(F.length("text")).alias("n")).collect() if r.n) <= 1000
    with pytest.raises(ValueError, match="another"):
        sharding.write_shards(docs.withColumn("shard", F.lit(1)), str(tmp_path / "no"), 1000)


# 7 -------------------------------------------------------------------------


def check_packing(found, rows, length, limit_padding=None):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path())
    ids = defaultdict(list)
    for r in rows:
        ids[r[0]].append(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2])
    pieces = defaultdict(list)
    for p in found:
        pieces[p.doc_id].append(p)
    assert set(pieces) == set(ids)
    for doc, copies in ids.items():
        want = Counter((start, zlib.crc32(np.array(copies[0][start : start + n], "<u4").tobytes())) for start, n in {(p.start, p.length) for p in pieces[doc]})
        assert {(p.start, p.ids_crc32) for p in pieces[doc]} == set(want)
        assert {p.doc_tokens for p in pieces[doc]} == {len(copies[0])}
        held = Counter(i for p in pieces[doc] for i in range(p.start, p.start + p.length))
        assert held == {i: len(copies) for i in range(len(copies[0]))}
    at = defaultdict(list)
    for p in found:
        at[p.sequence_id].append((p.offset, p.length))
    for spans in at.values():
        spans.sort()
        assert spans[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(spans, spans[1:], strict=False))
        assert sum(n for _, n in spans) <= length
    total = sum(p.length for p in found)
    return len(at) * length / total - 1


@pytest.mark.parametrize("length", [4096, 128])
def test_packing(documents, rows, length):
    found = packing.pack(documents, tokenizer_path(), length, open_windows=4, fan_in=2).collect()
    padding = check_packing(found, rows, length)
    assert padding < 0.12


def test_packing_of_nothing(empty):
    assert packing.pack(empty, tokenizer_path()).count() == 0


def test_cached_tokenizer_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer, cached = Tokenizer.from_file(tokenizer_path()), packing.tokenizer_at(tokenizer_path())
    texts = ["", "a<|endoftext|>b  c's I'LL x\x0b\x1cé é Ⅷ İİ ΣΑΣ ﬁ ", "\n\n x \t", "Straße, ÇA... !!!??? 'tis don't 12a 3.14 _x_ ½ 中文 👍🏽 ́a", "a\xa0b c"] * 2
    ids, at = cached.encode([t.encode() for t in texts])
    for i, t in enumerate(texts):
        assert ids[at[i] : at[i + 1]].tolist() == tokenizer.encode(t, add_special_tokens=False).ids + [2]


# 8 -------------------------------------------------------------------------


def test_near_dedup_takes_candidates_from_simhash(spark):
    from ridgeline.llm import near_copies
    from ridgeline.plans.scratch import Scratch

    rng = np.random.default_rng(11)
    base = [[f"w{x}" for x in rng.integers(0, 400, 600)] for _ in range(40)]
    made = [" ".join(b) for b in base] + [" ".join([*b, "tail"]) for b in base]
    documents = spark.createDataFrame(list(enumerate(made)), "doc_id long, text string").repartition(3)
    scratch = Scratch(spark, "t")
    sets = scratch.keep(near_copies.with_sets(documents))
    of = {r.doc_id: r.sid for r in sets.collect()}
    pairs = {(r.u, r.v) for r in near_copies.similar(sets, scratch).collect()}
    prints = simhash_dedup.fingerprints([t.encode() for t in made], near_copies.SHINGLE)
    close = {(a, b) for b in range(80) for a in range(b) if int(prints[a] ^ prints[b]).bit_count() <= simhash_dedup.DISTANCE}
    assert len(close) > 30 and all((min(of[a], of[b]), max(of[a], of[b])) in pairs for a, b in close)
    # These pairs alone link texts, and are only believed after the exact check.
    kept = near_copies.keep_one(documents, bands=0)
    assert kept.count() == 80 - len({b for _, b in close})


def test_near_dedup_shuffles_no_text_that_stays(spark):
    from ridgeline.llm import near_copies
    from ridgeline.plans.scratch import Scratch

    made = [(i if i % 9 else None, f"text {i % 1800} " * 5) for i in range(2000)]
    documents = spark.createDataFrame(made, "doc_id long, text string").withColumn("bits", F.lit("clash")).repartition(3)
    listed = documents.where("doc_id % 10 = 0 or doc_id is null").select("doc_id", F.xxhash64("text").alias("text_hash"))
    for most in (near_copies.MARK_WORDS, 8):  # 8 words are too few: more rows may be listed, but none is missed
        may, rest = near_copies.marked(documents, listed, Scratch(spark, "t"), most)
        assert may.columns == documents.columns and may.count() + rest.count() == 2000
        assert rest.where("doc_id % 10 = 0 or doc_id is null").count() == 0
        assert most == 8 or may.where("doc_id % 10 <> 0").count() < 100
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = near_copies.keep_one(documents.select("doc_id", "text"))._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", bound)
    # Texts that surely stay only meet a broadcast.
    assert "Union" in plan and "rightHint=(strategy=broadcast)" in plan


def brute_rules(text):
    text = text or ""
    w = words(text)
    seen = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    covered = {i + k for i in range(len(w) - 4) if seen[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_rule_statistics(documents, rows, labels):
    found = quality_rules.quality_rules(documents, labels).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == Counter((r[0], *brute_rules(r[1])) for r in rows)
    for r in found:
        assert r.base_failed == (r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words)
        assert not (r.base_failed and r.kept)


def test_rules_keep_clean_rows_and_catch_junk(spark):
    """On labelled rows that took no part in the fit."""
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    judged = quality_rules.quality_rules(docs, labels).join(labels, "doc_id").where("not base_failed").where(quality_rules.held_out(F.col("doc_id")))
    found = {r.quality: r.kept for r in judged.groupBy("quality").agg(F.avg(F.col("kept").cast("double")).alias("kept")).collect()}
    print("held-out rows kept, by quality:", found)
    assert found[1] > 0.99 and found[0] < 0.1


def brute_threshold(scores, good, loss):
    best = (-2.0, 0.0)
    order = sorted(set(scores))
    for cut in [*((a + b) / 2 for a, b in zip(order, order[1:])), order[-1]]:
        lost = np.sum(scores[good] > cut) / good.sum()
        best = max(best, (np.sum(scores[~good] > cut) / (~good).sum() - lost if lost <= loss else -1.0, cut))
    return best[1]


def test_rules_learn_from_every_labelled_row(spark):
    rng = np.random.default_rng(8)
    made, marked = [], []
    for i in range(15_000):
        good = bool(rng.random() < 0.6)
        text = [f"w{x}" + "%" * int(rng.random() < (0.05 if good else 0.15)) + "." * int(rng.random() < 0.3) for x in rng.integers(0, 999, int(rng.integers(12, 40)))]
        made.append((i, " ".join(text)))
        marked.append((i, int(good)))
    # A doc_id of two texts: both are learned from.
    made += [(i, f"another text of document {i} " + " ".join(f"{x}%" for x in range(20))) for i in range(40)]
    docs, labels = spark.createDataFrame(made, "doc_id long, text string").repartition(3), spark.createDataFrame(marked, "doc_id long, quality int")
    judged = quality_rules.quality_rules(docs, labels).where("not base_failed").join(labels, "doc_id")
    found = judged.where(~quality_rules.held_out(F.col("doc_id"))).toPandas()
    assert len(found) > 9_500
    scores, good = found.anomaly.to_numpy(), (found.quality == 1).to_numpy()
    assert ((scores <= brute_threshold(scores, good, quality_rules.LOSS)) == found.kept).all()


def test_trees_draw_from_all_good_rows_however_they_are_dealt(spark):
    made = spark.range(20_000).select(F.xxhash64("id").alias("key"), F.array_repeat(F.col("id").cast("double"), len(quality_rules.FEATURES)).alias("features"))
    found = [np.array(quality_rules.subsamples(made.repartition(n), 20_000))[:, :, 0] for n in (2, 7)]
    assert found[0].shape == (quality_rules.TREES, quality_rules.SUBSAMPLE) and (found[0] == found[1]).all()
    assert all(len(set(tree)) == quality_rules.SUBSAMPLE for tree in found[0]) and len(np.unique(found[0])) > 19_000


def test_rules_without_labels(documents, labels, empty):
    assert all(r.kept == (not r.base_failed) for r in quality_rules.quality_rules(documents, labels.limit(0)).collect())
    assert quality_rules.quality_rules(empty, labels).count() == 0


# 9 -------------------------------------------------------------------------


def test_lm_scores(documents, rows, monkeypatch):
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 3000)
    found = lm_scoring.score_documents(documents).collect()
    held = lambda d: d is not None and zlib.crc32(str(d).encode()) % 10 == 0
    tokens = lambda text: [*words(fold(text)), None]
    count = Counter(t for r in rows if not held(r[0]) for t in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = Counter()
    for r in rows:
        ts = tokens(r[1])
        base = sum(np.log10((count[t] + 0.1) / (n + 0.1 * (v + 1))) for t in ts)
        want[(r[0], held(r[0]), len(ts), sum(count[t] > 0 for t in ts), n, round(base, 6))] += 1
    assert Counter((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found) == want
    assert all(np.isfinite(r.score) and r.score < 0 for r in found)


def test_lm_is_better_than_unigrams(spark):
    found = lm_scoring.score_documents(spark.read.parquet("/root/testdata/sf0.1/documents.parquet")).where("held_out").agg(F.sum("score").alias("s"), F.sum("base_score").alias("b"), F.sum("n_tokens").alias("n")).first()
    print(f"held-out log10 a token: model {found.s / found.n:.4f}, unigrams {found.b / found.n:.4f}")
    assert found.s > found.b


def test_lm_odd_tables(spark, empty):
    assert lm_scoring.score_documents(empty).count() == 0
    only_held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    r = lm_scoring.score_documents(spark.createDataFrame([(only_held, "a b", "en", "s", 3)], empty.schema)).first()
    assert r.train_tokens == 0 and np.isfinite(r.base_score) and np.isfinite(r.score)


def test_lm_scores_do_not_depend_on_partitions(spark, documents, rows, monkeypatch):
    """Whole documents scored one token at a time by a model trained here, with counts in a dictionary, give the query's scores."""
    from ridgeline.llm import gru

    shards = 3
    total = sum(len(words(r[1])) + 1 for r in rows if not lm_scoring.is_held_out(r[0]))
    monkeypatch.setattr(lm_scoring, "SHARD_TOKENS", -(-total // shards))
    monkeypatch.setattr(lm_scoring, "FAN_IN", 2)
    found = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_scoring.score_documents(documents).collect())
    monkeypatch.setattr(lm_scoring, "BLOCK_TOKENS", 4000)
    again = sorted((str(r.doc_id), r.n_tokens, r.score) for r in lm_scoring.score_documents(documents.repartition(7)).collect())
    assert [x[:2] for x in found] == [x[:2] for x in again]
    assert np.allclose([x[2] for x in found], [x[2] for x in again], rtol=1e-5)

    hash_of = lambda text: [*Words([(text or "").encode()], fold=True).hashes().tolist(), int(lm_scoring.END)]
    held = [lm_scoring.is_held_out(r[0]) for r in rows]
    texts = [hash_of(r[1]) for r in rows]
    count = Counter(h for t, out in zip(texts, held, strict=True) if not out for h in t)
    signed = lambda h: h - (1 << 64) if h >= 1 << 63 else h
    top = sorted((-c, signed(h), h) for h, c in count.items() if h != int(lm_scoring.END))[: lm_scoring.OWN - 1]
    known = [h for *_, h in sorted([*top, (-count[int(lm_scoring.END)], signed(int(lm_scoring.END)), int(lm_scoring.END))])]
    place = {h: i for i, h in enumerate(known)}
    share = lambda h: int(lm_scoring.shared_id(np.array([h], np.uint64))[0])
    id_of = lambda h: place[h] if h in place else lm_scoring.OWN + share(h)
    n_of, v_of, mass = Counter(), Counter(), np.zeros(gru.IDS)
    for h, c in count.items():
        mass[id_of(h)] += c
        if h not in place:
            n_of[share(h)] += c
            v_of[share(h)] += 1
    begin = place[int(lm_scoring.END)]
    sequences = Counter(np.array([id_of(h) for h in t], np.uint16).tobytes() for t, out in zip(texts, held, strict=True) if not out)
    hashes = {bytes(r.ids): r.h for r in spark.createDataFrame([(x,) for x in sequences], "ids binary").withColumn("h", F.xxhash64("ids")).collect()}
    dealt = defaultdict(list)
    for x, n in sequences.items():
        for i in range(n):
            dealt[(hashes[x] + i) % shards].append(x)
    made = []
    for shard in range(shards):
        params, n = lm_scoring._train(gru.initial(mass), [np.frombuffer(x, np.uint16) for x in sorted(dealt[shard])], begin, shard)
        made.append((np.frombuffer(gru.pack(params), np.float32).astype(float), n))
    params = gru.unpack((sum(x * n for x, n in made) / sum(n for _, n in made)).astype(np.float32).tobytes())
    table, want = gru.input_table(params), []
    for r, t in zip(rows, texts, strict=True):
        h, before, score = np.zeros((1, gru.HIDDEN), np.float32), begin, 0.0
        for token in t[:400]:
            _, h = gru.states(params, table, np.array([[before]]), h)
            before = id_of(token)
            score += float(gru.log_probs(params, h, np.array([before]))[0])
            if token not in place:
                score += np.log((count[token] + 0.1) / (n_of[share(token)] + 0.1 * (v_of[share(token)] + 1)))
        if len(t) <= 400:
            want.append((str(r[0]), len(t), score / np.log(10)))
    short = [x for x in found if x[1] <= 400]
    assert len(short) > 100 and np.allclose([x[2] for x in short], [x[2] for x in sorted(want)], rtol=1e-3)


def test_training_reads_every_token_with_the_state_of_scoring(monkeypatch):
    from ridgeline.llm import gru

    rng = np.random.default_rng(4)
    docs = [rng.integers(0, gru.IDS, n).astype(np.uint16) for n in (701, 2, 301, 1, 91, 16, 17, 18)]
    monkeypatch.setattr(lm_scoring, "LANE_TOKENS", 100)
    monkeypatch.setattr(lm_scoring, "RATE", 0.0)
    for least in (1, 200):
        if least == 1:
            monkeypatch.setattr(lm_scoring, "LANES", 1)
        else:
            monkeypatch.setattr(lm_scoring, "LANES", 8)
        seen, real = [], gru.gradients

        def gradients(p, into, out, h, *more, real=real, seen=seen):
            loss, *rest = real(p, into, out, h, *more)
            n = int(more[1].sum()) if more else out.size
            seen.append((loss * n, n))
            return loss, *rest

        monkeypatch.setattr(gru, "gradients", gradients)
        params = gru.initial(rng.integers(1, 100, gru.IDS))
        total = sum(map(len, docs))
        assert lm_scoring._train(params, docs, 7, 1)[1] == total == sum(n for _, n in seen)
        at = np.concatenate(([0], np.cumsum([len(d) for d in docs])))
        scored = gru.text_log_probs(params, np.concatenate(docs).astype(np.int64), at, 7)
        assert np.isclose(sum(x for x, _ in seen), -scored.sum(), rtol=1e-4)
        monkeypatch.setattr(gru, "gradients", real)


def test_state_is_carried_across_windows():
    from ridgeline.llm import gru

    rng = np.random.default_rng(0)
    p = gru.initial(rng.integers(1, 100, gru.IDS))
    ids = rng.integers(0, gru.IDS, 100)
    at = np.array([0, 40, 41, 100])
    batch = gru.text_log_probs(p, ids, at, 1)
    for a, b in zip(at[:-1], at[1:], strict=True):
        table, h, out = gru.input_table(p), np.zeros((1, gru.HIDDEN), np.float32), []
        for before, now in zip([1, *ids[a : b - 1]], ids[a:b], strict=True):
            _, h = gru.states(p, table, np.array([[before]]), h)
            out.append(gru.log_probs(p, h, np.array([now]))[0])
        assert np.allclose(out, batch[a:b], atol=1e-4)
    every = gru.log_probs(p, np.repeat(h, gru.IDS, axis=0), np.arange(gru.IDS))
    assert np.exp(every).sum() == pytest.approx(1, abs=1e-4)


def test_gradients_equal_differences():
    from ridgeline.llm import gru

    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in gru.initial(np.ones(gru.IDS)).items()}
    into, out, h = rng.integers(0, gru.IDS, (5, 3)), rng.integers(0, gru.IDS, (5, 3)), np.zeros((3, gru.HIDDEN))
    _, grads, _ = gru.gradients(p, into, out, h)
    for k, at in {"emb": (into[1, 1], 3), "wx": (2, 5), "u": (3, 7), "b": (20,), "wc": (2, 3), "bc": (1,), "bw": (out[0, 0] // gru.MEMBERS, 3)}.items():
        losses = []
        for e in (1e-3, -1e-3):
            q = {n: v.copy() for n, v in p.items()}
            q[k][at] += e
            losses.append(gru.gradients(q, into, out, h)[0])
        assert grads[k][at] == pytest.approx((losses[0] - losses[1]) / 2e-3, rel=0.02, abs=1e-5)


# 10 ------------------------------------------------------------------------


def brute_targets(sizes, weights=(5, 2, 1), limit=3):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_, left = {}, set(order), float(sum(sizes.values()))
    while open_:
        total = sum(weight[s] for s in open_)
        over = [s for s in open_ if left * weight[s] / total > limit * sizes[s]]
        if not over:
            target |= {s: left * weight[s] / total for s in open_}
            break
        for s in over:
            target[s] = float(limit * sizes[s])
        left -= sum(target[s] for s in over)
        open_ -= set(over)
    return target


@pytest.mark.parametrize("table", ["fixture", "sf0.01", "sf0.1"])
def test_mixing(spark, documents, table):
    docs = documents if table == "fixture" else spark.read.parquet(f"/root/testdata/{table}/documents.parquet")
    texts = docs.select("doc_id", "source", "text").collect()
    size = Counter()
    for r in texts:
        size[r.source] += len(words(r.text))
    found = mixing.mix(docs).collect()
    assert Counter((r.doc_id, r.source, r.size) for r in found) == Counter((r.doc_id, r.source, len(words(r.text))) for r in texts)
    target, taken = brute_targets(size), Counter()
    for r in found:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source], rel=1e-9)
        assert 0 <= r.taken <= 3 * r.size and (r.taken == r.copies * r.size)
        taken[r.source] += r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= max(0.01 * target[s], 60 if table == "fixture" else 20), s


def test_mixing_stops_sources_at_three_times_their_size(spark):
    rows = [(i, "w " * 10, "a") for i in range(3)] + [(i, "w " * 10, "b") for i in range(3, 100)] + [(200, None, "c"), (201, "", None)]
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert {r.copies for r in found if r.source == "a"} == {3}
    assert {r.target for r in found if r.source == "c"} == {0.0}
    again = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(5)).collect()
    assert sorted(map(repr, found)) == sorted(map(repr, again))


def test_mixing_of_nothing(empty):
    assert mixing.mix(empty).count() == 0
    assert mixing.mixed_documents(empty).count() == 0


def test_mixed_documents_repeat_rows(documents):
    copies = {(r.doc_id, r.source, r.size): r.copies for r in mixing.mix(documents).collect()}
    more = documents.withColumn("hash", F.lit("clash")).withColumn("size", F.lit(1)).withColumn("_copies", F.lit(2)).withColumn("row", F.lit(3))
    mixed = mixing.mixed_documents(more)
    assert mixed.columns == more.columns
    out = Counter((r.doc_id, r.source, len(words(r.text))) for r in mixed.collect())
    twice = Counter((r.doc_id, r.source, len(words(r.text))) for r in documents.collect())
    assert out == Counter({d: n * twice[d] for d, n in copies.items() if n})


def test_mixing_of_repeated_and_missing_ids(spark):
    """A doc_id in two sources with opposite gaps, and rows without one that make up most of a source."""
    rng = np.random.default_rng(2)
    rows = [(1, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(1, 60))), s) for s in "ab" for _ in range(200)]
    rows += [(None, " ".join(f"w{x}" for x in rng.integers(0, 99, rng.integers(1, 60))), "c") for _ in range(300)] + [(5, "same text", "c")] * 20
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found, size = mixing.mix(docs).collect(), Counter()
    for _, text, s in rows:
        size[s] += len(words(text))
    target, taken = brute_targets(size), Counter()
    for r in found:
        taken[r.source] += r.taken
    assert len(found) == len(rows) and all(abs(taken[s] - target[s]) <= 0.01 * target[s] + 2 for s in size)
    assert sorted(map(repr, found)) == sorted(map(repr, mixing.mix(docs.repartition(7)).collect()))


def test_mixing_of_many_sources(spark):
    """Targets against brute force for more sources than partitions, in the order of code points."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(["w"] * int(n)), f"s{chr(int(c))}") for i, (n, c) in enumerate(zip(rng.integers(0, 40, 400), rng.integers(0x41, 0x2FF, 400), strict=True))] + [(1000, "a b c", None)]
    size = Counter()
    for _, text, s in rows:
        size[s] += len(words(text))
    want = brute_targets(size)
    found = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).select("source", "target").distinct().collect()
    assert len(found) == len(want) and all(r.target == pytest.approx(want[r.source], rel=1e-9, abs=1e-9) for r in found)


def test_multipliers_equal_a_root_finder(spark, documents):
    """Each source's multiplier against bisection on the constraint itself."""
    scratch = Scratch(spark, "t")
    sized = documents.select("source", mixing.word_count(F.col("text")).alias("size")).where("size > 0")
    sizes = sized.groupBy("source", "size").agg(F.count("*").alias("n"))
    wanted = mixing.targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), scratch)
    held = defaultdict(list)
    for r in sizes.collect():
        held[r.source].append((r["size"], r.n))
    for r in mixing.solve(sizes, wanted, scratch).collect():
        total = lambda lam, r=r: sum(s * n * min(3.0, np.exp(min(50.0, lam * s / r.scale))) for s, n in held[r.source])
        low, high = -1e4, 1e4
        for _ in range(200):
            middle = (low + high) / 2
            low, high = (low, middle) if total(middle) > r.target else (middle, high)
        assert total(r.lam) == pytest.approx(r.target, rel=2e-6)
        if r.target < 2.999 * sum(s * n for s, n in held[r.source]):
            assert r.lam == pytest.approx((low + high) / 2, rel=1e-3, abs=1e-5)


def test_long_texts_are_one_chunk(spark):
    text = "word%d " * 3 % (1, 2, 3) + "x" * (CHUNK_BYTES + 10)
    docs = spark.createDataFrame([(1, text, "en", "s", 1), (2, "a b c", "en", "s", 1)], "doc_id long, text string, lang string, source string, n_chars long")
    found = {r.doc_id: r for r in simhash_dedup.near_duplicates(docs).collect()}
    assert found[1].fp % (1 << 64) == brute_fingerprint(text)
    assert {r.doc_id: r.n_words for r in substring_dedup.removal_report(docs).collect()} == {1: 4, 2: 3}
