"""Toxicity by a subsequence string kernel, Nystrom landmarks and a support vector machine.

The kernel compares two units of text by the sequences of ``ORDER`` symbols
that they share, gaps allowed: each occurrence counts ``DECAY`` for every
symbol that it skips, and spans ``REACH`` symbols at most.  So an insult with
letters put in between, or with another ending, stays near the plain one.  The
kernel is normalised: a unit with itself gives one.

A unit is a word in lower case, marks left out ("i.d*iot"), common digits read
as letters; one-letter words in a row are one unit ("i d i o t").  A sentence
ends with a mark of ``.!?`` at a word's end, or with the line.  A sentence
takes the label of its document; its units are the instances.

* Training counts in Spark in how many distinct sentences of either kind each
  unit occurs; a sentence of texts of both kinds is a clean one, and copies
  count once.  A bounded number of units is learned from (``ASSOCIATED`` that go most
  with the label, the ``FREQUENT`` commonest, ``DRAWN`` by a hash); a greedy
  pass over them picks the landmarks.  Kernel values with the landmarks, turned
  by the landmarks' own kernel matrix (Nystrom), are the features of a linear
  machine with squared hinge loss; a unit of both kinds of texts pulls both
  ways by its share of each.
* A unit's margin is a weighted sum of its kernels with all landmarks.  That
  sum is one linear form over gapped sequences, so the landmarks are folded
  into one table (``Model.table``) and a unit costs the same however many they
  are.
* A sentence's margin is its units' largest; a document's score comes from its
  three largest sentence margins, how many are positive, and how many units
  there are, by a logistic fit on labelled texts that the machine has not seen.

The fit uses at most ``FIT_ROWS`` labelled rows, chosen by a hash of the
doc_id among those that may be learned from (one text a doc_id); a third of
them is for the logistic fit.  Scores go over all documents and whole texts.

Neither labels, lang, source nor doc_id enter a score.  A null or empty text
has no unit and is scored by the same fit.  Repeated rows are scored alike.
With labels of one kind only, every score is that label; without any, a half.
An empty table gives no rows.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import Words, chunks, mix, one_a_document, prefix_hash, rows, span_hash, worker_state
from ridgeline.plans.scratch import Scratch

ORDER, DECAY, REACH = 3, 0.6, 5
FIT_ROWS, ASSOCIATED, FREQUENT, DRAWN = 12_000, 4_000, 2_000, 6_000
LANDMARKS, NEAR, REGULAR, LONGEST = 512, 0.9, 1e-3, 64
TOP, FLOOR, FEATURES = 3, -1.5, 5
#: Units whose margins a worker keeps from chunk to chunk.
KEPT = 1 << 18

#: Symbols: letters, one for digits that are not read as letters, some for bytes beyond ASCII, and a unit's start.
START = 47
SYMBOLS = 48
_CODE = np.full(256, -1, np.int16)
_CODE[97:123] = np.arange(26)
_CODE[65:91] = np.arange(26)
_CODE[48:58] = 26
# Digits and marks that stand for letters.
for _mark, _letter in {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s"}.items():
    _CODE[ord(_mark)] = ord(_letter) - 97
_CODE[128:] = 27 + np.arange(128) % 20
_VALUES = mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_GAPS = [(j, k) for k in range(2, REACH + 1) for j in range(1, k)]


@dataclass
class Units:
    """The units of some texts: their symbols one after another, where each begins, its text and its sentence."""

    symbols: np.ndarray
    at: np.ndarray
    doc: np.ndarray
    sentence: np.ndarray

    def hashes(self) -> np.ndarray:
        prefix = prefix_hash(_VALUES[self.symbols])
        return mix(span_hash(prefix, self.at[:-1], self.at[1:]) + np.diff(self.at).astype(np.uint64))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and bounds of these units alone."""
        length = (self.at[1:] - self.at[:-1])[which]
        at = np.concatenate(([0], np.cumsum(length)))
        index = np.arange(at[-1]) + np.repeat(self.at[:-1][which] - at[:-1], length)
        return self.symbols[index], at


def sentence_of_word(words: Words) -> np.ndarray:
    """Numbers of sentences: a sentence's last word ends with a mark, or its line or text ends after it."""
    doc = words.doc_of_word()
    line = np.searchsorted(np.flatnonzero(words.buf == 10), words.start)
    new = np.zeros(len(doc), bool)
    new[1:] = np.isin(words.buf[words.end[:-1] - 1], list(b".!?")) | (line[1:] != line[:-1]) | (doc[1:] != doc[:-1])
    return np.cumsum(new)


def units(texts: list[bytes]) -> tuple[Units, Words]:
    words = Words(texts)
    code = _CODE[words.buf]
    kept = np.flatnonzero(code >= 0)
    word = np.searchsorted(words.start, kept, side="right") - 1
    size = np.bincount(word, minlength=len(words.start))
    doc, sentence = words.doc_of_word(), sentence_of_word(words)
    alone = size == 1
    joins = np.zeros(len(doc), bool)
    joins[1:] = alone[1:] & alone[:-1] & (doc[1:] == doc[:-1])
    has = size > 0
    unit = np.cumsum(has & ~joins) - 1
    first = np.flatnonzero(has & ~joins)
    length = np.bincount(unit[word], minlength=len(first)) + 1
    at = np.concatenate(([0], np.cumsum(length)))
    symbols = np.full(at[-1], START, np.int32)
    inner = np.ones(at[-1], bool)
    inner[at[:-1]] = False
    symbols[inner] = code[kept]
    return Units(symbols, at, doc[first], sentence[first]), words


def sequences(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All gapped sequences of units: unit, code of the sequence, what the occurrence counts."""
    unit = np.repeat(np.arange(len(at) - 1), np.diff(at))
    found = []
    for j, k in _GAPS:
        i = np.flatnonzero(unit[:-k] == unit[k:])
        code = (symbols[i] * SYMBOLS + symbols[i + j]) * SYMBOLS + symbols[i + k]
        found.append((unit[i], code, np.full(len(i), DECAY ** (k - ORDER + 1))))
    return tuple(np.concatenate(c) for c in zip(*found, strict=True))


def merged(symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """sequences with one row for each unit and code, normalised: a unit's squares add up to one."""
    unit, code, value = sequences(symbols, at)
    key = unit.astype(np.int64) * SYMBOLS**ORDER + code
    order = np.argsort(key, kind="stable")
    key, value = key[order], value[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    value = np.add.reduceat(value, first) if len(first) else value
    unit, code = np.divmod(key[first], SYMBOLS**ORDER)
    norm = np.sqrt(np.bincount(unit, value**2, minlength=len(at) - 1))
    return unit, code, value / norm[unit]


def kernel(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """Kernel values of all units of a with all units of b (few); each given as symbols and bounds."""
    unit_b, code_b, value_b = merged(*b)
    codes, column = np.unique(code_b, return_inverse=True)
    table = np.zeros((len(codes) + 1, len(b[1]) - 1))
    table[column, unit_b] = value_b
    unit, code, value = merged(*a)
    place = np.minimum(np.searchsorted(codes, code), max(len(codes) - 1, 0))
    row = np.where(codes[place] == code, place, len(codes)) if len(codes) else np.zeros(len(code), np.int64)
    hit = row < len(codes)
    unit, row, value = unit[hit], row[hit], value[hit]
    out = np.zeros((len(a[1]) - 1, table.shape[1]))
    for low in range(0, len(unit), 1 << 14):
        part = slice(low, low + (1 << 14))
        first = np.flatnonzero(np.concatenate(([True], unit[part][1:] != unit[part][:-1])))
        out[unit[part][first]] += np.add.reduceat(value[part][:, None] * table[row[part]], first, axis=0)
    return out


@dataclass(frozen=True)
class Model:
    #: The landmarks, weighted and added up: what each gapped sequence counts.
    table: np.ndarray
    bias: float
    #: Mean, scale, weights and intercept of the logistic fit.
    logistic: tuple[np.ndarray, np.ndarray, np.ndarray, float]
    name: int

    def margins(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        unit, code, value = merged(symbols, at)
        return np.bincount(unit, value * self.table[code], minlength=len(at) - 1) + self.bias

    def unit_margins(self, found: Units) -> np.ndarray:
        """Each distinct unit is measured once; a worker remembers those that it has seen."""
        hashes, first, back = np.unique(found.hashes(), return_index=True, return_inverse=True)
        held = worker_state(("toxicity", self.name), lambda: {"hash": np.zeros(0, np.uint64), "margin": np.zeros(0)})
        place = np.minimum(np.searchsorted(held["hash"], hashes), max(len(held["hash"]) - 1, 0))
        known = held["hash"][place] == hashes if len(held["hash"]) else np.zeros(len(hashes), bool)
        out = np.zeros(len(hashes))
        out[known] = held["margin"][place[known]]
        fresh = np.flatnonzero(~known)
        for low in range(0, len(fresh), 1 << 13):
            part = fresh[low : low + (1 << 13)]
            out[part] = self.margins(*found.take(first[part]))
        if len(fresh) and len(held["hash"]) + len(fresh) <= KEPT:
            both = np.concatenate([held["hash"], hashes[fresh]])
            order = np.argsort(both, kind="stable")
            held["hash"], held["margin"] = both[order], np.concatenate([held["margin"], out[fresh]])[order]
        return out[back]

    def features(self, texts: list[bytes]) -> np.ndarray:
        found, _ = units(texts)
        return summary(found, self.unit_margins(found), len(texts))

    def scores(self, texts: list[bytes]) -> np.ndarray:
        mean, scale, weights, intercept = self.logistic
        return _sigmoid((self.features(texts) - mean) / scale @ weights + intercept)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def sentence_margins(found: Units, margin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sentence, its text and its margin, of each sentence with a unit."""
    first = np.flatnonzero(np.concatenate(([True], found.sentence[1:] != found.sentence[:-1]))) if len(margin) else np.zeros(0, np.int64)
    return found.sentence[first], found.doc[first], np.maximum.reduceat(margin, first) if len(first) else margin


def summary(found: Units, margin: np.ndarray, n: int) -> np.ndarray:
    """A row of FEATURES per text: its largest sentence margins, how many are positive, how many units there are."""
    _, doc, top = sentence_margins(found, margin)
    top = np.clip(top, FLOOR, -FLOOR)
    out = np.full((n, FEATURES), FLOOR)
    order = np.lexsort((-top, doc))
    rank = np.arange(len(doc)) - np.searchsorted(doc[order], doc[order])
    best = rank < TOP
    out[doc[order][best], rank[best]] = top[order][best]
    out[:, TOP] = np.log1p(np.bincount(doc, top > 0, minlength=n))
    out[:, TOP + 1] = np.log1p(np.bincount(found.doc, minlength=n))
    return out


def pick_landmarks(candidates: list[bytes], most: int) -> list[bytes]:
    """Units in order, those left out that are near one already taken."""
    taken: list[bytes] = []
    for low in range(0, len(candidates), 512):
        some = candidates[low : low + 512]
        among = kernel(spans(some), spans(some))
        far = np.ones(len(some), bool) if not taken else kernel(spans(some), spans(taken)).max(axis=1) < NEAR
        mine: list[int] = []
        for i in np.flatnonzero(far & (np.diag(among) > 0)).tolist():
            if len(taken) + len(mine) < most and (not mine or among[i, mine].max() < NEAR):
                mine.append(i)
        taken += [some[i] for i in mine]
        if len(taken) >= most:
            break
    return taken


def spans(names: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(names), np.uint8).astype(np.int32), np.concatenate(([0], np.cumsum([len(x) for x in names]))).astype(np.int64)


def train(names: list[bytes], toxic: np.ndarray, clean: np.ndarray, landmarks: list[bytes]) -> tuple[np.ndarray, float]:
    """Weights of the normalised landmarks and the bias: a squared-hinge machine on Nystrom features, by Newton steps."""
    k = kernel(spans(landmarks), spans(landmarks))
    value, vector = np.linalg.eigh(k)
    root = vector @ np.diag(1 / np.sqrt(np.maximum(value, 1e-3))) @ vector.T
    x = np.hstack([kernel(spans(names), spans(landmarks)) @ root, np.ones((len(names), 1))])
    x, y = np.vstack([x, x]), np.repeat([1.0, -1.0], len(names))
    share = toxic / (toxic + clean)
    weight = (toxic + clean) ** 0.6
    weight = np.concatenate([weight * share, weight * (1 - share)])
    weight /= weight.sum()
    w = np.zeros(x.shape[1])
    penalty = np.full(x.shape[1], REGULAR / len(landmarks))
    penalty[-1] = 1e-9
    loss = lambda v: (weight * np.maximum(0, 1 - y * (x @ v)) ** 2).sum() + (penalty * v * v).sum()
    now = loss(w)
    for _ in range(60):
        on = (y * (x @ w) < 1) & (weight > 0)
        a = x[on] * weight[on, None]
        step, size = np.linalg.solve(a.T @ x[on] + np.diag(penalty), a.T @ y[on]) - w, 1.0
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        before, now = now, loss(w)
        if before - now < 1e-10 * before:
            break
    return root @ w[:-1], float(w[-1])


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Newton steps of a ridge logistic fit."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-3
    z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
    w, ridge = np.zeros(z.shape[1]), np.diag([1e-2] * x.shape[1] + [1e-6]) * len(x) ** 0.5
    for _ in range(40):
        p = _sigmoid(z @ w)
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge + 1e-9 * np.eye(len(w)), z.T @ (y - p) - ridge @ w)
        w = w + step
        if np.abs(step).max() < 1e-9:
            break
    return mean, scale, w[:-1], float(w[-1])


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _unit_counts(texts: DataFrame) -> DataFrame:
    """unit, and in how many distinct sentences of either kind it occurs, of rows (text, bad)."""
    schema = pa.schema([("sentence", pa.binary()), ("bad", pa.bool_()), ("units", pa.list_(pa.binary()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in chunks(batches):
            bad = part.column(1).to_numpy(zero_copy_only=False)
            found, _ = units(some)
            raw = found.symbols.astype(np.uint8).tobytes()
            names = [raw[a:b] for a, b in zip(found.at[:-1], found.at[1:], strict=True)]
            edge = np.flatnonzero(np.concatenate(([True], found.sentence[1:] != found.sentence[:-1], [True]))) if names else np.zeros(1, np.int64)
            spans_ = list(zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True))
            yield rows(schema, [hashlib.md5(raw[found.at[a] : found.at[b]]).digest() for a, b in spans_], bad[found.doc[edge[:-1]]], [list({n for n in names[a:b] if len(n) <= LONGEST}) for a, b in spans_])

    sentences = texts.select("text", "bad").mapInArrow(work, "sentence binary, bad boolean, units array<binary>")
    # One of a kind: copies of a text would make all its words look like its label.
    distinct = sentences.groupBy("sentence").agg(F.min("bad").alias("bad"), F.first("units").alias("units"))
    return distinct.select(F.explode("units").alias("unit"), F.col("bad").cast("long").alias("bad")).groupBy("unit").agg(F.sum("bad").alias("toxic"), (F.count("*") - F.sum("bad")).alias("clean"))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | float:
    """The model, or the one score that all documents get if labels of both kinds are lacking."""
    scratch = Scratch(documents.sparkSession, "toxicity")
    may = labels.where("doc_id is not null and toxic is not null").where(~held_out(F.col("doc_id")))
    h = F.xxhash64("doc_id", F.lit("toxicity"))
    chosen = may.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(h, "doc_id").limit(fit_rows)
    # At most fit_rows ids: a bounded broadcast.  Of rows that share a doc_id the least text is learned from.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("toxic") == 1).alias("bad"), (F.pmod(h, F.lit(3)) == 0).alias("aside"))
    sample = scratch.keep(one_a_document(texts))
    kinds = {r["bad"] for r in sample.select("bad").distinct().collect()}
    if len(kinds) < 2:
        return float(kinds.pop()) if kinds else 0.5
    learned = sample.where("not aside")
    if len({r["bad"] for r in learned.select("bad").distinct().collect()}) < 2:
        learned = sample
    counts = scratch.keep(_unit_counts(learned))
    base = counts.agg((F.sum("toxic") / F.sum(F.col("toxic") + F.col("clean"))).alias("rate")).first()["rate"]
    if base is None:
        return float(np.mean([r["bad"] for r in sample.select("bad").collect()]))
    n = F.col("toxic") + F.col("clean")
    drawn = F.xxhash64("unit")
    bounded = lambda order, most: counts.orderBy(*order, drawn, "unit").limit(most).collect()
    associated = bounded([F.desc((F.col("toxic") - base * n) / F.sqrt(n + 2))], ASSOCIATED)
    frequent, some = bounded([F.desc(n)], FREQUENT), bounded([], DRAWN)
    names = {bytes(r["unit"]): (r["toxic"], r["clean"]) for r in [*associated, *frequent, *some]}
    landmarks = pick_landmarks([bytes(r["unit"]) for r in associated], LANDMARKS // 2)
    other = pick_landmarks([u for r in zip(frequent, some, strict=False) for u in map(lambda x: bytes(x["unit"]), r) if u not in landmarks], LANDMARKS - LANDMARKS // 2)
    landmarks = list(dict.fromkeys(landmarks + other))
    if not landmarks:
        return float(np.mean([r["bad"] for r in sample.select("bad").collect()]))
    counted = np.array(list(names.values()), np.float64)
    weights, bias = train(list(names), counted[:, 0], counted[:, 1], landmarks)
    unit, code, value = merged(*spans(landmarks))
    table = np.bincount(code, value * weights[unit], minlength=SYMBOLS**ORDER)
    name = int(mix(np.frombuffer(table.tobytes(), np.uint64)).sum(dtype=np.uint64))
    model = Model(table, bias, (np.zeros(FEATURES), np.ones(FEATURES), np.zeros(FEATURES), 0.0), name)
    aside = sample.where("aside")
    if len({r["bad"] for r in aside.select("bad").distinct().collect()}) < 2:
        aside = sample
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("bad", pa.bool_()), ("x", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield rows(schema, part.column(1), list(shared.value.features(texts)))

    measured = aside.select("text", "bad").mapInArrow(work, "bad boolean, x array<double>").toArrow()  # at most fit_rows rows
    x, y = np.array(measured["x"].to_pylist()), measured["bad"].to_numpy().astype(np.float64)
    both = np.unique(np.column_stack([x, y]).round(9), axis=0)  # copies count once, in whatever order they came
    return Model(table, bias, logistic(both[:, :-1], both[:, -1]), name)


def score_with(model: Model | float, documents: DataFrame) -> DataFrame:
    """doc_id and score of each document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in chunks(batches):
            yield rows(schema, part.column(0), np.full(len(texts), model) if isinstance(model, float) else model.scores(texts))

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, score double")


def toxic_sentences(model: Model, documents: DataFrame) -> DataFrame:
    """doc_id, sentence and margin of every sentence with a positive margin."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("sentence", pa.string()), ("margin", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            found, words = units(texts)
            sentence, doc, margin = sentence_margins(found, shared.value.unit_margins(found))
            bad = np.flatnonzero(margin > 0)
            of_word = sentence_of_word(words)
            a, b = np.searchsorted(of_word, sentence[bad]), np.searchsorted(of_word, sentence[bad], side="right") - 1
            text = [words.raw[words.start[i] : words.end[j]].decode("utf-8", "replace") for i, j in zip(a, b, strict=True)]
            yield rows(schema, part.column(0).take(pa.array(doc[bad])), text, margin[bad])

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, sentence string, margin double")


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = score_with(fit(documents, labels), documents)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
