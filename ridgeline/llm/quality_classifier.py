"""Quality classifier: random-indexing word vectors and a two-layer network.

Random indexing: every unit (a word, or the shape of a word) has a fixed
sparse index vector of random signs.  A unit's context vector is the sum of
the index vectors of all units next to it anywhere in the corpus; one pass over
all documents gathers these sums exactly, as integers.  A document is the
mean context vector of its words and of their shapes, and the mean index
vector of its pairs of neighbouring shapes.

A two-layer numpy network scores these.  It is trained on a bounded sample of
labelled rows (``FIT_ROWS``, chosen by a hash of the doc_id among the rows
that may be learned from); a fifth of that sample is set aside to fit the
temperature that calibrates its probabilities.  Words fall into ``WORDS`` and
shapes into ``SHAPES`` hashed rows, so the model's size is fixed.

Neither labels, lang, source nor doc_id enter a score.  Null and empty texts
are the zero vector.  Repeated rows are scored alike; of labelled rows that
share a doc_id one is learned from.  A text of any length is pooled whole.  An
empty table gives no rows.  ``keep_good`` keeps all columns, whatever their
names.  With labels of one kind only, every score is that label;
without any, every score is a half.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ridgeline.llm.words import SEPARATOR, Words, chunks, mix, new_name, one_a_document, rows
from ridgeline.plans.scratch import Scratch

DIMENSION, NONZERO = 64, 2
WORDS, SHAPES = 2048, 512
UNITS = WORDS + SHAPES
FIT_ROWS, HIDDEN, EPOCHS, BATCH, SEED = 8_000, 32, 40, 256, 5
FEATURES = 3 * DIMENSION
#: Documents that are pooled at a time, and sums that are added at a time.
POOL, FAN_IN = 1024, 16

_CLASS = np.full(256, 3, np.int64)  # other ASCII marks
for _i, _codes in enumerate((range(97, 123), range(65, 91), range(48, 58))):
    _CLASS[list(_codes)] = _i
_CLASS[list(b"#*$%&|<>")] = 4
_CLASS[33] = 5
_CLASS[list(b".,;:?")] = 6
_CLASS[128:] = 7


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of each unit's nonzero components (units by NONZERO)."""
    h = mix(np.arange(1, UNITS * NONZERO + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)).reshape(UNITS, NONZERO)
    return (h % np.uint64(DIMENSION)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)


PLACES, SIGNS = index_vectors()
SHAPE_INDEX = np.zeros((SHAPES * 2, DIMENSION), np.float32)
_h = mix(np.arange(1, SHAPES * 2 * 4 + 1, dtype=np.uint64) * np.uint64(0x9FB21C651E98DF25)).reshape(-1, 4)
np.add.at(SHAPE_INDEX, (np.arange(SHAPES * 2)[:, None], (_h % np.uint64(DIMENSION)).astype(np.int64)), np.where(_h >> np.uint64(63), 1.0, -1.0))


def units(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word: its row, its shape's row (from WORDS on), and the row of its pair with the next shape."""
    hashes = words.hashes()
    kinds = _CLASS[words.buf]
    kinds[SEPARATOR[words.buf]] = 8
    has = lambda c: per_span((kinds == c).astype(np.int32), words)
    length = words.end - words.start
    upper = has(1)
    doc = words.doc_of_word()
    again = np.zeros(len(hashes), np.int64)
    again[1:] = (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1])
    shape = kinds[words.start] + 8 * kinds[words.end - 1]
    shape = shape * 4 + np.minimum(length // 4, 3)
    shape = shape * 4 + (upper > 1) + 2 * (has(4) > 0)
    shape = shape * 2 + again
    shape = (mix(shape.astype(np.uint64) + np.uint64(77)) % np.uint64(SHAPES)).astype(np.int64)
    pair = np.zeros(len(hashes), np.int64)
    pair[:-1] = np.where(doc[1:] == doc[:-1], shape[1:] + 1, 0)
    pair = (mix((shape * 1024 + pair).astype(np.uint64) + np.uint64(5)) % np.uint64(SHAPES * 2)).astype(np.int64)
    return (hashes % np.uint64(WORDS)).astype(np.int64), shape + WORDS, pair


def per_span(values: np.ndarray, words: Words) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[words.end] - total[words.start]


def context_sums(words: Words, out: np.ndarray) -> None:
    """Adds to out (UNITS by DIMENSION, flat) the index vectors of each unit's neighbours."""
    word, shape, _ = units(words)
    doc = words.doc_of_word()
    next_to = np.flatnonzero(doc[1:] == doc[:-1])
    for here, there in ((next_to, next_to + 1), (next_to + 1, next_to)):
        for row in (word[here], shape[here]):
            for unit in (word[there], shape[there]):
                for k in range(NONZERO):
                    out += np.bincount(row * DIMENSION + PLACES[unit, k], SIGNS[unit, k], minlength=len(out))


def context_vectors(documents: DataFrame) -> np.ndarray:
    """Context vectors of all units over all documents, as unit vectors."""
    schema = pa.schema([("slot", pa.int64()), ("sums", pa.binary())])
    ddl = "slot long, sums binary"
    scratch = Scratch(documents.sparkSession, "context")

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros(UNITS * DIMENSION)
        for _, texts in chunks(batches):
            context_sums(Words(texts), out)
        slot = TaskContext.get().partitionId() if TaskContext.get() else 0
        yield rows(schema, [slot], [zstandard.compress(out.astype(np.int64).tobytes(), 1)])

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(zstandard.decompress(x), np.int64) for x in table["sums"].to_pylist())
        return pa.Table.from_batches([rows(schema, [table["slot"][0].as_py() // FAN_IN], [zstandard.compress(total.tobytes(), 1)])])

    # A row of fixed size for each partition, added up in a tree of bounded fan-in; one row reaches the driver.
    sums = scratch.keep(documents.select("doc_id", "text").mapInArrow(gather, ddl))
    left = (sums.agg(F.max("slot")).first()[0] or 0) + 1
    while True:
        sums = sums.withColumn("to", F.floor(F.col("slot") / FAN_IN)).groupBy("to").applyInArrow(add, ddl)
        left = -(-left // FAN_IN)
        if left == 1:
            break
    total = np.zeros(UNITS * DIMENSION, np.int64)
    for r in sums.collect():
        total += np.frombuffer(zstandard.decompress(bytes(r["sums"])), np.int64)
    vectors = total.reshape(UNITS, DIMENSION).astype(np.float64)
    norm = np.linalg.norm(vectors, axis=1, keepdims=True)
    return (vectors / np.where(norm == 0, 1, norm)).astype(np.float32)


def pooled(words: Words, vectors: np.ndarray) -> np.ndarray:
    """A row of FEATURES per text."""
    word, shape, pair = units(words)
    out = np.zeros((words.n, FEATURES), np.float64)
    for a in range(0, words.n, POOL):
        b = min(words.n, a + POOL)
        i, j = words.word_at[a], words.word_at[b]
        counts = words.counts[a:b]
        doc = np.repeat(np.arange(b - a), counts)
        n = np.maximum(counts, 1)[:, None]
        for k, (row, size, table) in enumerate(((word[i:j], WORDS, vectors[:WORDS]), (shape[i:j] - WORDS, SHAPES, vectors[WORDS:]), (pair[i:j], SHAPES * 2, SHAPE_INDEX))):
            share = np.bincount(doc * size + row, minlength=(b - a) * size).reshape(b - a, size).astype(np.float32)
            out[a:b, k * DIMENSION : (k + 1) * DIMENSION] = (share @ table) / n
    return out


@dataclass(frozen=True)
class Model:
    vectors: np.ndarray
    mean: np.ndarray
    scale: np.ndarray
    layers: tuple[np.ndarray, ...]
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        w1, b1, w2, b2 = self.layers
        return np.tanh((x - self.mean) / self.scale @ w1 + b1) @ w2 + b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, seed: int = SEED) -> Model:
    """Two layers by Adam on four fifths of the rows, the temperature on the rest."""
    rng = np.random.default_rng(seed)
    order = rng.permutation(len(x))
    aside = order[: len(x) // 5]
    rest = order[len(x) // 5 :]
    mean, scale = x[rest].mean(axis=0), x[rest].std(axis=0) + 1e-3
    z = (x - mean) / scale
    layers = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(())]
    first, second, step = [np.zeros_like(p) for p in layers], [np.zeros_like(p) for p in layers], 0
    epochs = max(EPOCHS, 2000 * BATCH // max(len(rest), 1) // 10)
    for _ in range(epochs):
        rest = rng.permutation(rest)
        for a in range(0, len(rest), BATCH):
            part = rest[a : a + BATCH]
            hidden = np.tanh(z[part] @ layers[0] + layers[1])
            error = (_sigmoid(hidden @ layers[2] + layers[3]) - y[part]) / len(part)
            back = error[:, None] * layers[2] * (1 - hidden**2)
            grads = [z[part].T @ back + 1e-4 * layers[0], back.sum(axis=0), hidden.T @ error + 1e-4 * layers[2], error.sum()]
            step += 1
            for k, g in enumerate(grads):
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.999 * second[k] + 0.001 * g**2
                layers[k] = layers[k] - 3e-3 * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    model = Model(vectors, mean, scale, tuple(layers), 1.0)
    if not len(aside):
        return model
    logits = model.logits(x[aside])
    grid = np.exp(np.linspace(np.log(0.05), np.log(8), 80))
    loss = [np.mean(np.logaddexp(0, logits / t) - y[aside] * logits / t) for t in grid]
    return Model(vectors, mean, scale, tuple(layers), float(grid[int(np.argmin(loss))]))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Model | float:
    """The model, or the one score that all documents get if labels of both kinds are lacking."""
    may = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    chosen = may.groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id", F.lit("classifier")), "doc_id").limit(fit_rows)
    vectors = context_vectors(documents)
    shared = documents.sparkSession.sparkContext.broadcast(vectors)
    schema = pa.schema([("doc_id", pa.int64()), ("good", pa.bool_()), ("x", pa.list_(pa.float64()))])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield rows(schema, part.column(0), part.column(2), list(pooled(Words(texts), shared.value)))

    # At most fit_rows ids of 16 bytes each: a bounded broadcast.
    texts = documents.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", (F.col("quality") == 1).alias("good"))
    sample = one_a_document(texts.mapInArrow(work, "doc_id long, good boolean, x array<double>")).toArrow()
    y = sample["good"].to_numpy()
    if not len(y):
        return 0.5
    if y.all() or not y.any():
        return float(y[0])
    x = np.array(sample["x"].to_pylist())
    order = np.lexsort((*x.T, y))  # whatever order the rows came in
    return train(x[order], y[order].astype(np.float64), vectors)


def score_with(model: Model | float, documents: DataFrame, whole: bool = False, column: str = "score") -> DataFrame:
    """doc_id and score of each document, the score in the named column; with whole, all its columns and the score."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    schema = documents.schema if whole else documents.select("doc_id").schema

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for part, texts in chunks(batches):
            score = np.full(len(texts), model) if isinstance(model, float) else model.scores(pooled(Words(texts), model.vectors))
            columns = part.columns if whole else part.columns[:1]
            names = part.schema.names if whole else part.schema.names[:1]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*names, column])

    rows_in = documents if whole else documents.select("doc_id", "text")
    return rows_in.mapInArrow(work, StructType([*schema.fields, StructField(column, DoubleType())]))


def classify(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for each document."""
    scored = score_with(fit(documents, labels), documents)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """documents less those that the classifier rejects."""
    column = new_name(documents, "score")
    return score_with(fit(documents, labels), documents, whole=True, column=column).where(F.col(column) >= 0.5).select(*(F.col(f"`{c}`") for c in documents.columns))
