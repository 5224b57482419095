"""Whole texts as numpy arrays: words, lines and rolling hashes.

A word is a maximal run of bytes other than space and 0x09-0x0D.  Those
separators are single bytes in UTF-8, so all work is done on bytes: the texts
of a chunk are joined by a line feed into one buffer, and words are pairs of
offsets into it.

Rolling hashes are polynomials modulo 2**64 in an odd base (the Rabin-Karp
form).  With the prefix sums ``P[i] = sum(v[k] * B**-k for k < i)`` the hash of
``v[s:e]`` is ``(P[e] - P[s]) * B**s``, whatever its place, so all spans of a
chunk are hashed by three vector operations.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Hashable, Iterable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SEPARATOR = np.zeros(256, bool)
SEPARATOR[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
BASE = 0x9E3779B97F4A7C15 | 1
#: Text bytes that are worked on at a time; one longer text is a chunk of its own.
CHUNK_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """The finalising step of splitmix64: every bit of x reaches every bit."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS["up"]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.multiply.accumulate(steps)
    return _POWERS["up"], _POWERS["down"]


def prefix_hash(values: np.ndarray) -> np.ndarray:
    _, down = _powers(len(values) + 1)
    out = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * down[: len(values)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    up, _ = _powers(len(prefix))
    return (prefix[end] - prefix[start]) * up[start]


def per_doc(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Sums of values[at[i]:at[i + 1]]."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


class Words:
    """The words of some texts (bytes each): what lies between the bytes marked in gaps, line feed among them."""

    def __init__(self, texts: list[bytes], fold: bool = False, gaps: np.ndarray = SEPARATOR):
        self.n = len(texts)
        self.raw = b"\n".join(texts) + b"\n"
        self.buf = np.frombuffer(self.raw, np.uint8)
        if fold:
            self.buf = LOWER[self.buf]
            self.raw = self.buf.tobytes()
        lengths = np.fromiter((len(x) for x in texts), np.int64, self.n)
        self.doc_at = np.zeros(self.n + 1, np.int64)
        np.cumsum(lengths + 1, out=self.doc_at[1:])
        gap = gaps[self.buf]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        if len(self.buf) and not gap[0]:
            edge = np.concatenate(([0], edge))
        self.start, self.end = edge[0::2], edge[1::2]
        #: Words of text i: word_at[i] up to word_at[i + 1].
        self.word_at = np.searchsorted(self.start, self.doc_at)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_at)

    def doc_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of every word."""
        return mix(span_hash(prefix_hash(BYTE_VALUES[self.buf]), self.start, self.end) + (self.end - self.start).astype(np.uint64))

    def word(self, i: int) -> bytes:
        return self.raw[self.start[i] : self.end[i]]

    def windows(self, hashes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        """First words of all windows of width words within one text, and the windows' hashes."""
        n = len(hashes)
        if n < width:
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        doc = self.doc_of_word()
        first = np.flatnonzero(doc[: n - width + 1] == doc[width - 1 :])
        prefix = prefix_hash(hashes)
        return first, mix(span_hash(prefix, first, first + width))


    def joined(self, kept: np.ndarray | None = None) -> tuple[bytes, np.ndarray, np.ndarray]:
        """The (kept) words, one space after each: the bytes, each word's start in them, each text's first word."""
        start, end = (self.start, self.end) if kept is None else (self.start[kept], self.end[kept])
        edge = np.zeros(len(self.buf) + 2, np.int8)
        edge[start] += 1
        edge[end + 1] -= 1
        out = self.buf[np.cumsum(edge, dtype=np.int8)[: len(self.buf)].view(bool)].copy()
        at = np.zeros(len(start) + 1, np.int64)
        np.cumsum(end - start + 1, out=at[1:])
        out[at[1:] - 1] = 0x20
        return out.tobytes(), at, np.searchsorted(start, self.doc_at)


#: What this Python worker keeps from task to task: key, state, and the task that last used it.
_HELD: dict[str, Any] = {}


def _task() -> int | None:
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def _give_back() -> None:
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def worker_state(key: Hashable, make: Callable[[], Any]) -> Any:
    """State that a worker keeps for later tasks of an operator, made if it has none for key; it keeps one at a time."""
    if _HELD.get("key") != key:
        _HELD.clear()
        _give_back()
        _HELD.update(key=key, state=make())
    _HELD["task"] = _task()
    return _HELD["state"]


def texts_of(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """UTF-8 bytes of each text; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.fill_null("").cast(kind).to_pylist()


def chunks(batches: Iterable[pa.RecordBatch], text: str = "text", size: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows in order, with their texts, about size bytes of text at a time.

    Several workers share an executor's memory, so each gives back what it freed,
    and what an earlier operator left in it.
    """
    if _HELD and _HELD["task"] != _task():
        _HELD.clear()
        _give_back()
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        lengths = np.zeros(batch.num_rows, np.int64)
        if batch.num_rows:
            import pyarrow.compute as pc

            lengths = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start, held = 0, 0
        for i, length in enumerate(lengths.tolist()):
            if held and held + length > size:
                yield (part := batch.slice(start, i - start)), texts_of(part.column(batch.schema.get_field_index(text)))
                start, held = i, 0
            held += length + 1
        if start < batch.num_rows:
            yield (part := batch.slice(start)), texts_of(part.column(batch.schema.get_field_index(text)))
        batch = column = part = None
        pa.default_memory_pool().release_unused()
    _give_back()


def bound_batches(spark: SparkSession) -> None:
    """Rows go to Python workers in batches of few bytes, however long they are: every worker and its JVM hold some at a time."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", 2 * CHUNK_BYTES)


def rows(schema: pa.Schema, *columns) -> pa.RecordBatch:
    """A record batch of arrays, numpy arrays or lists in the order of schema."""
    return pa.RecordBatch.from_arrays([c.cast(f.type) if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def new_name(table: DataFrame, name: str) -> str:
    """name, with underscores in front until table has no such column (in whatever case)."""
    taken = {c.lower() for c in table.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def one_a_document(sample: DataFrame) -> DataFrame:
    """sample (doc_id and others) with one row, the least, for each doc_id, and without it."""
    others = [c for c in sample.columns if c != "doc_id"]
    return sample.groupBy("doc_id").agg(F.min(F.struct(*others)).alias("row")).select("row.*")
