"""Packing of tokenised documents into training sequences, with bounded space.

Each task keeps a fixed number of open windows.  A piece goes to the open
window that it fills best; if none has room, the fullest is emitted.  Before
that, a window with a gap worth filling takes the head of the piece, so
emitted windows are full or nearly so.  Documents longer than a window are cut
into whole windows first.

When its input ends, a task holds a few partly filled windows.  Their pieces
are merged in rounds: groups of tasks pool their leftovers and pack them
again, largest first, until one group is left.  A group holds at most
``FAN_IN * OPEN`` windows whatever the size of the corpus.

Tokens come from a public tokenizer file.  Words are separated by the white
space that this tokenizer drops, so each different word is tokenised once per
Python worker and looked up from then on.  Every id lies in exactly one piece.
A null text is empty and has the end token only.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import Words, chunks, rows, worker_state
from ridgeline.plans.scratch import Scratch

LENGTH = 4096
END = 2
OPEN = 32
#: A gap of fewer ids is padded rather than filled with the head of a piece.
LEAST_HEAD = 16
FAN_IN = 16
#: Words that one worker remembers.
REMEMBERED = 1_500_000


class HashTable:
    """64-bit keys to running numbers, by vectorised open addressing."""

    def __init__(self, bits: int = 16):
        self.mask = np.uint64((1 << bits) - 1)
        self.keys = np.zeros(1 << bits, np.uint64)
        self.numbers = np.full(1 << bits, -1, np.int32)
        self.n = 0

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The number of each key; -1 if it isn't there."""
        slot = (keys & self.mask).astype(np.int64)
        out = self.numbers[slot]
        open_ = np.flatnonzero((out >= 0) & (self.keys[slot] != keys))
        slot = slot[open_]
        while len(open_):
            slot = (slot + 1) & int(self.mask)
            number = self.numbers[slot]
            out[open_] = number
            wrong = (number >= 0) & (self.keys[slot] != keys[open_])
            open_, slot = open_[wrong], slot[wrong]
        return out

    def add(self, keys: np.ndarray) -> None:
        """Gives the next numbers to different keys that aren't there yet."""
        if (self.n + len(keys)) * 2 > len(self.keys):
            old = self.keys[self.numbers >= 0][np.argsort(self.numbers[self.numbers >= 0])]
            bits = int(2 * (self.n + len(keys))).bit_length() + 1
            self.__init__(bits)
            self.add(old)
        number = np.arange(self.n, self.n + len(keys), dtype=np.int32)
        slot = (keys & self.mask).astype(np.int64)
        self.n += len(keys)
        while len(keys):
            free = self.numbers[slot] < 0
            self.numbers[slot[free]] = number[free]  # of several for one slot, one stays
            self.keys[slot[free]] = keys[free]
            lost = self.numbers[slot] != number
            self.keys[slot[~lost]] = keys[~lost]
            keys, number, slot = keys[lost], number[lost], (slot[lost] + 1) & int(self.mask)


class CachedTokenizer:
    """Token ids of whole texts by looking up their words.

    The tokenizer drops white space, so a text's ids are those of its words in
    order.  A word of plain letters and closing punctuation is two runs that
    the tokenizer's own model encodes; any other word goes through the whole
    tokenizer.
    """

    PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        setup = json.loads(self.tokenizer.to_str())
        steps = [x["type"] for x in (setup.get("normalizer") or {}).get("normalizers", [])], [x["type"] for x in (setup.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        #: The short way is right for this chain of steps only.
        self.model = self.tokenizer.model if steps == (["NFC", "Replace", "Lowercase"], ["Split", "ByteLevel"]) else None
        # The byte-level alphabet: printable bytes are themselves, the rest follow from 256 on.
        rest = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255)]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(rest)}
        self.forget()

    def forget(self) -> None:
        self.table = HashTable()
        self.flat = np.zeros(1 << 20, np.uint32)
        self.at = np.zeros(1 << 18, np.int32)

    def _run(self, run: str) -> list[int]:
        run = run.lower()
        if not run.isascii():
            run = run.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(run)]

    def _learn(self, new: list[bytes]) -> None:
        plain = self.PLAIN.fullmatch if self.model is not None else lambda _: None
        runs: dict[str, list[int]] = {"": []}
        encoded = []
        for word in map(bytes.decode, new):
            if m := plain(word):
                letters, marks = m.groups()
                if (head := runs.get(letters)) is None:
                    head = runs[letters] = self._run(letters)
                if marks:
                    if (tail := runs.get(marks)) is None:
                        tail = runs[marks] = self._run(marks)
                    head = head + tail
                encoded.append(head)
            else:
                encoded.append(self.tokenizer.encode(word, add_special_tokens=False).ids)
        n = self.table.n
        lengths = np.fromiter(map(len, encoded), np.int64, len(encoded))
        used, m = int(self.at[n]), int(lengths.sum())
        while len(self.flat) < used + m:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) < n + len(new) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[used : used + m] = np.fromiter(chain.from_iterable(encoded), np.uint32, m)
        self.at[n + 1 : n + len(new) + 1] = used + np.cumsum(lengths)

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, each text's followed by END, and where each text begins."""
        if self.table.n > REMEMBERED:
            self.forget()
        words = Words(texts)
        hashes = words.hashes()
        word = self.table.find(hashes)
        missing = np.flatnonzero(word < 0)
        if len(missing):
            keys, first = np.unique(hashes[missing], return_index=True)
            self._learn([words.word(i) for i in missing[first].tolist()])
            self.table.add(keys)
            word[missing] = self.table.find(hashes[missing])
        length = (self.at[word + 1] - self.at[word]).astype(np.int64)
        ends = np.cumsum(length)
        before = np.concatenate(([0], ends))[words.word_at]
        text_at = before + np.arange(len(texts) + 1)
        out = np.empty(int(text_at[-1]), np.uint32)
        last = text_at[1:] - 1
        out[last] = END
        body = np.ones(len(out), bool)
        body[last] = False
        out[body] = self.flat[np.repeat(self.at[word] - (ends - length), length) + np.arange(int(ends[-1]) if len(ends) else 0)]
        return out, text_at


def tokenizer_at(path: str) -> CachedTokenizer:
    return worker_state(("tokenizer", path), lambda: CachedTokenizer(path))


class Packer:
    """Bounded-space online best fit.  A piece is (length, payload); cut(piece, n) splits it."""

    def __init__(self, length: int, open_windows: int, cut=None):
        self.length, self.most, self.cut = length, open_windows, cut
        self.windows: list[tuple[int, list]] = []

    def put(self, piece) -> list[list]:
        """Places a piece of at most the window's length; returns the windows emitted."""
        out = []
        while True:
            size = piece[0]
            best, room = -1, self.length + 1
            for i, (used, _) in enumerate(self.windows):
                if size <= self.length - used < room:
                    best, room = i, self.length - used
            if best >= 0:
                used, held = self.windows[best]
                held.append(piece)
                if used + size == self.length:
                    del self.windows[best]
                    out.append(held)
                else:
                    self.windows[best] = (used + size, held)
                return out
            if len(self.windows) < self.most:
                if size == self.length:
                    return [*out, [piece]]
                self.windows.append((size, [piece]))
                return out
            fullest = max(range(len(self.windows)), key=lambda i: self.windows[i][0])
            used, held = self.windows.pop(fullest)
            gap = self.length - used
            if self.cut and gap >= LEAST_HEAD and size - gap >= 1:
                head, piece = self.cut(piece, gap)
                held.append(head)
            out.append(held)

    def rest(self) -> list[list]:
        out, self.windows = [held for _, held in self.windows], []
        return out


_PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("part", pa.int64())])
_PIECES_DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, part long"
NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _pack_part(path: str, length: int, open_windows: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = tokenizer_at(path)
        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        # Sequence numbers: the round and the part above, a running number below.
        serial = part << 32
        crc = lambda ids: zlib.crc32(ids.astype("<u4", copy=False).tobytes())

        def cut(piece, n):
            size, doc, start, ids, total = piece
            return (n, doc, start, ids[:n], total), (size - n, doc, start + n, ids[n:], total)

        packer = Packer(length, open_windows, cut)
        out: list[list] = [[] for _ in range(8)]

        def write(held, number, rest):
            offset = 0
            for size, doc, start, ids, total in held:
                for column, value in zip(out, (doc, start, size, crc(ids), total, number, offset, part if rest else None), strict=True):
                    column.append(value)
                offset += size

        for batch, texts in chunks(batches):
            ids, at = tokenizer.encode(texts)
            for doc, a, b in zip(batch.column(0).to_pylist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                for begin in range(a, b, length):
                    end = min(b, begin + length)
                    # Copied, so that a leftover doesn't hold its chunk in memory.
                    for held in packer.put((end - begin, doc, begin - a, ids[begin:end].copy(), b - a)):
                        write(held, serial, False)
                        serial += 1
            if len(out[0]) >= 10_000:
                yield rows(_PIECES, *out)
                for column in out:
                    column.clear()
        for held in packer.rest():
            write(held, serial, True)
            serial += 1
        if out[0]:
            yield rows(_PIECES, *out)

    return work


def _repack(length: int, open_windows: int, turn: int, last: bool):
    """One group of leftovers: pieces packed again, largest first; what is still open stays leftover unless this is the last round."""

    def work(table: pa.Table) -> pa.Table:
        data = table.select(_PIECES.names).to_pylist()
        group = table["grp"][0].as_py()
        data.sort(key=lambda r: (-r["length"], r["doc_id"] is None, r["doc_id"] or 0, r["start"], r["ids_crc32"], r["sequence_id"], r["offset"]))
        packer = Packer(length, open_windows if not last else len(data) + 1)
        done: list[tuple[list, bool]] = []
        for r in data:
            done += [(held, False) for held in packer.put((r["length"], r))]
        done += [(held, not last) for held in packer.rest()]
        out: list[list] = [[] for _ in range(8)]
        for k, (held, rest) in enumerate(done):
            offset = 0
            for size, r in held:
                for column, value in zip(out, (r["doc_id"], r["start"], size, r["ids_crc32"], r["doc_tokens"], (turn << 56) | (group << 32) | k, offset, group if rest else None), strict=True):
                    column.append(value)
                offset += size
        return pa.Table.from_batches([rows(_PIECES, *out)])

    return work


def pack(documents: DataFrame, tokenizer_path: str, length: int = LENGTH, open_windows: int = OPEN, fan_in: int = FAN_IN) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    scratch = Scratch(documents.sparkSession, "packing")
    now = scratch.keep(documents.select("doc_id", "text").mapInArrow(_pack_part(tokenizer_path, length, open_windows), _PIECES_DDL))
    done = [now.where("part is null")]
    turn = 1
    parts = (now.agg(F.max("part")).first()[0] or 0) + 1
    while True:
        parts = -(-parts // fan_in)
        grouped = now.where("part is not null").withColumn("grp", F.expr(f"part div {fan_in}"))
        now = scratch.keep(grouped.groupBy("grp").applyInArrow(_repack(length, open_windows, turn, parts == 1), _PIECES_DDL))
        done.append(now.where("part is null"))
        turn += 1
        if parts == 1:
            break
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out.select(*NAMES)
