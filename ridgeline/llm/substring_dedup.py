"""Removal of passages that repeat, by Rabin-Karp hashes of all word windows.

1. Each task hashes every window of ``width`` words of its documents and deals
   the hashes out to buckets by their leading bits, as many buckets as the
   texts' bytes ask for (``BUCKET_BYTES``).  A hash that repeats within
   the task goes out once, so a passage that fills a third of the corpus costs
   one entry a task; buckets stay even because the hashes are uniform.
2. A bucket counts equal hashes over all tasks and returns, to each task's
   block, the places of those seen twice or more.
3. A block's places merge into maximal intervals of words to remove.
4. The intervals join the documents again, which drop those words.

Entries travel as packed arrays, nine bytes a window (the hash and the gap to
the block's previous window in that bucket); no row is made per window.

Hashes have 64 bits and a fixed base, so two different windows count as equal
with odds of about 2**-56 on texts that weren't written to collide; against
such texts there is no guarantee.  Nothing else is approximate.  Null and empty
texts have no words.  Repeated rows are copies like any other (all their
windows repeat), also where doc_ids are null.  A text of any length is read
whole; an empty table gives no rows; other columns play no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import Words, chunks, rows
from ridgeline.plans.scratch import Scratch

WIDTH = 35
#: Windows that a task gathers before it deals them out.
BLOCK_WINDOWS = 3_000_000
#: Text bytes for each bucket of window hashes; about as many bytes of entries.
BUCKET_BYTES = 1 << 24
#: Text bytes for each partition of blocks, whose entries are but the repeated windows.
BLOCK_BYTES = 1 << 26
_DEALT = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("meta", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_DEALT_DDL = "bucket int, block long, meta boolean, a binary, b binary, c binary"
_FOUND = pa.schema([("block", pa.int64()), ("meta", pa.bool_()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])
_FOUND_DDL = "block long, meta boolean, a binary, b binary, c binary"
_SPANS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])
_SPANS_DDL = "doc_id long, text_hash long, starts array<int>, ends array<int>"
RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])


def pack(places: np.ndarray) -> bytes:
    """Ascending integers as gaps: a byte each, and four more for gaps of 255 or more."""
    gaps = np.diff(places, prepend=0)
    wide = gaps >= 255
    return np.uint32(len(gaps)).tobytes() + np.where(wide, 255, gaps).astype(np.uint8).tobytes() + gaps[wide].astype(np.uint32).tobytes()


def unpack(data: bytes) -> np.ndarray:
    n = int(np.frombuffer(data, np.uint32, 1)[0])
    gaps = np.frombuffer(data, np.uint8, n, 4).astype(np.int64)
    gaps[gaps == 255] = np.frombuffer(data, np.uint32, offset=4 + n)
    return np.cumsum(gaps)


def _squeeze(data: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(data)


def _open(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def repeated(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Masks: of entries whose hash occurs twice or more, and of one entry for each hash."""
    order = np.argsort(hashes)
    same = hashes[order[1:]] == hashes[order[:-1]]
    often, first = np.zeros(len(hashes), bool), np.ones(len(hashes), bool)
    often[order[1:][same]] = True
    often[order[:-1][same]] = True
    first[order[1:][same]] = False
    return often, first


def _deal(width: int, buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        held: list[np.ndarray] = []
        ids: list[pa.Array] = []
        keys: list[pa.Array] = []
        sizes: list[np.ndarray] = []

        def out() -> Iterator[pa.RecordBatch]:
            hashes = np.concatenate(held)
            often, first = repeated(hashes)
            places = np.flatnonzero(first)
            hashes = hashes[first]
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.uint16 if buckets <= 1 << 16 else np.uint32)
            order = np.argsort(bucket, kind="stable")
            at = np.searchsorted(bucket[order], np.arange(buckets + 1))
            n = int((np.diff(at) > 0).sum())
            full = [b for b in range(buckets) if at[b] < at[b + 1]]
            yield rows(
                _DEALT,
                [*full, serial % buckets],
                [serial] * (n + 1),
                [*[False] * n, True],
                [*(hashes[order[at[b] : at[b + 1]]].tobytes() for b in full), pa.concat_arrays(ids).to_numpy(zero_copy_only=False).tobytes()],
                [*(pack(places[order[at[b] : at[b + 1]]]) for b in full), pa.concat_arrays(keys).to_numpy(zero_copy_only=False).tobytes()],
                [*[None] * n, _squeeze(np.concatenate(sizes).astype(np.int32).tobytes() + pack(np.flatnonzero(often)))],
            )

        for part, texts in chunks(batches):
            words = Words(texts)
            _, hashes = words.windows(words.hashes(), width)
            counts = np.maximum(words.counts - width + 1, 0)
            long = counts > 0
            if long.any():
                held.append(hashes)
                ids.append(part.column(0).filter(pa.array(long)).fill_null(-(1 << 63)))
                keys.append(part.column(2).filter(pa.array(long)))
                sizes.append(counts[long])
            if sum(map(len, held)) >= BLOCK_WINDOWS:
                yield from out()
                serial += 1
                for x in (held, ids, keys, sizes):
                    x.clear()
        if held:
            yield from out()

    return work


def _count(table: pa.Table) -> pa.Table:
    """One bucket: the places, by block, of hashes that several blocks hold."""
    meta = table.filter(table["meta"]).drop_columns(["bucket"])
    table = table.filter(pa.compute.invert(table["meta"]))
    hashes = [np.frombuffer(x, np.uint64) for x in table["a"].to_pylist()]
    out = [meta.cast(_FOUND)]
    if hashes:
        often, _ = repeated(np.concatenate(hashes))
        ends = np.cumsum([len(h) for h in hashes])
        found = []
        for block, gaps, mask in zip(table["block"].to_pylist(), table["b"].to_pylist(), np.split(often, ends[:-1]), strict=True):
            if mask.any():
                found.append((block, pack(unpack(gaps)[mask])))
        if found:
            out.append(pa.Table.from_batches([rows(_FOUND, [b for b, _ in found], [False] * len(found), [_squeeze(x) for _, x in found], [None] * len(found), [None] * len(found))]))
    return pa.concat_tables(out)


def _merge(width: int):
    def work(table: pa.Table) -> pa.Table:
        """One block: each document's maximal intervals of words to remove."""
        meta = table.filter(table["meta"])
        if not meta.num_rows:
            return _SPANS.empty_table()
        ids = np.frombuffer(meta["a"][0].as_py(), np.int64)
        keys = np.frombuffer(meta["b"][0].as_py(), np.int64)
        rest = _open(meta["c"][0].as_py())
        sizes = np.frombuffer(rest, np.int32, len(ids)).astype(np.int64)
        places = [unpack(rest[4 * len(ids) :])]
        places += [unpack(_open(x)) for x in table.filter(pa.compute.invert(table["meta"]))["a"].to_pylist()]
        flag = np.zeros(int(sizes.sum()), bool)
        for p in places:
            flag[p] = True
        at = np.flatnonzero(flag)
        ends = np.cumsum(sizes)
        doc = np.searchsorted(ends, at, "right")
        word = at - (ends - sizes)[doc]
        new = np.ones(len(at), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (word[1:] > word[:-1] + width)
        first = np.flatnonzero(new)
        last = np.append(first[1:], len(at)) - 1 if len(at) else first
        starts, stops, owner = word[first], word[last] + width, doc[first]
        docs = np.unique(owner)
        cut = np.append(np.searchsorted(owner, docs), len(owner)).astype(np.int32)
        lists = [pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(x.astype(np.int32))) for x in (starts, stops)]
        id_of = pa.array(ids[docs], mask=ids[docs] == -(1 << 63))
        return pa.Table.from_batches([rows(_SPANS, id_of, keys[docs], *lists)])

    return work


def repeated_spans(documents: DataFrame, scratch: Scratch, width: int = WIDTH, buckets: int | None = None) -> DataFrame:
    """(doc_id, text_hash, starts, ends) of each text that has words in a repeated window."""
    n_bytes = documents.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets or max(1, -(-n_bytes // BUCKET_BYTES))
    blocks = max(1, -(-n_bytes // BLOCK_BYTES))
    keyed = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("text_hash"))
    dealt = keyed.mapInArrow(_deal(width, buckets), _DEALT_DDL).repartition(buckets, "bucket")
    found = dealt.groupBy("bucket").applyInArrow(_count, _FOUND_DDL).repartition(blocks, "block")
    spans = found.groupBy("block").applyInArrow(_merge(width), _SPANS_DDL)
    # The intervals follow from the text alone, so repeated rows share them.
    return scratch.keep(spans.groupBy("doc_id", "text_hash").agg(F.min(F.struct("starts", "ends")).alias("s")).select("doc_id", "text_hash", "s.starts", "s.ends"))


def with_spans(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text, starts, ends) for each row of documents; the lists are null where nothing repeats."""
    spans = repeated_spans(documents, Scratch(documents.sparkSession, "substring-dedup"), width)
    keyed = documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).alias("d")
    same = F.col("d.doc_id").eqNullSafe(F.col("s.doc_id")) & (F.col("d.text_hash") == F.col("s.text_hash"))
    return keyed.join(spans.alias("s"), same, "left").select("d.doc_id", "d.text", "s.starts", "s.ends")


def _kept(words: Words, starts: pa.Array, ends: pa.Array) -> np.ndarray:
    doc = np.repeat(np.arange(words.n), pa.compute.fill_null(pa.compute.list_value_length(starts), 0).to_numpy(zero_copy_only=False))
    edge = np.zeros(len(words.start) + 1, np.int32)
    np.add.at(edge, words.word_at[doc] + starts.flatten().to_numpy(zero_copy_only=False), 1)
    np.add.at(edge, words.word_at[doc] + ends.flatten().to_numpy(zero_copy_only=False), -1)
    return np.cumsum(edge[:-1]) == 0


def removal_report(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """Per document: its words, those removed, and a digest of the kept words joined by a space."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            kept = _kept(words, part.column(2), part.column(3))
            data, at, first = words.joined(kept)
            digests = [hashlib.sha256(data[at[a] : at[b] - 1] if b > a else b"").hexdigest() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
            yield rows(RESULT, part.column(0), words.counts, words.counts - np.diff(first), digests)

    return with_spans(documents, width).mapInArrow(work, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def remove_repeats(documents: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, text) with the words outside repeated passages, joined by a space."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = Words(texts)
            data, at, first = words.joined(_kept(words, part.column(2), part.column(3)))
            yield rows(schema, part.column(0), [data[at[a] : at[b] - 1].decode("utf-8", "replace") if b > a else "" for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)])

    return with_spans(documents, width).mapInArrow(work, "doc_id long, text string")
