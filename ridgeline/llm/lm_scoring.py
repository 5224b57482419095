"""Log-likelihood of documents under a recurrent language model.

1. One pass packs documents into blocks: the block's different tokens (64-bit
   hashes, ascending) and, for each document, the sequence of their numbers.
   Blocks are written once; all later steps read them.
2. Token counts over all training documents: each block deals its tokens'
   hashes and counts to buckets by leading bits, as many as the texts' bytes
   ask for; a bucket adds up equal hashes and returns each block the totals of
   its own tokens, in their order.  The vocabulary is never in one place.
3. The ``OWN`` most frequent tokens get ids of the gated recurrent model; every
   other one falls by its hash into one of ``SHARED`` ids and takes its count's
   share of that id's probability.
4. Training documents become sequences of ids, equal ones counted, and are
   dealt evenly into shards by a hash of their content; so a shard holds the
   same sequences however the input is partitioned.  Every shard trains a copy
   of the model by truncated backpropagation on all windows of its documents
   in order, with the state carried from one to the next as in scoring; copies
   are averaged by their tokens in a tree of bounded fan-in, in ``ROUNDS``
   rounds.
5. Each block scores its documents whole, the state carried across windows.

Tokens are words with A-Z folded, and one end per document; a null or empty
text has the end only.  A document is trained on unless it is held out; a null
doc_id counts as not held out.  Repeated rows are documents like any other, in
training and in the result.  A text of any length is one document; its block
is as large as it is.  An empty table gives no rows; without training documents
N is zero and both scores are finite.  Columns other than doc_id and text are
ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import gru
from ridgeline.llm.words import Words, chunks, mix, rows
from ridgeline.plans.scratch import Scratch

BLOCK_TOKENS = 2_000_000
#: Text bytes for each bucket of token counts.
BUCKET_BYTES = 1 << 25
#: Ids of frequent tokens (the end among them), and ids that all others share.
OWN, SHARED = 1792, 512
#: Tokens of a training shard; its lanes, of at least so many tokens each; copies averaged at a time.
SHARD_TOKENS, LANES, LANE_TOKENS, FAN_IN = 8_000_000, 512, 4_096, 16
ROUNDS, RATE = 1, 5e-3
#: The hash that stands for the end of a text.
END = np.uint64(0x5851F42D4C957F2D)

_BLOCK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("ids", pa.binary()), ("hashes", pa.binary()), ("numbers", pa.binary())])
_BLOCK_DDL = "bucket int, block long, ids binary, hashes binary, numbers binary"
_TOTAL = pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("counts", pa.binary()), ("top", pa.binary()), ("shared", pa.binary())])
_TOTAL_DDL = "block long, bucket int, counts binary, top binary, shared binary"
_PARAMS = pa.schema([("grp", pa.int64()), ("n", pa.int64()), ("params", pa.binary())])
_PARAMS_DDL = "grp long, n long, params binary"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
_SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _squeeze(x: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    return zstandard.ZstdCompressor(level=3).compress(x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes())


def _open(data: bytes, dtype) -> np.ndarray:
    raw = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.ascontiguousarray(raw.reshape(np.dtype(dtype).itemsize, -1).T).view(dtype).ravel()


def is_held_out(doc_id: int | None) -> bool:
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 10 == 0


def _blocks(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
        tokens: list[np.ndarray] = []
        counts: list[np.ndarray] = []
        ids: list[int | None] = []

        def out() -> Iterator[pa.RecordBatch]:
            lengths = np.concatenate(counts)
            held = np.fromiter(map(is_held_out, ids), bool, len(ids))
            hashes, number = np.unique(np.concatenate(tokens), return_inverse=True)
            trained = np.bincount(number[np.repeat(~held, lengths)], minlength=len(hashes)).astype(np.uint32)
            bucket = ((hashes >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
            at = np.searchsorted(bucket, np.arange(buckets + 1))
            full = [b for b in range(buckets) if at[b] < at[b + 1]]
            head = np.array([i if i is not None else 0 for i in ids], np.int64).tobytes() + np.array([i is None for i in ids]).tobytes() + held.tobytes() + lengths.astype(np.int32).tobytes()
            yield rows(
                _BLOCK,
                [*full, -1],
                [block] * (len(full) + 1),
                [*[None] * len(full), zstandard.compress(len(ids).to_bytes(8, "little") + head, 3)],
                [*(hashes[at[b] : at[b + 1]].tobytes() for b in full), hashes.tobytes()],
                [*(_squeeze(trained[at[b] : at[b + 1]]) for b in full), _squeeze(number.astype(np.uint32))],
            )

        for part, texts in chunks(batches):
            words = Words(texts, fold=True)
            with_end = np.empty(len(words.start) + words.n, np.uint64)
            ends = words.word_at[1:] + np.arange(words.n)
            body = np.ones(len(with_end), bool)
            body[ends] = False
            with_end[body], with_end[ends] = words.hashes(), END
            tokens.append(with_end)
            counts.append(words.counts + 1)
            ids += part.column(0).to_pylist()
            if sum(map(len, tokens)) >= BLOCK_TOKENS:
                yield from out()
                block += 1
                for x in (tokens, counts, ids):
                    x.clear()
        if tokens:
            yield from out()

    return work


def _add_up(table: pa.Table) -> pa.Table:
    """One bucket: totals of equal hashes, back to each block in its order; and the bucket's own summary."""
    hashes = [np.frombuffer(x, np.uint64) for x in table["hashes"].to_pylist()]
    counts = [_open(x, np.uint32) for x in table["numbers"].to_pylist()]
    found, number = np.unique(np.concatenate(hashes), return_inverse=True)
    total = np.bincount(number, np.concatenate(counts), len(found)).astype(np.uint64)
    back = [_squeeze(total[n]) for n in np.split(number, np.cumsum([len(h) for h in hashes])[:-1])]
    first = np.lexsort((found, -total.astype(np.int64)))[:OWN]
    first = first[total[first] > 0]
    bucket = table["bucket"][0].as_py()
    blocks = table["block"].to_pylist()
    k = len(blocks)
    place = shared_id(found)
    sums = np.concatenate([np.bincount(place, total, SHARED), np.bincount(place, total > 0, SHARED)]).astype(np.int64)
    return pa.Table.from_batches([rows(_TOTAL, [*blocks, None], [bucket] * (k + 1), [*back, None], [*[None] * k, np.concatenate([found[first], total[first]]).tobytes()], [*[None] * k, sums.tobytes()])])


def shared_id(hashes: np.ndarray) -> np.ndarray:
    """Which of the SHARED ids each hash falls into."""
    return (mix(hashes) % np.uint64(SHARED)).astype(np.int64)


class Block:
    """A block as it is read back."""

    def __init__(self, ids: bytes, hashes: bytes, numbers: bytes):
        raw = zstandard.decompress(ids)
        n = int.from_bytes(raw[:8], "little")
        self.doc_ids = np.frombuffer(raw, np.int64, n, 8)
        self.no_id = np.frombuffer(raw, bool, n, 8 + 8 * n)
        self.held = np.frombuffer(raw, bool, n, 8 + 9 * n)
        lengths = np.frombuffer(raw, np.int32, n, 8 + 10 * n)
        self.at = np.concatenate(([0], np.cumsum(lengths, dtype=np.int64)))
        self.hashes = np.frombuffer(hashes, np.uint64)
        self.number = _open(numbers, np.uint32)

    def model_ids(self, known: np.ndarray) -> np.ndarray:
        """Ids of the block's different tokens: the place in known (hashes by frequency), or a shared id."""
        order = np.argsort(known)
        place = np.minimum(np.searchsorted(known[order], self.hashes), len(known) - 1)
        there = known[order][place] == self.hashes
        return np.where(there, order[place], OWN + shared_id(self.hashes)).astype(np.int64)


def _train(params: gru.Params, docs: list[np.ndarray], begin: int, seed: int) -> tuple[gru.Params, int]:
    """params trained on the documents (ids each, the end included): lanes of documents are read from end to end, side by side.

    Longest first, a document goes to the lane with the fewest tokens; within
    a lane the order is random.  No lane is much longer than the longest
    document or LANE_TOKENS.
    """
    length = np.array([len(d) for d in docs], np.int64)
    total = int(length.sum())
    if not total:
        return params, 0
    rng = np.random.default_rng(seed)
    n_lanes = max(1, min(LANES, len(docs), total // max(LANE_TOKENS, int(length.max()))))
    lanes: list[list[int]] = [[] for _ in range(n_lanes)]
    shortest = [(0, i) for i in range(n_lanes)]
    for d in np.argsort(-length, kind="stable").tolist():
        held, i = shortest[0]
        lanes[i].append(d)
        heapq.heapreplace(shortest, (held + int(length[d]), i))
    lanes.sort(key=lambda lane: -int(length[lane].sum()))
    size = np.array([length[lane].sum() for lane in lanes])
    read = np.concatenate([rng.permutation(lane) for lane in lanes])
    token = np.concatenate([docs[d] for d in read.tolist()]).astype(np.int64)
    fresh = np.zeros(len(token), bool)
    fresh[np.cumsum(length[read]) - length[read]] = True
    before = np.where(fresh, begin, np.roll(token, 1))
    lane_end = np.cumsum(size)
    adam = gru.Adam(params, RATE)
    state = np.zeros((n_lanes, gru.HIDDEN), np.float32)
    for a in range(0, int(size[0]), gru.WINDOW):
        left = int((size > a).sum())  # lanes are sorted by their tokens
        place = (lane_end - size)[:left] + a + np.arange(gru.WINDOW)[:, None]
        there = place < lane_end[:left]
        place = np.minimum(place, len(token) - 1)
        _, grads, state = gru.gradients(params, before[place], token[place], state[:left], fresh[place], there)
        adam.step(grads)
    return params, total


def training_shards(texts: DataFrame, known: np.ndarray, tokens: int, partitions: int) -> tuple[DataFrame, int]:
    """(shard, ids, copies): the training documents as sequences of ids, and the number of shards.

    Copies of a sequence are spread over the shards, so the shards stay even.
    """
    shared = texts.sparkSession.sparkContext.broadcast(known)
    schema = pa.schema([("ids", pa.binary())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                block = Block(r["ids"], r["hashes"], r["numbers"])
                raw = block.model_ids(shared.value).astype(np.uint16)[block.number].tobytes()
                yield rows(schema, [raw[2 * block.at[d] : 2 * block.at[d + 1]] for d in np.flatnonzero(~block.held).tolist()])

    n = max(1, -(-tokens // SHARD_TOKENS))
    counted = texts.select("ids", "hashes", "numbers").mapInArrow(work, "ids binary").repartition(partitions, "ids").groupBy("ids").agg(F.count("*").alias("all"))
    dealt = counted.select("ids", "all", F.explode(F.sequence(F.lit(0).cast("long"), F.least("all", F.lit(n)) - 1)).alias("i"))
    copies = F.floor(F.col("all") / n) + (F.col("i") < F.col("all") % n).cast("long")
    return dealt.select(F.pmod(F.xxhash64("ids") + F.col("i"), F.lit(n)).cast("long").alias("shard"), "ids", F.when(F.col("all") < n, 1).otherwise(copies).cast("long").alias("copies")), n


def _average(table: pa.Table) -> pa.Table:
    """Parameters averaged by their tokens, in the order of the copies' numbers."""
    table = table.sort_by("grp")
    n = np.array(table["n"].to_pylist(), np.float64)
    total = sum(w * np.frombuffer(x, np.float32).astype(np.float64) for w, x in zip(n / max(n.sum(), 1), table["params"].to_pylist(), strict=True))
    return pa.Table.from_batches([rows(_PARAMS, [table["grp"][0].as_py() // FAN_IN], [int(n.sum())], [total.astype(np.float32).tobytes()])])


def _fit(shards: DataFrame, n_shards: int, params: gru.Params, begin: int) -> gru.Params:
    spark = shards.sparkSession

    def trainer(shared: Broadcast, turn: int):
        def work(table: pa.Table) -> pa.Table:
            shard = table["shard"][0].as_py()
            docs = [np.frombuffer(x, np.uint16) for x, n in sorted(zip(table["ids"].to_pylist(), table["copies"].to_pylist(), strict=True)) for _ in range(n)]
            new, n = _train(gru.unpack(shared.value), docs, begin, shard * ROUNDS + turn)
            return pa.Table.from_batches([rows(_PARAMS, [shard], [n], [gru.pack(new)])])

        return work

    for turn in range(ROUNDS):
        work = trainer(spark.sparkContext.broadcast(gru.pack(params)), turn)
        copies, left = shards.repartition(n_shards, "shard").groupBy("shard").applyInArrow(work, _PARAMS_DDL), n_shards
        while True:
            copies = copies.withColumn("to", F.floor(F.col("grp") / FAN_IN)).groupBy("to").applyInArrow(_average, _PARAMS_DDL)
            left = -(-left // FAN_IN)
            if left == 1:
                break
        found = copies.first()
        if found is not None and found["n"]:
            params = gru.unpack(bytes(found["params"]))
    return params


def score_documents(documents: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for each document.

    base_score is the unigram log10 likelihood with add-0.1 smoothing, score
    the recurrent model's.  Without any training document N is zero and both
    are finite.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "lm-scoring")
    trained = "doc_id is null or crc32(cast(cast(doc_id as string) as binary)) % 10 <> 0"
    n_bytes, ends = documents.agg(F.sum(F.octet_length("text")), F.count_if(F.expr(trained))).first()
    buckets = max(1, -(-(n_bytes or 0) // BUCKET_BYTES))
    blocks = scratch.keep(documents.select("doc_id", "text").mapInArrow(_blocks(buckets), _BLOCK_DDL))
    texts = blocks.where("bucket = -1")
    n_blocks = max(1, texts.count())
    counted = blocks.where("bucket >= 0").select("bucket", "block", "hashes", "numbers").repartition(buckets, "bucket")
    totals = scratch.keep(counted.groupBy("bucket").applyInArrow(_add_up, _TOTAL_DDL))
    summary = totals.where("block is null")
    pairs = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("c", pa.int64())])

    def most(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                hashes, counts = np.frombuffer(x, np.int64).reshape(2, -1)
                yield rows(pairs, hashes, counts, np.zeros(len(hashes), np.int64))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                n, v = np.frombuffer(x, np.int64).reshape(2, -1)
                yield rows(pairs, np.arange(SHARED), n, v)

    # Bounded numbers of rows: the model's own ids, less one for the end, and its shared ids.
    top = summary.select("top").mapInArrow(most, "a long, b long, c long").where(F.col("a") != int(END.astype(np.int64))).orderBy(F.desc("b"), "a").limit(OWN - 1).collect()
    found = {r["a"]: (r["n"], r["v"]) for r in summary.select("shared").mapInArrow(sums, "a long, b long, c long").groupBy("a").agg(F.sum("b").alias("n"), F.sum("c").alias("v")).collect()}
    by_count = sorted([(-r["b"], r["a"]) for r in top] + [(-ends, int(END.astype(np.int64)))])
    known = np.array([h for _, h in by_count], np.int64).view(np.uint64)
    own = np.array([-c for c, _ in by_count], np.float64)
    n_of, v_of = (np.array([found.get(i, (0, 0))[k] for i in range(SHARED)], np.float64) for k in (0, 1))
    n, v = int(n_of.sum()), int(v_of.sum())
    # What frequent tokens have of their own isn't shared.
    n_of -= np.bincount(shared_id(known), own, SHARED)
    v_of -= np.bincount(shared_id(known), own > 0, SHARED)
    counts = np.zeros(gru.IDS)
    counts[: len(own)], counts[OWN:] = own, n_of
    begin = int(np.flatnonzero(known == END)[0])
    params = gru.initial(counts)
    if n:
        shards, n_shards = training_shards(texts, known, n, n_blocks)
        params = _fit(shards if ROUNDS == 1 else scratch.keep(shards), n_shards, params, begin)
    shared = spark.sparkContext.broadcast((gru.pack(params), known, n_of, v_of))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return _SCORED.empty_table()
        packed, known, n_of, v_of = shared.value
        block = Block(*(left[c][0].as_py() for c in ("ids", "hashes", "numbers")))
        right = right.sort_by("bucket")
        counts = np.concatenate([_open(x, np.uint64) for x in right["counts"].to_pylist()]).astype(np.float64)
        base = np.log10((counts + 0.1) / (n + 0.1 * (v + 1)))
        model = block.model_ids(known)
        i = np.maximum(model - OWN, 0)
        within = np.where(model < OWN, 0.0, np.log((counts + 0.1) / (n_of[i] + 0.1 * (v_of[i] + 1))))
        probs = gru.text_log_probs(gru.unpack(packed), model[block.number], block.at, begin)
        probs += within[block.number]
        per_doc = lambda x: np.add.reduceat(x, block.at[:-1])  # noqa: E731  every text has its end
        return pa.Table.from_batches([rows(
            _SCORED, pa.array(block.doc_ids, mask=block.no_id), block.held, np.diff(block.at), per_doc((counts > 0)[block.number].astype(np.int64)),
            np.full(len(block.doc_ids), n), per_doc(base[block.number]), per_doc(probs) / np.log(10),
        )])

    back = totals.where("block is not null").select("block", "bucket", "counts").repartition(n_blocks, "block")
    whole = texts.select("block", "ids", "hashes", "numbers").repartition(n_blocks, "block")
    return whole.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(score, _SCORED_DDL)
