"""Approximate nearest neighbours by a permutation index.

A fixed number of pivots is drawn from the vectors by a hash.  A vector is
represented by the order of its ``PREFIX`` nearest pivots and posted, with the
pivot's place in that order, in the inverted file of each of them.  A query
reads the files of its own nearest pivots; what it meets there is ranked by
the footrule distance of the two orders (a pivot outside an order has the
place after its last), and the best are reranked by their exact distance.

The vectors are dealt evenly into chunks of ``CHUNK`` and the queries into
blocks of ``QUERY_BLOCK``; each chunk keeps its own inverted files and meets
each block once, so a task holds one chunk and one block whatever their total.
Of a chunk of n vectors, at most ``CUT * n + AMPLIFY * nearest`` are reranked
for a query, by the same rule at every size; vectors without a pivot in common
with the query are not visited.  Every vector is indexed and every query meets
every chunk.

Each row whose ``is_query`` holds asks, and its candidates are all rows but
itself; so rows that share a vec_id can find each other, and each of them has
its own ranks.  Vectors take no part if they are null, zero or hold null or
non-finite components, nor do rows without a vec_id.  Distances need vectors
of one length: those that differ from the most common length (the longer, if
two are as common) take no part either.  An empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ridgeline.llm.words import rows
from ridgeline.plans.scratch import Scratch

PIVOTS, PREFIX, NEAREST = 256, 48, 10
CUT, AMPLIFY = 0.1, 12
CHUNK, QUERY_BLOCK = 8_192, 16_384

_PLACED = pa.schema([("uid", pa.int64()), ("vec_id", pa.int64()), ("asks", pa.bool_()), ("vector", pa.binary()), ("pivots", pa.binary())])
_PLACED_DDL = "uid long, vec_id long, asks boolean, vector binary, pivots binary"
_FOUND = pa.schema([("query_uid", pa.int64()), ("query_id", pa.int64()), ("uid", pa.int64()), ("vec_id", pa.int64()), ("score", pa.float64())])
_FOUND_DDL = "query_uid long, query_id long, uid long, vec_id long, score double"


def usable(vector: Column) -> Column:
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def orders(vectors: np.ndarray, pivots: np.ndarray, prefix: int) -> np.ndarray:
    """Each vector's nearest pivots in order, ties to the smaller pivot."""
    apart = (pivots**2).sum(axis=1) - 2.0 * vectors @ pivots.T
    return np.argsort(apart, axis=1, kind="stable")[:, :prefix].astype(np.int16)


class Postings:
    """Inverted files of one chunk."""

    def __init__(self, order: np.ndarray, pivots: int):
        self.n, self.prefix = order.shape
        flat = np.argsort(order.ravel(), kind="stable")
        self.row, self.place = flat // self.prefix, (flat % self.prefix).astype(np.int32)
        self.at = np.searchsorted(order.ravel()[flat], np.arange(pivots + 1))

    def footrule(self, order: np.ndarray) -> np.ndarray:
        """Distance of one order to each vector; a pivot beyond the prefix has the place after it."""
        m = self.prefix
        out = np.full(self.n, m * (m + 1), np.int32)  # no pivot in common
        for place, pivot in enumerate(order.tolist()):
            part = slice(self.at[pivot], self.at[pivot + 1])
            theirs = self.place[part]
            out[self.row[part]] += np.abs(theirs - place) + theirs + (place - 2 * m)
        return out


def candidates(files: Postings, order: np.ndarray, ids: np.ndarray, most: int) -> np.ndarray:
    """Up to most of the vectors that share a pivot with the query, the nearest by footrule, ties to the smaller place in ids' order."""
    apart = files.footrule(order)
    met = np.flatnonzero(apart < files.prefix * (files.prefix + 1))
    if len(met) <= most:
        return met
    key = apart[met].astype(np.int64) * files.n + ids[met]
    return met[np.argpartition(key, most - 1)[:most]]


def search_chunk(uids: np.ndarray, ids: np.ndarray, vectors: np.ndarray, order: np.ndarray, query_uids: np.ndarray, queries: np.ndarray, query_order: np.ndarray, pivots: int, nearest: int, cut: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Numbers of queries and of the chunk's rows, and their distances: each query's nearest among those that it reranks."""
    files = Postings(order, pivots)
    by_id = np.empty(len(ids), np.int64)
    by_id[np.lexsort((uids, ids))] = np.arange(len(ids))
    most = int(np.ceil(cut * len(ids))) + AMPLIFY * nearest
    which, near, scores = [], [], []
    for q in range(len(queries)):
        some = candidates(files, query_order[q], by_id, most)
        some = some[uids[some] != query_uids[q]]
        score = np.sqrt(((vectors[some] - queries[q]) ** 2).sum(axis=1))
        best = np.lexsort((by_id[some], score))[:nearest]
        which.append(np.full(len(best), q))
        near.append(some[best])
        scores.append(score[best])
    none = np.zeros(0, np.int64)
    return (np.concatenate(which), np.concatenate(near), np.concatenate(scores)) if which else (none, none, np.zeros(0))


def nearest_neighbours(embeddings: DataFrame, is_query: Column, nearest: int = NEAREST, pivots: int = PIVOTS, prefix: int = PREFIX, cut: float = CUT, chunk: int = CHUNK, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(query_id, rank, vec_id, score) of the nearest vectors found for each query row, by Euclidean distance."""
    spark = embeddings.sparkSession
    scratch = Scratch(spark, "permutation-index")
    valid = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("vector"), is_query.alias("asks")).where(usable(F.col("vector")) & F.col("vec_id").isNotNull())
    common = valid.groupBy(F.size("vector").alias("length")).count().orderBy(F.desc("count"), F.desc("length")).first()
    if common is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    valid = valid.where(F.size("vector") == common["length"])
    # Pivots: a bounded number of different vectors, the first by a hash.
    drawn = valid.orderBy(F.xxhash64("vec_id"), "vec_id", "vector").limit(8 * pivots).select("vector").collect()
    points = np.array([list(v) for v in dict.fromkeys(tuple(r["vector"]) for r in drawn)][:pivots])
    n_pivots, prefix = len(points), min(prefix, len(points))
    shared = spark.sparkContext.broadcast(points)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points = shared.value
        for batch in batches:
            if batch.num_rows:
                vectors = batch.column(3).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
                yield rows(_PLACED, *(batch.column(i) for i in range(3)), [v.tobytes() for v in vectors], [o.tobytes() for o in orders(vectors, points, prefix)])

    # Rows are numbered once and kept, so that a number means the same row from here on.
    placed = scratch.keep(valid.select(F.monotonically_increasing_id().alias("uid"), "vec_id", F.coalesce("asks", F.lit(False)).alias("asks"), "vector").mapInArrow(place, _PLACED_DDL))
    total, asking = placed.agg(F.count("*"), F.count_if("asks")).first()
    if not asking:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    chunks, blocks = -(-total // chunk), -(-asking // query_block)
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda n: F.pmod(F.xxhash64("uid"), F.lit(n)).cast("int")
    filed = placed.select(dealt(chunks).alias("chunk"), every(blocks).alias("block"), "uid", "vec_id", "vector", "pivots")
    asked = placed.where("asks").select(every(chunks).alias("chunk"), dealt(blocks).alias("block"), "uid", "vec_id", "vector", "pivots")

    def read(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        stack = lambda c, t: np.frombuffer(b"".join(table[c].to_pylist()), t).reshape(table.num_rows, -1)
        return table["uid"].to_numpy(), table["vec_id"].to_numpy(), stack("vector", np.float64), stack("pivots", np.int16)

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return _FOUND.empty_table()
        uids, ids, vectors, order = read(left)
        query_uids, query_ids, queries, query_order = read(right)
        which, near, score = search_chunk(uids, ids, vectors, order, query_uids, queries, query_order, n_pivots, nearest, cut)
        return pa.Table.from_batches([rows(_FOUND, query_uids[which], query_ids[which], uids[near], ids[near], score)])

    cells = chunks * blocks
    dealt_out = lambda df: df.repartition(cells, "chunk", "block").groupBy("chunk", "block")
    found = dealt_out(filed).cogroup(dealt_out(asked)).applyInArrow(search, _FOUND_DDL)
    best = W.partitionBy("query_uid").orderBy("score", "vec_id", "uid")
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= nearest).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
