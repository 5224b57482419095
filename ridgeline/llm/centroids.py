"""Centroid clustering on whole numbers, exact at every step.

A vector's components become ``floor(1024 * x)``.  The kept vectors are packed
into blocks of ``BLOCK`` (a row of one table each, with no shuffle), and every
round goes over the blocks once:

* Squared distances come from the expansion ``|x|^2 - 2 x.c + |c|^2``, one
  float64 matrix product a block.  While ``width * (max|x| + max|c|)^2`` stays
  below 2^53, no partial sum leaves the whole numbers that a double holds, in
  whatever order BLAS adds, so the result is exact.  Rows beyond that bound
  (and only they) are measured with Python integers.
* Sums and counts of each cluster are added by ``RDD.treeAggregate``; what
  travels has a fixed size (clusters by width).  Sums become Python integers
  before they can leave 63 bits.

Centroids start as the vectors whose id's hash is smallest.  A round replaces
each centroid by the floor of its vectors' mean; one without vectors stays.

Only vectors of ``width`` components take part, none of them null or
non-finite.  Repeated rows count as often as they occur.  A row without a
vec_id is clustered like any other, but starts a centroid only after all rows
with one; rows of equal hash start in the order of their vectors.  With fewer
rows than clusters there are as many centroids as rows; an empty table gives
no rows.  A distance or inertia that 64 bits can't hold is null (only
components beyond some 10^5 get there); the assignment is exact all the same.
Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.words import rows
from ridgeline.plans.scratch import Scratch

CLUSTERS, ROUNDS, WIDTH, SCALE = 8, 10, 64, 1024
#: Vectors in a block: two megabytes at 64 components.
BLOCK = 4096
EXACT, LONG = 1 << 53, 1 << 63

_BLOCKS = pa.schema([("ids", pa.list_(pa.int64())), ("vectors", pa.binary())])


def usable(vector: Column, width: int) -> Column:
    """Whether a vector has so many components, none null or non-finite."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & finite, F.lit(False))


def whole(x: float) -> int:
    """floor(SCALE * x) of a finite double, however large."""
    return math.floor(x * SCALE) if abs(x) < 1e300 else int(x) * SCALE


def grid(vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """floor(SCALE * x) as doubles, and which rows overflow on the way (their values are put to zero)."""
    with np.errstate(over="ignore"):
        q = np.floor(vectors * SCALE)
    over = ~np.isfinite(q).all(axis=1)
    q[over] = 0
    return q, over


def nearest(vectors: np.ndarray, centroids: list[list[int]]) -> tuple[np.ndarray, list[int] | np.ndarray]:
    """The nearest centroid of each row (ties: the smaller number) and its squared distance, exact."""
    width = vectors.shape[1]
    q, wide = grid(vectors)
    top = max((abs(c) for row in centroids for c in row), default=0)
    if top < EXACT:
        wide |= width * (np.abs(q).max(axis=1, initial=0) + top) ** 2 >= EXACT
    else:
        wide[:] = True
    c = np.array([[float(v) if top < EXACT else 0.0 for v in row] for row in centroids])
    apart = (q * q).sum(axis=1)[:, None] - 2.0 * (q @ c.T) + (c * c).sum(axis=1)
    which = apart.argmin(axis=1)
    found = apart[np.arange(len(q)), which]
    if not wide.any():
        return which, found.astype(np.int64)
    distance = [int(v) for v in np.where(wide, 0, found)]
    for i in np.flatnonzero(wide).tolist():
        x = [whole(v) for v in vectors[i].tolist()]
        distance[i], which[i] = min((sum((a - b) ** 2 for a, b in zip(x, row, strict=True)), k) for k, row in enumerate(centroids))
    return which, distance


@dataclass
class Sums:
    """What clusters hold: their count, their components' sums and the sum of their distances, as Python integers."""

    count: list[int]
    total: list[list[int]]
    inertia: list[int]

    @classmethod
    def none(cls, clusters: int, width: int) -> Sums:
        return cls([0] * clusters, [[0] * width for _ in range(clusters)], [0] * clusters)

    def add(self, other: Sums) -> Sums:
        self.count = [a + b for a, b in zip(self.count, other.count, strict=True)]
        self.total = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(self.total, other.total, strict=True)]
        self.inertia = [a + b for a, b in zip(self.inertia, other.inertia, strict=True)]
        return self


def block_sums(vectors: np.ndarray, centroids: list[list[int]]) -> Sums:
    """One block's part of the sums."""
    k, width = len(centroids), vectors.shape[1]
    which, distance = nearest(vectors, centroids)
    q, over = grid(vectors)
    count = np.bincount(which, minlength=k).tolist()
    if not over.any() and np.abs(q).max(initial=0) * len(q) < EXACT and isinstance(distance, np.ndarray) and distance.max(initial=0) * len(q) < EXACT:
        member = (which[:, None] == np.arange(k)).astype(np.float64)
        inertia = np.zeros(k, np.int64)
        np.add.at(inertia, which, distance)
        return Sums(count, [[int(v) for v in row] for row in (member.T @ q).tolist()], inertia.tolist())
    out = Sums.none(k, width)
    out.count = count
    for x, c, d in zip(vectors.tolist(), which.tolist(), distance, strict=True):
        out.total[c] = [a + whole(b) for a, b in zip(out.total[c], x, strict=True)]
        out.inertia[c] += int(d)
    return out


def pack(vectors: DataFrame, width: int, block: int) -> DataFrame:
    """Rows (vec_id, embedding of doubles) in blocks: ids, and the vectors' doubles one after another."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, data, held = [], [], 0
        for batch in batches:
            column = batch.column(1)
            flat = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
            start = 0
            while start < len(flat):
                stop = min(len(flat), start + block - held)
                ids += batch.column(0).slice(start, stop - start).to_pylist()
                data.append(flat[start:stop].astype("<f8").tobytes())
                held, start = held + stop - start, stop
                if held == block:
                    yield rows(_BLOCKS, [ids], [b"".join(data)])
                    ids, data, held = [], [], 0
        if held:
            yield rows(_BLOCKS, [ids], [b"".join(data)])

    return vectors.mapInArrow(work, "ids array<long>, vectors binary")


def _vectors(data: bytes, width: int) -> np.ndarray:
    return np.frombuffer(data, "<f8").reshape(-1, width)


def first_centroids(kept: DataFrame, clusters: int, seed: int) -> list[list[int]]:
    """The vectors whose ids hash lowest, as whole numbers: so many rows reach the driver, no more."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [[whole(v) for v in r["embedding"]] for r in kept.orderBy(h.asc_nulls_last(), "embedding").select("embedding").limit(clusters).collect()]


def cluster(embeddings: DataFrame, clusters: int = CLUSTERS, rounds: int = ROUNDS, width: int = WIDTH, seed: int = 3, block: int = BLOCK) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 of each vector that takes part."""
    spark = embeddings.sparkSession
    kept = embeddings.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding")).where(usable(F.col("embedding"), width))
    blocks = Scratch(spark, "centroids").keep(pack(kept, width, block))
    centroids = first_centroids(kept, clusters, seed)

    def sums(now: list[list[int]]) -> Sums:
        add = lambda held, data: held.add(block_sums(_vectors(data, width), now))
        return blocks.select("vectors").rdd.map(lambda r: bytes(r[0])).treeAggregate(Sums.none(len(now), width), add, Sums.add)

    for _ in range(rounds if centroids else 0):
        found = sums(centroids)
        centroids = [[s // n for s in total] if n else old for n, total, old in zip(found.count, found.total, centroids, strict=True)]
    inertia = sums(centroids).inertia if centroids else []
    long = lambda v: v if v < LONG else None
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    out = pa.schema([("vec_id", pa.int64()), ("cluster", pa.int32()), ("distance", pa.int64()), ("cluster_inertia", pa.int64()), ("inertia", pa.int64()), ("centroid_sha256", pa.string())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, data in zip(batch.column(0), batch.column(1), strict=True):
                which, distance = nearest(_vectors(data.as_py(), width), centroids)
                c = which.tolist()
                yield rows(out, ids.values, c, [long(int(d)) for d in distance], [long(inertia[k]) for k in c], [long(sum(inertia))] * len(c), [digests[k] for k in c])

    return blocks.mapInArrow(assign, "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string")
