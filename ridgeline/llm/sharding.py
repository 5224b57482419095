"""Sharding by extendible hashing.

A document's address is a string of hash bits.  The directory starts as one
shard; a shard over its byte limit splits on the next bit, and only such
shards do, until each fits.  A document's shard is therefore the shortest
prefix of its address whose documents fit the limit together.

Rounds take ``BITS`` address bits at a time: one pre-aggregated histogram of
bytes by prefix gives every split among those bits, so a round is one pass
over (address, bytes) rows however many splits it makes.  Shards that are
still too large after a round go into the next, alone.

The address is the MD5 of the doc_id (60 bits), then, for what no such bit can
part (rows that share a doc_id), bits of a hash of the row's place in the
input.  A single document over the limit ends as the only one of its shard.
Null texts have no bytes; a null doc_id has the address of the empty string.
Repeated rows are rows of their own.  An empty table has no shards.  Columns
other than doc_id and text play no part; ``write_shards`` writes them all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.scratch import Scratch

#: Address bits of one round; a round's directory has at most 2**(BITS + 1) entries a parent.
BITS = 15
KEY_ROUNDS = 4  # 60 bits of MD5
MAX_ROUNDS = 8


def _bits(turn: int):
    """The turn-th group of BITS address bits, as a long."""
    if turn < KEY_ROUNDS:
        digest = F.conv(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")
        return F.shiftright(digest, 60 - BITS * (turn + 1)).bitwiseAND(F.lit((1 << BITS) - 1))
    return F.shiftrightunsigned(F.xxhash64("place"), 64 - BITS * (turn - KEY_ROUNDS + 1)).bitwiseAND(F.lit((1 << BITS) - 1))


def _placed_shards(placed: DataFrame, limit: int, scratch: Scratch) -> DataFrame:
    """(doc_id, n_bytes, place, depth, shard) for rows that have doc_id, n_bytes and place."""
    active = placed.select("doc_id", "n_bytes", "place", F.lit("").alias("prefix"))
    done: list[DataFrame] = []
    for turn in range(MAX_ROUNDS):
        filed = active.withColumn("bits", _bits(turn))
        bins = filed.groupBy("prefix", "bits").agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("rows"))
        deeper = F.explode(F.sequence(F.lit(0), F.lit(BITS))).alias("depth")
        nodes = bins.select("prefix", "bits", "bytes", "rows", deeper).withColumn("node", F.expr(f"shiftright(bits, {BITS} - depth)")).groupBy("prefix", "depth", "node").agg(F.sum("bytes").alias("bytes"), F.sum("rows").alias("rows"))
        fitting = nodes.where((F.col("bytes") <= limit) | (F.col("rows") == 1)).select("prefix", "depth", "node")
        # The shortest fitting prefix of each bin that occurs.
        at = bins.select("prefix", "bits", deeper).withColumn("node", F.expr(f"shiftright(bits, {BITS} - depth)")).join(fitting, ["prefix", "depth", "node"]).groupBy("prefix", "bits").agg(F.min("depth").alias("depth"))
        directory = scratch.keep(at)
        found = scratch.keep(filed.join(directory, ["prefix", "bits"], "left"))
        binary = F.lpad(F.bin("bits"), BITS, "0")
        own = F.concat("prefix", F.expr(f"substring(lpad(bin(bits), {BITS}, '0'), 1, depth)"))
        done.append(found.where("depth is not null").select("doc_id", "n_bytes", "place", (F.col("depth") + turn * BITS).alias("depth"), own.alias("shard")))
        rest = found.where("depth is null").select("doc_id", "n_bytes", "place", F.concat("prefix", binary).alias("prefix"))
        if not rest.limit(1).count():
            break
        active = scratch.keep(rest)
    else:
        raise RuntimeError(f"shards over the limit are left after {MAX_ROUNDS * BITS} address bits")
    out = done[0]
    for more in done[1:]:
        out = out.union(more)
    return out


def _sized(documents: DataFrame, *more: Column) -> DataFrame:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long")
    return documents.select(*more, "doc_id", size.alias("n_bytes"), F.monotonically_increasing_id().alias("place"))


def extendible_shards(documents: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, depth, shard): the shard is the address prefix, as 0s and 1s; depth its length."""
    scratch = Scratch(documents.sparkSession, "sharding")
    return _placed_shards(scratch.keep(_sized(documents)), limit, scratch).select("doc_id", "n_bytes", "depth", "shard")


def write_shards(documents: DataFrame, path: str, limit: int, column: str = "shard") -> None:
    """Writes documents as Parquet, every row once and with all its columns, in one folder per shard.

    The folders are named by column, which documents must not have; its value is
    a p and the shard's prefix, so that it reads back as text.
    """
    if column in documents.columns:
        raise ValueError(f"documents have a column {column}; name another for the shard")
    scratch = Scratch(documents.sparkSession, "shards")
    # Rows are numbered once and kept, so that a number means the same row in both uses.
    kept = scratch.keep(_sized(documents, F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row")))
    at = _placed_shards(kept, limit, scratch).select("place", F.col("shard").alias("_at"))
    kept.join(at, "place").select("row.*", F.concat(F.lit("p"), "_at").alias(column)).repartition(column).write.partitionBy(column).parquet(path)
