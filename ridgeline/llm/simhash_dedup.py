"""SimHash near-duplicates, with candidates from pigeonring filtering.

A fingerprint is 64 majority bits over the XXH64 values of a text's word
shingles.  Its bits form a ring of five segments.  If two fingerprints differ
in at most two bits, then some start on the ring has a chain of consecutive
segments whose summed differences stay, for each length l, within the
proportional budget floor(2 * l / 5): 0, 0, 1, 1, 2.  The first two budgets
are zero, so the first two segments (25 or 26 bits) form an exact key under
each of the five starts; the longer chains prune what shares a key before the
Hamming distance is taken.

Equal fingerprints collapse first, so copies cost nothing.  A key shared by
more than ``HOT`` different fingerprints is not paired up: there every
fingerprint is filed under itself and each of its one-bit variants.  Two
fingerprints are within two bits exactly if they share such a file, so linking
each file to its least member gives the same components with a number of links
that is linear in the members.

A text of any length has one fingerprint.  Null and empty texts have
fingerprint zero and link like any other.  A null doc_id is never a
component's id unless the component has no other.  Repeated rows are all
returned, in one component.  An empty table gives no rows; columns other than
doc_id and text play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm.components import connected_components
from ridgeline.llm.words import Words, chunks, rows
from ridgeline.plans.scratch import Scratch

BITS, DISTANCE, SEED = 64, 2, 42
#: Widths of the ring's segments, from the top bit on.
SEGMENTS = (13, 13, 13, 13, 12)
#: Different fingerprints under one key that are still compared pair by pair.
HOT = 64


def fingerprints(texts: list[bytes], shingle: int = 3) -> np.ndarray:
    """SimHash of each text: A-Z folded, shingles of so many words, repeats included."""
    words = Words(texts, fold=True)
    data, at, first = words.joined()
    counts = np.diff(first)
    width = np.minimum(counts, shingle)
    n = np.maximum(counts - shingle + 1, np.minimum(counts, 1))  # shingles of each text
    doc = np.repeat(np.arange(len(texts)), n)
    shingle_at = np.concatenate(([0], np.cumsum(n)))
    begin = first[doc] + np.arange(len(doc)) - shingle_at[doc]
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.fromiter((digest(data[s:e], seed) for s, e in zip(at[begin].tolist(), (at[begin + width[doc]] - 1).tolist(), strict=True)), np.uint64, len(doc))
    out = np.zeros(len(texts), np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones = np.add.reduceat(bits, shingle_at[full], axis=0, dtype=np.int32)
        out[full] = np.packbits(ones * 2 > n[full, None], axis=1, bitorder="little").view(np.uint64).ravel()
    return out


def with_fingerprints(documents: DataFrame, shingle: int = 3) -> DataFrame:
    """(doc_id, fp) for each row; fp as a signed long."""
    schema = pa.schema([("doc_id", pa.int64()), ("fp", pa.int64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            yield rows(schema, part.column(0), fingerprints(texts, shingle).view(np.int64))

    return documents.select("doc_id", "text").mapInArrow(work, "doc_id long, fp long")


def _turned(fp: Column, by: int) -> Column:
    return fp if by == 0 else F.shiftleft(fp, by).bitwiseOR(F.shiftrightunsigned(fp, BITS - by))


def ring_index(classes: DataFrame) -> DataFrame:
    """A row per start on the ring: the key, the fingerprint turned so that the chain leads, and where its chains end."""
    starts = []
    for i in range(len(SEGMENTS)):
        widths = [SEGMENTS[(i + k) % len(SEGMENTS)] for k in range(len(SEGMENTS))]
        turned = _turned(F.col("fp"), sum(SEGMENTS[:i]))
        key = F.shiftrightunsigned(turned, BITS - sum(widths[:2])).bitwiseOR(F.lit(i << 32))
        starts.append(F.struct(key.alias("key"), F.lit(i).alias("start"), turned.alias("turned"), *(F.lit(BITS - sum(widths[:k])).alias(f"below{k}") for k in (2, 3, 4))))
    return classes.select("fp", F.explode(F.array(*starts)).alias("s")).select("fp", "s.*")


def _keyed(classes: DataFrame, scratch: Scratch, hot: int) -> tuple[DataFrame, DataFrame]:
    """Rows of the ring index under keys that several fingerprints share: those of few, and of many as (fp, start, file), a file for each one-bit variant."""
    index = ring_index(classes)
    shared = scratch.keep(index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1"))
    kept = scratch.keep(index.join(shared, "key"))
    # Bits of the key are equal in all members, so variants are made of the rest only.
    variants = F.expr("concat(array(turned), transform(sequence(0, below2 - 1), b -> turned ^ shiftleft(1L, b)))")
    return kept.where(F.col("members") <= hot), kept.where(F.col("members") > hot).select("fp", "start", F.explode(variants).alias("file"))


def _pairs(few: DataFrame) -> DataFrame:
    """(u, v): all pairs under one key whose chains stay in their budgets and that differ in few enough bits."""
    a, b = few.alias("a"), few.select("key", F.col("fp").alias("other"), F.col("turned").alias("other_turned")).alias("b")
    apart = F.col("turned").bitwiseXOR(F.col("other_turned"))
    chains = [F.expr(f"bit_count(shiftrightunsigned(turned ^ other_turned, below{k})) <= {2 * k // 5}") for k in (3, 4)]
    close = chains[0] & chains[1] & (F.bit_count(apart) <= DISTANCE)
    return a.join(b, (F.col("a.key") == F.col("b.key")) & (F.col("fp") < F.col("other")) & close).select(F.col("fp").alias("u"), F.col("other").alias("v"))


def links(classes: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(u, v): links that join all fingerprints within DISTANCE bits of each other into the right components; not all pairs, where a key is hot."""
    few, many = _keyed(classes, scratch, hot)
    filed = scratch.keep(many.groupBy("start", "file").agg(F.min("fp").alias("v"), F.count("*").alias("n")).where("n > 1").drop("n"))
    stars = many.join(filed, ["start", "file"]).where("fp <> v").select(F.col("fp").alias("u"), "v")
    return _pairs(few).union(stars)


def unsettled(classes: DataFrame, scratch: Scratch, hot: int = HOT) -> DataFrame:
    """(fp): of rows (fp, low, high), the least and largest name of what a fingerprint belongs to, those within DISTANCE bits of one that belongs elsewhere.

    Itself counts.  A hot key's fingerprints are asked by files, so some may
    be named that only share a file with two that are apart; none is missed.
    """
    few, many = _keyed(classes.select("fp"), scratch, hot)
    of = lambda c: classes.select(F.col("fp").alias(c), F.col("low").alias(f"{c}_low"), F.col("high").alias(f"{c}_high"))
    apart = _pairs(few).join(of("u"), "u").join(of("v"), "v").where(F.least("u_low", "v_low") < F.greatest("u_high", "v_high"))
    named = many.join(classes, "fp")
    split = named.groupBy("start", "file").agg(F.min("low").alias("a"), F.max("high").alias("b")).where("a < b").select("start", "file")
    own = classes.where("low < high").select("fp")
    return own.union(apart.select("u")).union(apart.select("v")).union(many.join(split, ["start", "file"], "left_semi").select("fp")).distinct()


def near_duplicates(documents: DataFrame, shingle: int = 3, hot: int = HOT) -> DataFrame:
    """(doc_id, fp, component_id) for each row of documents."""
    scratch = Scratch(documents.sparkSession, "simhash")
    docs = scratch.keep(with_fingerprints(documents, shingle))
    classes = scratch.keep(docs.groupBy("fp").agg(F.min("doc_id").alias("least")))
    parts = connected_components(links(classes, scratch, hot), scratch)
    placed = scratch.keep(classes.join(parts.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component")))
    named = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    resolved = scratch.keep(placed.join(named, "component").select("fp", "component_id"))
    return docs.join(resolved, "fp").select("doc_id", "fp", "component_id")

