"""Near copies: texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

Candidates come from the SimHash operator: sets whose fingerprints of the
five-word shingles its pigeonring filtering finds within two bits (or equal).
It hands on links that stand for such groups, and a link that fails the check
must not part the others, so sets whose group is then in several components go
through the exact filter below as well.  Two bits do not reach down to a similarity of 0.8, where fingerprints of 64 bits differ by
about ten bits and no segment of a ring is selective.  So that no link is lost,
sets that share one of ``BANDS`` further keys, each made of ``ROWS``
min-hashes, are candidates as well; a pair at similarity 0.8 shares none with
probability (1 - 0.8**5)**32 = 3e-6, a closer pair with less.  Every candidate
pair is then checked on the whole sets (of 64-bit shingle hashes), so no link
is an estimate, whichever way it came.

Equal sets collapse first.  Under each key every set is checked against one
hub, the set whose keys are the most popular (in a cluster of copies that is
the one they resemble most), so a key costs as many pairs as it has sets.  The
sets under keys that are then still in several components go through an exact
prefix filter: with the rarest shingles first, two sets at 0.8 or more meet at
one that is early enough in both for the rest to make up the overlap that they
need.  Sets that share a key because of a common passage, or as loose copies of
one text, have what they share last in that order and don't meet; those that do
meet and are not linked yet are checked.  No pair at 0.8 or more that shares a
key is left out.

Words are folded and cut as in the SimHash operator; a text of fewer than five
words is one shingle, and empty and null texts are copies of each other.  Rows
are told apart by doc_id and text: rows that share a doc_id but not the text
are separate documents, and rows without a doc_id are compared like others.  A
text of any length is compared whole; an empty table stays empty; other
columns are kept and play no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.llm import simhash_dedup
from ridgeline.llm.components import connected_components
from ridgeline.llm.words import Words, chunks, mix, prefix_hash, rows, span_hash
from ridgeline.plans.scratch import Scratch

SHINGLE, BANDS, ROWS = 5, 32, 5
#: Jaccard similarity from which on two texts are near copies, as a fraction.
LEAST = (4, 5)
#: Words of 64 bits in a table of marks: four rows a word, and more when there are more rows than this has room for.
MARK_WORDS = 1 << 21
_FACTORS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)).reshape(2, -1) | np.uint64(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)

_SETS = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("sid", pa.int64()), ("n", pa.int32()), ("fp", pa.int64()), ("keys", pa.list_(pa.int64()))])
_SETS_DDL = "doc_id long, text_hash long, sid long, n int, fp long, keys array<long>"
_SHINGLES = pa.schema([("sid", pa.int64()), ("shingles", pa.list_(pa.int64()))])


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's different shingles, ascending within a text, and where each text's begin."""
    words = Words(texts, fold=True)
    counts = words.counts
    n = np.maximum(counts - SHINGLE + 1, np.minimum(counts, 1))
    doc = np.repeat(np.arange(len(texts)), n)
    first = words.word_at[doc] + np.arange(len(doc)) - (np.cumsum(n) - n)[doc]
    width = np.minimum(counts, SHINGLE)[doc]
    hashes = mix(span_hash(prefix_hash(words.hashes()), first, first + width) + width.astype(np.uint64))
    order = np.lexsort((hashes, doc))
    hashes, doc = hashes[order], doc[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (hashes[1:] != hashes[:-1])
    return hashes[new], np.searchsorted(doc[new], np.arange(len(texts) + 1))


def band_keys(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of BANDS keys for each non-empty set."""
    begin = at[:-1][at[:-1] < at[1:]]
    out = np.empty((len(begin), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(begin), band + 1, np.uint64)
        for i in range(band * ROWS, (band + 1) * ROWS):
            key = mix(key * _STEP + np.minimum.reduceat((hashes ^ _FACTORS[0, i]) * _FACTORS[1, i], begin))
        out[:, band] = key
    return out


def set_ids(hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """An id of each set, equal for equal sets."""
    total = np.concatenate(([np.uint64(0)], np.cumsum(mix(hashes), dtype=np.uint64)))
    return mix(total[at[1:]] - total[at[:-1]] + np.diff(at).astype(np.uint64)).view(np.int64)


def with_sets(documents: DataFrame) -> DataFrame:
    """doc_id, text_hash, sid (equal for equal sets), n (different shingles), fp (the SimHash fingerprint) and keys for each row."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            hashes, at = shingle_sets(texts)
            n = np.diff(at)
            keys = np.zeros((len(texts), BANDS), np.int64)
            if len(hashes):
                keys[n > 0] = band_keys(hashes, at).view(np.int64)
            yield rows(_SETS, part.column(0), part.column(2), set_ids(hashes, at), n, simhash_dedup.fingerprints(texts, SHINGLE).view(np.int64), pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, BANDS), pa.int32()), pa.array(keys.ravel())))

    return documents.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(work, _SETS_DDL)


def similar(sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(u, v, fits): links for sets of equal fingerprints or those that the SimHash operator joins; fits if their sizes allow for near copies.

    Sets with one fingerprint are linked to a head, which stands for them, so a
    pair that is close may be joined by way of others only (see ``unjoined``);
    but every set that is close to another is in a link.
    """
    prints = sets.where("n > 0").select("fp", "sid", "n").distinct()
    heads = scratch.keep(prints.groupBy("fp").agg(F.min(F.struct("sid", "n")).alias("head")))
    equal = prints.join(heads, "fp").select(F.struct("sid", "n").alias("a"), F.col("head").alias("b"))
    near = simhash_dedup.links(heads.select("fp"), scratch)
    for name, end in (("a", "u"), ("b", "v")):
        near = near.join(heads.select(F.col("fp").alias(end), F.col("head").alias(name)), end)
    both = equal.union(near.select("a", "b")).where(F.col("a.sid") != F.col("b.sid"))
    return scratch.keep(both.select(F.least("a.sid", "b.sid").alias("u"), F.greatest("a.sid", "b.sid").alias("v"), _alike("a.n", "b.n").alias("fits")).distinct())


def unjoined(sets: DataFrame, parts: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, component): sets with a fingerprint within two bits of that of a set in another component."""
    prints = sets.where("n > 0").select("fp", "sid").distinct()
    placed = scratch.keep(prints.join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("fp", "sid", F.coalesce("component", "sid").alias("component")))
    spans = scratch.keep(placed.groupBy("fp").agg(F.min("component").alias("low"), F.max("component").alias("high")))
    return placed.join(simhash_dedup.unsettled(spans, scratch), "fp", "left_semi").select("sid", "component")


def _word(row: Column, words: int) -> Column:
    return F.pmod(F.shiftrightunsigned(row, 24), F.lit(words))


def _bits(row: Column) -> Column:
    """Four bits of a word, by the bits of the row's hash that do not choose the word."""
    out = F.lit(0).cast("long")
    for i in range(4):
        out = out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftright(row, 6 * i).bitwiseAND(F.lit(63)).cast("int")))
    return out


def marked(documents: DataFrame, listed: DataFrame, scratch: Scratch, most: int = MARK_WORDS) -> tuple[DataFrame, DataFrame]:
    """documents in two parts: rows that listed (doc_id, text_hash) may hold, and rows that it surely does not.

    A Bloom filter of listed is broadcast, of a few bytes a row and of at most
    ``most`` words, so that no text is shuffled to find out.  The first part has
    all rows that are listed and a few that are not (more, if the filter is too
    small), and whoever needs exactly the listed ones has to join it.
    """
    words = min(most, max(1, listed.count() // 4))
    row = F.xxhash64("doc_id", "text_hash")
    marks = scratch.keep(listed.select(_word(row, words).alias("word"), _bits(row).alias("bits")).groupBy("word").agg(F.bit_or("bits").alias("bits")))
    own = F.xxhash64("d.doc_id", F.xxhash64("d.text"))
    known = documents.alias("d").join(F.broadcast(marks).alias("m"), _word(own, words) == F.col("m.word"), "left")
    may = F.coalesce(F.col("m.bits"), F.lit(0)).bitwiseAND(_bits(own)) == _bits(own)
    return known.where(may).select("d.*"), known.where(~may).select("d.*")


def _shingles(asked: DataFrame, documents: DataFrame, sets: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, shingles) of each sid asked for, and of a few others, cut again from one of the texts that have it.

    All shingles of all texts take more room than the texts, and few are asked for.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            hashes, at = shingle_sets(texts)
            yield rows(_SHINGLES, set_ids(hashes, at), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(hashes.view(np.int64))))

    one = sets.join(asked, "sid", "left_semi").groupBy("sid").agg(F.min(F.struct("doc_id", "text_hash")).alias("of"))
    texts, _ = marked(documents.select("doc_id", "text"), scratch.keep(one.select("of.doc_id", "of.text_hash")), scratch)
    # Rows alike in doc_id and text, or marked by chance, give a set more than once.
    return scratch.keep(texts.mapInArrow(work, "sid long, shingles array<long>").groupBy("sid").agg(F.first("shingles").alias("shingles")))


def _near(pairs: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """The pairs (u, v) that are near copies, by their whole sets; found holds the shingles of every set in a pair."""
    pairs = scratch.keep(pairs.distinct())
    first = found.select(F.col("sid").alias("u"), F.col("shingles").alias("a")).join(pairs.select("u"), "u", "left_semi")
    second = found.select(F.col("sid").alias("v"), F.col("shingles").alias("b")).join(pairs.select("v"), "v", "left_semi")
    both = pairs.join(first, "u").join(second, "v")
    part, whole = LEAST
    same = F.size(F.array_intersect("a", "b"))
    return scratch.keep(both.where(same * whole >= (F.size("a") + F.size("b") - same) * part).select("u", "v"))


def _alike(n: str, other: str):
    """Sets of too different sizes can't be near copies."""
    part, whole = LEAST
    return F.least(n, other) * whole >= F.greatest(n, other) * part


def _rarest(asked: DataFrame, found: DataFrame, scratch: Scratch) -> DataFrame:
    """(sid, n, at, shingle): of each set asked for, the shingles at the places that a first one in common with a near copy can have, the rarest among the sets asked for first."""
    part, whole = LEAST
    flat = scratch.keep(found.join(asked, "sid", "left_semi").select("sid", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle")))
    often = flat.groupBy("shingle").agg(F.count("*").alias("times")).where("times > 1")
    # Shingles of one set only come first, and have no one to meet: they take places but no rows.
    ordered = flat.join(often, "shingle").groupBy("sid", "n").agg(F.array_sort(F.collect_list(F.struct("times", "shingle"))).alias("all"))
    single = F.col("n") - F.size("all")
    least = F.floor((F.col("n") * part + whole - 1) / whole)
    first = F.slice("all", F.lit(1), F.greatest(F.col("n") - least + 1 - single, F.lit(0)).cast("int"))
    met = scratch.keep(ordered.select("sid", "n", single.alias("single"), F.posexplode(first).alias("at", "x")).select("sid", "n", (F.col("at") + F.col("single")).alias("at"), F.col("x.shingle").alias("shingle")))
    scratch.drop(flat)
    return met


def _meetings(met: DataFrame) -> DataFrame:
    """(u, v): sets of different components with a shingle in common from which on both have enough left.

    The larger set, or of two alike in size the one with the larger sid, looks the other up.
    """
    part, whole = LEAST
    # The smaller set needs 2 * part / (part + whole) of its own shingles, so that fewer of its first ones are filed.
    filed = met.where((F.col("n") - F.col("at")) * (part + whole) >= F.col("n") * 2 * part)
    other = filed.select("shingle", *(F.col(c).alias(f"other_{c}") for c in ("sid", "n", "at", "component")))
    enough = F.least(F.col("n") - F.col("at"), F.col("other_n") - F.col("other_at")) * (part + whole) >= (F.col("n") + F.col("other_n")) * part
    larger = (F.col("n") > F.col("other_n")) | ((F.col("n") == F.col("other_n")) & (F.col("sid") > F.col("other_sid")))
    found = met.join(other, "shingle").where(larger & enough & (F.col("component") != F.col("other_component")) & _alike("n", "other_n"))
    return found.select(F.least("sid", "other_sid").alias("u"), F.greatest("sid", "other_sid").alias("v"))


def near_groups(documents: DataFrame, bands: int = BANDS) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_hash, sid) for each row, and (sid, component) for each set that has near copies; with no bands, those that SimHash finds."""
    scratch = Scratch(documents.sparkSession, "near-copies")
    sets = scratch.keep(with_sets(documents))
    classes = sets.where("n > 0").groupBy("sid").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    index = scratch.keep(classes.select("sid", "n", F.explode(F.slice("keys", 1, bands)).alias("key")))
    shared = index.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    kept = scratch.keep(index.join(shared, "key"))
    scratch.drop(index)
    prints = similar(sets, scratch)
    # Every set that is compared below is in such a link or under a shared key, so the texts are gone through once for them.
    asked = kept.select("sid").union(prints.select("u")).union(prints.select("v"))
    found = _shingles(asked.distinct(), documents, sets, scratch)
    weights = kept.groupBy("sid").agg(F.sum("members").alias("weight"))
    weighed = scratch.keep(kept.join(weights, "sid").select("key", "sid", "n", "weight"))
    hubs = weighed.groupBy("key").agg(F.max(F.struct("weight", "sid", "n")).alias("hub"))
    stars = weighed.join(hubs, "key").where((F.col("sid") != F.col("hub.sid")) & _alike("n", "hub.n"))
    links = _near(prints.where("fits").select("u", "v").union(stars.select(F.least("sid", "hub.sid").alias("u"), F.greatest("sid", "hub.sid").alias("v"))), found, scratch)
    parts = connected_components(links, scratch)
    placed = scratch.keep(weighed.join(parts.withColumnRenamed("node", "sid"), "sid", "left").select("key", "sid", "n", F.coalesce("component", "sid").alias("component")))
    scratch.drop(kept)
    scratch.drop(weighed)
    mixed = placed.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a < b").select("key")
    open_ = scratch.keep(placed.join(mixed, "key", "left_semi").select("sid", "component").union(unjoined(sets, parts, scratch)).distinct())
    if not open_.isEmpty():
        met = _rarest(open_.select("sid"), found, scratch)
        parts = connected_components(links.union(_near(_meetings(met.join(open_, "sid")), found, scratch)), scratch)
    scratch.drop(found)
    return sets.select("doc_id", "text_hash", "sid"), parts.withColumnRenamed("node", "sid")


def keep_one(documents: DataFrame, bands: int = BANDS) -> DataFrame:
    """documents with one row of each group that near copies link: the one with the smallest doc_id.

    Of rows that share that doc_id the one whose text has the least hash stays,
    and a group without any doc_id keeps one of its rows by the same rule.  Only
    texts that may go are looked up in the list of what does.
    """
    scratch = Scratch(documents.sparkSession, "keep-one")
    found, parts = near_groups(documents, bands)
    keys = scratch.keep(found.join(parts, "sid", "left").groupBy(F.coalesce("component", "sid").alias("component"), "doc_id", "text_hash").agg(F.count("*").alias("n")))
    first = keys.groupBy("component").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash")).alias("first"))
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("text_hash") == F.col("first.text_hash"))
    # Rows that go, and those that stay once though they are there more often.
    listed = scratch.keep(keys.join(first, "component").where(~stays | (F.col("n") > 1)).select("doc_id", "text_hash", stays.alias("stays")))
    may, out = marked(documents, listed, scratch)
    own, same = may.alias("d"), F.col("d.doc_id").eqNullSafe(F.col("l.doc_id")) & (F.xxhash64("d.text") == F.col("l.text_hash"))
    out = out.union(own.join(listed.alias("l"), same, "left_anti"))
    repeated = listed.where("stays")
    if repeated.isEmpty():
        return out
    return out.union(own.join(repeated.alias("l"), same, "left_semi").dropDuplicates(["doc_id", "text"]))
