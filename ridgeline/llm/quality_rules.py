"""Quality rules: an isolation forest on rule statistics.

Every document gets a vector of rule statistics, all computed from its whole
text.  A forest of random trees, each grown on a random subsample of the rows
labelled good, splits these at random: a document that few splits separate
from the rest has a short mean path and a high anomaly score.  The threshold
on the score is calibrated from labelled rows.  Documents that fail the fixed
base rules are not kept whatever their score.

Labels choose two things: the rows that the trees are grown on are those
labelled good, and the threshold separates both kinds.  The box in which cuts
fall spans both.  Trees grown on both kinds together find junk of one make
normal, as it is a cluster of its own (the README has figures of both).

The fit goes over all labelled rows that pass the base rules, but for a third
(``held_out``) by which it can be judged: the box is their range, each of
``TREES`` trees draws its ``SUBSAMPLE`` rows (the isolation forest's own
subsampling) from all good ones, and the threshold is the best one for the
scores of all of them.  Statistics, scores and verdicts cover every document.
Null texts have no words and fail the base rules.  Without labels of both
kinds no threshold can be calibrated and the base rules decide alone.  Repeated
rows get the same verdict and are learned from once; rows that share a doc_id
but not the text are all learned from under its label.  An empty table gives no
rows; texts of any length are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline.llm.words import BYTE_VALUES, SEPARATOR, Words, chunks, mix, per_doc, prefix_hash, rows, span_hash
from ridgeline.plans.scratch import Scratch

TREES, SUBSAMPLE, SEED = 200, 512, 11
#: Share of labelled good rows that calibration may lose.
LOSS = 0.002
WINDOW = 5
#: Rows that meet all trees at a time.
ROWS = 2_000
#: Equal parts of the range of scores, each calibrated in one group.
PARTS = 1 << 16
SYMBOL = np.zeros(256, np.int8)
SYMBOL[list(b"#*$%&|<>")] = 1
UPPER = np.zeros(256, np.int8)
UPPER[65:91] = 1
ASCII_LETTER = np.zeros(256, np.int8)
ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = 1
PUNCTUATION = np.zeros(256, np.int8)
PUNCTUATION[list(b"!?.,;:'\"()-")] = 1
CHAR = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point


def base_statistics(words: Words) -> dict[str, np.ndarray]:
    """The contract's statistics of each text."""
    hashes = words.hashes()
    in_word = ~SEPARATOR[words.buf]
    doc = words.doc_of_word()
    first, windows = words.windows(hashes, WINDOW)
    repeat = np.zeros(len(hashes) + 1, np.int64)
    if len(first):
        keyed = windows ^ mix(doc[first].astype(np.uint64) + np.uint64(1))
        order = np.argsort(keyed)
        same = keyed[order[1:]] == keyed[order[:-1]]
        often = np.zeros(len(first), bool)
        often[order[1:][same]] = True
        often[order[:-1][same]] = True
        np.add.at(repeat, first[often], 1)
        np.add.at(repeat, first[often] + WINDOW, -1)
    covered = np.cumsum(repeat[:-1]) > 0

    # Lines: between line feeds; the byte that ends a text is one as well.
    ends = np.flatnonzero(words.buf == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    with_word = np.searchsorted(words.start, ends) > np.searchsorted(words.start, starts)
    starts, ends = starts[with_word], ends[with_word]
    line_doc = np.searchsorted(words.doc_at, starts, "right") - 1
    lines = mix(span_hash(prefix_hash(BYTE_VALUES[words.buf]), starts, ends) + (ends - starts).astype(np.uint64)) ^ mix(line_doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(lines, kind="stable")
    earlier = np.zeros(len(lines), bool)
    earlier[order[1:][lines[order[1:]] == lines[order[:-1]]]] = True
    line_at = np.searchsorted(starts, words.doc_at)
    return {
        "n_words": words.counts.astype(np.int64),
        "word_chars": per_doc((in_word & CHAR[words.buf]).astype(np.int8), words.doc_at),
        "n_symbols": per_doc(SYMBOL[words.buf], words.doc_at),
        "n_dup_lines": per_doc(earlier.astype(np.int8), line_at),
        "n_repeat_words": per_doc(covered.astype(np.int8), words.word_at),
        "n_lines": np.diff(line_at),
        "n_adjacent": per_doc(np.concatenate(([False], (hashes[1:] == hashes[:-1]) & (doc[1:] == doc[:-1]))).astype(np.int8)[: len(hashes)], words.word_at),
    }


FEATURES = ("symbols", "dup_lines", "repeats", "adjacent", "capitals", "punctuation", "word_length", "odd_words", "bare_words")


def statistics(texts: list[bytes]) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Base statistics, and the matrix of rule statistics (a row per text, columns FEATURES)."""
    words = Words(texts)
    base = base_statistics(words)
    n = np.maximum(base["n_words"], 1)
    chars = np.maximum(base["word_chars"], 1)
    letters = np.maximum(per_doc(ASCII_LETTER[words.buf], words.doc_at), 1)
    last = words.buf[words.end - 1]
    length = words.end - words.start
    # Shares enter as square roots, so that small ones stand out from none.
    matrix = np.column_stack(
        [
            np.sqrt(np.minimum(base["n_symbols"] / n, 1)),
            base["n_dup_lines"] / np.maximum(base["n_lines"], 1),
            np.sqrt(base["n_repeat_words"] / n),
            np.sqrt(base["n_adjacent"] / n),
            np.sqrt(per_doc(UPPER[words.buf], words.doc_at) / letters),
            per_doc(PUNCTUATION[words.buf], words.doc_at) / chars,
            chars / n,
            np.sqrt(per_doc((SYMBOL[last] | (last == 33)).astype(np.int8), words.word_at) / n),
            np.sqrt(per_doc((length == 1).astype(np.int8), words.word_at) / n),
        ]
    )
    return base, matrix


@dataclass(frozen=True)
class Forest:
    """Trees as arrays: a node tests feature < cut, goes to child or child + 1, and has depth plus the rest's expected path as its path."""

    feature: np.ndarray
    cut: np.ndarray
    child: np.ndarray
    path: np.ndarray
    roots: np.ndarray
    depth: int
    norm: float
    threshold: float = np.inf

    def scores(self, matrix: np.ndarray) -> np.ndarray:
        """Anomaly scores in (0, 1]; near 1 is isolated at once."""
        node = np.tile(self.roots, (len(matrix), 1))
        row = np.arange(len(matrix))[:, None]
        for _ in range(self.depth):
            child = self.child[node]
            node = np.where(child < 0, node, child + (matrix[row, self.feature[node]] >= self.cut[node]))
        return 2.0 ** (-self.path[node].mean(axis=1) / self.norm)


def _expected(n: int) -> float:
    """Mean path of an unsuccessful search among n, the usual normalisation."""
    return 0.0 if n < 2 else 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else 1.0


def grow(samples: list[np.ndarray], box: tuple[np.ndarray, np.ndarray], seed: int = SEED) -> Forest:
    """A forest with a tree of random splits for each sample, all of one size.

    Cuts are uniform in the part of the box that a node covers, not in the
    range of the rows there: with the box of good and bad rows together, a tree
    of good rows also cuts off the empty regions where bad ones lie, and these
    are isolated at once.
    """
    low0, high0 = box
    rng = np.random.default_rng(seed)
    size = len(samples[0])
    depth = max(1, int(np.ceil(np.log2(max(size, 2)))))
    feature, cut, child, path, roots = [], [], [], [], []

    def node(level: int, n: int) -> int:
        feature.append(0)
        cut.append(0.0)
        child.append(-1)
        path.append(level + _expected(n))
        return len(feature) - 1

    for held in samples:
        roots.append(node(0, size))
        queue = [(roots[-1], 0, held, low0, high0)]
        while queue:
            at, level, part, low, high = queue.pop()
            varied = np.flatnonzero(high > low)
            if level >= depth or len(part) < 2 or not len(varied):
                continue
            f = int(rng.choice(varied))
            c = rng.uniform(low[f], high[f])
            right = part[:, f] >= c
            a, b = node(level + 1, int((~right).sum())), node(level + 1, int(right.sum()))
            feature[at], cut[at], child[at] = f, c, a
            left_high, right_low = high.copy(), low.copy()
            left_high[f] = right_low[f] = c
            queue += [(a, level + 1, part[~right], low, left_high), (b, level + 1, part[right], right_low, high)]
    return Forest(*map(np.asarray, (feature, cut, child, path, roots)), depth, max(_expected(size), 1e-9))


def calibrate(scored: DataFrame, loss: float = LOSS) -> float:
    """Scores above it are anomalous: of all cuts between the scores of scored (good, score in (0, 1]) that lose at most a given share of good rows, the last one of the best balanced accuracy."""
    own = (F.count_if("good").alias("clean"), F.count_if(~F.col("good")).alias("junk"))
    part = F.floor(F.col("score") * PARTS).cast("int").alias("part")
    # At most PARTS + 1 rows: what lies below each part, and where the next one begins.
    parts = scored.groupBy(part).agg(*own, F.min("score").alias("least")).orderBy("part").toArrow()
    clean, junk = (np.cumsum(parts[n].to_numpy()) for n in ("clean", "junk"))
    below = pa.table({"part": parts["part"], "clean_below": clean - parts["clean"].to_numpy(), "junk_below": junk - parts["junk"].to_numpy(), "next": pa.concat_arrays([*parts["least"].slice(1).chunks, pa.nulls(1, pa.float64())])})
    up = Window.partitionBy("part").orderBy("score")
    placed = scored.groupBy(part, "score").agg(*own).join(F.broadcast(scored.sparkSession.createDataFrame(below)), "part")
    left = {n: F.lit(int(total[-1])) - F.col(f"{n}_below") - F.sum(n).over(up) for n, total in (("clean", clean), ("junk", junk))}
    above = F.coalesce(F.lead("score").over(up), "next", "score")
    cuts = placed.select(((F.col("score") + above) / 2).alias("cut"), (left["clean"] / int(clean[-1])).alias("lost"), (left["junk"] / int(junk[-1])).alias("caught"))
    best = cuts.select(F.when(F.col("lost") <= loss, F.col("caught") - F.col("lost")).otherwise(-1.0).alias("worth"), "cut")
    return float(best.agg(F.max(F.struct("worth", "cut")).alias("best")).first().best.cut)


def held_out(doc_id: Column) -> Column:
    """Labelled rows that neither grow the forest nor set its threshold, so that it can be judged by them."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def subsamples(learned: DataFrame, n: int, trees: int = TREES, subsample: int = SUBSAMPLE) -> list[np.ndarray]:
    """For each tree the features of the subsample rows (all n, if fewer) of learned (key, features) that its own hash puts first, however learned is partitioned."""
    size = min(subsample, n)
    schema = pa.schema([("tree", pa.int32()), ("place", pa.int64()), ("features", pa.list_(pa.float64()))])
    seeds = mix(np.arange(1, trees + 1, dtype=np.uint64) + np.uint64(SEED << 32))
    share = min(1.0, (size + 8 * size**0.5) / n)
    while True:
        # Non-negative hashes up to the limit: a few more rows of each tree than it takes, whatever n is.
        limit = np.uint64(min(int(share * 2**63), 2**63 - 1))

        def work(batches: Iterator[pa.RecordBatch], limit: np.uint64 = limit) -> Iterator[pa.RecordBatch]:
            for part in _slices(batches):
                place = mix(part.column(0).to_numpy().view(np.uint64)[:, None] ^ seeds) >> np.uint64(1)
                row, tree = np.nonzero(place <= limit)
                yield rows(schema, tree, place[row, tree].view(np.int64), part.column(1).take(pa.array(row)))

        drawn = learned.select("key", "features").mapInArrow(work, "tree int, place long, features array<double>").toArrow().combine_chunks()
        tree, place = drawn["tree"].to_numpy(), drawn["place"].to_numpy()
        counts = np.bincount(tree, minlength=trees)
        if share == 1 or counts.min() >= size:
            break
        share = min(1.0, 2 * share)
    matrix = np.array(drawn["features"].to_pylist())
    matrix = matrix[np.lexsort((place, tree))]
    return [matrix[at : at + size] for at in np.cumsum(counts) - counts]


def _with_scores(part: pa.RecordBatch, forest: Forest) -> np.ndarray:
    return forest.scores(_matrix(part.column(part.schema.get_field_index("features"))))


def fit(measured: DataFrame, labels: DataFrame, scratch: Scratch) -> Forest | None:
    """A calibrated forest from all labelled rows that are not held out; None without labels of both kinds."""
    may = labels.where("doc_id is not null and quality is not null").where(~held_out(F.col("doc_id")))
    kinds = may.groupBy("doc_id").agg((F.max("quality") == 1).alias("good"))
    passed = measured.where("not base_failed").select("doc_id", F.xxhash64("doc_id", "features").alias("key"), "features")
    learned = scratch.keep(passed.join(kinds, "doc_id").dropDuplicates(["doc_id", "key"]).select("key", "good", "features"))
    bounds = [f(F.col("features")[i]) for f in (F.min, F.max) for i in range(len(FEATURES))]
    n_good, n_bad, *box = learned.agg(F.count_if("good"), F.count_if(~F.col("good")), *bounds).first()
    if not n_good or not n_bad:
        scratch.drop(learned)
        return None
    low, high = np.array(box).reshape(2, -1)
    forest = grow(subsamples(learned.where("good"), n_good), (low, high))
    shared = measured.sparkSession.sparkContext.broadcast(forest)
    schema = pa.schema([("good", pa.bool_()), ("score", pa.float64())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in _slices(batches):
            yield rows(schema, part.column(0), _with_scores(part, shared.value))

    scored = scratch.keep(learned.select("good", "features").mapInArrow(work, "good boolean, score double"))
    threshold = calibrate(scored)
    scratch.drop(learned)
    scratch.drop(scored)
    return Forest(**{**forest.__dict__, "threshold": threshold})


def base_failed(base: dict[str, np.ndarray]) -> np.ndarray:
    return (base["n_words"] < 10) | (100 * base["n_repeat_words"] > 20 * base["n_words"])


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MEASURED = pa.schema([("doc_id", pa.int64()), *((n, pa.int64()) for n in _BASE), ("base_failed", pa.bool_()), ("features", pa.list_(pa.float64()))])
_BASE_DDL = f"doc_id long, {', '.join(f'{n} long' for n in _BASE)}, base_failed boolean"
_OUT = pa.schema([*list(_MEASURED)[:-1], ("anomaly", pa.float64()), ("kept", pa.bool_())])


def measure(documents: DataFrame) -> DataFrame:
    """Per document: the base statistics, base_failed and the rule statistics."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            base, matrix = statistics(texts)
            yield rows(_MEASURED, part.column(0), *(base[n] for n in _BASE), base_failed(base), pa.ListArray.from_arrays(pa.array(np.arange(0, matrix.size + 1, len(FEATURES)), pa.int32()), pa.array(matrix.ravel())))

    return documents.select("doc_id", "text").mapInArrow(work, f"{_BASE_DDL}, features array<double>")


def judge(measured: DataFrame, forest: Forest | None) -> DataFrame:
    """Per document: the base statistics, base_failed, the anomaly score (null without a forest) and kept."""
    shared = measured.sparkSession.sparkContext.broadcast(forest)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for part in _slices(batches):
            failed = part.column(len(_BASE) + 1).to_numpy(zero_copy_only=False)
            if forest is None:
                score = pa.nulls(part.num_rows, pa.float64())
                kept = ~failed
            else:
                score = _with_scores(part, forest)
                kept = ~failed & (score <= forest.threshold)
            yield rows(_OUT, *part.columns[:-1], score, kept)

    return measured.mapInArrow(work, f"{_BASE_DDL}, anomaly double, kept boolean")


def quality_rules(documents: DataFrame, labels: DataFrame) -> DataFrame:
    scratch = Scratch(documents.sparkSession, "rules")
    measured = scratch.keep(measure(documents))
    return judge(measured, fit(measured, labels, scratch))
