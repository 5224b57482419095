"""Mixing sources to target weights by entropy balancing.

Every document gets a rate r (mean number of copies).  Among all rates that
meet each source's token constraint ``sum(size * r) = target`` and stay below
the limit on copies, those closest in relative entropy to one copy each are
exponential tilts of the size, ``r = min(limit, exp(lam * x))`` with
``x = size / scale`` of the source.  The multiplier of each source minimises a
convex dual; guarded Newton steps solve all sources at once, each step being
one aggregation over the table of (source, size, documents).

Rates become whole copies: the fraction is decided by a hash of the document,
and a small correction then moves each source onto its target by changing the
copies of a few of its documents, found greedily by size.

All is DataFrame expressions.  Aggregates are pre-aggregated, so a source that
holds a third of all rows costs no single task more than another; what is
broadcast, if anything, is left to Spark's own size checks.  The sources
themselves may be many (hosts, say): they are ranked by a range-partitioned
sort and share their targets by aggregation, without a window over all of them.

Documents whose text is null or has no word have size zero, rate one and take
nothing; so does a source of such documents only.  Rounding goes by a hash of
doc_id, source and text, so rows without a doc_id round each for itself; rows
alike in all three are decided alike, and the correction counts them together.
A doc_id may occur in several sources.  A text of any length counts whole.  An
empty table gives no rows.  ``mixed_documents`` keeps all columns, whatever
their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ridgeline.plans.scratch import Scratch

# The contract's weights in order, and the most copies of one document.
WEIGHTS = (5, 2, 1)
LIMIT = 3
#: Relative error of the token constraints at which the dual counts as solved.
TOLERANCE = 1e-6
#: Guarded steps at most; brackets halve, so far fewer are needed, and more are an error.
STEPS = 200
#: Documents a source and octave of sizes that the correction may choose from.
CANDIDATES = 8


def word_count(text: Column) -> Column:
    """Number of maximal runs without space and 0x09-0x0D; null has none."""
    flat = F.translate(text, "\t\n\x0b\x0c\r", "     ")
    # A word begins at each non-space that follows a space or the beginning.
    return F.coalesce(F.size(F.filter(F.split(flat, " "), lambda w: w != "")), F.lit(0)).cast("long")


def _ranked(sources: DataFrame, scratch: Scratch) -> DataFrame:
    """sources plus rank, from 0 in the order of source, nulls last."""
    place = F.monotonically_increasing_id()  # the partition of the sorted table, and the place in it
    at = scratch.keep(sources.orderBy(F.col("source").asc_nulls_last()).select("*", place.alias("at")))
    # One row for each partition of the sort.
    sizes = at.groupBy(F.shiftright("at", 33).alias("part")).count().orderBy("part").collect()
    before, total = [], 0
    for r in sizes:
        before += [F.lit(r["part"]), F.lit(total)]
        total += r["count"]
    if not before:
        return at.select(*sources.columns, F.lit(0).cast("long").alias("rank"))
    offset = F.create_map(*before)[F.shiftright("at", 33)]
    return at.select(*sources.columns, (F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + offset).alias("rank"))


def targets(sources: DataFrame, scratch: Scratch, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """sources: (source, source_size).  Adds weight and target.

    The whole size is shared by weight.  A source stops at limit times its own
    size and its excess goes to the others by weight: with ``level`` the share
    of a unit of weight, a source gets the lesser of ``weight * level`` and its
    stop.  Every round takes the sources that stop at the level found so far
    out and shares what is left; stopped sources stay stopped, so rounds end.
    """
    choose = F.array(*map(F.lit, weights))
    sized = scratch.keep(
        _ranked(sources, scratch).select("source", "source_size", F.element_at(choose, (F.col("rank") % len(weights) + 1).cast("int")).cast("double").alias("weight"), (F.lit(float(limit)) * F.col("source_size")).alias("stop"))
    )
    total = float(sized.agg(F.sum("source_size")).first()[0] or 0)
    level, stopped = 0.0, -1
    while True:
        over = F.col("weight") * F.lit(level) > F.col("stop")
        weight, gone, n = sized.agg(F.sum(F.when(~over, F.col("weight"))), F.sum(F.when(over, F.col("stop"))), F.count_if(over)).first()
        if n == stopped or not weight:
            break
        level, stopped = (total - (gone or 0.0)) / weight, n
    return sized.select("source", "source_size", "weight", F.least(F.col("stop"), F.col("weight") * F.lit(level)).alias("target"))


def _rate(lam: Column, x: Column, limit: int) -> Column:
    return F.least(F.lit(float(limit)), F.exp(F.least(lam * x, F.lit(50.0))))


def solve(sizes: DataFrame, wanted: DataFrame, scratch: Scratch, limit: int = LIMIT) -> DataFrame:
    """wanted plus scale and lam, the multiplier of each source.

    sizes: (source, size, n) with size > 0.  Each source keeps a bracket around
    its multiplier; a Newton step that leaves it is replaced by a bisection.
    """
    scale = sizes.groupBy("source").agg((F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")) / F.sum(F.col("size") * F.col("n"))).alias("scale"), F.min("size").alias("least"))
    start = wanted.alias("w").join(scale.alias("s"), F.col("w.source").eqNullSafe(F.col("s.source")), "left").select("w.*", "s.scale", "s.least")
    # At lam = log(limit) / least x every rate is at the limit; below zero the total falls to nothing.
    up = F.col("target") > F.col("source_size")
    state = scratch.keep(
        start.select(
            "source", "source_size", "weight", "target", "scale",
            F.when(F.col("scale").isNull() | (F.col("target") <= 0), F.lit(True)).otherwise(F.abs(F.col("target") - F.col("source_size")) <= TOLERANCE * F.col("target")).alias("done"),
            F.lit(0.0).alias("lam"),
            F.when(up, 0.0).otherwise(-1e6).alias("low"),
            F.when(up, F.log(F.lit(float(limit))) * F.col("scale") / F.col("least")).otherwise(0.0).alias("high"),
        )
    )
    for _ in range(STEPS):
        x = F.col("size") / F.col("scale")
        rate = _rate(F.col("lam"), x, limit)
        mass = F.col("size") * F.col("n") * rate
        totals = sizes.alias("h").join(state.where("not done").alias("s"), F.col("h.source").eqNullSafe(F.col("s.source"))).groupBy("s.source").agg(F.sum(mass).alias("total"), F.sum(F.when(rate < limit, mass * x).otherwise(0.0)).alias("slope"))
        both = state.alias("s").join(totals.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source")), "left").select("s.*", "t.total", "t.slope")
        over = F.col("total") > F.col("target")
        low = F.when(over, F.col("low")).otherwise(F.col("lam"))
        high = F.when(over, F.col("lam")).otherwise(F.col("high"))
        newton = F.col("lam") - F.try_divide(F.col("total") - F.col("target"), F.col("slope"))
        met = F.abs(F.col("total") - F.col("target")) <= TOLERANCE * F.col("target")
        stepped = both.withColumn("new_low", F.coalesce(low, F.col("low"))).withColumn("new_high", F.coalesce(high, F.col("high"))).withColumn("newton", newton)
        inside = (F.col("newton") > F.col("new_low")) & (F.col("newton") < F.col("new_high"))
        halved = F.when(F.col("new_low") < -1e5, F.least(F.col("lam") * 2, F.lit(-1.0))).otherwise((F.col("new_low") + F.col("new_high")) / 2)
        settled = F.col("done") | F.col("total").isNull() | met | (F.col("new_high") - F.col("new_low") <= 1e-12 * F.abs(F.col("new_high")))
        new = scratch.keep(stepped.select("source", "source_size", "weight", "target", "scale", settled.alias("done"), F.when(settled, F.col("lam")).when(inside, F.col("newton")).otherwise(halved).alias("lam"), F.col("new_low").alias("low"), F.col("new_high").alias("high")))
        scratch.drop(state)
        state = new
        if not state.where("not done").limit(1).count():
            return state.select("source", "source_size", "target", "scale", "lam")
    raise RuntimeError(f"multipliers did not settle in {STEPS} steps")


def _corrections(copies: DataFrame, solved: DataFrame, scratch: Scratch, limit: int) -> DataFrame:
    """(hash, step): documents that take one copy more or less so that sources meet their targets.

    A source picks greedily, from the largest size down, among a bounded number
    of documents in each octave of sizes; rows with one hash count together.
    Rounding errors grow with the square root of a source's documents, so what
    the bound leaves is an ever smaller share of the target.
    """
    rows = copies.where("size > 0").groupBy("source", "hash").agg(F.count("*").alias("n"), F.first("size").alias("size"), F.first("copies").alias("copies"))
    taken = copies.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"))
    gap = scratch.keep(solved.alias("s").join(taken.alias("t"), F.col("s.source").eqNullSafe(F.col("t.source"))).select("s.source", (F.col("s.target") - F.col("t.taken")).alias("gap")))
    known = rows.alias("c").join(gap.alias("g"), F.col("c.source").eqNullSafe(F.col("g.source"))).select("c.*", "g.gap")
    able = known.where(((F.col("gap") > 0) & (F.col("copies") < limit)) | ((F.col("gap") < 0) & (F.col("copies") > 0))).withColumn("mass", F.col("size") * F.col("n"))
    octave = F.floor(F.log2(F.col("mass").cast("double")))
    some = able.groupBy("source", "gap", octave.alias("octave"), F.pmod(F.col("hash"), F.lit(CANDIDATES)).alias("slot")).agg(F.min(F.struct("hash", "mass")).alias("c"))
    lists = some.groupBy("source", "gap").agg(F.array_sort(F.collect_list(F.struct((-F.col("c.mass")).alias("order"), F.col("c.hash").alias("hash"), F.col("c.mass").alias("size")))).alias("all"))
    begin = F.struct(F.abs("gap").alias("left"), F.array().cast("array<bigint>").alias("chosen"))

    def exact(acc: Column, c: Column) -> Column:
        return F.when(c["size"] <= acc["left"], F.struct((acc["left"] - c["size"]).alias("left"), F.concat(acc["chosen"], F.array(c["hash"])).alias("chosen"))).otherwise(acc)

    return scratch.keep(lists.select(F.signum("gap").cast("int").alias("step"), F.explode(F.aggregate("all", begin, exact, lambda acc: acc["chosen"])).alias("hash")))


def _hash() -> Column:
    """A row's own number: rows alike in doc_id, source and text share it."""
    return F.xxhash64("doc_id", "source", "text", F.lit("mix"))


def _copies(size: Column, hashed: Column, limit: int) -> Column:
    """Whole copies from the rate of a row that has target, lam and scale; a uniform number in [0, 1) from the hash decides the fraction."""
    chance = F.shiftrightunsigned(hashed, 11).cast("double") / float(1 << 53)
    rate = F.when(size == 0, 1.0).when(F.col("target") <= 0, 0.0).otherwise(_rate(F.col("lam"), size / F.col("scale"), limit))
    return F.least(F.floor(rate + chance), F.lit(limit)).cast("long")


def _corrected(copies: Column, step: Column, limit: int) -> Column:
    return F.least(F.greatest(copies + F.coalesce(step, F.lit(0)), F.lit(0)), F.lit(limit))


def _decide(documents: DataFrame, weights: tuple[int, ...], limit: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The documents with their copies before correction, each source's solution, and the corrections."""
    scratch = Scratch(documents.sparkSession, "mixing")
    docs = scratch.keep(documents.select("doc_id", "source", word_count(F.col("text")).alias("size"), _hash().alias("hash")))
    sources = docs.groupBy("source").agg(F.sum("size").alias("source_size"))
    wanted = scratch.keep(targets(sources, scratch, weights, limit))
    sizes = scratch.keep(docs.where("size > 0").groupBy("source", "size").agg(F.count("*").alias("n")))
    solved = solve(sizes, wanted, scratch, limit)
    rated = docs.alias("d").join(solved.alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.source_size", "s.target", "s.lam", "s.scale")
    copied = scratch.keep(rated.select("doc_id", "source", "size", "hash", "source_size", "target", _copies(F.col("size"), F.col("hash"), limit).alias("copies")))
    return copied, solved, _corrections(copied, solved, scratch, limit)


def mix(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for each row of documents."""
    copied, _, moved = _decide(documents, weights, limit)
    final = copied.join(moved, "hash", "left").withColumn("copies", _corrected(F.col("copies"), F.col("step"), limit).cast("long"))
    return final.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).cast("long").alias("taken"))


def mixed_documents(documents: DataFrame, weights: tuple[int, ...] = WEIGHTS, limit: int = LIMIT) -> DataFrame:
    """documents with each row as often as the mix takes it; those taken zero times go.

    A row's copies follow from its own size and hash, its source's solution
    and the corrections, so texts meet only those two small tables.
    """
    _, solved, moved = _decide(documents, weights, limit)
    whole = documents.select(F.struct(*(F.col(f"`{c}`") for c in documents.columns)).alias("row"), "source", word_count(F.col("text")).alias("size"), _hash().alias("hash"))
    rated = whole.alias("d").join(solved.select("source", "target", "lam", "scale").alias("s"), F.col("d.source").eqNullSafe(F.col("s.source"))).select("d.*", "s.target", "s.lam", "s.scale").join(moved, "hash", "left")
    copies = _corrected(_copies(F.col("size"), F.col("hash"), limit), F.col("step"), limit).cast("int")
    return rated.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
