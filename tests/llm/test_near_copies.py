"""Near-dedup's candidates from SimHash: a link that fails the exact check takes no other with it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline.llm import near_copies, simhash_dedup
from ridgeline.plans.scratch import Scratch
from tests.llm.test_operators import brute_near_groups


@pytest.mark.parametrize("hot", [4, simhash_dedup.HOT])
def test_split_groups_are_all_named(spark, hot):
    """87 fingerprints under one key, in three components: every pair within two bits that lies in two is named, hot key or not."""
    rng = np.random.default_rng(3)
    base = int(rng.integers(0, 1 << 62))
    prints = {base} | {base ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 30, (120, 2))}
    prints = sorted(prints)[:87]
    part = {p: int(rng.integers(0, 3)) for p in prints}
    table = spark.createDataFrame([(p, part[p], part[p]) for p in prints] + [(-5, 7, 9), (-4096, 1, 1)], "fp long, low long, high long")
    found = {r.fp for r in simhash_dedup.unsettled(table, Scratch(spark, "t"), hot).collect()}
    close = [(a, b) for a in prints for b in prints if a < b and (a ^ b).bit_count() <= simhash_dedup.DISTANCE]
    split = {x for a, b in close if part[a] != part[b] for x in (a, b)}
    assert len(close) > 300 and split <= found and -5 in found and -4096 not in found


def test_groups_with_a_centre_unlike_the_rest(spark, monkeypatch):
    """All sets get one fingerprint, so the head stands for all; near copies that are unlike the head are still found, without min-hash keys."""
    rng = np.random.default_rng(8)
    made = []
    for _ in range(12):
        words = [f"w{x}" for x in rng.integers(0, 500, 90)]
        made.append(" ".join(words))
        for _ in range(int(rng.integers(0, 4))):
            copy = list(words)
            copy[int(rng.integers(0, 90))] = "changed"
            made.append(" ".join(copy))
    rows = list(enumerate(made))
    documents = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    real = near_copies.with_sets
    monkeypatch.setattr(near_copies, "with_sets", lambda d: real(d).withColumn("fp", F.lit(7).cast("long")))
    kept = sorted(r.doc_id for r in near_copies.keep_one(documents, bands=0).collect())
    groups = brute_near_groups(rows)
    assert kept == sorted(min(r[0] for r in g) for g in groups.values()) and len(kept) < len(rows)
