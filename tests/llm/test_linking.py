import random

import numpy as np
from fieldglass.llm import linking
from fieldglass.llm.linking import jaccard, link, overlap_of, pack_grams, shared_buckets, unpack_grams, verified


def gram_sets(families, seed):
    """Packed gram sets: each family is a list of shares of its 100 own grams that a member keeps at random."""
    draw = random.Random(seed)
    out = []
    for shares in families:
        own = [draw.getrandbits(64) for _ in range(100)]
        for share in shares:
            kept = draw.sample(own, round(100 * share))
            out.append(pack_grams(np.array(kept, dtype=np.uint64)))
    draw.shuffle(out)
    return out


def brute(sets, buckets):
    """Smallest item of each group under links among all pairs that share a bucket."""
    group = list(range(len(sets)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    grams = [unpack_grams(x) for x in sets]
    for a in range(len(sets)):
        for b in range(a + 1, len(sets)):
            if buckets[a] & buckets[b] and jaccard(grams[a], grams[b]) >= 0.8:
                lo, hi = sorted((top(a), top(b)))
                group[hi] = lo
    return {i: top(i) for i in range(len(sets))}


def found(spark, sets, buckets):
    rows = [(i, sorted(buckets[i]), bytearray(x)) for i, x in enumerate(sets)]
    items = spark.createDataFrame(rows, "item long, bands array<long>, grams binary")
    groups = link(shared_buckets(items.select("item", "bands")), items.select("item", "grams"), overlap_of(0.8))
    return {i: i for i in range(len(sets))} | {r["item"]: r["group"] for r in groups.collect()}


def test_families_and_lone_pairs_in_one_bucket(spark):
    """Families of several sizes, pairs, chains of weak links and single items, all in one large bucket."""
    families = [[0.97] * 40, [0.97] * 12, [0.97] * 11, [0.9] * 9] + [[0.97] * 2] * 15 + [[1.0]] * 20
    sets = gram_sets(families, 1)
    buckets = [{7} for _ in sets]
    want = brute(sets, buckets)
    assert len(set(want.values())) < len(sets)
    assert found(spark, sets, buckets) == want


def test_last_pair_of_a_bucket_without_other_links(spark):
    """One pair among 120 unlike items, in a table where no other bucket finds a link."""
    sets = gram_sets([[1.0]] * 118 + [[0.95] * 2], 2)
    buckets = [{7} for _ in sets]
    want = brute(sets, buckets)
    assert len(set(want.values())) == len(sets) - 1
    assert found(spark, sets, buckets) == want


def test_copies_with_many_buckets_are_compared_with_few_centres(spark, monkeypatch):
    """A family of copies that meet in many small buckets, beside pairs that meet in one; no link is lost."""
    sets = gram_sets([[0.97] * 60] + [[0.97] * 2] * 5 + [[1.0]] * 5, 3)
    draw = random.Random(3)
    buckets = [{draw.randrange(40) for _ in range(12)} | {99} for _ in sets]
    compared = []

    def counted(pairs, *rest):
        compared.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(linking, "verified", counted)
    rows = [(i, sorted(buckets[i]), bytearray(x)) for i, x in enumerate(sets)]
    items = spark.createDataFrame(rows, "item long, bands array<long>, grams binary")
    groups = link(shared_buckets(items.select("item", "bands")), items.select("item", "grams"), overlap_of(0.8), nearest_first=True)
    got = {i: i for i in range(len(sets))} | {r["item"]: r["group"] for r in groups.collect()}
    assert got == brute(sets, buckets)
    # One comparison an item at first, not one for each centre that it meets.
    assert compared[0] <= len(sets)
