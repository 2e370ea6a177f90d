"""Links between similar items that share a bucket, and their groups.

Items are 64-bit content hashes; equal contents are one item. A bucket never
gives all its pairs:

1. every item of a bucket is compared with the bucket's centre, the item that meets
   the most others over all buckets;
2. verified links form groups; where a bucket still holds several groups, the items
   outside its largest group are compared with a few heavy items of that group, and
   the groups are formed anew;
3. in each bucket that still holds several groups, every pair across groups is
   compared: in a bucket of at most ``ALL_PAIRS`` items pair by pair, in a larger one
   a block of items against a block (``across``).

So each pair of items that share a bucket is compared, or lies in one group already.

All steps are keyed by bucket and block or by item, so a large bucket is spread over
many tasks. Work grows with the items of a bucket times those outside its largest group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldglass.llm.shared import stage

#: Largest bucket whose remaining pairs are compared one by one.
ALL_PAIRS = 16
#: Heavy items of the largest group that are tried before the pairs of blocks.
CENTRES = 8
#: Items outside the largest group of a bucket, and items of the bucket, that one block comparison holds.
OUTSIDE_BLOCK, BUCKET_BLOCK = 32, 128


def pack_grams(hashes: np.ndarray) -> bytes:
    """Distinct 40-bit hashes, sorted, in five bytes each."""
    kept = np.unique(hashes >> np.uint64(24))
    return (kept & np.uint64(0xFFFFFFFF)).astype("<u4").tobytes() + (kept >> np.uint64(32)).astype("u1").tobytes()


def unpack_grams(data: bytes) -> np.ndarray:
    n = len(data) // 5
    return np.frombuffer(data, "<u4", n).astype(np.uint64) | (
        np.frombuffer(data, "u1", n, 4 * n).astype(np.uint64) << np.uint64(32)
    )


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Shared share of two sorted arrays of distinct values."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    common = int((both[1:] == both[:-1]).sum())
    return common / max(1, len(both) - common)


def shared_buckets(items: DataFrame) -> DataFrame:
    """``band, item, n, weight, centre`` of buckets with two or more items; takes ``item, bands``.

    ``weight`` is how many items an item meets over all its buckets. What lies
    nearest to the middle of a family of copies meets most of them, so the heaviest
    item of a bucket is its ``centre``.
    """
    members = items.select("item", F.explode("bands").alias("band"))
    counts = members.groupBy("band").agg(F.count("*").alias("n")).where("n > 1")
    met = stage(members.join(counts, "band"), "buckets")
    weighed = met.join(met.groupBy("item").agg(F.sum("n").alias("weight")), "item")
    centres = weighed.groupBy("band").agg(F.max(F.struct("weight", "item"))["item"].alias("centre"))
    return stage(weighed.join(centres, "band").select("band", "item", "n", "weight", "centre"), "buckets")


def overlap_of(least: float) -> Callable[[bytes, bytes], bool]:
    """Whether two packed gram sets have a Jaccard similarity of at least ``least``."""

    def alike(x: bytes, y: bytes) -> bool:
        return min(len(x), len(y)) >= least * max(len(x), len(y)) and jaccard(unpack_grams(x), unpack_grams(y)) >= least

    return alike


def verified(pairs: DataFrame, grams: DataFrame, alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs ``a, b`` whose grams are alike."""
    first = grams.select(F.col("item").alias("a"), F.col("grams").alias("_ga"))
    second = grams.select(F.col("item").alias("b"), F.col("grams").alias("_gb"))

    def compare(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good = [alike(x, y) for x, y in zip(batch["_ga"], batch["_gb"], strict=True)]
            yield batch.loc[np.array(good, dtype=bool), ["a", "b"]]

    return pairs.join(second, "b").join(first, "a").mapInPandas(compare, "a long, b long")


def _pair(x, y):
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def connected(edges: DataFrame) -> DataFrame:
    """``item, group`` for every end of an edge ``a, b``; the group is its smallest item.

    Takes the smallest neighbouring label, then the label's own label, until
    nothing changes; each round starts from written tables.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stage(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("item"), F.least("a", "m").alias("group")),
        "labels",
    )
    while True:
        near = (
            both.join(labels.withColumnRenamed("item", "b"), "b").groupBy("a").agg(F.min("group").alias("m"))
        ).withColumnRenamed("a", "item")
        lower = labels.join(near, "item").select("item", F.col("group").alias("old"), F.least("group", "m").alias("next"))
        jump = labels.select(F.col("item").alias("next"), F.col("group").alias("jumped"))
        new = stage(lower.join(jump, "next").select("item", "old", F.col("jumped").alias("group")), "labels")
        labels = new.select("item", "group")
        if new.where("group <> old").isEmpty():
            return labels


def across(rows: DataFrame, grams: DataFrame, alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """Links ``a, b`` that join all groups with a link between them in a bucket; takes ``band, item, group``.

    Items outside a bucket's largest group are held against the whole bucket, block
    by block. A pair is compared in the first bucket that it shares, and only while
    the links of its block leave it in two groups.
    """

    def compare(part: pd.DataFrame) -> pd.DataFrame:
        root: dict[int, int] = {}

        def top(group: int) -> int:
            while group in root:
                group = root[group]
            return group

        part = part.assign(bands=[frozenset(x) for x in part["bands"]])
        columns = ["item", "group", "bands", "grams"]
        bucket = list(part.loc[~part["outside"], columns].itertuples(index=False, name=None))
        band, main, found = part["band"].iloc[0], part["main"].iloc[0], []
        for a, group_a, bands_a, grams_a in part.loc[part["outside"], columns].itertuples(index=False, name=None):
            for b, group_b, bands_b, grams_b in bucket:
                # Two items outside the largest group meet twice.
                if group_a == group_b or (group_b != main and a > b) or min(bands_a & bands_b) != band:
                    continue
                x, y = top(group_a), top(group_b)
                if x != y and alike(grams_a, grams_b):
                    root[x] = y
                    found.append((min(a, b), max(a, b)))
        return pd.DataFrame(found, columns=["a", "b"], dtype="int64")

    held = rows.groupBy("band", "group").agg(F.count("*").alias("held"))
    main = (
        held.groupBy("band")
        .agg(F.max(F.struct("held", "group")).alias("m"), F.sum("held").alias("all"))
        .where("all > m.held")
        .select(
            "band",
            F.col("m.group").alias("main"),
            F.ceil((F.col("all") - F.col("m.held")) / OUTSIDE_BLOCK).alias("outer"),
            F.ceil(F.col("all") / BUCKET_BLOCK).alias("inner"),
        )
    )
    own = rows.groupBy("item").agg(F.collect_set("band").alias("bands"))
    full = rows.select("band", "item", "group").join(main, "band").join(own, "item").join(grams, "item")
    columns = ["band", "main", "item", "group", "bands", "grams"]

    def blocks(count: str):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.col(count) - 1))

    outside = full.where("group <> main").select(
        *columns, F.lit(True).alias("outside"), F.pmod(F.xxhash64("item"), "outer").alias("i"), blocks("inner").alias("j")
    )
    bucket = full.select(
        *columns, F.lit(False).alias("outside"), blocks("outer").alias("i"), F.pmod(F.xxhash64("item", F.lit(1)), "inner").alias("j")
    )
    return outside.unionByName(bucket).groupBy("band", "i", "j").applyInPandas(compare, "a long, b long")


def _several(shared: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of the buckets that hold several groups, with the group of each item."""
    placed = shared.join(groups, "item", "left").withColumn("group", F.coalesce("group", "item"))
    several = placed.groupBy("band").agg(F.min("group").alias("lo"), F.max("group").alias("hi")).where("lo <> hi")
    return stage(placed.join(several.select("band"), "band"), "open-buckets")


def _nearest_first(shared: DataFrame, grams: DataFrame, alike: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The links of items with the centres of their buckets, each item first with the centre that it meets most often.

    Other centres are compared only where they are left in another group than the item.
    """
    met = shared.where("item <> centre").groupBy("item", "centre").agg(F.count("*").alias("n"))
    nearest = met.groupBy("item").agg(F.max(F.struct("n", "centre"))["centre"].alias("centre"))
    edges = stage(verified(nearest.select(*_pair(F.col("item"), F.col("centre"))).distinct(), grams, alike), "links")
    groups = connected(edges)
    theirs = groups.select(F.col("item").alias("centre"), F.col("group").alias("_theirs"))
    rest = (
        met.join(groups, "item", "left")
        .join(theirs, "centre", "left")
        .where(F.coalesce("group", "item") != F.coalesce("_theirs", "centre"))
    )
    return edges.unionByName(stage(verified(rest.select(*_pair(F.col("item"), F.col("centre"))).distinct(), grams, alike), "links"))


def link(shared: DataFrame, grams: DataFrame, alike: Callable[[bytes, bytes], bool], nearest_first: bool = False) -> DataFrame:
    """``item, group`` of all items that a chain of links joins to another.

    ``nearest_first`` is for items of many buckets, whose centres would be compared with
    most of them again and again.
    """
    if nearest_first:
        edges = _nearest_first(shared, grams, alike)
    else:
        tested = shared.where("item <> centre").select(*_pair(F.col("item"), F.col("centre"))).distinct()
        edges = stage(verified(tested, grams, alike), "links")
    groups = connected(edges)
    shared = _several(shared.drop("centre"), groups)
    large = shared.where(F.col("n") > ALL_PAIRS)
    # The heaviest items of the largest group, one from each of a few fixed parts of it.
    part = F.pmod(F.xxhash64("item"), F.lit(CENTRES)).alias("part")
    hubs = (
        large.groupBy("band", "group", part)
        .agg(F.max(F.struct("weight", "item")).alias("heavy"), F.count("*").alias("held"))
        .groupBy("band", "group")
        .agg(F.collect_list("heavy.item").alias("hubs"), F.sum("held").alias("held"))
    )
    main = (
        hubs.groupBy("band")
        .agg(F.max(F.struct("held", "group", "hubs")).alias("m"))
        .select("band", F.col("m.group").alias("main"), "m.hubs")
    )
    starred = (
        large.join(main, "band")
        .where("group <> main")
        .select("item", F.explode("hubs").alias("hub"))
        .select(*_pair(F.col("item"), F.col("hub")))
    )
    found = stage(verified(starred.distinct(), grams, alike), "links")
    if not found.isEmpty():
        edges = edges.unionByName(found)
        groups = connected(edges)
        shared = _several(shared.drop("group"), groups)
    small = shared.where(F.col("n") <= ALL_PAIRS)
    other = small.select("band", F.col("item").alias("item2"), F.col("group").alias("group2"))
    pairs = small.join(other, "band").where("group <> group2 and item < item2").select(*_pair(F.col("item"), F.col("item2")))
    rest = stage(
        verified(pairs.distinct(), grams, alike).unionByName(
            across(shared.where(F.col("n") > ALL_PAIRS), grams, alike)
        ),
        "links",
    )
    return groups if rest.isEmpty() else connected(edges.unionByName(rest))
