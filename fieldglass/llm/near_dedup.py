"""Near-duplicate documents by BagMinHash.

A document is its multiset of five-word shingles. The weight axis of a shingle is
cut into levels (0, 1], (1, 2], (2, 4], (4, 8] and so on; each level carries a
Poisson process whose points have a time, a register and a place inside the
level. A point counts for a document if its place does not pass the shingle's
weight there, and every register keeps its earliest point. Registers of two
documents then agree with a probability equal to their weighted Jaccard
similarity. Points are drawn in order of time and only until they are later than
every register, so a long text costs little more than one point per shingle.

Registers are banded; documents that share a band are verified on the exact
multiset overlap and linked (``linking``). Groups are chains of links at a
similarity of 0.8 or more.

Equal texts are one item, whatever their ids. Null and empty texts, and texts
without words, are grouped by equality only (null and empty are equal). Null ids
and repeated rows stay as rows. Texts are read whole. An empty table gives no
rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm import words
from fieldglass.llm.linking import link, overlap_of, pack_grams, shared_buckets
from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage, whole_text
from fieldglass.llm.words import U64, mix

SIMILARITY = 0.8
#: 24 bands of 6 registers miss a pair at the threshold once in about 1,500 times.
BANDS, ROWS = 24, 6
REGISTERS = BANDS * ROWS
#: A column that the choice of kept rows adds while it works.
MARK = "__near_mark"
#: Points drawn at once per process, round by round.
DRAWS = (1, 1, 2, 4, 8, 16, 32)


def bags(data: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles of each text: their hashes, their text numbers and how often each occurs."""
    hashes, counts = words.shingle_hashes(data)
    owner = np.repeat(np.arange(len(data)), counts)
    order = np.lexsort((hashes, owner))
    h, o = hashes[order], owner[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    at = np.flatnonzero(new)
    return h[at], o[at], np.diff(np.append(at, len(h)))


def registers(hashes: np.ndarray, owner: np.ndarray, weights: np.ndarray, n: int, size: int = REGISTERS) -> np.ndarray:
    """The earliest counted point of each register, one row per text."""
    out = np.full(n * size, np.inf)
    # One process per shingle and level that its weight reaches.
    deepest = np.ceil(np.log2(np.maximum(weights, 1))).astype(int)
    h, o, w, level = hashes, owner, weights, np.zeros(len(hashes), dtype=int)
    more = np.repeat(np.arange(len(hashes)), deepest)
    if len(more):
        step = np.arange(len(more)) - np.repeat(np.cumsum(deepest) - deepest, deepest) + 1
        h, o = np.concatenate([h, hashes[more]]), np.concatenate([o, owner[more]])
        w, level = np.concatenate([w, weights[more]]), np.concatenate([level, step])
    below = np.where(level == 0, 0, 2.0 ** (level - 1))
    span = np.maximum(below, 1.0)
    seed = mix(h + level.astype(U64) * U64(0x9E3779B97F4A7C15))
    time = np.zeros(len(h))
    drawn, turn = 0, 0
    while len(h):
        k = DRAWS[min(turn, len(DRAWS) - 1)]
        serial = np.arange(drawn + 1, drawn + k + 1, dtype=U64) * U64(0xD1342543DE82EF95)
        a = mix(seed[:, None] + serial[None, :])
        b = mix(a + U64(0x2545F4914F6CDD1D))
        gaps = -np.log(((a >> U64(11)).astype(float) + 0.5) * 2.0**-53) / (span * size)[:, None]
        times = time[:, None] + np.cumsum(gaps, axis=1)
        place = below[:, None] + (b >> U64(40)).astype(float) * 2.0**-24 * span[:, None]
        # Weights are whole numbers: a point inside a cell counts if the weight reaches the cell's end.
        counted = np.floor(place) < w[:, None]
        target = o[:, None] * size + (b & U64(0xFFFFFFFF)).astype(np.int64) % size
        np.minimum.at(out, target[counted], times[counted])
        time = times[:, -1]
        latest = out.reshape(n, size).max(axis=1)
        on = time < latest[o]
        h, o, w, below, span, seed, time = h[on], o[on], w[on], below[on], span[on], seed[on], time[on]
        drawn, turn = drawn + k, turn + 1
    return out.reshape(n, size)


def band_keys(found: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """One 64-bit key per text and band."""
    bits = np.ascontiguousarray(found).view(U64).reshape(len(found), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=U64), (len(found), bands)).copy()
    for i in range(rows):
        key = mix(key * U64(0x9E3779B97F4A7C15) + bits[:, :, i])
    return key.view(np.int64)


def _signed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        bands: list = []
        for _, data in words.chunks(words.lowered(batch["text"])):
            h, o, w = bags(data)
            keys = band_keys(registers(h, o, w, len(data)))
            has = np.bincount(o, minlength=len(data)) > 0
            bands.extend(k if some else [] for k, some in zip(keys, has, strict=True))
        yield pd.DataFrame({"item": batch["item"], "bands": bands})


def _grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        grams: list[bytes] = []
        for _, data in words.chunks(words.lowered(batch["text"])):
            h, o, w = bags(data)
            # The n-th occurrence of a shingle is an element of its own, so set overlap is multiset overlap.
            nth = np.arange(int(w.sum())) - np.repeat(np.cumsum(w) - w, w)
            every = words.mix(np.repeat(h, w) + nth.astype(words.U64) * words.U64(0xA0761D6478BD642F))
            ends = np.cumsum(np.bincount(o, weights=w, minlength=len(data)).astype(int))
            grams.extend(pack_grams(part) for part in np.split(every, ends[:-1]))
        yield pd.DataFrame({"item": batch["item"], "grams": grams})


def near_groups(docs: DataFrame, least: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """Items of all documents and their groups.

    Gives ``doc_id, item`` per row and ``item, group`` of the linked items.
    """
    given = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"), F.xxhash64(whole_text()).alias("item")
    )
    # Equal texts meet before any text is read in Python.
    texts = given.select("item", "text").dropDuplicates(["item"])
    signed = stage(texts.mapInPandas(_signed, "item long, bands array<long>"), "signatures")
    shared = shared_buckets(signed)
    wanted = shared.select("item").distinct()
    grams = stage(
        texts.join(wanted, "item", "left_semi").mapInPandas(_grams, "item long, grams binary"),
        "grams",
    )
    return given.select("doc_id", "item"), link(shared, grams, overlap_of(least))


def classes(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id, class_size`` of every document.

    A class is named by the smallest id in it (null if it has only null ids).
    """
    rows, groups = near_groups(docs, least)
    placed = stage(
        rows.join(groups, "item", "left").select("doc_id", F.coalesce("group", "item").alias("group")), "classes"
    )
    named = placed.groupBy("group").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return placed.join(named, "group").select("doc_id", "class_id", "class_size")


def _hashable(field: T.StructField) -> Column:
    """A column as hashes take it: maps and variants, alone or inside others, as JSON."""
    name = F.col(f"`{field.name}`")
    whole = field.dataType.simpleString()
    return F.to_json(F.struct(name)) if "map<" in whole or "variant" in whole else name


def keep_one(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """The documents without all but one of each class: the one with the smallest id.

    Columns stay as they are. Among rows with that id the content decides; rows
    equal in every column count once.
    """
    rows, groups = near_groups(docs, least)
    mark = F.xxhash64(*[F.struct(F.col(f"`{f.name}`").isNull(), _hashable(f)) for f in docs.schema.fields])
    marked = docs.withColumn(MARK, mark)
    own = marked.select(
        F.col("doc_id").cast("long").alias("_id"), F.xxhash64(whole_text()).alias("item"), MARK
    ).join(groups, "item", "left")
    kept = own.groupBy(F.coalesce("group", "item").alias("group")).agg(
        F.min(F.struct(F.col("_id").isNull(), "_id", MARK))[MARK].alias(MARK)
    )
    return marked.join(kept.select(MARK), MARK, "left_semi").dropDuplicates([MARK]).drop(MARK)


@query("op10_near_dedup")
def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The class of near copies of every document."""
    return classes(table(spark, sf_dir, "documents"))
