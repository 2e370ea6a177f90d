"""Packing of documents into sequences by minimum bin slack.

A document is its token ids and one end id. One longer than a sequence is cut
into whole sequences, with the remainder as its first piece. For each sequence a
bitset subset-sum search over the lengths that are left finds the fullest
combination with the longest of them; that combination is taken out as often as
the lengths last. The search needs only how many pieces have each length, at
most one number per token of a sequence, so its work and size do not grow with
the corpus. Each piece then finds its sequence from its rank among the pieces of
its length.

A null or empty text is the end id alone. Null ids and repeated rows are packed
like any other row; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage
from fieldglass.llm.tokens import token_ids

SEQUENCE = 1024
END_ID = 2
#: Pieces of one length are ranked in so many groups, more where groups would pass GROUP_ROWS.
GROUPS = 256
GROUP_ROWS = 1_000_000


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The combination of available lengths with the largest sum within ``room``.

    ``counts`` is read from the longest length on; bit ``s`` of ``reach`` says
    that some combination adds up to ``s``.
    """
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for length in sorted((n for n in counts if n <= room and counts[n]), reverse=True):
        steps.append((length, reach))
        most, power = min(counts[length], room // length), 1
        while most:
            take = min(power, most)
            reach |= (reach << (take * length)) & mask
            most -= take
            power *= 2
        if reach >> room & 1:
            break
    left, chosen = reach.bit_length() - 1, {}
    for length, before in reversed(steps):
        used = 0
        while not before >> (left - used * length) & 1:
            used += 1
        if used:
            chosen[length] = used
            left -= used * length
    return chosen


def plan_sequences(counts: dict[int, int], size: int = SEQUENCE) -> list[tuple[int, int, int, int, int, int]]:
    """Which ranks of each length go where.

    Rows ``(length, from_rank, to_rank, first_sequence, per_sequence, offset)``:
    the pieces of ``length`` with these ranks fill consecutive sequences,
    ``per_sequence`` in each, from ``offset`` on.
    """
    left = {n: c for n, c in counts.items() if c}
    used: dict[int, int] = dict.fromkeys(left, 0)
    rows, sequence = [], 0
    while left:
        longest = max(left)
        left[longest] -= 1
        chosen = fullest(left, size - longest)
        left[longest] += 1
        chosen[longest] = chosen.get(longest, 0) + 1
        times = min(left[n] // k for n, k in chosen.items())
        offset = 0
        for length, k in sorted(chosen.items(), reverse=True):
            rows.append((length, used[length], used[length] + k * times, sequence, k, offset))
            used[length] += k * times
            offset += k * length
            left[length] -= k * times
            if not left[length]:
                del left[length]
        sequence += times
    return rows


def _cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import numpy as np

    end = np.array([END_ID], dtype="<u4")
    for batch in batches:
        out = []
        for row, text in enumerate(batch["text"]):
            ids = np.concatenate([token_ids(text or ""), end])
            edges = [0, *range(len(ids) % SEQUENCE or SEQUENCE, len(ids) + 1, SEQUENCE)] if len(ids) > SEQUENCE else [0, len(ids)]
            for piece, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                part = ids[a:b]
                out.append((row, piece, a, b - a, zlib.crc32(part.tobytes()), part.astype("i4")))
        made = pd.DataFrame(out, columns=["row", "piece", "start", "length", "ids_crc32", "ids"])
        made.insert(0, "doc_id", batch["doc_id"].to_numpy()[made["row"].to_numpy(dtype=int)])
        yield made.drop(columns="row")


def _cut_without_ids(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for made in _cut(batches):
        yield made.drop(columns="ids")


def _plan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    counts: dict[int, int] = {}
    for batch in batches:
        for length, n in zip(batch["length"], batch["n"], strict=True):
            counts[int(length)] = counts.get(int(length), 0) + int(n)
    yield pd.DataFrame(
        plan_sequences(counts), columns=["length", "from_rank", "to_rank", "first", "per_sequence", "base"]
    )


def cut_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """The pieces of all documents: ``doc_id, piece, start, length, ids_crc32`` and, if asked for, ``ids``."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    if with_ids:
        return given.mapInPandas(_cut, schema + ", ids array<int>")
    return given.mapInPandas(_cut_without_ids, schema)


def pack(pieces: DataFrame) -> DataFrame:
    """Add ``sequence_id`` and ``offset`` to pieces that have a ``length`` of at most a sequence.

    Takes a written table: it is read once to count and once to place. Its rows
    are told apart by their place in the files.
    """
    rows = pieces.withColumn("_spread", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    groups = max(GROUPS, -(-pieces.count() // GROUP_ROWS))
    grouped = rows.withColumn("_group", F.pmod("_spread", F.lit(groups)))
    sizes = grouped.groupBy("length", "_group").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("length").orderBy("_group").rowsBetween(Window.unboundedPreceding, -1)
    bases = sizes.select("length", "_group", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    plan = (
        pieces.groupBy("length")
        .agg(F.count("*").alias("n"))
        .coalesce(1)
        .mapInPandas(_plan, "length long, from_rank long, to_rank long, first long, per_sequence long, base long")
    )
    within = Window.partitionBy("length", "_group").orderBy("_spread")
    ranked = grouped.join(bases, ["length", "_group"]).withColumn(
        "_rank", F.col("_before") + F.row_number().over(within) - 1
    )
    # The plan has a few rows for each possible length: bounded by the sequence size alone.
    step = F.col("_rank") - F.col("from_rank")
    return (
        ranked.join(F.broadcast(plan), "length")
        .where((F.col("_rank") >= F.col("from_rank")) & (F.col("_rank") < F.col("to_rank")))
        .select(
            *pieces.columns,
            (F.col("first") + F.floor(step / F.col("per_sequence"))).cast("long").alias("sequence_id"),
            (F.col("base") + step % F.col("per_sequence") * F.col("length")).cast("long").alias("offset"),
        )
    )


def pack_documents(docs: DataFrame, with_ids: bool = False) -> DataFrame:
    """Cut and pack documents (``doc_id``, ``text``)."""
    return pack(stage(cut_documents(docs, with_ids), "pieces"))


@query("op4_pack_documents")
def op4_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1,024 tokens."""
    return pack_documents(table(spark, sf_dir, "documents"))
