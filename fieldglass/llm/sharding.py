"""Sharding by sampled splitters, with DataFrame operations only.

Records are ordered by a hash of their text. A sample drawn in proportion to
size gives splitters that cut the order into ranges of about equal bytes; a key
that alone fills a range gets a range of its own. The exact bytes and rows of
every range are then counted, overfull ranges are subdivided by a second hash of the
key, and the parts are dealt to the shards, largest first. Equal texts stay in one
shard unless they alone are more than a part may hold: only such a key is cut by row.

Size is the UTF-8 length of the text plus one. Null texts count as empty; null
ids are kept; repeated rows are placed one by one; an empty table gives no rows.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from fieldglass.llm.register import query, table
from fieldglass.llm.shared import literal_table, stage, whole_text

SHARDS = 8
#: Ranges that the splitters aim at, per shard.
RANGES_PER_SHARD = 64
#: Expected sampled keys per range.
SAMPLES_PER_RANGE = 16
#: A range over one part in so many of a shard's bytes is overfull; likewise for rows.
OVERFULL_BYTES, OVERFULL_ROWS = 4, 16
#: An overfull range is cut into cells of about one part in so many of a shard.
CELLS_PER_SHARD = 32
#: No cell is planned over more rows than this, whatever the table's size, so that
#: one task can number the rows of a cell.
CELL_ROWS = 1_000_000
#: Bits of the key by which ranges are looked up.
LOOKUP_BITS = 12
LOWEST, HIGHEST = -(2**63), 2**63 - 1


def splitters(sample: list[tuple[int, float]], ranges: int) -> list[tuple[int, int]]:
    """Inclusive key ranges of about equal weight that cover all keys.

    A key as heavy as a whole range becomes a range of its own.
    """
    fill = sum(w for _, w in sample) / max(ranges, 1)
    starts, held = {LOWEST}, 0.0
    for key, weight in sorted(sample):
        if weight >= fill:
            starts.add(key)
            if key < HIGHEST:
                starts.add(key + 1)
            held = 0.0
        elif held + weight > fill:
            starts.add(key)
            held = weight
        else:
            held += weight
    edges = sorted(starts)
    return [(lo, hi - 1) for lo, hi in zip(edges, edges[1:] + [HIGHEST + 1], strict=True)]


def deal(cells: list[tuple[int, int, int, int]], shards: int) -> list[dict]:
    """Give cells (range, part, bytes, rows) to shards, largest first to the emptiest.

    Each cell gets its shard and the number of rows before it there.
    """
    loads = [(0, s) for s in range(shards)]
    rows_in = [0] * shards
    out = []
    for rng, part, size, rows in sorted(cells, key=lambda c: (-c[2], c[0], c[1])):
        load, s = heapq.heappop(loads)
        heapq.heappush(loads, (load + size, s))
        out.append({"_range": rng, "_part": part, "shard": s, "_before": rows_in[s]})
        rows_in[s] += rows
    return out


def shard_by_bytes(
    records: DataFrame, text_col: str = "text", id_col: str = "doc_id", shards: int = SHARDS, most_rows: int = CELL_ROWS
) -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` for every record."""
    spark = records.sparkSession
    text = whole_text(text_col)
    digests = stage(
        records.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + F.lit(1)).cast("long").alias("size"),
            F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
            F.xxhash64(text).alias("_key"),
        ),
        "shard-digests",
    )
    # The place of a record in the written files tells repeated rows apart.
    keyed = digests.withColumn("_spread", F.xxhash64("_metadata.file_name", "_metadata.row_index"))
    total, rows = keyed.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    ranges = RANGES_PER_SHARD * shards
    share = ranges * SAMPLES_PER_RANGE / max(total, 1)
    draw = F.pmod(F.xxhash64("doc_id", "_key", F.lit(17)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # A record as large as a sampling step is always drawn and weighs its size.
    sample = (
        keyed.where(draw < F.col("size") * F.lit(share))
        .groupBy("_key")
        .agg(F.sum(F.greatest(F.col("size").cast("double"), F.lit(1 / share))).alias("w"))
        .collect()
    )
    bounds = [
        {"_range": n, "_lo": lo, "_hi": hi, "_slots": list(range(lo >> (64 - LOOKUP_BITS), (hi >> (64 - LOOKUP_BITS)) + 1))}
        for n, (lo, hi) in enumerate(splitters([(r["_key"], r["w"]) for r in sample], ranges))
    ]
    bound = literal_table(spark, bounds, "_range:int,_lo:bigint,_hi:bigint,_slots:array<int>")
    bound = bound.select("_range", "_lo", "_hi", F.explode("_slots").alias("_slot"))
    # At most as many rows as ranges and lookup slots together: a bounded broadcast.
    ranged = (
        keyed.withColumn("_slot", F.shiftright("_key", 64 - LOOKUP_BITS).cast("int"))
        .join(F.broadcast(bound), "_slot")
        .where(F.col("_key").between(F.col("_lo"), F.col("_hi")))
        .drop("_slot", "_lo", "_hi")
    )
    filled = ranged.groupBy("_range").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    cell_bytes = max(1, total / (shards * CELLS_PER_SHARD))
    cell_rows = max(1, min(most_rows, rows / (shards * CELLS_PER_SHARD)))
    over_bytes = total / (shards * OVERFULL_BYTES)
    over_rows = min(most_rows, rows / (shards * OVERFULL_ROWS))
    overfull = {r["_range"]: [r["b"], r["n"]] for r in filled if r["b"] > over_bytes or r["n"] > over_rows}

    def pieces(size: int, count: int) -> int:
        return max(1, round(size / cell_bytes), round(count / cell_rows))

    # A key is heavy only if it alone is overfull, so heavy keys are few.
    heavy = []
    if overfull:
        listed = literal_table(spark, [{"_range": r} for r in overfull], "_range:int")
        counted = ranged.join(F.broadcast(listed), "_range").groupBy("_range", "_key")
        alone = counted.agg(F.sum("size").alias("b"), F.count("*").alias("n"))
        heavy = alone.where((F.col("b") > over_bytes) | (F.col("n") > over_rows)).collect()
    own, at = [], 0
    for r in sorted(heavy, key=lambda r: r["_key"]):
        overfull[r["_range"]][0] -= r["b"]
        overfull[r["_range"]][1] -= r["n"]
        count = pieces(r["b"], r["n"])
        own.append({"_key": r["_key"], "_from": at, "_pieces": count})
        at += count
    parts = [
        {"_range": r["_range"], "_parts": pieces(*overfull[r["_range"]]) if r["_range"] in overfull else 1} for r in filled
    ]
    by_key = F.pmod(F.xxhash64("_key", F.lit(29)), F.col("_parts"))
    by_row = -1 - F.col("_from") - F.pmod("_spread", F.col("_pieces"))
    subdivided = (
        ranged.join(F.broadcast(literal_table(spark, parts, "_range:int,_parts:int")), "_range")
        .join(F.broadcast(literal_table(spark, own, "_key:bigint,_from:int,_pieces:int")), "_key", "left")
        .withColumn("_part", F.coalesce(by_row, by_key).cast("int"))
    )
    cells = subdivided.groupBy("_range", "_part").agg(F.sum("size").alias("b"), F.count("*").alias("n")).collect()
    dealt = literal_table(
        spark,
        deal([(c["_range"], c["_part"], c["b"], c["n"]) for c in cells], shards),
        "_range:int,_part:int,shard:int,_before:bigint",
    )
    within = Window.partitionBy("_range", "_part").orderBy("_key", "doc_id", "_spread")
    return subdivided.join(dealt, ["_range", "_part"]).select(
        "doc_id",
        "size",
        "text_crc32",
        "shard",
        (F.col("_before") + F.row_number().over(within) - 1).alias("slot"),
    )


@query("op6_shard_documents")
def op6_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of near equal bytes."""
    placed = shard_by_bytes(table(spark, sf_dir, "documents"))
    return placed.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast(T.IntegerType()).alias("grown_shard"),
    )
