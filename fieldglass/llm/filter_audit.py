"""Audit of five text filters in every order, kept by a stream that can take back what it counted.

Each file of the documents passes once through a Structured Streaming query with
the available-now trigger. A text gets a mask of the filters it fails:

* A: fewer than 100 words, B: under 80 % distinct words, C: over 10 % capital letters,
  D: one of ``#$%&*|`` (all of the text alone, decided where it is read);
* E: a smaller id has the same text, in whatever file.

E is not known until the last file is read. So the state of the stream keeps, by text
(its SHA-256), the smallest id so far and the rows that have it. Rows count as
repeats unless they have that id; when a smaller id arrives, the rows of the former
one are taken back from the counters of their mask and counted under the mask with
E. What the state emits are therefore signed changes; each micro-batch adds them up
by part and mask and writes one small table under its batch number, so a batch that
is run again replaces its own. The counts of all 120 orders follow from the 32 mask counters of
a part.

State is keyed by pages of texts, about ``PAGE_BYTES`` of input each, because a state
row of Python costs milliseconds whatever it holds. Before the shuffle every task
merges its rows of one text, so a text that fills a third of a table sends a few rows
a task to its page. State lives in RocksDB and in the stream's checkpoint below the
cluster's shared folder.

Null texts are empty. A null ``lang`` is the part ``''``. A row with a null id has no
place among the ids: it never fails E and makes no other row fail it. Repeated rows with one id and
one text count one by one and do not make each other fail. Labels of one id are
joined (1 wins); null labels are none. Without documents there are no parts and no
rows. Extra columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from contextlib import contextmanager
from itertools import permutations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.register import query, table
from fieldglass.sources.scratch import new_folder

FILTERS = "ABCDE"
REPEAT = 1 << FILTERS.index("E")
LEAST_WORDS, DISTINCT_PERCENT, CAPITAL_PERCENT = 100, 80, 10
SIGNS = b"#$%&*|"
#: Bytes of input files to one page of the state.
PAGE_BYTES = 1 << 18
#: Bytes of files that one micro-batch takes up.
BATCH_BYTES = 4 << 40
_CAPITALS = bytes(range(65, 91))

_DIGEST = "doc_id long, part string, text_key binary, page long, mask int"
_COMBINED = (
    "page long, text_key binary, part string, mask int, good boolean, toxic boolean, first_id long, firsts long, rows long"
)
_CHANGE = "part string, mask int, good boolean, toxic boolean, change long"
_COLUMNS = ["text_key", "part", "mask", "good", "toxic"]
_COUNTED = ["part", "mask", "good", "toxic"]


def text_mask(data: bytes, code_points: int) -> int:
    """The bits of the filters A to D that a text fails."""
    words = data.split()  # of bytes: splits at x20 and x09 to x0D only
    capitals = len(data) - len(data.translate(None, _CAPITALS))
    signs = len(data) - len(data.translate(None, SIGNS))
    return (
        (len(words) < LEAST_WORDS)
        | (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) << 1
        | (100 * capitals > CAPITAL_PERCENT * code_points) << 2
        | (signs > 0) << 3
    )


def _digests(pages: int):
    def run(batches):
        import hashlib

        import pyarrow as pa

        for batch in batches:
            keys, places, masks = [], [], []
            for text in batch.column("text").to_pylist():
                text = text or ""
                data = text.encode("utf-8", "replace")
                key = hashlib.sha256(data).digest()
                keys.append(key)
                places.append(int.from_bytes(key[:8], "little") % pages)
                masks.append(text_mask(data, len(text)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    batch.column("part"),
                    pa.array(keys, pa.binary()),
                    pa.array(places, pa.int64()),
                    pa.array(masks, pa.int32()),
                ],
                ["doc_id", "part", "text_key", "page", "mask"],
            )

    return run


def _combined(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The rows of one text, part and labels in a batch as one row: smallest id, rows with it, all rows."""
    by = ["page", *_COLUMNS]
    names = [*by, "first_id", "firsts", "rows"]
    for batch in batches:
        known = batch[batch["doc_id"].notna()]
        if len(known):
            known = known.assign(doc_id=known["doc_id"].astype("int64"))
            groups = known.groupby(by, sort=False)["doc_id"]
            firsts = known["doc_id"] == groups.transform("min")
            made = known.assign(_first=firsts).groupby(by, sort=False).agg(
                first_id=("doc_id", "min"), firsts=("_first", "sum"), rows=("doc_id", "size")
            )
            yield made.reset_index().astype({"firsts": "int64"})[names]
        nameless = batch[batch["doc_id"].isna()]
        if len(nameless):
            made = nameless.groupby(by, sort=False).size().rename("rows").reset_index()
            yield made.assign(first_id=pd.array([None] * len(made), dtype="Int64"), firsts=0)[names]


def merge_page(held: pd.DataFrame, arrived: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The rows with the smallest id of each text, and the changes of the counters.

    ``held`` and the first result have the columns of a text, ``first_id`` and
    ``firsts``; ``arrived`` has ``rows`` besides.
    """
    known = arrived[arrived["first_id"].notna()].astype({"first_id": "int64"})
    nameless = arrived[arrived["first_id"].isna()]
    every = pd.concat([held.assign(rows=0, old=True), known.assign(old=False)], ignore_index=True)
    every = every.astype({"old": bool, "mask": "int32", "first_id": "int64", "firsts": "int64"})
    smallest = every.groupby("text_key", sort=False)["first_id"].transform("min")
    first = every["first_id"] == smallest
    fresh, lost = every[~every["old"]], every[every["old"] & ~first]
    new_first = every[~every["old"] & first]
    repeat = lambda rows: rows["mask"] | REPEAT
    changes = pd.concat(
        [
            # What arrives counts as repeated, but for the rows with the smallest id.
            fresh.assign(mask=repeat(fresh), change=fresh["rows"]),
            new_first.assign(mask=repeat(new_first), change=-new_first["firsts"]),
            new_first.assign(change=new_first["firsts"]),
            # Rows of a former smallest id are taken back.
            lost.assign(change=-lost["firsts"]),
            lost.assign(mask=repeat(lost), change=lost["firsts"]),
            nameless.assign(change=nameless["rows"]),
        ],
        ignore_index=True,
    )
    kept = every[first].groupby([*_COLUMNS, "first_id"], sort=False)["firsts"].sum().reset_index()
    summed = changes.groupby(_COUNTED, sort=False)["change"].sum().reset_index()
    return kept, summed[summed["change"] != 0]


def _packed(held: pd.DataFrame) -> bytes:
    import pyarrow as pa

    sink = pa.BufferOutputStream()
    batch = pa.RecordBatch.from_pandas(held, preserve_index=False)
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes) -> pd.DataFrame:
    import pyarrow as pa

    return pa.ipc.open_stream(data).read_all().to_pandas()


def _page(_, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    held = (
        _unpacked(bytes(state.get[0]))
        if state.exists
        else pd.DataFrame({c: [] for c in [*_COLUMNS, "first_id", "firsts"]}).astype(
            {"mask": "int32", "good": bool, "toxic": bool, "first_id": "int64", "firsts": "int64"}
        )
    )
    made = []
    for arrived in batches:
        held, changes = merge_page(held, arrived)
        made.append(changes)
    state.update((_packed(held),))
    yield pd.concat(made, ignore_index=True)[[*_COUNTED, "change"]]


@contextmanager
def _state_in_rocksdb(spark: SparkSession):
    """Streams started inside keep their state in RocksDB, unless the session names another provider than Spark's first choice.

    Without space set aside: a store would take megabytes on disk before it holds a row,
    in every partition.
    """
    stores = "spark.sql.streaming.stateStore."
    named = spark.conf.get(stores + "providerClass", None)
    own = {}
    if named is None or named.endswith("HDFSBackedStateStoreProvider"):
        own[stores + "providerClass"] = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    if spark.conf.get(stores + "rocksdb.allowFAllocate", None) is None:
        own[stores + "rocksdb.allowFAllocate"] = "false"
    before = {k: spark.conf.get(k, None) for k in own}
    for k, v in own.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def mask_counts(spark: SparkSession, path: str, labels: DataFrame, files_per_batch: int | None = None) -> DataFrame:
    """``part, mask, good, toxic, n``: rows by the filters they fail and their labels; reads the Parquet files at ``path``.

    ``files_per_batch`` bounds a micro-batch by files in place of ``BATCH_BYTES``.
    """
    path = path.rstrip("/")
    size = spark.read.format("binaryFile").load(path).agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]
    source = spark.readStream.schema(spark.read.parquet(path).schema)
    source = source.option("maxFilesPerTrigger", files_per_batch) if files_per_batch else source.option("maxBytesPerTrigger", BATCH_BYTES)
    # A pattern may name one file as well as a folder; a stream takes a plain path for a folder.
    docs = source.parquet(f"{path[:-1]}[{path[-1]}]").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("lang", F.lit("")).alias("part"), "text"
    )
    known = (
        labels.where(F.col("doc_id").isNotNull())
        .groupBy(F.col("doc_id").cast("long").alias("_id"))
        .agg(
            F.max(F.coalesce(F.col("quality") == 1, F.lit(False))).alias("good"),
            F.max(F.coalesce(F.col("toxic") == 1, F.lit(False))).alias("toxic"),
        )
        .withColumn("_salt", F.lit(0).cast("long"))
    )
    # Null ids have no labels and are spread by their texts.
    salt = F.when(F.col("doc_id").isNull(), F.pmod(F.xxhash64("text_key"), F.lit(1 << 16)) + 1).otherwise(F.lit(0).cast("long"))
    digests = (
        docs.mapInArrow(_digests(max(64, size // PAGE_BYTES)), _DIGEST)
        .withColumns({"_id": F.coalesce("doc_id", F.lit(0).cast("long")), "_salt": salt})
        .join(known, ["_id", "_salt"], "left")
        .select(
            "doc_id", "part", "text_key", "page", "mask",
            F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"),
        )
    )
    changes = (
        digests.mapInPandas(_combined, _COMBINED)
        .groupBy("page")
        .applyInPandasWithState(_page, _CHANGE, "held binary", "append", "NoTimeout")
    )
    folder, written = new_folder(spark, "audit-counters"), []

    def count(changed: DataFrame, batch: int) -> None:
        to = f"{folder}/batch-{batch}"
        changed.groupBy(*_COUNTED).agg(F.sum("change").alias("change")).write.mode("overwrite").parquet(to)
        written.append(to)

    with _state_in_rocksdb(spark):
        stream = (
            changes.writeStream.foreachBatch(count)
            .outputMode("append")
            .option("checkpointLocation", new_folder(spark, "audit-stream"))
            .trigger(availableNow=True)
            .start()
        )
        stream.awaitTermination()
    counters = spark.read.schema(_CHANGE)
    found = counters.parquet(*dict.fromkeys(written)) if written else spark.createDataFrame([], _CHANGE)
    return found.groupBy(*_COUNTED).agg(F.sum("change").alias("n")).where("n > 0")


def interactions(counts: DataFrame) -> DataFrame:
    """One row per part, order of the filters and step, from ``mask_counts``."""
    steps = [
        {"o": "".join(order), "s": i + 1, "b": 1 << FILTERS.index(f), "e": sum(1 << FILTERS.index(g) for g in order[:i])}
        for order in permutations(FILTERS)
        for i, f in enumerate(order)
    ]
    all_steps = F.from_json(F.lit(json.dumps(steps)), "array<struct<o:string,s:int,b:int,e:int>>")
    masks = counts.groupBy("part", "mask").agg(
        F.sum("n").alias("n"),
        F.coalesce(F.sum(F.when(F.col("good"), F.col("n"))), F.lit(0)).alias("good"),
        F.coalesce(F.sum(F.when(F.col("toxic"), F.col("n"))), F.lit(0)).alias("toxic"),
    )
    # At most 32 masks a part.
    parts = masks.groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("masks"))
    rows = parts.select("part", "masks", F.explode(all_steps).alias("_at"))

    def total(what: str, where) -> Column:
        met = F.filter("masks", where)
        return F.aggregate(met, F.lit(0).cast("long"), lambda acc, m: acc + m[what])

    bit, before = F.col("_at.b"), F.col("_at.e")
    removed = lambda m: (m.mask.bitwiseAND(bit) > 0) & (m.mask.bitwiseAND(before) == 0)
    counted = rows.select(
        "part",
        F.col("_at.o").alias("filter_order"),
        F.col("_at.s").alias("step"),
        bit.alias("_bit"),
        total("n", lambda m: m.mask.bitwiseAND(bit.bitwiseOR(before)) == 0).alias("kept"),
        total("n", removed).alias("removed"),
        total("n", lambda m: (m.mask.bitwiseAND(bit) > 0) & (m.mask.bitwiseAND(before) > 0)).alias("redundant"),
        total("n", lambda m: m.mask == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"),
        total("toxic", removed).alias("toxic_lost"),
    )
    own = Window.partitionBy("part", "_bit")
    return counted.withColumn("shapley", F.sum("removed").over(own)).drop("_bit")


_SQL = r"""
with texts as (
    select doc_id, coalesce(lang, '') as part, coalesce(text, '') as text from documents
), labelled as (
    select doc_id as id, max((coalesce(quality, 0) = 1)::int) as good, max((coalesce(toxic, 0) = 1)::int) as toxic
    from labels where doc_id is not null group by doc_id
), cut as (
    select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words, min(doc_id) over (partition by text) as first_id from texts
), masked as (
    select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
        (len(words) < 100)::int + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::int
        + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::int
        + 8 * (regexp_matches(text, '[#$%&*|]'))::int + 16 * coalesce(doc_id > first_id, false)::int as mask
    from cut left join labelled on doc_id = id
), counted as (
    select part, mask, count(*) as n, sum(good) as good, sum(toxic) as toxic from masked group by part, mask
), f(x, b) as (
    values ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)
), orders as (
    select p.x || q.x || r.x || s.x || t.x as filter_order, [p.b, q.b, r.b, s.b, t.b] as bits
    from f p, f q, f r, f s, f t
    where p.b | q.b | r.b | s.b | t.b = 31
), steps as (
    select filter_order, k.step, bits[k.step] as b, coalesce(list_sum(bits[1:k.step - 1]), 0)::int as e
    from orders, (select unnest([1, 2, 3, 4, 5]) as step) k
), told as (
    select part, filter_order, step, b,
        coalesce(sum(n) filter (where mask & (b | e) = 0), 0)::bigint as kept,
        coalesce(sum(n) filter (where mask & b > 0 and mask & e = 0), 0)::bigint as removed,
        coalesce(sum(n) filter (where mask & b > 0 and mask & e > 0), 0)::bigint as redundant,
        coalesce(sum(n) filter (where mask = b), 0)::bigint as unique_fails,
        coalesce(sum(good) filter (where mask & b > 0 and mask & e = 0), 0)::bigint as good_lost,
        coalesce(sum(toxic) filter (where mask & b > 0 and mask & e = 0), 0)::bigint as toxic_lost
    from counted, steps group by part, filter_order, step, b
)
select part, filter_order, step::int as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) over (partition by part, b))::bigint as shapley
from told
"""


@query("op11_filter_audit", _SQL)
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each filter removes from all documents, by part, in every order."""
    path = f"{sf_dir.rstrip('/')}/documents.parquet"
    return interactions(mask_counts(spark, path, table(spark, sf_dir, "labels")))
