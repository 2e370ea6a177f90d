"""Ranked lexical search with the roles turned round: documents stream through an index of the queries.

The items (queries) are taken in blocks of at most ``BLOCK_BYTES`` of text. A block's
inverted index (term -> items that hold it, and how often) is broadcast, which the
block size bounds. One pass over the texts writes each document's length and its
counts of the index's terms; from that table come the document frequencies and, in
a second pass, the scores. Every task keeps the best documents of each item only,
and the tasks' lists are merged in two levels. So a document is never sent to an
item and nothing grows with documents times items.

The terms of a text are the runs of ASCII letters, ASCII digits and characters
outside ASCII, capitals A to Z lowered. Scores are whole numbers:

* ``w = floor(1000 ln((2N+2) / (2 df+1)))``, ``m = 25 + (75 n N) div L``;
* the sum over the item's terms, with repeats, of ``w ((10^9 tf) div (1000 tf + 8 m))``.

Null and empty texts have no terms: such a document is never found, such an item
finds nothing. Equal scores rank by ascending id, null ids last. Repeated rows are
documents (or items) of their own. Very long texts are read whole. Without
documents or items there are no rows; extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage

BEST = 10
#: Bytes of item texts whose index is broadcast at once.
BLOCK_BYTES = 4 << 20
#: Entries of the score sums that a task holds at once.
SUMS = 1 << 19
#: Lists that the lists of all tasks are merged into before the last merge.
MERGED = 64

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)
_COUNTS = "doc_id long, n long, terms array<int>, times array<int>"
_FOUND = "item int, doc_id long, score long"


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text in order, with repeats."""
    return (text or "").encode("utf-8", "replace").translate(_LOWER).split()


def item_blocks(items: DataFrame, most: int = BLOCK_BYTES) -> Iterator[list[tuple[int | None, str | None]]]:
    """Rows ``(item_id, text)`` of all items in blocks of about ``most`` bytes of text."""
    held, size = [], 0
    for row in items.select(F.col("item_id"), "text").toLocalIterator():
        held.append((row[0], row[1]))
        size += len(row[1] or "") + 64
        if size >= most:
            yield held
            held, size = [], 0
    if held:
        yield held


class Index:
    """Terms of a block of items, numbered, and the items of each term."""

    def __init__(self, texts: list[str | None]):
        self.number: dict[bytes, int] = {}
        at, items, times = [], [], []
        for i, text in enumerate(texts):
            for term, k in Counter(terms_of(text)).items():
                at.append(self.number.setdefault(term, len(self.number)))
                items.append(i)
                times.append(k)
        order = np.argsort(np.array(at, dtype=np.int64), kind="stable")
        self.items = np.array(items, dtype=np.int64)[order]
        self.times = np.array(times, dtype=np.int64)[order]
        self.sizes = np.bincount(np.array(at, dtype=np.int64), minlength=len(self.number))
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.n_items = len(texts)


def term_counts(docs: DataFrame, index) -> DataFrame:
    """``doc_id, n, terms, times`` of all documents with a term; ``index`` is broadcast."""

    def run(batches):
        import pyarrow as pa

        number = index.value.number
        for batch in batches:
            ids, n, terms, times = [], [], [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = terms_of(text)
                if words:
                    found = Counter(filter(lambda x: x is not None, map(number.get, words)))
                    ids.append(doc_id)
                    n.append(len(words))
                    terms.append(list(found.keys()))
                    times.append(list(found.values()))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()),
                    pa.array(n, pa.int64()),
                    pa.array(terms, pa.list_(pa.int32())),
                    pa.array(times, pa.list_(pa.int32())),
                ],
                ["doc_id", "n", "terms", "times"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, _COUNTS)


class BestLists:
    """The ``size`` best documents of each item so far, as bounded lists in arrays."""

    def __init__(self, n_items: int, size: int):
        self.size = size
        self.floor = np.ones(n_items, dtype=np.int64)  # the least score that can still enter
        self.item = np.empty(0, dtype=np.int64)
        self.score = np.empty(0, dtype=np.int64)
        self.id = np.empty(0, dtype=np.int64)
        self.nameless = np.empty(0, dtype=bool)

    def push(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, nameless: np.ndarray) -> None:
        if not len(item):
            return
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids, nameless = np.concatenate([self.id, ids]), np.concatenate([self.nameless, nameless])
        order = np.lexsort((ids, nameless, -score, item))
        item = item[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        kept = order[place < self.size]
        full = place == self.size - 1
        self.floor[item[full]] = score[order[full]]
        self.item, self.score, self.id, self.nameless = item[place < self.size], score[kept], ids[kept], nameless[kept]


def _chunks(postings: np.ndarray, n_items: int) -> Iterator[tuple[int, int]]:
    """Ranges of documents whose sums and postings stay near ``SUMS``."""
    load = np.cumsum(postings + n_items)
    first = 0
    while first < len(load):
        before = load[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(load, before + SUMS, side="right")))
        yield first, last
        first = last


def best_documents(counts: DataFrame, index, weights: np.ndarray, docs: int, total: int, best: int = BEST) -> DataFrame:
    """``item, doc_id, score``: each task's best documents of every item."""

    def run(batches):
        import pyarrow as pa

        held = index.value
        lists = BestLists(held.n_items, best)
        for batch in batches:
            n = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            terms, times = batch.column(2), batch.column(3)
            sizes = terms.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            t = terms.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            tf = times.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(0).fill_null(0).to_numpy(zero_copy_only=False)
            nameless = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(len(n)), sizes)
            m = 100 - 75 + (75 * n * docs) // total
            worth = weights[t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m[doc]))
            fan = held.sizes[t]
            ends = np.cumsum(sizes)
            per_doc = np.bincount(doc, weights=fan, minlength=len(n)).astype(np.int64)
            for a, b in _chunks(per_doc, held.n_items):
                lo, hi = (ends[a - 1] if a else 0), ends[b - 1]
                count = fan[lo:hi]
                at = np.repeat(held.starts[t[lo:hi]] - (np.cumsum(count) - count), count) + np.arange(count.sum())
                sums = np.zeros((b - a) * held.n_items, dtype=np.int64)
                spot = np.repeat((doc[lo:hi] - a) * held.n_items, count) + held.items[at]
                np.add.at(sums, spot, np.repeat(worth[lo:hi], count) * held.times[at])
                sums = sums.reshape(b - a, held.n_items)
                row, item = np.nonzero(sums >= lists.floor)
                lists.push(item, sums[row, item], ids[a + row], nameless[a + row])
        if len(lists.item):
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(lists.item.astype(np.int32)),
                    pa.array(lists.id, pa.int64(), mask=lists.nameless),
                    pa.array(lists.score),
                ],
                ["item", "doc_id", "score"],
            )

    return counts.mapInArrow(run, _FOUND)


def _ranked(found: DataFrame, by: list, best: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)


def search(docs: DataFrame, items: DataFrame, best: int = BEST, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``item_id, rank, doc_id, score``: the best documents of every item."""
    spark = docs.sparkSession
    made = None
    for block in item_blocks(items, block_bytes):
        index = Index([text for _, text in block])
        shared = spark.sparkContext.broadcast(index)
        counts = stage(term_counts(docs, shared), "term-counts")
        n, total = counts.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        # At most as many rows as the index has terms.
        held = counts.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df")).collect()
        df = np.zeros(len(index.number), dtype=np.int64)
        for row in held:
            df[row["term"]] = row["df"]
        weights = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * int(k) + 1))) for k in df], dtype=np.int64)
        found = best_documents(counts, shared, weights, n, max(total, 1), best)
        part = F.coalesce(F.pmod(F.xxhash64("doc_id"), F.lit(MERGED)), F.lit(0))
        nearly = _ranked(found.withColumn("_part", part), ["item", "_part"], best).drop("rank", "_part")
        names = spark.createDataFrame([(i, item_id) for i, (item_id, _) in enumerate(block)], "item int, item_id long")
        ranked = _ranked(nearly, ["item"], best).join(names, "item").select("item_id", "rank", "doc_id", "score")
        made = ranked if made is None else made.unionByName(ranked)
    if made is None:
        return spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    return made


_SQL = r"""
with t as (
    select doc_id, unnest(regexp_extract_all(
        translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from documents where text is not null
), q as (
    select item_id, term, count(*) as times from (
        select item_id, unnest(regexp_extract_all(
            translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
        from benchmark where text is not null)
    group by item_id, term
), sizes as (
    select doc_id, count(*) as n from t group by doc_id
), whole as (
    select count(*) as docs, sum(n)::bigint as total from sizes
), counts as (
    select doc_id, term, count(*) as tf from t where term in (select term from q) group by doc_id, term
), weights as (
    select term, floor(1000 * ln((2 * docs + 2)::double / (2 * count(*) + 1)::double))::bigint as w
    from counts, whole group by term, docs
), scored as (
    select item_id, c.doc_id,
        sum(times * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // total))))::bigint as score
    from counts c join weights using (term) join q using (term) join sizes s on s.doc_id = c.doc_id, whole
    group by item_id, c.doc_id
), ranked as (
    select *, row_number() over (partition by item_id order by score desc, doc_id) as rank from scored where score > 0
)
select item_id, rank::int as rank, doc_id, score from ranked where rank <= 10
"""


@query("op13_lexical_search", _SQL)
def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every benchmark item."""
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("long").alias("item_id"), "text")
    return search(table(spark, sf_dir, "documents"), items)
