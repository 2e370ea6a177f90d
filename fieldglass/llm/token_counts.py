"""Token counts by a two-tier lookup inside the map side.

The tokenizer starts a pre-token at every space that stands before a character
that is no white space, so a text falls into pieces there whose tokens do not
depend on each other: a word with its marks and what white space follows.

First tier: one pass over all texts counts the pieces, each task keeping a
bounded summary; the most frequent ones are given their number of tokens, and this table
of a fixed size is broadcast. Second tier: pieces that the table does not hold are
encoded in the task and kept in a cache of the worker. No piece is
shuffled: a task hands on its summary as one value, and summaries are merged whole, in two
levels, so the driver gets one table however many tasks there are. What the
table holds changes the speed, never a count.

A null text is empty: no bytes, no tokens. Special strings inside a text count
as the library counts them. Rows are counted one by one, repeated or not; an
empty table gives no rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.register import query, table
from fieldglass.llm.tokens import SPECIAL, VOCABULARY, fast_encoder, kept, library

#: Entries of the broadcast table.
TABLE_PIECES = 30_000
#: Distinct pieces a task keeps while it counts, and those that it hands on.
SUMMARY_PIECES, HANDED_ON = 200_000, 60_000
#: Tasks that merge summaries before the last one does.
MERGERS = 64
#: Longer pieces are encoded each time; they enter neither table nor cache.
PIECE_CHARS = 40
#: Pieces a worker's cache holds before it starts anew.
CACHE_PIECES = 400_000
#: Characters of a text that are cut into pieces at once.
STRETCH = 1 << 20
LIMIT = 512
#: Python's white space holds all that the tokenizer's pattern takes for it, so no cut is wrong.
CUT = re.compile(r" (?=\S)")


def stretches(text: str) -> Iterator[str]:
    """A text in parts of about ``STRETCH`` characters, cut where pieces begin."""
    at = 0
    while len(text) - at > STRETCH:
        found = CUT.search(text, at + STRETCH)
        if not found:
            break
        yield text[at : found.start()]
        at = found.start()
    yield text[at:] if at else text


def _heaviest(seen: Counter, size: int) -> Counter:
    if len(seen) <= size:
        return seen
    return Counter(dict(sorted(seen.items(), key=lambda kv: (-kv[1], kv[0]))[:size]))


def _packed(seen: Counter) -> Iterator[pd.DataFrame]:
    top = _heaviest(seen, HANDED_ON)
    if top:
        yield pd.DataFrame({"pieces": [list(top)], "counts": [list(top.values())]})


def _summary(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row: the most frequent pieces of one task, without their space, and their counts there."""
    seen: Counter = Counter()
    for batch in batches:
        for text in batch["text"]:
            for part in stretches(text or ""):
                seen.update([p for p in CUT.split(part)[1:] if len(p) <= PIECE_CHARS])
                if len(seen) > SUMMARY_PIECES:
                    seen = _heaviest(seen, SUMMARY_PIECES // 2)
    yield from _packed(seen)


def _merged(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row: the summaries that reach a task, one after the other, as one."""
    seen: Counter = Counter()
    for batch in batches:
        for pieces, counts in zip(batch["pieces"], batch["counts"], strict=True):
            for piece, n in zip(pieces, counts, strict=True):
                seen[piece] += int(n)
            if len(seen) > SUMMARY_PIECES:
                seen = _heaviest(seen, SUMMARY_PIECES // 2)
    yield from _packed(seen)


def frequent_pieces(docs: DataFrame, size: int = TABLE_PIECES) -> list[str]:
    """The pieces most often led by a space, at most ``size`` of them."""
    shape = "pieces array<string>, counts array<long>"
    found = docs.select("text").mapInPandas(_summary, shape)
    # Whole summaries move, dealt by turns; one task merges those of the mergers.
    for tasks in (MERGERS, 1):
        found = found.repartition(tasks).mapInPandas(_merged, shape)
    only = found.select(F.slice(F.arrays_zip("pieces", "counts"), 1, size)["pieces"].alias("pieces")).first()
    return only["pieces"] if only else []


def lengths_of(pieces: list[str]) -> dict[str, int]:
    """Token numbers of pieces, each led by a space.

    Short ones go through the faster encoder of the same vocabulary, which gives the same tokens.
    """
    fast, slow = fast_encoder().encode_ordinary, library().encode
    return {
        p: len(fast(" " + p)) if len(p) <= PIECE_CHARS else len(slow(" " + p, add_special_tokens=False).ids) for p in pieces
    }


def tokens_in(text: str, first: dict[str, int], cache: dict[str, int]) -> int:
    """Tokens of a text without special strings."""
    total = 0
    for part in stretches(text):
        head, *pieces = CUT.split(part)
        if head:
            total += len(library().encode(head, add_special_tokens=False).ids)
        counts = list(map(first.get, pieces))
        if None in counts:
            left = [p for p, n in zip(pieces, counts, strict=True) if n is None]
            counts = [n for n in counts if n is not None]
            new = [p for p in dict.fromkeys(left) if p not in cache]
            lengths = lengths_of(new)
            if len(cache) + len(new) > CACHE_PIECES:
                lengths.update((p, cache[p]) for p in left if p in cache)
                cache.clear()
            cache.update((p, n) for p, n in lengths.items() if len(p) <= PIECE_CHARS)
            counts += [lengths[p] if p in lengths else cache[p] for p in left]
        total += sum(counts)
    return total


def count_tokens(docs: DataFrame, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every document."""
    spark = docs.sparkSession
    plain = [p for p in frequent_pieces(docs) if SPECIAL not in p]
    shared = spark.sparkContext.broadcast(lengths_of(plain))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = shared.value
        cache: dict[str, int] = kept(("lengths", VOCABULARY), dict)
        for batch in batches:
            rows = []
            for text in batch["text"]:
                text = text or ""
                if SPECIAL in text:
                    n = len(library().encode(text, add_special_tokens=False).ids)
                else:
                    n = tokens_in(text, first, cache)
                rows.append((len(text.encode()), n))
            made = pd.DataFrame(rows, columns=["n_bytes", "n_tokens"])
            made.insert(0, "doc_id", batch["doc_id"].to_numpy())
            made["over_limit"] = made["n_tokens"] > limit
            yield made

    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return given.mapInPandas(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    return count_tokens(table(spark, sf_dir, "documents"))
