"""Benchmark decontamination by pigeonhole edit matching.

Test items and documents are compared in lower case, with every run of white
space and of ASCII characters other than letters and digits as one space. An
item may be found with up to a tenth of its length in edits (insertions,
deletions, substitutions). It is split into one piece more than that budget, so
at least one piece occurs unchanged. All pieces are sought in one pass over each
text. A hit is verified from the piece outwards: by the same argument one of the
two halves of a matching run of ``p`` pieces holds fewer edits than pieces, so
ever longer runs around the hit are checked with Myers' bit-parallel distance
until the whole item is, or a run fails. No true match is lost.

Items are a stated query set: they reach the tasks in blocks of bounded size, and
every block is held against all documents.

Items under ``LEAST`` compared characters say too little and are not sought; null
or empty items neither. Null and empty documents hold nothing. Rows with a null
id are reported with it, repeated rows each on their own. An item with several
rows, or found at several places of a document, is reported once per document
row and item row, with its smallest distance. Empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldglass.llm.register import query, table
from fieldglass.llm.shared import where_text

BUDGET = 0.1
LEAST = 30
#: Characters of test items that are sent to the tasks at once.
BLOCK_CHARS = 4_000_000

_SPACED = {b: " " for b in range(128) if not chr(b).isalnum()}


def compared(text: str | None) -> str:
    return " ".join((text or "").lower().translate(_SPACED).split())


def distance_in(pattern: str, masks: dict[str, int], text: str) -> tuple[int, int]:
    """The least edits that turn the pattern into a part of the text, and where that part ends.

    Myers' algorithm: the differences down a column of the edit table are bits.
    """
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus = full, 0
    score, best, end = m, m, 0
    for i, c in enumerate(text, 1):
        eq = masks.get(c, 0)
        across = (((eq & plus) + plus) ^ plus) | eq
        down = eq | minus
        up = minus | (full & ~(across | plus))
        low = plus & across
        if up & top:
            score += 1
        elif low & top:
            score -= 1
            if score < best:
                best, end = score, i
        up = (up << 1) & full
        plus = ((low << 1) & full) | (full & ~(down | up))
        minus = up & down
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    out: dict[str, int] = {}
    for i, c in enumerate(pattern):
        out[c] = out.get(c, 0) | (1 << i)
    return out


def one_edit(piece: str, text: str) -> bool:
    """Whether at most one edit turns the piece into a start of the text."""
    same = 0
    for a, b in zip(piece, text, strict=False):
        if a != b:
            break
        same += 1
    n = len(piece)
    if same >= n - 1:
        return True
    rest = piece[same + 1 :]
    return rest == text[same + 1 : n] or rest == text[same : n - 1] or piece[same:] == text[same + 1 : n + 1]


class Searcher:
    """All pieces of a block of items in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], budget: float = BUDGET):
        import ahocorasick

        self.items = [(key, text) for key, text in ((k, compared(t)) for k, t in items) if len(text) >= LEAST]
        self.masks: dict[tuple[int, int, int], dict[str, int]] = {}
        self.runs: list[dict[int, list[tuple[int, int, int]]]] = []
        where: dict[str, list[tuple]] = {}
        for n, (_, text) in enumerate(self.items):
            pieces = int(len(text) * budget) + 1
            cuts = [len(text) * i // pieces for i in range(pieces + 1)]
            self.runs.append(runs := self._runs(cuts, pieces))
            for i in range(pieces):
                a, b = cuts[i], cuts[i + 1]
                # In a run of two pieces the other one, next to the hit, has one edit at most.
                after = before = None
                if runs[i] and runs[i][0][2] == 1 and pieces > 2:
                    lo, hi, _ = runs[i].pop(0)
                    after, before = (text[b:hi], None) if lo == a else (None, text[lo:a][::-1])
                where.setdefault(text[a:b], []).append((n, i, a, after, before))
        self.found = None
        if where:
            self.found = ahocorasick.Automaton()
            for piece, places in where.items():
                self.found.add_word(piece, (len(piece), places))
            self.found.make_automaton()

    @staticmethod
    def _runs(cuts: list[int], pieces: int) -> dict[int, list[tuple[int, int, int]]]:
        """For each piece the runs to verify, shortest first: start, end, allowed edits."""
        out: dict[int, list[tuple[int, int, int]]] = {i: [] for i in range(pieces)}
        todo = [(0, pieces)]
        while todo:
            lo, hi = todo.pop()
            for i in range(lo, hi):
                out[i].append((cuts[lo], cuts[hi], hi - lo - 1))
            if hi - lo > 1:
                mid = (lo + hi + 1) // 2
                todo += [(lo, mid), (mid, hi)]
        # The piece alone is the hit; of an item of one piece it is also the item.
        return {i: sorted(r, key=lambda x: x[1] - x[0])[pieces > 1 :] for i, r in out.items()}

    def _check(self, n: int, start: int, end: int, window: str) -> tuple[int, int]:
        pattern = self.items[n][1][start:end]
        key = (n, start, end)
        if key not in self.masks:
            self.masks[key] = masks_of(pattern)
        return distance_in(pattern, self.masks[key], window)

    def matches(self, text: str | None) -> dict[int, tuple[int, int, int]]:
        """For each item found (by number): its distance and the start and end in the compared text."""
        out: dict[int, tuple[int, int, int]] = {}
        if self.found is None:
            return out
        given = compared(text)
        tried: dict[tuple[int, int], int] = {}
        for last, (size, places) in self.found.iter(given):
            for n, piece, offset, after, before in places:
                if after is not None and not one_edit(after, given[last + 1 : last + 2 + len(after)]):
                    continue
                if before is not None:
                    first = last + 1 - size
                    if not one_edit(before, given[max(0, first - len(before) - 1) : first][::-1]):
                        continue
                if n in out and out[n][0] == 0:
                    continue
                origin = last + 1 - size - offset
                whole = self.items[n][1]
                most = len(whole)
                for start, end, edits in self.runs[n][piece]:
                    lo, hi = max(0, origin + start - edits), origin + end + edits
                    if (end - start) == most:
                        # Another piece of the same place was verified already.
                        if tried.get((n, origin)) is not None:
                            most = -1
                            break
                        tried[n, origin] = 1
                    best, stop = self._check(n, start, end, given[lo:hi])
                    if best > edits:
                        most = -1
                        break
                if most < 0:
                    continue
                if n not in out or best < out[n][0]:
                    # Read backwards from the end to find the start.
                    back = given[lo : lo + stop][::-1]
                    _, length = distance_in(whole[::-1], masks_of(whole[::-1]), back)
                    out[n] = (best, lo + stop - length, lo + stop)
        return out


def _blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The test items in blocks whose size is bounded."""
    given = items.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").alias("text")).where("text is not null")
    chars = given.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]
    blocks = max(1, -(-chars // BLOCK_CHARS))
    cut = given.withColumn("_block", F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)))
    for b in range(blocks):
        yield [(r["item_id"], r["text"]) for r in cut.where(F.col("_block") == b).orderBy("item_id", "text").collect()]


def find_leaks(docs: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """``doc_id, item_id, distance, item_chars, start, end`` for every item in every document.

    Places count characters of the compared text.
    """
    spark = docs.sparkSession
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)

        def seek(batches: Iterator[pd.DataFrame], sent=sent) -> Iterator[pd.DataFrame]:
            searcher = Searcher(sent.value, budget)
            for batch in batches:
                rows = [
                    (doc_id, searcher.items[n][0], d, len(searcher.items[n][1]), a, b)
                    for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True)
                    for n, (d, a, b) in searcher.matches(text).items()
                ]
                made = pd.DataFrame(rows, columns=["doc_id", "item_id", "distance", "item_chars", "start", "end"])
                yield made.astype({"doc_id": "Int64", "item_id": "Int64"})

        found = given.mapInPandas(
            seek, "doc_id long, item_id long, distance int, item_chars int, start int, end int"
        )
        out = found if out is None else out.unionByName(found)
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, budget: float = BUDGET) -> DataFrame:
    """The documents that hold no test item; columns stay as they are."""
    spark = docs.sparkSession
    for block in _blocks(items):
        sent = spark.sparkContext.broadcast(block)
        held: dict = {}

        def clean(texts, sent=sent, held=held):
            if "searcher" not in held:
                held["searcher"] = Searcher(sent.value, budget)
            return [not held["searcher"].matches(t) for t in texts]

        docs = where_text(docs, clean)
    return docs


@query("op2_decontaminate")
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every benchmark item found in every document."""
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
