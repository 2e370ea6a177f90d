"""Repeated passages: MinHash banding of paragraphs, and all repeated runs of words.

A paragraph is a line of at least ``LEAST_WORDS`` words. Equal paragraphs are one
item. Signatures of the five-word shingles are banded; paragraphs that share a band
are verified on the exact Jaccard similarity of their shingle sets, and links make
components (``linking``). In each component the paragraph that comes first by
document id and position stays; the others are marked for removal.

Lines do not bound the second search: every run of ``RUN`` words that occurs more
than once is found wherever it lies, inside a long line or across short ones. Of the
``ANCHOR``-word grams of a run the one with the smallest hash is its anchor, so equal
runs have equal anchors. The runs whose anchor occurs twice are hashed; runs with
equal hashes are equal. The first place of a run stays. Neighbouring runs with the same class are one passage; a
passage that lies in paragraphs of the first search with the same verdict is not
given again. Passages may overlap. Runs that differ in a word are found only as
paragraphs.

Words are compared without case and punctuation, so a passage repeated with other
marks around its words is found.

Null and empty texts have no passages. A paragraph repeated inside one document
counts as repeated. Repeated rows repeat all their paragraphs; with a null id
they sort last. Texts are read whole. An empty table gives no rows; extra columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fieldglass.llm import words
from fieldglass.llm.linking import link, overlap_of, pack_grams, shared_buckets
from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage
from fieldglass.llm.words import U64, mix

SIMILARITY = 0.8
LEAST_WORDS = 40
#: Paragraphs are mostly either copies or unlike, so short bands are cheap: 10 bands
#: of 3 miss a pair at the threshold once in about 1,300 times.
BANDS, ROWS = 10, 3
HASHES = BANDS * ROWS
#: Words of the grams that bring equal runs together, and of the shortest run found anywhere.
ANCHOR = 25
RUN = 2 * ANCHOR
#: Factor of one word's place in a rolling value.
_STEP = 0xD1342543DE82EF95
BLOCK_SCHEMA = (
    "row long, doc_id long, at int, n int, anchor long, key long, runs array<long>, starts array<int>, ends array<int>, covers array<tinyint>"
)
COLUMNS = ["doc_id", "start", "end", "n_words", "class_id", "class_size", "removed"]


def paragraphs(text: str) -> list[tuple[int, int]]:
    """Start and end of each line of a text, in characters."""
    out, at = [], 0
    for line in text.split("\n"):
        out.append((at, at + len(line)))
        at += len(line) + 1
    return out


def judged(texts) -> Iterator[tuple[list[int], list[int], list[int], list[str]]]:
    """Lines with enough words, in groups of bounded size: text numbers, starts, ends, lower-cased lines."""
    owner, starts, ends, lines, size = [], [], [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        for a, b in paragraphs(text):
            line = text[a:b]
            # A line with enough words has at least one character and one gap for each.
            if b - a < 2 * LEAST_WORDS - 1:
                continue
            owner.append(i)
            starts.append(a)
            ends.append(b)
            lines.append(line.lower())
            size += b - a
            if size > 1 << 20:
                yield owner, starts, ends, lines
                owner, starts, ends, lines, size = [], [], [], [], 0
    if lines:
        yield owner, starts, ends, lines


def content_keys(words_in: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """A hash of the word sequence of each line."""
    at = np.arange(len(words_in)) - np.repeat(np.cumsum(counts) - counts, counts)
    marked = mix(words_in + mix(at.astype(U64) + U64(1)))
    sums = np.zeros(len(words_in) + 1, dtype=U64)
    np.cumsum(marked, out=sums[1:])
    ends = np.cumsum(counts)
    return mix(sums[ends] - sums[ends - counts] + mix(counts.astype(U64))).view(np.int64)


def _factors() -> tuple[np.ndarray, np.ndarray]:
    draw = np.random.default_rng(11)
    a = draw.integers(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
    return a, draw.integers(0, 2**63, HASHES, dtype=np.int64).astype(np.uint64)


def signatures(shingles: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """MinHash values, one row per line; every line has a shingle."""
    a, b = _factors()
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), HASHES), dtype=np.uint64)
    held = np.empty_like(shingles)
    for i in range(HASHES):
        np.multiply(shingles, a[i], out=held)
        held += b[i]
        held ^= held >> np.uint64(29)
        out[:, i] = np.minimum.reduceat(held, starts)
    return out


def band_keys(found: np.ndarray) -> np.ndarray:
    rows = found.reshape(len(found), BANDS, ROWS)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=U64), (len(found), BANDS)).copy()
    for i in range(ROWS):
        key = mix(key * U64(0x9E3779B97F4A7C15) + rows[:, :, i])
    return key.view(np.int64)


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The judged paragraphs with their place, content key and bands."""
    for batch in batches:
        ids, numbers = batch["doc_id"].to_numpy(), batch["row"].to_numpy()
        for owner, starts, ends, lines in judged(batch["text"].tolist()):
            found, counts = words.word_hashes([x.encode("utf-8", "replace") for x in lines])
            enough = counts >= LEAST_WORDS
            found, counts = found[np.repeat(enough, counts)], counts[enough]
            if not len(counts):
                continue
            shingles, n = words.shingles_of(found, counts)
            yield pd.DataFrame(
                {
                    "row": numbers[owner][enough],
                    "doc_id": ids[owner][enough],
                    "start": np.array(starts)[enough],
                    "end": np.array(ends)[enough],
                    "n_words": counts,
                    "item": content_keys(found, counts),
                    "bands": list(band_keys(signatures(shingles, n))),
                }
            )


def _read_grams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The shingles of the given lines."""
    for batch in batches:
        items, lines = [], []
        for text, own, starts, ends in zip(batch["text"], batch["items"], batch["starts"], batch["ends"], strict=True):
            items.extend(own)
            lines.extend(text[a:b].lower() for a, b in zip(starts, ends, strict=True))
        for first, data in words.chunks(lines):
            shingles, n = words.shingle_hashes(data)
            grams = [pack_grams(p) for p in np.split(shingles, np.cumsum(n)[:-1])]
            yield pd.DataFrame({"item": items[first : first + len(data)], "grams": grams})


def _joined(left: np.ndarray, right: np.ndarray, width: int) -> np.ndarray:
    """The rolling values of two neighbouring stretches as one; ``width`` words in the second."""
    return left[: len(right)] * U64(pow(_STEP, width, 1 << 64)) + right


def _rolled(found: np.ndarray, width: int) -> np.ndarray:
    """A rolling value of each ``width`` words in a row, put together from halves."""
    if width == 1:
        return found
    half = width // 2
    out = _rolled(found, half)
    out = _joined(out, out[half:], half)
    return _joined(out, found[2 * half :], 1) if width % 2 else out


def _leading(grams: np.ndarray) -> np.ndarray:
    """The place of the smallest gram, the first of equal ones, in each window of grams that one run holds."""
    at, width, whole = np.arange(len(grams)), 1, RUN - ANCHOR + 1
    while width < whole:
        step = min(width, whole - width)
        a, b = at[:-step], at[step:]
        at = np.where(grams[a] <= grams[b], a, b)
        width += step
    return at


def _runs(texts: pd.Series) -> Iterator[tuple]:
    """Groups of texts of bounded size, with the rolling values of their words.

    Gives the first text's number, the lower-cased texts, the joined bytes, word starts
    and ends in them, each word's text, rolling values and hashes of ``ANCHOR`` words,
    whether the run from each word stays in its text, and the place of its anchor.
    """
    for first, data in words.chunks(words.lowered(texts)):
        joined, starts, ends, owner = words.word_spans(data)
        if len(starts) < RUN:
            continue
        rolled = _rolled(words.span_hashes(joined, starts, ends), ANCHOR)
        grams = mix(rolled)
        whole = owner[: len(starts) - RUN + 1] == owner[RUN - 1 :]
        yield first, data, joined, starts, ends, owner, rolled, grams, whole, _leading(grams)


def _read_anchors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The anchors of all runs; ``at`` counts words."""
    for batch in batches:
        rows = batch["row"].to_numpy()
        for first, _, _, _, _, owner, _, grams, whole, leading in _runs(batch["text"]):
            at = np.unique(leading[whole])
            begin = np.searchsorted(owner, owner[at])
            yield pd.DataFrame({"row": rows[first + owner[at]], "key": grams[at].view(np.int64), "at": at - begin})


def _places(text: str, data: bytes, at: np.ndarray) -> np.ndarray:
    """Characters of a text before each place in its lower-cased bytes; places are at edges of words."""
    sizes = np.zeros(len(data) + 1, dtype=np.int64)
    np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80, out=sizes[1:])
    if sizes[-1] == len(text):
        return sizes[at]
    # Some characters have a longer lower case.
    return np.searchsorted(np.cumsum([len(c.lower().encode("utf-8", "replace")) for c in text]), at, side="left") + (at > 0)


def _flat(lists) -> tuple[np.ndarray, np.ndarray]:
    """The values of many lists, null ones empty, and the list each comes from."""
    held = [np.asarray(x if x is not None else (), dtype=np.int64) for x in lists]
    sizes = [len(x) for x in held]
    return np.concatenate(held), np.repeat(np.arange(len(held)), sizes)


def _read_blocks(batches):
    """The runs whose anchor is among the given ones; neighbouring runs with one anchor are a block.

    ``covers`` of a run is 1 if found paragraphs cover it, 2 if removed ones do. Equal
    blocks have equal keys.
    """
    import pyarrow as pa

    for batch in batches:
        part = batch.to_pandas()
        ids = batch.column("doc_id")
        for first, data, joined, starts, ends, owner, rolled, grams, whole, leading in _runs(part["text"]):
            here = part.iloc[first : first + len(data)]
            begin = np.searchsorted(owner, np.arange(len(data)))
            at, text_of = _flat(here["ats"])
            wanted = np.zeros(len(starts), dtype=bool)
            wanted[begin[text_of] + at] = True
            kept = np.flatnonzero(whole & wanted[leading])
            if not len(kept):
                continue
            new = np.flatnonzero(np.concatenate([[True], leading[kept[1:]] != leading[kept[:-1]]]))
            sizes = np.diff(np.append(new, len(kept)))
            runs = mix(_joined(rolled, rolled[ANCHOR:], ANCHOR))[kept]

            bytes_before = np.cumsum([0] + [len(x) + 1 for x in data])
            edges = np.append(begin, len(starts))
            for i, (text, lower) in enumerate(zip(here["text"], data, strict=True)):
                own = slice(edges[i], edges[i + 1])
                starts[own] = _places(text or "", lower, starts[own] - bytes_before[i])
                ends[own] = _places(text or "", lower, ends[own] - bytes_before[i])
            # Places of all texts in one row of numbers, so that lines of all texts are looked up at once.
            ahead = np.cumsum([0] + [len(x or "") + 1 for x in here["text"]])
            placed = ahead[owner] + starts
            line_start, line_of = _flat(here["starts"])
            line_end, line_gone = _flat(here["ends"])[0], _flat(here["removed"])[0].astype(bool)
            a = np.searchsorted(placed, ahead[line_of] + line_start)
            b = np.searchsorted(placed, ahead[line_of] + line_end)
            covers = np.zeros(len(kept), dtype=np.int8)
            for chosen in (np.ones(len(a), dtype=bool), line_gone):
                depth = np.zeros(len(starts) + 1, dtype=np.int64)
                np.add.at(depth, a[chosen], 1)
                np.add.at(depth, b[chosen], -1)
                sums = np.concatenate([[0], np.cumsum(np.cumsum(depth[:-1]) > 0)])
                covers += sums[kept + RUN] - sums[kept] == RUN

            head, tail = new, new + sizes - 1
            key = mix(runs[head] + mix(runs[tail] + sizes.astype(U64)))
            offsets = pa.array(np.append(new, len(kept)), pa.int32())

            def each(values, kind, offsets=offsets):
                return pa.ListArray.from_arrays(offsets, pa.array(values, kind))

            texts_of = owner[kept[head]]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("row").take(pa.array(first + texts_of)),
                    ids.take(pa.array(first + texts_of)),
                    pa.array(kept[head] - begin[texts_of], pa.int32()),
                    pa.array(sizes, pa.int32()),
                    pa.array(grams[leading[kept[head]]].view(np.int64)),
                    pa.array(key.view(np.int64)),
                    each(runs.view(np.int64), pa.int64()),
                    each(starts[kept], pa.int32()),
                    each(ends[kept + RUN - 1], pa.int32()),
                    each(covers, pa.int8()),
                ],
                names=[x.split()[0] for x in BLOCK_SCHEMA.split(", ")],
            )


def repeated_runs(texts: DataFrame, lines: DataFrame) -> DataFrame:
    """The passages of repeated runs of words; takes ``row, doc_id, text`` and the found paragraphs of the rows.

    Equal runs have equal anchors. Where all blocks of an anchor are equal (of one kind),
    their runs are classed as one; of the other kinds one block each is unfolded into
    single runs.
    """
    anchors = stage(texts.select("row", "text").mapInPandas(_read_anchors, "row long, key long, at int"), "anchors")
    often = anchors.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    wanted = anchors.join(often, "key", "left_semi").groupBy("row").agg(F.collect_list("at").alias("ats"))
    held = lines.groupBy("row").agg(F.collect_list(F.struct("start", "end", "removed")).alias("lines"))
    blocks = stage(
        texts.join(wanted, "row")
        .join(held, "row", "left")
        .select("row", "doc_id", "text", "ats", F.col("lines.start").alias("starts"), F.col("lines.end").alias("ends"), F.col("lines.removed").alias("removed"))
        .mapInArrow(_read_blocks, BLOCK_SCHEMA),
        "blocks",
    )

    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row", "at")
    kinds = stage(
        blocks.groupBy("anchor", "key").agg(
            F.count("*").alias("class_size"), F.min("doc_id").alias("class_id"), F.min(place).alias("_first"), F.min("n").alias("n")
        ),
        "kinds",
    )
    per_anchor = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"))
    alone = (F.col("kinds") == 1) & (F.col("class_size") > 1)
    kinds = stage(kinds.join(per_anchor, "anchor").where(alone | (F.col("kinds") > 1)).drop("anchor"), "kinds")
    fields = ["key", "pos", "n", "class_size", "class_id", F.col("_first.row").alias("first_row")]
    whole = kinds.where("kinds = 1").select(*fields[:1], F.lit(0).alias("pos"), *fields[2:], F.col("_first.at").alias("first_at"))
    # One block of each other kind is unfolded.
    one = kinds.where("kinds > 1").select("key", "class_size", "class_id", "_first", F.col("_first.row").alias("row"), F.col("_first.at").alias("at"))
    single = stage(
        blocks.select("row", "at", "runs")
        .join(one, ["row", "at"])
        .select("key", "class_size", "class_id", "_first", F.posexplode("runs").alias("pos", "run")),
        "runs",
    )
    place = F.struct("_first.no_id", "_first.doc_id", "_first.row", (F.col("_first.at") + F.col("pos")).alias("at"))
    several = (
        single.groupBy("run")
        .agg(F.sum("class_size").alias("class_size"), F.min("class_id").alias("class_id"), F.min(place).alias("_first"))
        .where("class_size > 1")
    )
    # Neighbouring runs of a kind that have their class and the offset to its first place in common are one part.
    shared = ["key", "class_size", "class_id", "first_row", "first_at"]
    marked = single.select("key", "pos", "run").join(several, "run").select(
        *["key", "pos", "class_size", "class_id"], F.col("_first.row").alias("first_row"), (F.col("_first.at") - F.col("pos")).alias("first_at")
    )
    nth = F.row_number().over(Window.partitionBy(*shared).orderBy("pos"))
    parts = (
        marked.withColumn("part", F.col("pos") - nth)
        .groupBy(*shared, "part")
        .agg(F.min("pos").alias("pos"), F.count("*").cast("int").alias("n"))
    )
    classes = stage(whole.unionByName(parts.drop("part")), "kinds")
    own = F.slice("covers", F.col("pos") + 1, F.col("n"))
    removed = (F.col("row") != F.col("first_row")) | (F.col("begin") != F.col("first_at"))
    found = (
        blocks.select("key", "row", "doc_id", F.col("at").alias("begin"), "starts", "ends", "covers")
        .join(classes, "key")
        .select(
            "row",
            "doc_id",
            (F.col("begin") + F.col("pos")).alias("at"),
            "n",
            F.get("starts", F.col("pos")).alias("start"),
            F.get("ends", F.col("pos") + F.col("n") - 1).alias("end"),
            "class_size",
            "class_id",
            removed.alias("removed"),
            (F.array_min(own) >= F.when(removed, 2).otherwise(1)).alias("covered"),
        )
    )
    # Neighbouring runs of one class are a passage.
    along = Window.partitionBy("row").orderBy("at")
    before = F.lag(F.struct((F.col("at") + F.col("n")).alias("at"), "class_id", "class_size", "removed")).over(along)
    goes_on = before.eqNullSafe(F.struct("at", "class_id", "class_size", "removed"))
    return (
        found.withColumn("first", F.when(goes_on, 0).otherwise(1))
        .withColumn("passage", F.sum("first").over(along))
        .groupBy("row", "doc_id", "passage", "class_id", "class_size", "removed")
        .agg(
            F.min("start").alias("start"),
            F.max("end").alias("end"),
            (F.sum("n") + (RUN - 1)).cast("int").alias("n_words"),
            F.min("covered").alias("covered"),
        )
        .where("not covered")
        .select(COLUMNS)
    )


def repeated_passages(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """``doc_id, start, end, n_words, class_id, class_size, removed`` of every repeated passage.

    Places count characters; ``class_id`` is the smallest id among the documents
    of the class.
    """
    texts = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("row")), "texts", "zstd")
    read = stage(
        texts.mapInPandas(_read, "row long, doc_id long, start int, end int, n_words int, item long, bands array<long>"),
        "paragraphs",
    )
    shared = shared_buckets(read.select("item", "bands").dropDuplicates(["item"]))
    # The shingles are read from one place of each paragraph that shares a bucket.
    wanted = shared.select("item").distinct()
    chosen = read.groupBy("item").agg(F.min(F.struct("row", "start", "end")).alias("p")).join(wanted, "item", "left_semi")
    chosen = chosen.groupBy("p.row").agg(F.collect_list(F.struct("item", "p.start", "p.end")).alias("lines"))
    grams = stage(
        texts.join(chosen, "row")
        .select("text", F.col("lines.item").alias("items"), F.col("lines.start").alias("starts"), F.col("lines.end").alias("ends"))
        .mapInPandas(_read_grams, "item long, grams binary"),
        "grams",
    )
    groups = link(shared, grams, overlap_of(least))
    place = F.struct(F.col("doc_id").isNull(), "doc_id", "start", "row")
    placed = stage(
        read.select("row", "doc_id", "start", "end", "n_words", "item", place.alias("_place"))
        .join(groups, "item", "left")
        .withColumn("group", F.coalesce("group", "item")),
        "placed",
    )
    classes = (
        placed.groupBy("group")
        .agg(F.count("*").alias("class_size"), F.min("_place").alias("_first"), F.min("doc_id").alias("class_id"))
        .where("class_size > 1")
    )
    lines = stage(
        placed.join(classes, "group").withColumn("removed", F.col("_place") != F.col("_first")).select("row", *COLUMNS),
        "lines",
    )
    return lines.select(COLUMNS).unionByName(repeated_runs(texts, lines))


@query("op1_repeated_passages")
def op1_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All passages that occur more than once in the documents."""
    return repeated_passages(table(spark, sf_dir, "documents"))
