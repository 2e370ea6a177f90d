"""Toxicity by the nearest labelled examples under TF-IDF cosine.

At most ``LABELLED`` labelled documents are the examples. Their terms are the
dimensions, as far as they tell the labels apart (chi-squared of at least
``LEAST_CHI`` over the examples); document frequencies are counted over all documents.
A text is the vector of ``(1 + ln tf) ln((1 + N) / (1 + df))`` over these terms, scaled
to length one.

The examples lie in an inverted index cut into blocks of ``BLOCK`` examples, and
each term keeps its greatest weight in every block. The weights of a text times
these maxima bound the cosine of all examples of a block, so blocks are read in
falling order of their bound, and no more when the bounds lie under the similarity of
the last of the ``NEIGHBOURS`` nearest found: the result is exact (similarities are compared
by nine digits). The neighbours vote
with their similarity; ``PRIOR`` of a vote at the share of toxic examples is added, so
that far neighbours say little. Votes become probabilities by a monotone fit on the
examples themselves, each scored without its own document. The neighbours are the
evidence.

Labels of held-out rows (``crc32(doc_id as text) mod 4 = 2``) are never read;
``lang``, ``source`` and ``doc_id`` are no input of a score. Terms are runs of ASCII
letters, digits and characters outside ASCII, in lower case.

Null and empty texts, and texts without a term of the index, have no neighbours and
get the score of such texts. Rows with a null id are scored and not held out. Equal
similarities rank by example (id, then text). Repeated rows get equal scores;
examples with several labels vote with each. Without labels of both kinds all scores are the
share of toxic examples (0 without any). Texts are read whole. An empty table gives no rows; extra columns stay.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage

#: Labelled rows that serve as examples, at most, chosen by a hash of the id.
LABELLED = 20_000
NEIGHBOURS = 15
#: Examples of one block of the index.
BLOCK = 64
#: Blocks read before the first look at the bounds; eight times as many at each further look.
FIRST_BLOCKS = 4
#: Least chi-squared of a term over the examples and their labels.
LEAST_CHI = 25.0
#: Weight of the share of toxic examples among the votes.
PRIOR = 1.0
THRESHOLD = 0.3
HELD_OUT_REMAINDER = 2
#: Neighbours named as evidence.
SHOWN = 5

_LOWER = bytes(
    b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256)
)


def terms_of(text: str | None) -> list[bytes]:
    return (text or "").lower().encode("utf-8", "replace").translate(_LOWER).split()


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def _runs(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers of the runs that begin at ``first``, one after another."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


class Model:
    """Dimensions, the block-max index of the examples, and the fit of votes to probabilities."""

    def __init__(self, number: dict[bytes, int], idf: np.ndarray):
        self.number, self.idf = number, idf
        self.curve: tuple[np.ndarray, np.ndarray] | None = None
        self.index([])

    def vector(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Dimensions and weights of a text, length one."""
        found = Counter(filter(lambda x: x is not None, map(self.number.get, terms_of(text))))
        return self.scaled(found)

    def scaled(self, found: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        at = np.fromiter(found.keys(), dtype=np.int64, count=len(found))
        tf = np.fromiter(found.values(), dtype=float, count=len(found))
        order = np.argsort(at)
        at, w = at[order], ((1 + np.log(tf)) * self.idf[at])[order]
        norm = np.sqrt((w * w).sum())
        return (at, w / norm) if norm > 0 else (at[:0], w[:0])

    def index(self, examples: list[tuple[int, int, dict[int, int]]]) -> None:
        """Lay out ``(id, toxic, term counts)`` in blocks; examples with the same heaviest term lie together."""
        vectors = [(i, y, *self.scaled(found)) for i, y, found in examples]
        vectors.sort(key=lambda v: (int(v[2][np.argmax(v[3])]) if len(v[2]) else -1, v[0], v[1]))
        self.ids = np.array([v[0] for v in vectors], dtype=np.int64)
        self.toxic = np.array([v[1] for v in vectors], dtype=float)
        self.share = float(self.toxic.mean()) if len(vectors) else 0.0
        self.n_blocks = -(-len(vectors) // BLOCK)
        term = np.concatenate([v[2] for v in vectors]) if vectors else np.empty(0, dtype=np.int64)
        weight = np.concatenate([v[3] for v in vectors]) if vectors else np.empty(0)
        owner = np.repeat(np.arange(len(vectors)), [len(v[2]) for v in vectors])
        block = owner // BLOCK
        order = np.lexsort((owner, block, term))
        term, weight, owner, block = term[order], weight[order], owner[order], block[order]
        self.posting_example, self.posting_weight = owner, weight
        # One list per term and block; the lists of a term lie side by side.
        new = np.ones(len(term), dtype=bool)
        new[1:] = (term[1:] != term[:-1]) | (block[1:] != block[:-1])
        self.list_start = np.append(np.flatnonzero(new), len(term))
        self.list_block = block[new]
        self.list_peak = np.maximum.reduceat(weight, self.list_start[:-1]) if len(term) else weight
        self.list_size = np.diff(self.list_start)
        counts = np.bincount(term[new], minlength=len(self.idf))
        self.term_lists = np.append(0, np.cumsum(counts))

    def nearest(self, at: np.ndarray, w: np.ndarray, without: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and similarities of the nearest examples, exact; at most ``NEIGHBOURS`` with a similarity above 0.

        ``without`` is an id whose examples are left out.
        """
        none = np.empty(0, dtype=np.int64), np.empty(0)
        if not len(at) or not self.n_blocks:
            return none
        first, size = self.term_lists[at], self.term_lists[at + 1] - self.term_lists[at]
        lists = _runs(first, size)
        if not len(lists):
            return none
        weight = np.repeat(w, size)
        blocks = self.list_block[lists]
        bound = np.round(np.bincount(blocks, weights=weight * self.list_peak[lists], minlength=self.n_blocks), 9)
        order = np.argsort(-bound, kind="stable")
        best, least, last = none, 0.0, -1
        start, step = 0, FIRST_BLOCKS
        while start < len(order):
            turn = order[start : start + step]
            # A block bounded by the last neighbour's similarity matters only if its examples go before that one.
            turn = turn[(bound[turn] > least) | ((bound[turn] == least) & (turn * BLOCK < last))]
            if not len(turn):
                break
            wanted = np.zeros(self.n_blocks, dtype=bool)
            wanted[turn] = True
            read = wanted[blocks]
            lo, n = self.list_start[lists[read]], self.list_size[lists[read]]
            spot = _runs(lo, n)
            scores = np.bincount(
                self.posting_example[spot], weights=np.repeat(weight[read], n) * self.posting_weight[spot], minlength=1
            )
            hit = np.flatnonzero(scores)
            value = np.round(scores[hit], 9)
            ok = value >= max(least, 1e-9)
            if without is not None:
                ok &= self.ids[hit] != without
            number, value = np.concatenate([best[0], hit[ok]]), np.concatenate([best[1], value[ok]])
            top = np.lexsort((number, -value))[:NEIGHBOURS]
            best = number[top], value[top]
            if len(top) == NEIGHBOURS:
                least, last = best[1][-1], best[0][-1]
            start, step = start + step, step * 8
        return best

    def votes(self, number: np.ndarray, similarity: np.ndarray) -> float:
        return float(((similarity * self.toxic[number]).sum() + PRIOR * self.share) / (similarity.sum() + PRIOR))

    def fit_votes(self, votes: np.ndarray, toxic: np.ndarray) -> None:
        """Pool adjacent violators; between the pools' means the curve is straight."""
        if not len(votes) or toxic.min() == toxic.max():
            return
        order = np.argsort(votes, kind="stable")
        pools: list[list[float]] = []  # mean of toxic, rows, sum of votes
        for v, y in zip(votes[order], toxic[order], strict=True):
            pools.append([float(y), 1.0, float(v)])
            while len(pools) > 1 and (pools[-2][0] >= pools[-1][0] or pools[-2][2] / pools[-2][1] == pools[-1][2] / pools[-1][1]):
                y2, n2, v2 = pools.pop()
                y1, n1, v1 = pools.pop()
                pools.append([(y1 * n1 + y2 * n2) / (n1 + n2), n1 + n2, v1 + v2])
        x = np.array([v / n for _, n, v in pools])
        # One row of either kind is added, so that no score is certain.
        self.curve = x, np.array([(y * n + self.share) / (n + 1) for y, n, _ in pools])

    def probability(self, votes: np.ndarray) -> np.ndarray:
        if self.curve is None:
            return np.full(len(votes), self.share)
        return np.interp(votes, *self.curve)


def _examples(docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """``doc_id, toxic, text`` of the chosen labelled documents, written once."""
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
        .distinct()
        .orderBy(F.xxhash64("doc_id"), "doc_id", "toxic")
        .limit(most)
    )
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    # At most ``most`` rows are broadcast. Repeated rows are one example.
    found = given.join(F.broadcast(chosen), "doc_id").withColumn("_key", F.sha2("text", 256))
    return stage(found.dropDuplicates(["doc_id", "toxic", "_key"]).drop("_key"), "toxicity-examples")


def _term_labels(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        with_term: Counter = Counter()
        toxic: Counter = Counter()
        for text, y in zip(batch["text"], batch["toxic"], strict=True):
            words = set(terms_of(text))
            with_term.update(words)
            if y:
                toxic.update(words)
        yield pd.DataFrame(
            {"term": list(with_term), "n": list(with_term.values()), "toxic": [toxic[t] for t in with_term]}
        ).astype({"n": "int64", "toxic": "int64"})


def _dimensions(examples: DataFrame) -> list[bytes]:
    """The terms that tell the labels apart."""
    rows, toxic = examples.agg(F.count("*"), F.coalesce(F.sum("toxic"), F.lit(0))).first()
    if not toxic or toxic == rows:
        return []
    counts = examples.mapInPandas(_term_labels, "term binary, n long, toxic long").groupBy("term").agg(
        F.sum("n").alias("n"), F.sum("toxic").alias("toxic")
    )
    n, a = F.col("n").cast("double"), F.col("toxic").cast("double")
    # A term in one example, or in all, tells nothing that could be held against another.
    below = n * (rows - n) * toxic * (rows - toxic)
    chi = rows * F.pow(a * (rows - toxic - (n - a)) - (n - a) * (toxic - a), 2) / below
    return sorted(bytes(r["term"]) for r in counts.where((n > 1) & (n < rows) & (chi >= LEAST_CHI)).select("term").collect())


def _frequencies(docs: DataFrame, terms: list[bytes]) -> tuple[int, np.ndarray]:
    """How many documents there are, and how many hold each term, over all documents."""
    shared = docs.sparkSession.sparkContext.broadcast({t: i for i, t in enumerate(terms)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number, rows, held = shared.value, 0, Counter()
        for batch in batches:
            for text in batch["text"]:
                held.update(set(filter(lambda x: x is not None, map(number.get, terms_of(text)))))
            rows += len(batch)
        yield pd.DataFrame({"term": [-1, *held], "n": [rows, *held.values()]}).astype({"term": "int32", "n": "int64"})

    found = docs.select("text").mapInPandas(run, "term int, n long").groupBy("term").agg(F.sum("n").alias("n"))
    counts = {r["term"]: r["n"] for r in found.collect()}  # a row per dimension
    return counts.pop(-1, 0), np.array([counts.get(i, 0) for i in range(len(terms))], dtype=float)


def learn(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Model:
    """The model of a bounded number of labelled rows outside the held-out fold."""
    spark = docs.sparkSession
    examples = _examples(docs, labels, most)
    terms = _dimensions(examples)
    total, df = _frequencies(docs, terms) if terms else (0, np.empty(0))
    model = Model({t: i for i, t in enumerate(terms)}, np.log((1 + total) / (1 + df)))
    if not terms:
        model.share = float(examples.agg(F.coalesce(F.avg("toxic"), F.lit(0.0))).first()[0])
        return model

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [Counter(filter(lambda x: x is not None, map(model.number.get, terms_of(t)))) for t in batch["text"]]
            yield pd.DataFrame(
                {"doc_id": batch["doc_id"], "toxic": batch["toxic"], "at": [list(f) for f in found], "tf": [list(f.values()) for f in found]}
            )

    rows = examples.mapInPandas(counted, "doc_id long, toxic int, at array<int>, tf array<int>").collect()
    held = [(r["doc_id"], r["toxic"], dict(zip(r["at"], r["tf"], strict=True))) for r in rows]
    model.index(sorted(held, key=lambda e: (e[0], e[1], sorted(e[2].items()))))
    shared = spark.sparkContext.broadcast(model)

    def voted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for batch in batches:
            votes = [m.votes(*m.nearest(*m.vector(t), without=i)) for t, i in zip(batch["text"], batch["doc_id"], strict=True)]
            yield pd.DataFrame({"votes": votes, "toxic": batch["toxic"].astype(float)})

    own = examples.mapInPandas(voted, "votes double, toxic double").toPandas()
    model.fit_votes(own["votes"].to_numpy(), own["toxic"].to_numpy())
    return model


def score_documents(docs: DataFrame, model: Model) -> DataFrame:
    """All columns of the documents, ``score`` and ``evidence`` (the nearest examples as ``id:similarity``)."""
    docs = docs.drop("score", "evidence")
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        import pyarrow as pa

        m = shared.value
        for batch in batches:
            votes, evidence = [], []
            for text in batch.column(batch.schema.get_field_index("text")).to_pylist():
                number, sims = m.nearest(*m.vector(text))
                votes.append(m.votes(number, sims))
                evidence.append(" ".join(f"{m.ids[i]}:{s:.4f}" for i, s in zip(number[:SHOWN], sims[:SHOWN], strict=True)))
            scores = m.probability(np.array(votes, dtype=float))
            batch = batch.append_column("score", pa.array(scores, pa.float64()))
            yield batch.append_column("evidence", pa.array(evidence, pa.string()))

    added = [T.StructField("score", T.DoubleType()), T.StructField("evidence", T.StringType())]
    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, *added]))


@query("op12_toxicity")
def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = score_documents(docs, learn(docs, table(spark, sf_dir, "labels")))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
        "evidence",
    )
