"""Quality scores learnt from preference pairs (Bradley-Terry).

Every labelled text of quality 1 is preferred to every one of quality 0. A text's
score is a weighted sum of features of the whole text; the weights minimise the
logistic loss of score differences over pairs. The threshold is the score
quantile at the share of quality-0 rows among the labelled ones; a logistic curve
maps it to 0.7 and all scores into 0 to 1.

Labels of held-out rows (``crc32(doc_id as text) mod 4 = 2``) are never read.
``lang``, ``source`` and ``doc_id`` are no features. Every other labelled row is learnt
from: the features of the labelled texts are dealt by a hash of the id into cells of
about ``CELL_ROWS`` rows, and each step of the fit sums over the pairs of every cell, in
which each row of the more frequent quality meets ``PARTNERS`` of the other. A cell that
holds one quality only adds to the mean, the spread and the threshold, but has no pairs. The number of
all pairs is a product, so not every pair is used. The threshold comes from all scores, exact in
rank up to ``1 / RANKS`` of them.

Empty and null texts have features of an empty text. Rows with a null id are
scored and not held out. Repeated rows get equal scores. Without labels of both
qualities no pair exists and every score is 0.7. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fieldglass.llm import words
from fieldglass.llm.register import query, table
from fieldglass.llm.shared import stage, where_text

#: Labelled rows of a cell, about; pairs of a row; ranks that the threshold tells apart.
CELL_ROWS = 16_384
PARTNERS = 16
RANKS = 100_000
HELD_OUT_REMAINDER = 2
THRESHOLD = 0.7
RIDGE = 1e-3
SYMBOLS = b"#$%&*@^~`<>{}[]=+_\\/|"


def _byte_classes() -> np.ndarray:
    groups = np.zeros(256, dtype=np.int64)
    for b in range(256):
        c = chr(b)
        groups[b] = (
            0 if b >= 128 else 1 if c.islower() else 2 if c.isupper() else 3 if c.isdigit() else 4 if c == " "
            else 5 if c == "\n" else 6 if c == "." else 7 if c == "," else 8 if c == "!" else 9 if c == "|"
            else 10 if b in SYMBOLS else 11
        )
    return groups


_CLASSES = _byte_classes()
FEATURES = 12 + 12 + 8


def features(texts) -> np.ndarray:
    """One row of numbers per text; the whole text is read."""
    out = []
    for _, data in words.chunks(texts):
        joined, starts, ends, owner = words.word_spans(data)
        n = len(data)
        sizes = np.array([len(d) for d in data], dtype=float)
        text_of = np.repeat(np.arange(n), [len(d) + 1 for d in data])
        counts = np.bincount(text_of * 12 + _CLASSES[joined], minlength=12 * n).reshape(n, 12).astype(float)
        counts[:, 5] -= 1  # the line break that joins texts
        share = counts / np.maximum(sizes, 1)[:, None]
        hashes = words.span_hashes(joined, starts, ends)
        n_words = np.bincount(owner, minlength=n).astype(float)
        per = np.maximum(n_words, 1)
        word_bytes = np.bincount(owner, weights=ends - starts, minlength=n) / per
        first_upper = np.bincount(owner, weights=_CLASSES[joined[starts]] == 2, minlength=n) / per
        last_upper = np.bincount(owner, weights=_CLASSES[joined[ends - 1]] == 2, minlength=n) / per
        # Words followed by a mark that is neither white space, full stop nor comma.
        marked = np.bincount(owner, weights=~np.isin(_CLASSES[joined[ends]], (4, 5, 6, 7)), minlength=n) / per
        short = np.bincount(owner, weights=(ends - starts) <= 3, minlength=n) / per
        order = np.lexsort((hashes, owner))
        o, h = owner[order], hashes[order]
        new = np.ones(len(o), dtype=bool)
        new[1:] = (o[1:] != o[:-1]) | (h[1:] != h[:-1])
        distinct = np.bincount(o[new], minlength=n) / np.sqrt(per)
        extra = np.stack(
            [np.log1p(sizes), np.log1p(n_words), word_bytes, first_upper, last_upper, marked, short, distinct], axis=1
        )
        out.append(np.concatenate([share, np.sqrt(np.maximum(share, 0)), extra], axis=1))
    return np.concatenate(out) if out else np.empty((0, FEATURES))


def _moments(good: np.ndarray, bad: np.ndarray) -> np.ndarray:
    """Rows of each quality, means, and sums of squares about them."""
    x = np.concatenate([good, bad])
    mean = x.mean(axis=0)
    return np.concatenate([[len(good), len(bad)], mean, ((x - mean) ** 2).sum(axis=0)])


def _slopes(good: np.ndarray, bad: np.ndarray, model: dict) -> np.ndarray:
    """Pairs of a cell and, summed over them, the gradient and curvature of their loss."""
    n_pairs, grad, curve = 0, np.zeros(FEATURES), np.zeros((FEATURES, FEATURES))
    if len(good) and len(bad):
        g, b, at = _scaled(good, model), _scaled(bad, model), np.arange(max(len(good), len(bad)))
        for k in range(PARTNERS):
            # The rows of the rarer quality are gone through in turn, from another one each time.
            turn = at + k * max(1, min(len(g), len(b)) // PARTNERS)
            d = g[(at if len(g) >= len(b) else turn) % len(g)] - b[(turn if len(g) >= len(b) else at) % len(b)]
            p = 1 / (1 + np.exp(-np.clip(d @ model["weights"], -30, 30)))
            n_pairs += len(d)
            grad += d.T @ (p - 1)
            curve += (d * (p * (1 - p))[:, None]).T @ d
    return np.concatenate([[n_pairs], grad, curve.ravel()])


def _scaled(x: np.ndarray, model: dict) -> np.ndarray:
    return np.clip((x - model["centre"]) / model["spread"], -8, 8)


def _fitted(over, quantile) -> dict[str, np.ndarray | float]:
    """Weights by Newton steps, and the threshold.

    ``over(f)`` gives ``f(good, bad)`` of every cell, always in the same order;
    ``quantile(model, share)`` that quantile of all rows' scores.
    """
    found = over(_moments)
    model = {"centre": np.zeros(FEATURES), "spread": np.full(FEATURES, 1e-9), "weights": np.zeros(FEATURES), "threshold": 0.0}
    if not found:
        return model
    sizes = np.array([m[0] + m[1] for m in found])
    means, squares = np.array([m[2 : 2 + FEATURES] for m in found]), np.array([m[2 + FEATURES :] for m in found])
    n_good, n_bad = sum(m[0] for m in found), sum(m[1] for m in found)
    model["centre"] = (sizes[:, None] * means).sum(axis=0) / sizes.sum()
    spread = (squares + sizes[:, None] * (means - model["centre"]) ** 2).sum(axis=0) / sizes.sum()
    model["spread"] = np.sqrt(spread) + 1e-9
    if not n_good or not n_bad:
        return model
    for _ in range(12):
        total = sum(over(lambda good, bad, model=dict(model): _slopes(good, bad, model)))
        if not total[0]:
            return model
        grad = total[1 : 1 + FEATURES] / total[0] + RIDGE * model["weights"]
        curve = total[1 + FEATURES :].reshape(FEATURES, FEATURES) / total[0] + RIDGE * np.eye(FEATURES)
        step = np.linalg.solve(curve, grad)
        model["weights"] = model["weights"] - step
        if np.abs(step).max() < 1e-6:
            break
    model["threshold"] = float(quantile(model, float(n_bad / (n_good + n_bad))))
    return model


def fit(x: np.ndarray, quality: np.ndarray) -> dict[str, np.ndarray | float]:
    """The model of one cell of rows."""
    good, bad = x[quality == 1], x[quality == 0]
    both = np.concatenate([good, bad])
    return _fitted(
        lambda f: [f(good, bad)] if len(both) else [],
        lambda model, share: np.quantile(_scaled(both, model) @ model["weights"], share),
    )


def score(x: np.ndarray, model: dict) -> np.ndarray:
    s = _scaled(x, model) @ model["weights"] - model["threshold"]
    return 1 / (1 + np.exp(-np.clip(s + np.log(THRESHOLD / (1 - THRESHOLD)), -700, 700)))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4 == HELD_OUT_REMAINDER, F.lit(False))


def _cells(docs: DataFrame, labels: DataFrame, cell_rows: int) -> DataFrame:
    """``cell, good, bad``: the features of the labelled rows outside the held-out fold, a row per cell."""
    usable = F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))
    chosen = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), "quality").where(F.col("quality").isin(0, 1) & usable).distinct()
    )
    cells = max(1, -(-chosen.count() // cell_rows))

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            x = features(batch.column(2).to_pylist())
            ends = pa.array(np.arange(len(x) + 1) * FEATURES, pa.int32())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.ListArray.from_arrays(ends, pa.array(x.ravel()))], names=["doc_id", "hash", "x"])

    def pack(table):
        import pyarrow as pa

        order = table.sort_by([("doc_id", "ascending"), ("hash", "ascending")])
        x = order.column("x").combine_chunks().flatten().to_numpy().reshape(-1, FEATURES)
        quality = order.column("quality").to_numpy()
        parts = [pa.array([x[quality == q].tobytes()], pa.binary()) for q in (1, 0)]
        return pa.Table.from_arrays([table.column("cell").combine_chunks().slice(0, 1), *parts], names=["cell", "good", "bad"])

    # Texts stay in the task that read them; their features are joined with the labels.
    given = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("hash"), "text").where(usable)
    rows = given.mapInArrow(read, "doc_id long, hash long, x array<double>").join(chosen, "doc_id")
    once = rows.dropDuplicates(["doc_id", "quality", "hash"]).withColumn("cell", F.pmod(F.xxhash64("doc_id"), F.lit(cells)))
    return stage(once.groupBy("cell").applyInArrow(pack, "cell long, good binary, bad binary"), "quality-cells")


def learn(docs: DataFrame, labels: DataFrame, cell_rows: int = CELL_ROWS) -> dict:
    """Fit on all labelled rows outside the held-out fold; sums of the cells reach the driver, no rows."""
    cells = _cells(docs, labels, cell_rows)

    def rows_of(batches):
        for batch in batches:
            for cell, *parts in zip(*batch.columns, strict=True):
                yield cell.as_py(), [np.frombuffer(p.as_py(), dtype=float).reshape(-1, FEATURES) for p in parts]

    def over(f):
        def run(batches):
            import pyarrow as pa

            for cell, (good, bad) in rows_of(batches):
                yield pa.RecordBatch.from_pydict({"cell": [cell], "sums": pa.array([f(good, bad).tobytes()], pa.binary())})

        found = cells.mapInArrow(run, "cell long, sums binary").collect()
        return [np.frombuffer(r["sums"], dtype=float) for r in sorted(found, key=lambda r: r["cell"])]

    def quantile(model, share):
        def run(batches):
            import pyarrow as pa

            for _, parts in rows_of(batches):
                yield pa.RecordBatch.from_pydict({"s": _scaled(np.concatenate(parts), model) @ model["weights"]})

        return cells.mapInArrow(run, "s double").agg(F.percentile_approx("s", F.lit(share), F.lit(RANKS))).first()[0]

    return _fitted(over, quantile)


def score_documents(docs: DataFrame, model: dict) -> DataFrame:
    """All columns of the documents and ``score``, in place of any column of that name; texts alone decide."""
    docs = docs.drop("score")

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
            yield batch.append_column("score", pa.array(score(features(texts), model), pa.float64()))

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))


def drop_rejected(docs: DataFrame, model: dict, least: float = THRESHOLD) -> DataFrame:
    """The documents that score at least ``least``; columns stay as they are."""
    return where_text(docs, lambda texts: score(features(texts), model) >= least)


@query("op5_quality_scores")
def op5_quality_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = learn(docs, table(spark, sf_dir, "labels"))
    scored = score_documents(docs, model)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= THRESHOLD).cast("int").alias("predicted"),
    )
