import zlib

import numpy as np
from fieldglass.llm import quality as Q
from helpers import story
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def texts(n):
    return [story(i, 30 + i % 50) if i % 4 else " | ".join(story(i, 30 + i % 50).upper().split()) for i in range(n)]


def test_held_out_accuracy(spark, docs):
    given = texts(400)
    df = docs(*given)
    labels = spark.createDataFrame([(i, int(bool(i % 4)), 0) for i in range(400)], LABELS)
    rows = Q.score_documents(df, Q.learn(df, labels)).withColumn("out", Q.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["out"]]
    assert [r["doc_id"] for r in held] == [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = sum((r["score"] >= Q.THRESHOLD) == bool(r["doc_id"] % 4) for r in held)
    assert right / len(held) > 0.95


def test_held_out_labels_are_not_read(spark, docs):
    df = docs(*texts(200))
    rows = [(i, int(bool(i % 4)), 0) for i in range(200)]
    turned = [(i, 1 - q if zlib.crc32(str(i).encode()) % 4 == 2 else q, t) for i, q, t in rows]
    a, b = (Q.learn(df, spark.createDataFrame(x, LABELS)) for x in (rows, turned))
    assert np.array_equal(a["weights"], b["weights"]) and a["threshold"] == b["threshold"]


def test_pairs_decide():
    draw = np.random.default_rng(3)
    x = draw.normal(size=(500, Q.FEATURES))
    quality = (x[:, 3] - x[:, 5] > -1).astype(int)
    model = Q.fit(x, quality)
    good, bad = Q.score(x[quality == 1], model), Q.score(x[quality == 0], model)
    assert (good[:, None] > bad[None, :]).mean() > 0.97
    assert abs((Q.score(x, model) < Q.THRESHOLD).mean() - (quality == 0).mean()) < 0.02


def test_odd_rows(spark, docs):
    df = docs("", None, "?", "\n\n", (None, "words here"), (None, "words here"), "x" * 200_000, extra=True)
    labels = spark.createDataFrame([(0, 1, 0), (2, 0, 0), (2, 0, 0), (None, 1, 1), (3, None, None), (99, 1, 0)], LABELS)
    rows = Q.score_documents(df, Q.learn(df, labels)).collect()
    assert len(rows) == 7 and all(0 <= r["score"] <= 1 for r in rows)
    kept = Q.drop_rejected(df, Q.learn(df, labels))
    assert kept.schema == df.schema


def test_no_labels_and_no_documents(spark, docs):
    none = spark.createDataFrame([], LABELS)
    model = Q.learn(docs("a", "b"), none)
    assert [round(r["score"], 9) for r in Q.score_documents(docs("a", ""), model).collect()] == [0.7, 0.7]
    assert Q.score_documents(docs("a").where(F.lit(False)), model).collect() == []
    one = Q.learn(docs(*texts(20)), spark.createDataFrame([(i, 1, 0) for i in range(20)], LABELS))
    assert [round(r["score"], 9) for r in Q.score_documents(docs("a"), one).collect()] == [0.7]


def test_every_labelled_row_is_learnt_from(spark, docs):
    """One row more among many, and cells of any number, go into the model; how cells fall does not matter for the order of rows."""
    df = docs(*texts(300))
    rows = [(i, int(bool(i % 4)), 0) for i in range(300)]
    model = lambda some, size: Q.learn(df, spark.createDataFrame(some, LABELS), size)
    whole, again = model(rows, 40), model(rows[::-1], 40)
    assert np.array_equal(whole["weights"], again["weights"]) and whole["threshold"] == again["threshold"]
    learnt = [i for i in range(300) if zlib.crc32(str(i).encode()) % 4 != 2]
    want = Q.features([texts(300)[i] for i in learnt]).mean(axis=0)
    assert np.allclose(whole["centre"], want)
    right = sum((s >= Q.THRESHOLD) == bool(i % 4) for i, s in enumerate(Q.score(Q.features(texts(300)), whole)))
    assert right / 300 > 0.95
