import random
import zlib

import numpy as np
from fieldglass.llm import toxicity as X
from helpers import story
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grub", "sneer", "vile", "muck"]


def texts(n):
    """Every sixth text holds one or two bad words."""
    draw, out = random.Random(9), []
    for i in range(n):
        words = story(i, 40 + i % 60).split()
        if i % 6 == 0:
            for _ in range(1 + i % 2):
                words.insert(draw.randrange(len(words)), draw.choice(BAD))
        out.append(" ".join(words))
    return out


def labels_of(spark, n):
    return spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(n)], LABELS)


def test_held_out_rows(spark, docs):
    n = 900
    df = docs(*texts(n))
    model = X.learn(df, labels_of(spark, n))
    assert {b.encode() for b in BAD} <= set(model.number)
    rows = X.score_documents(df, model).withColumn("out", X.held_out(F.col("doc_id"))).collect()
    held = [r for r in rows if r["out"]]
    assert [r["doc_id"] for r in held] == [i for i in range(n) if zlib.crc32(str(i).encode()) % 4 == 2]
    caught = [r["score"] >= X.THRESHOLD for r in held if r["doc_id"] % 6 == 0]
    wrong = [r["score"] >= X.THRESHOLD for r in held if r["doc_id"] % 6]
    assert np.mean(caught) >= 0.95 and np.mean(wrong) <= 0.03
    # Scores are near the share of toxic texts among rows of that score.
    high = [r["doc_id"] % 6 == 0 for r in held if r["score"] > 0.8]
    assert np.mean(high) > 0.8
    named = next(r for r in held if r["score"] > 0.8)["evidence"].split()
    assert 0 < len(named) <= X.SHOWN and all(zlib.crc32(x.split(":")[0].encode()) % 4 != 2 for x in named)


def test_neighbours_are_exact():
    draw = np.random.default_rng(4)
    model = X.Model({b"t%d" % i: i for i in range(60)}, draw.uniform(0.5, 4, 60))
    examples = []
    for i in range(1500):
        at = draw.choice(60, size=draw.integers(0, 7), replace=False)
        examples.append((i // 2, int(draw.integers(0, 2)), {int(t): int(draw.integers(1, 4)) for t in at}))
    examples += [(5000 + i, 1, {3: 1}) for i in range(200)]  # equal examples over several blocks
    model.index(examples)
    whole = np.zeros((len(examples), 60))
    for b in range(60):
        for k in range(model.term_lists[b], model.term_lists[b + 1]):
            lo, hi = model.list_start[k], model.list_start[k + 1]
            assert model.list_peak[k] == model.posting_weight[lo:hi].max()
            whole[model.posting_example[lo:hi], b] = model.posting_weight[lo:hi]
    for i in range(300):
        at, w = model.scaled({int(t): 1 for t in draw.choice(60, size=i % 9, replace=False)})
        sims = np.round(whole[:, at] @ w, 9)
        without = i if i % 3 == 0 else None
        hit = [k for k in np.flatnonzero(sims > 0) if model.ids[k] != without]
        best = sorted(hit, key=lambda k: (-sims[k], k))[: X.NEIGHBOURS]
        number, found = model.nearest(at, w, without)
        assert list(number) == best and np.allclose(found, sims[best])


def test_labels_of_held_out_rows_are_not_read(spark, docs):
    n = 240
    df, rows = docs(*texts(n)), [(i, 1, int(i % 6 == 0)) for i in range(n)]
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in rows]
    a, b = (X.score_documents(df, X.learn(df, spark.createDataFrame(x, LABELS))).collect() for x in (rows, turned))
    assert a == b


def test_odd_rows(spark, docs):
    n = 300
    given = docs(*texts(n), (None, None), (None, ""), (400, "vile " * 50_000), (401, "VILE, vile"), (401, "VILE, vile"), extra=True)
    known = labels_of(spark, n).union(spark.createDataFrame([(None, 1, 1), (3, None, None), (6, 1, 0), (999, 1, 1)], LABELS))
    model = X.learn(given, known)
    rows = X.score_documents(given.withColumn("score", F.lit("x")), model).collect()
    assert len(rows) == n + 5 and all(0 <= r["score"] <= 1 for r in rows)
    by = {r["doc_id"]: r for r in rows if r["doc_id"] is not None and r["doc_id"] >= 400}
    assert by[400]["score"] >= X.THRESHOLD and by[401]["score"] >= X.THRESHOLD
    empty = [r for r in rows if not r["text"]]
    assert len(empty) == 2 and {r["evidence"] for r in empty} == {""} and max(r["score"] for r in empty) < X.THRESHOLD
    assert X.score_documents(given.where(F.lit(False)), model).collect() == []


def test_labels_of_one_kind(spark, docs):
    df = docs(*texts(20))
    ones = spark.createDataFrame([(i, 1, 1) for i in range(20)], LABELS)
    assert {r["score"] for r in X.score_documents(df, X.learn(df, ones)).collect()} == {1.0}
    none = X.learn(df, spark.createDataFrame([], LABELS))
    assert {r["score"] for r in X.score_documents(df, none).collect()} == {0.0}


def test_fit_is_monotone():
    model = X.Model({}, np.empty(0))
    model.share = 0.4
    draw = np.random.default_rng(1)
    votes = np.round(draw.uniform(0, 1, 500), 2)
    model.fit_votes(votes, (draw.uniform(0, 1, 500) < votes).astype(float))
    at = model.probability(np.linspace(0, 1, 200))
    assert (np.diff(at) >= -1e-12).all() and at[0] < 0.2 and at[-1] > 0.8
