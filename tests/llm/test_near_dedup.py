import collections
import random
import re

import numpy as np
from fieldglass.llm.near_dedup import bags, classes, keep_one, registers
from helpers import story
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def bag(text):
    words = WORD.findall((text or "").lower())
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else None


def brute(texts):
    """Smallest id of each group under chains of links at 0.8 or more."""
    found = {i: bag(t) for i, t in texts.items()}
    group = {i: i for i in texts}
    pairs = [(a, b) for a in texts for b in texts if a < b]

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a, b in pairs:
        x, y = found[a], found[b]
        if x is None or y is None:
            same = (texts[a] or "") == (texts[b] or "")
        else:
            common = sum((x & y).values())
            same = common / (x.total() + y.total() - common) >= 0.8
        if same:
            lo, hi = sorted((top(a), top(b)))
            group[hi] = lo
    return {i: top(i) for i in texts}


def edited(text, n, seed):
    draw = random.Random(seed)
    words = text.split()
    for _ in range(n):
        words[draw.randrange(len(words))] = "edit%d" % draw.randrange(10**6)
    return " ".join(words)


def test_registers_estimate_the_weighted_similarity():
    draw = random.Random(2)
    for _ in range(4):
        words = [f"w{draw.randrange(30)}" for _ in range(400)]
        other = words[:300] + [f"v{draw.randrange(30)}" for _ in range(100)]
        data = [" ".join(words).encode(), " ".join(other).encode()]
        h, o, w = bags(data)
        found = registers(h, o, w, 2, 3000)
        a, b = bag(" ".join(words)), bag(" ".join(other))
        common = sum((a & b).values())
        true = common / (a.total() + b.total() - common)
        assert abs((found[0] == found[1]).mean() - true) < 0.04


def test_weights_count():
    data = [b"a b c d e " * 9, b"a b c d e " * 3]
    h, o, w = bags(data)
    found = registers(h, o, w, 2, 3000)
    a, b = (bag(d.decode()) for d in data)
    common = sum((a & b).values())
    assert abs((found[0] == found[1]).mean() - common / (a.total() + b.total() - common)) < 0.04


def test_same_as_all_pairs(docs):
    texts, n = {}, 0
    for g in range(12):
        base = story(g, 60 + 20 * g)
        for k in range(1 + g % 5):
            texts[n] = edited(base, k, g * 10 + k) if k else base
            n += 1
    texts |= {n: "", n + 1: None, n + 2: "!!!", n + 3: "!!!", n + 4: "?!", n + 5: "one two", n + 6: "ONE, two", n + 7: story(99, 9000)}
    got = {r["doc_id"]: r["class_id"] for r in classes(docs(*texts.items(), extra=True)).collect()}
    assert got == brute(texts)


def test_large_family_makes_one_class(docs):
    base = story(5, 300)
    texts = {i: edited(base, 1 + i % 3, i) for i in range(300)}
    got = {r["doc_id"]: r["class_id"] for r in classes(docs(*texts.items())).collect()}
    assert got == brute(texts)


def test_repeats_nulls_and_empty(docs):
    df = docs((None, "a b c d e f"), (None, "a b c d e f"), (4, "a b c d e f"), (4, "a b c d e f"), (5, None))
    rows = sorted((str(r["doc_id"]), str(r["class_id"]), r["class_size"]) for r in classes(df).collect())
    assert rows == [("4", "4", 4), ("4", "4", 4), ("5", "5", 1), ("None", "4", 4), ("None", "4", 4)]
    assert classes(docs("a").where(F.lit(False))).collect() == []


def test_keep_one(docs):
    df = docs((3, "a b c d e f"), (2, "A b c d e f!"), (2, "A b c d e f!"), (7, None), (6, ""), (8, "other words are here now"))
    kept = keep_one(df)
    assert kept.columns == df.columns and kept.schema == df.schema
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 6, 8]


def test_no_words_no_registers():
    h, o, w = bags([b"", b"?"])
    assert len(h) == 0 and np.isinf(registers(h, o, w, 2)).all()


def test_map_columns(spark, docs):
    df = docs(story(1), story(1), story(2)).withColumn("m", F.create_map(F.lit("k"), F.col("doc_id")))
    df = df.withColumn("s", F.struct(F.array(F.col("m")).alias("inner")))
    kept = keep_one(df)
    assert kept.schema == df.schema and sorted(r["doc_id"] for r in kept.collect()) == [0, 2]
