import math
import random
import re
from collections import Counter

from fieldglass.llm import lexical_search as S
from helpers import story

ITEMS = "item_id long, text string"


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def expected(docs, items, best=10):
    counts = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scored = []
        for i, c in counts:
            m = 25 + (75 * sum(c.values()) * n_docs) // total
            score = sum(
                math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                for t in terms(text)
                if c[t]
            )
            if score > 0:
                scored.append((-score, i is None, i or 0, i))
        out += [(item, r, i, -s) for r, (s, _, _, i) in enumerate(sorted(scored)[:best], 1)]
    return sorted(map(repr, out))


def test_against_all_scores(spark, docs):
    draw = random.Random(2)
    texts = [story(draw.randrange(40), draw.randrange(1, 90)) for _ in range(150)]
    texts += ["", None, "É é Ünd 12x_12X", "tor " * 5000, " tor min", texts[0].upper(), texts[0], texts[0]]
    given = docs(*texts, (None, texts[3]), (None, texts[3]), (7, texts[7]), extra=True)
    rows = [(r["doc_id"], r["text"]) for r in given.select("doc_id", "text").collect()]
    items = [(k, story(k, 12) + " " + texts[k][:80]) for k in range(30)] + [(90, ""), (91, None), (92, "unseen"), (93, "tor tor É")]
    items.append((3, items[3][1]))
    frame = spark.createDataFrame(items, ITEMS)
    want = expected(rows, items)
    assert sorted(repr(tuple(r)) for r in S.search(given, frame).collect()) == want
    # Blocks of items and chunks of documents change nothing.
    assert sorted(repr(tuple(r)) for r in S.search(given, frame, block_bytes=500).collect()) == want


def test_ties_by_id(spark, docs):
    given = docs(*[(i, "alpha beta") for i in range(400, 0, -1)], (None, "alpha beta"), (1000, "gamma"))
    got = S.search(given, spark.createDataFrame([(5, "alpha")], ITEMS)).orderBy("rank").collect()
    assert [(r["rank"], r["doc_id"]) for r in got] == [(i, i) for i in range(1, 11)]
    few = S.search(docs((None, "alpha"), (2, "alpha"), (9, "x"), (8, "y")), spark.createDataFrame([(5, "Alpha")], ITEMS)).orderBy("rank")
    assert [r["doc_id"] for r in few.collect()] == [2, None]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], ITEMS)
    one = spark.createDataFrame([(1, "a")], ITEMS)
    assert S.search(docs("a", "b"), none).collect() == []
    assert S.search(docs("a").where("false"), one).collect() == []
    assert S.search(docs("", None), one).collect() == []


def test_lists_are_bounded():
    import numpy as np

    lists = S.BestLists(3, 4)
    draw, rows = random.Random(1), []
    for _ in range(30):
        part = [(draw.randrange(3), draw.randrange(1, 9), draw.randrange(1000)) for _ in range(40)]
        rows += part
        item, score, ids = (np.array(x) for x in zip(*part, strict=True))
        keep = score >= lists.floor[item]
        lists.push(item[keep], score[keep], ids[keep], np.zeros(keep.sum(), dtype=bool))
        assert len(lists.item) <= 12
    for k in range(3):
        best = sorted((-s, i) for it, s, i in rows if it == k)[:4]
        assert [(-int(s), int(i)) for it, s, i in zip(lists.item, lists.score, lists.id, strict=True) if it == k] == best
