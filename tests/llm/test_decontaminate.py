import random

from fieldglass.llm import decontaminate as D
from helpers import story
from pyspark.sql import functions as F


def edits(a, b):
    """The least edits from ``a`` to any part of ``b``, by the full table."""
    row = [0] * (len(b) + 1)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return min(row)


def changed(text, n, seed):
    draw = random.Random(seed)
    out = list(text)
    for _ in range(n):
        at = draw.randrange(len(out))
        kind = draw.randrange(3)
        if kind == 0:
            out[at] = draw.choice("abcxyz ")
        elif kind == 1:
            out.insert(at, draw.choice("abcxyz"))
        else:
            del out[at]
    return "".join(out)


def test_distance_is_the_full_table():
    draw = random.Random(1)
    for _ in range(200):
        a = "".join(draw.choice("ab ") for _ in range(draw.randint(1, 90)))
        b = "".join(draw.choice("ab ") for _ in range(draw.randint(0, 120)))
        assert D.distance_in(a, D.masks_of(a), b)[0] == edits(a, b)


def test_every_match_within_the_budget_is_found():
    items = [(n, story(n, 12 + n)) for n in range(25)]
    search = D.Searcher(items)
    for n, text in items:
        for more in (-2, 0, 1, 3):
            want = D.compared(text)
            body = story(100 + n, 30) + " " + changed(want, int(len(want) * D.BUDGET) + more, n * 7 + more) + " " + story(200 + n, 30)
            hits = {search.items[k][0]: v for k, v in search.matches(body).items()}
            true = edits(want, D.compared(body))
            assert (n in hits) == (true <= int(len(want) * D.BUDGET))
            if n in hits:
                assert hits[n][0] == true
                part = D.compared(body)[hits[n][1] : hits[n][2]]
                assert edits(want, part) == true


def test_small_budgets():
    items = [(n, story(n, 8 + 3 * n)) for n in range(12)]
    for budget in (0.0, 0.01, 0.02, 0.03, 0.05):
        search = D.Searcher(items, budget)
        for n, text in items:
            most = int(len(text) * budget)
            for k in range(most + 2):
                body = story(70 + n, 20) + " " + changed(text, k, 31 * n + k) + " " + story(90 + n, 20)
                true = edits(D.compared(text), D.compared(body))
                hits = {search.items[i][0]: v for i, v in search.matches(body).items()}
                assert (n in hits) == (true <= most)
                if n in hits:
                    assert hits[n][0] == true
                    assert edits(D.compared(text), D.compared(body)[hits[n][1] : hits[n][2]]) == true


def test_queries_over_tables(spark, docs):
    items = spark.createDataFrame(
        [(1, story(1, 15)), (2, story(2, 15)), (2, story(2, 15)), (3, "short"), (4, None), (None, story(5, 15))],
        "item_id long, text string",
    )
    marked = "!! ".join(story(1, 15).upper().split())
    df = docs(story(9, 50) + "\n" + marked, story(8, 40), (None, story(2, 15)), None, "", (7, story(5, 15)), (7, story(5, 15)))
    got = sorted((str(r["doc_id"]), str(r["item_id"]), r["distance"]) for r in D.find_leaks(df, items).collect())
    assert got == [("0", "1", 0), ("7", "None", 0), ("7", "None", 0), ("None", "2", 0), ("None", "2", 0)]
    kept = D.drop_leaks(df, items)
    assert kept.schema == df.schema
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["1", "3", "4"]


def test_blocks_see_all_items(spark, docs, monkeypatch):
    monkeypatch.setattr(D, "BLOCK_CHARS", 150)
    items = spark.createDataFrame([(i, story(i, 15)) for i in range(9)], "item_id long, text string")
    df = docs(*[story(i, 15) for i in range(9)], story(50, 4000))
    assert sorted((r["doc_id"], r["item_id"]) for r in D.find_leaks(df, items).collect()) == [(i, i) for i in range(9)]
    assert [r["doc_id"] for r in D.drop_leaks(df, items).collect()] == [9]


def test_empty_tables(spark, docs):
    none = spark.createDataFrame([], "item_id long, text string")
    assert D.find_leaks(docs("a"), none).collect() == []
    assert D.drop_leaks(docs("a"), none).count() == 1
    some = spark.createDataFrame([(1, story(1, 15))], "item_id long, text string")
    assert D.find_leaks(docs("a").where(F.lit(False)), some).collect() == []


def test_clashing_columns(spark, docs):
    items = spark.createDataFrame([(1, story(1, 15))], "item_id long, text string")
    df = docs(story(1, 15), story(2, 15), extra=True)
    assert [r["doc_id"] for r in D.find_leaks(df, items).collect()] == [0]
    assert D.drop_leaks(df, items).columns == df.columns
