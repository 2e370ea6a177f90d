import random
import re
from collections import Counter
from itertools import permutations

import pandas as pd
from fieldglass.llm import filter_audit as A
from helpers import story
from pyspark.sql import functions as F

LABELS = "doc_id long, quality int, toxic int"


def fails(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    out = ""
    out += "A" * (len(words) < 100)
    out += "B" * (100 * len(set(words)) < 80 * len(words))
    out += "C" * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text))
    return out + "D" * bool(re.search(r"[#$%&*|]", text))


def expected(rows, labels):
    """Every column of the result, by going through all orders row by row."""
    first = {}
    for i, text, _ in rows:
        if i is not None:
            first[text or ""] = min(i, first.get(text or "", i))
    failed = [
        (p or "", fails(t or "") + "E" * (i is not None and i > first[t or ""]), *labels.get(i, (0, 0))) for i, t, p in rows
    ]
    out, removed_by = {}, Counter()
    for part in {p for p, *_ in failed}:
        for order in map("".join, permutations("ABCDE")):
            left = [x for x in failed if x[0] == part]
            gone = []
            for step, f in enumerate(order, 1):
                here = [x for x in left if f in x[1]]
                redundant = sum(f in x[1] for x in gone)
                left = [x for x in left if f not in x[1]]
                gone += here
                removed_by[part, f] += len(here)
                out[part, order, step] = [
                    len(left), len(here), redundant, sum(x[0] == part and x[1] == f for x in failed),
                    sum(x[2] for x in here), sum(x[3] for x in here),
                ]
    return {(p, o, s, *v, removed_by[p, o[s - 1]]) for (p, o, s), v in out.items()}


def write(spark, docs, tmp_path, files):
    """The rows in several files, the largest ids first."""
    path = f"{tmp_path}/documents.parquet"
    rows = docs.collect()
    for k in range(files):
        part = rows[len(rows) * k // files : len(rows) * (k + 1) // files]
        spark.createDataFrame(part, docs.schema).coalesce(1).write.mode("append").parquet(path)
    return path


def test_smaller_ids_take_counts_back(spark, tmp_path):
    draw = random.Random(5)
    texts = [story(s, n) for s in range(6) for n in (20, 150)] + ["A B #", "", None, "word " * 200, "X" * 40, "é ü " * 120]
    rows = [(i, draw.choice(texts), draw.choice(["en", "de", None])) for i in range(90, 0, -1)]
    rows += [(7, texts[0], "en"), (7, texts[0], "en"), (None, texts[0], "en"), (None, texts[0], None), (-4, texts[2], "de")]
    labels = {i: (i % 3 == 0, i % 5 == 0) for i in range(0, 91, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("mask", F.lit(3)).withColumn("page", F.lit("x"))
    path = write(spark, docs, tmp_path, 4)
    known = spark.createDataFrame([(i, int(q), int(t)) for i, (q, t) in labels.items()] + [(3, None, None), (None, 1, 1)], LABELS)
    got = A.interactions(A.mask_counts(spark, path, known, files_per_batch=1))
    assert got.columns == [
        "part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"
    ]
    assert {tuple(r) for r in got.collect()} == expected(rows, labels)
    once = A.mask_counts(spark, path, known)
    many = A.mask_counts(spark, path, known, files_per_batch=2)
    assert sorted(map(tuple, once.collect())) == sorted(map(tuple, many.collect()))


def test_pages_retract():
    def rows(*given):
        out = pd.DataFrame(given, columns=["text_key", "part", "mask", "good", "toxic", "first_id", "firsts", "rows"])
        return out.assign(page=0)

    held = rows().drop(columns=["rows", "page"])
    held, changes = A.merge_page(held, rows((b"k", "en", 1, False, True, 9, 1, 4)))
    assert sorted(map(tuple, changes.to_numpy().tolist())) == [("en", 1, False, True, 1), ("en", 17, False, True, 3)]
    held, changes = A.merge_page(held, rows((b"k", "de", 1, True, False, 2, 2, 2)))
    assert sorted(map(tuple, changes.to_numpy().tolist())) == [
        ("de", 1, True, False, 2), ("en", 1, False, True, -1), ("en", 17, False, True, 1)
    ]
    held, changes = A.merge_page(held, rows((b"k", "en", 1, False, True, 2, 1, 1)))
    assert list(changes["change"]) == [1] and list(changes["mask"]) == [1]
    assert sorted(held["firsts"]) == [1, 2]


def test_hot_text_and_empty_table(spark, tmp_path):
    n = 30_000
    docs = spark.range(n, 0, -1).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "same").otherwise(F.col("id").cast("string")).alias("text"),
        F.lit("en").alias("lang"),
    )
    path = f"{tmp_path}/documents.parquet"
    docs.repartition(3).write.parquet(path)
    none = spark.createDataFrame([], LABELS)
    got = {r["mask"]: r["n"] for r in A.mask_counts(spark, path, none, files_per_batch=1).collect()}
    assert got == {1: n - n // 3 + 1, 17: n // 3 - 1}
    empty = f"{tmp_path}/empty.parquet"
    docs.limit(0).coalesce(1).write.parquet(empty)
    assert A.interactions(A.mask_counts(spark, empty, none)).collect() == []
