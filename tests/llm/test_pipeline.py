import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline as P
from helpers import story


@pytest.fixture
def tables(spark, docs, tmp_path):
    texts = {i: story(i, 40 + i % 60) for i in range(120)}
    texts |= {200 + i: " | ".join(story(200 + i, 50).upper().split()) for i in range(40)}
    texts[300] = texts[5] + " more"
    texts[301] = texts[5]
    texts[302] = story(302, 60) + "\n" + story(900, 20)
    texts[303] = story(303, 60) + " token = 0123456789abcdef0123"
    docs(*texts.items()).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(i, int(i < 200), 0) for i in texts if i < 300]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    bench = spark.createDataFrame([(1, story(900, 20))], "item_id long, text string")
    bench.write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def test_stages_take_effect(spark, tables, tmp_path):
    given = spark.read.parquet(f"{tables}/documents.parquet")
    seen = {}
    docs = given
    for n, (name, step) in enumerate(P.STAGES):
        step(spark, docs, tables).write.parquet(str(tmp_path / f"out{n}"))
        docs = spark.read.parquet(str(tmp_path / f"out{n}"))
        seen[name] = docs
        if n < len(P.STAGES) - 1:
            assert docs.columns == given.columns
    ids = {name: {r["doc_id"] for r in df.select("doc_id").collect()} for name, df in seen.items()}
    assert len([i for i in ids["quality"] if 200 <= i < 240]) <= 2
    assert len([i for i in ids["quality"] if i < 120]) >= 115
    assert 5 in ids["near_dedup"] and not {300, 301} & ids["near_dedup"]
    assert ids["decontamination"] == ids["near_dedup"] - {302}
    assert ids["secrets"] == ids["decontamination"] == ids["packing"]
    text = {r["doc_id"]: r["text"] for r in seen["secrets"].collect()}
    assert text[303].endswith(" [assign]")
    run = {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in P.run(spark, tables).collect()}
    assert run == {(r["doc_id"], r["piece"], r["ids_crc32"]) for r in seen["packing"].collect()}


def test_order():
    assert [name for name, _ in P.STAGES] == ["quality", "near_dedup", "decontamination", "secrets", "packing"]
