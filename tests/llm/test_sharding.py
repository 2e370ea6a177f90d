import zlib

from pyspark.sql import functions as F

from fieldglass.llm.sharding import HIGHEST, LOWEST, deal, shard_by_bytes, splitters

from helpers import story


def shards(df, **how):
    return [r.asDict() for r in shard_by_bytes(df, **how).collect()]


def balanced(rows, largest):
    loads = [sum(r["size"] for r in rows if r["shard"] == s) for s in range(8)]
    assert max(loads) - min(loads) <= largest
    for s in range(8):
        assert sorted(r["slot"] for r in rows if r["shard"] == s) == list(range(sum(r["shard"] == s for r in rows)))


def test_sizes_and_sums(docs):
    texts = [story(i, 5 + i % 40) for i in range(400)]
    rows = shards(docs(*texts, extra=True))
    assert {r["doc_id"]: (r["size"], r["text_crc32"]) for r in rows} == {
        i: (len(t) + 1, zlib.crc32(t.encode())) for i, t in enumerate(texts)
    }
    balanced(rows, 300)


def test_a_third_are_copies(docs):
    rows = shards(docs(*[story(1)] * 200, *[story(i, 60) for i in range(400)]))
    assert len(rows) == 600
    balanced(rows, 900)


def test_nulls_empties_repeats(docs):
    rows = shards(docs((None, None), (None, ""), (1, "é"), (1, "é"), (2, "x" * 5000)))
    assert sorted(r["size"] for r in rows) == [1, 1, 3, 3, 5001]
    assert [r["text_crc32"] for r in rows if r["size"] == 1] == [0, 0]
    balanced(rows, 5001)


def test_small_groups_stay_together(docs):
    texts = [story(i // 2, 30) for i in range(600)]
    rows = shards(docs(*texts))
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in where.values())


def test_overfull_ranges_are_cut_by_key(docs):
    texts = [story(i // 2, 30) for i in range(2000)] + [story(5000, 40)] * 60
    rows = shards(docs(*texts), most_rows=5)
    assert len(rows) == len(texts)
    balanced(rows, 2000)
    where = {}
    for r in rows:
        where.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert {len(s) for t, s in where.items() if t != texts[-1]} == {1}
    assert len(where[texts[-1]]) > 1


def test_empty(docs):
    assert shards(docs("a").where(F.lit(False))) == []


def test_splitters_cover_all_keys():
    found = splitters([(k, 1.0) for k in range(-50, 50)] + [(7, 80.0)], 10)
    assert found[0][0] == LOWEST and found[-1][1] == HIGHEST
    assert all(b[0] == a[1] + 1 for a, b in zip(found, found[1:], strict=False))
    assert (7, 7) in found


def test_deal_counts_rows_before():
    out = deal([(0, 0, 10, 2), (1, 0, 10, 3), (2, 0, 5, 1)], 2)
    assert sum(d["shard"] == 0 for d in out) in (1, 2)
    assert sorted(d["_before"] for d in out)[:2] == [0, 0]
