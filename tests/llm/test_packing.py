import random
import zlib

import numpy as np
from fieldglass.llm.packing import SEQUENCE, cut_documents, fullest, pack_documents, plan_sequences
from fieldglass.llm.tokens import library
from helpers import story
from pyspark.sql import functions as F


def brute_best(counts, room):
    best = {0}
    for length, n in counts.items():
        for _ in range(n):
            best |= {b + length for b in best if b + length <= room}
    return max(best)


def test_fullest_is_optimal():
    draw = random.Random(4)
    for _ in range(200):
        counts = {draw.randint(1, 40): draw.randint(1, 3) for _ in range(draw.randint(1, 6))}
        room = draw.randint(1, 90)
        got = fullest(counts, room)
        assert all(k <= counts[n] for n, k in got.items())
        assert sum(n * k for n, k in got.items()) == brute_best(counts, room)


def test_plan_places_every_piece_once():
    draw = random.Random(5)
    counts = {n: draw.randint(0, 30) for n in [*draw.sample(range(1, 500), 300), SEQUENCE]}
    loads, ranks = {}, {}
    for length, lo, hi, first, per, base in plan_sequences(counts):
        for r in range(lo, hi):
            s, o = first + (r - lo) // per, base + (r - lo) % per * length
            loads.setdefault(s, []).append((o, length))
            ranks.setdefault(length, []).append(r)
    assert {n: len(r) for n, r in ranks.items()} == {n: c for n, c in counts.items() if c}
    assert all(sorted(r) == list(range(len(r))) for r in ranks.values())
    for parts in loads.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= SEQUENCE
    total = sum(n * c for n, c in counts.items())
    assert len(loads) <= -(-total // SEQUENCE) + 2


def check(df, texts):
    ids = {k: np.array(library().encode(t or "", add_special_tokens=False).ids + [2], dtype="<u4") for k, t in texts.items()}
    rows = pack_documents(df).collect()
    seqs, seen = {}, {}
    for r in rows:
        part = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(part) == r["length"] and zlib.crc32(part.tobytes()) == r["ids_crc32"]
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["start"], r["length"]))
    for parts in seqs.values():
        at = 0
        for o, length in sorted(parts):
            assert o == at
            at += length
        assert at <= SEQUENCE
    return rows, seen, ids, seqs


def test_round_trip(docs):
    texts = {i: story(i, 20 + 37 * i % 900) for i in range(60)} | {100: story(100, 6000), 101: "", 102: None}
    texts[103] = "a <|endoftext|> b"
    rows, seen, ids, seqs = check(docs(*texts.items(), extra=True), texts)
    for k, parts in seen.items():
        parts.sort()
        at = 0
        for i, (piece, start, length) in enumerate(parts):
            assert (piece, start) == (i, at)
            assert length == SEQUENCE or i == 0
            at += length
        assert at == len(ids[k])
    total = sum(map(len, ids.values()))
    assert len(seqs) <= -(-total // SEQUENCE) + 3


def test_repeated_rows_and_null_ids(docs):
    rows = pack_documents(docs((None, "x"), (None, "x"), (3, None), (3, ""))).collect()
    assert len(rows) == 4 and len({(r["sequence_id"], r["offset"]) for r in rows}) == 4


def test_empty(docs):
    assert pack_documents(docs("a").where(F.lit(False))).collect() == []


def test_ids_can_be_kept(docs):
    row = cut_documents(docs("hello there"), with_ids=True).first()
    assert row["ids"] == [*library().encode("hello there", add_special_tokens=False).ids, 2]
