import re

import numpy as np
from fieldglass.llm import words as W
from helpers import story

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")
TEXTS = ["", "?", "one", "one two", "a b c d e", "A, b; c_d e f", "é ü\nñ", "x" * 5000, story(1, 500), "a b c d e a b c d e a"]


def test_words_are_told_apart_like_strings():
    data = [t.encode() for t in W.lowered(TEXTS)]
    hashes, counts = W.word_hashes(data)
    want = [w for t in TEXTS for w in WORD.findall(t.lower())]
    assert counts.tolist() == [len(WORD.findall(t.lower())) for t in TEXTS]
    assert len(set(zip(want, hashes.tolist(), strict=True))) == len(set(want)) == len(set(hashes.tolist()))


def test_shingles():
    data = [t.encode() for t in W.lowered(TEXTS)]
    hashes, counts = W.shingle_hashes(data)
    want = []
    for t in TEXTS:
        w = WORD.findall(t.lower())
        want += [tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else []
    assert len(hashes) == len(want) == counts.sum()
    assert len(set(zip(want, hashes.tolist(), strict=True))) == len(set(want)) == len(set(hashes.tolist()))


def test_place_in_a_group_does_not_matter():
    alone = [W.shingle_hashes([t.encode()])[0] for t in W.lowered(TEXTS)]
    together, counts = W.shingle_hashes([t.encode() for t in W.lowered(TEXTS)])
    assert np.array_equal(np.concatenate(alone), together)


def test_chunks_keep_all():
    got = [(i, d) for i, d in W.chunks(["a" * 10, None, "b" * 100, "c"], 12)]
    assert [d for _, part in got for d in part] == [b"a" * 10, b"", b"b" * 100, b"c"]
    assert [i for i, _ in got] == [0, 2, 3]
