import re

from fieldglass.llm.paragraph_dedup import LEAST_WORDS, repeated_passages
from helpers import story
from pyspark.sql import functions as F

WORD = re.compile(r"[a-z0-9\u0080-\U0010ffff]+")


def brute(texts):
    parts = []
    for i, text in texts.items():
        at = 0
        for line in (text or "").split("\n"):
            words = WORD.findall(line.lower())
            if len(words) >= LEAST_WORDS:
                parts.append((i, at, at + len(line), {tuple(words[k : k + 5]) for k in range(len(words) - 4)}))
            at += len(line) + 1
    group = list(range(len(parts)))

    def top(x):
        while group[x] != x:
            x = group[x]
        return x

    for a in range(len(parts)):
        for b in range(a + 1, len(parts)):
            x, y = parts[a][3], parts[b][3]
            if len(x & y) / len(x | y) >= 0.8:
                lo, hi = sorted((top(a), top(b)))
                group[hi] = lo
    out = set()
    for n, (i, start, end, _) in enumerate(parts):
        members = [m for m in range(len(parts)) if top(m) == top(n)]
        if len(members) > 1:
            first = min((parts[m][0], parts[m][1]) for m in members)
            out.add((i, start, end, min(parts[m][0] for m in members), len(members), (i, start) != first))
    return out


def found(df):
    return {
        (r["doc_id"], r["start"], r["end"], r["class_id"], r["class_size"], r["removed"])
        for r in repeated_passages(df).collect()
    }


def test_same_as_all_pairs(docs):
    shared, other = story(1, 60), story(2, 80)
    words = shared.split()
    marked = "*** ".join(w.upper() for w in words)
    near = " ".join([*words[:30], "changed", *words[31:]])
    texts = {
        0: story(10, 90) + "\n" + shared,
        1: "é" + story(11, 50) + "\n" + near + "\n" + other,
        2: marked + "\n" + story(12, 45),
        3: other + "\n\n" + other,
        4: "short line\n" + " ".join(words[:20]),
        5: "short line",
        6: "",
        7: None,
        8: story(13, 8000),
    }
    got = found(docs(*texts.items(), extra=True))
    assert got == brute(texts)
    assert {g[0] for g in got} == {0, 1, 2, 3}


def test_repeats_nulls_and_empty(docs):
    line = story(3, 50)
    rows = repeated_passages(docs((1, line), (1, line), (None, line))).collect()
    assert sorted(r["removed"] for r in rows) == [False, True, True]
    assert found(docs("a", None)) == set()
    assert found(docs("a").where(F.lit(False))) == set()


def repeated_windows(texts, size=50):
    """Document and character span of every run of words that occurs more than once."""
    places = {}
    for i, text in texts.items():
        spans = [(m.group(), m.start(), m.end()) for m in WORD.finditer((text or "").lower())]
        for k in range(len(spans) - size + 1):
            key = tuple(w for w, _, _ in spans[k : k + size])
            places.setdefault(key, []).append((i, spans[k][1], spans[k + size - 1][2]))
    return [p for found in places.values() if len(found) > 1 for p in found]


def test_repeats_in_short_lines(docs):
    lines = [story(20 + i, 12) for i in range(8)]
    texts = {
        0: "\n".join(lines),
        1: "\n".join(lines),
        2: story(40, 30) + "\n" + "\n".join(lines[1:7]) + "\n" + story(41, 20),
        3: "\n".join(lines[:3]),
    }
    got = found(docs(*texts.items()))
    assert {g[0] for g in got} == {0, 1, 2}
    assert all(any(g[0] == i and g[1] <= a and b <= g[2] for g in got) for i, a, b in repeated_windows(texts))
    assert {g[5] for g in got if g[0] == 0} == {False} and {g[5] for g in got if g[0] > 0} == {True}


def test_repeat_inside_long_lines(docs):
    shared = story(50, 60)
    texts = {
        0: "İ " + story(51, 70) + " " + shared + " " + story(52, 70),
        1: story(53, 100) + " " + shared.upper() + " " + story(54, 40),
        2: story(55, 200),
    }
    got = found(docs(*texts.items()))
    at = {i: texts[i].lower().replace("i̇", "i").index(shared) for i in (0, 1)}
    assert got == {(i, at[i], at[i] + len(shared), 0, 2, i == 1) for i in (0, 1)}


def test_runs_of_copies_are_unfolded_once(spark, docs, monkeypatch):
    """Copies of a text, whole and with other surroundings: what is written grows with the kinds, not with the copies."""
    from fieldglass.llm import paragraph_dedup

    written = {}
    stage = paragraph_dedup.stage

    def counted(df, label, *more):
        out = stage(df, label, *more)
        written[label] = max(written.get(label, 0), out.count())
        return out

    monkeypatch.setattr(paragraph_dedup, "stage", counted)
    shared = "\n".join(story(60 + i, 20) for i in range(10))
    texts = {i: shared for i in range(30)} | {30: story(80, 30) + "\n" + shared, 31: story(81, 15) + " " + shared + "\n" + story(82, 20)}
    got = found(docs(*texts.items()))
    assert all(any(g[0] == i and g[1] <= a and b <= g[2] for g in got) for i, a, b in repeated_windows(texts))
    assert {g[5] for g in got if g[0] == 0} == {False} and {g[5] for g in got if g[0] > 0} == {True}
    # 151 runs in each of 32 texts.
    assert written["runs"] < 4 * 151
