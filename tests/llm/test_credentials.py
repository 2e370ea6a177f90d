import random
import re
import time

from fieldglass.llm.credentials import SCOPE, endpoints, find_credentials, mask, masked, parts_of
from pyspark.sql import functions as F

KEY = "AKIA" + "Q7" * 8


def spans(df):
    return [sorted((s["kind"], s["start"], s["end"]) for s in r["spans"]) for r in find_credentials(df).orderBy("doc_id").collect()]


def test_base_patterns():
    text = f'é Api_Key: "abcdefghijkl" passwd=short token = token = abcdefghijklm {KEY} deadbeefdeadbeef0 AKIAQ'
    got = [(k, text[a:b]) for k, a, b in parts_of(text) if not k.startswith("weak")]
    assert got == [("assign", 'Api_Key: "abcdefghijkl'), ("access", KEY), ("hex", "deadbeefdeadbeef0")]


def test_weak_parts_need_a_partner(docs):
    near = "x" * (SCOPE - 30)
    got = spans(
        docs(
            "password = hunter7 and more",
            f"password = hunter7 {near} login: bob@example.org",
            f"password = hunter7 {near * 2} login: bob",
            f"https://host.example/path {KEY}",
            f"https://host.example/path {near} password=hunter7",
        )
    )
    kinds = [[k for k, _, _ in g] for g in got]
    assert kinds == [[], ["weak_endpoint", "weak_secret", "weak_user"], [], ["access"], ["weak_endpoint", "weak_secret"]]


def test_block_edges_equal_all_pairs(docs):
    """Links by blocks are the links of all pairs of starts."""
    texts = []
    for gap in range(SCOPE - 12, SCOPE + 12):
        for shift in (0, 1, 57, SCOPE - 1):
            texts.append("-" * shift + "password=hunter7" + " " * (gap - 16) + "login=bob")
    for text, got in zip(texts, spans(docs(*texts)), strict=True):
        assert bool(got) == (text.index("login") - text.index("password") <= SCOPE)


def test_masking(docs):
    df = docs(f"a {KEY} b", "password=hunter7 login=bob", None, "", "clean", (9, "secret: abcdefabcdefabcdef0"), (9, "secret: abcdefabcdefabcdef0"), extra=True)
    rows = mask(df).orderBy("doc_id").collect()
    assert mask(df).schema == df.schema
    assert [r["text"] for r in rows] == ["a [access] b", "[weak_secret] [weak_user]", None, "", "clean", "[assign]", "[assign]"]
    assert [r["n_chars"] for r in rows] == [12, 25, None, 0, 5, 8, 8]
    assert masked("abcdef", [(1, 4, "x"), (2, 3, "y"), (4, 5, "z")]) == "a[x][z]f"


def test_repeats_nulls_long_and_empty(docs):
    long = "user=bob " * 20_000 + "password=hunter7"
    got = spans(docs((None, KEY), (None, KEY), (1, long), (2, None)))
    assert got[:2] == [[("access", 0, 20)]] * 2
    assert [k for k, _, _ in got[2]].count("weak_secret") == 1
    # Only the user names whose start lies in the scope of the one secret.
    assert [k for k, _, _ in got[2]].count("weak_user") == SCOPE // 9
    assert got[3] == []
    assert spans(docs("a").where(F.lit(False))) == []


def test_endpoints_are_those_of_one_pattern():
    """Sought outwards from their signs, endpoints are the leftmost matches of the plain pattern."""
    plain = re.compile(
        r"[a-z][a-z0-9+.-]*://[^\s\"'<>]+|[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+|\b\d{1,3}(?:\.\d{1,3}){3}\b", re.ASCII
    )
    draw = random.Random(6)
    bits = ["a", "Z", "7", ".", "-", "+", "_", "%", "@", "://", " ", "/", "ab.cd", "1.2.3.4", "é", '"', "x@y.z", "h://q"]
    for _ in range(6000):
        text = "".join(draw.choice(bits) for _ in range(draw.randrange(1, 14)))
        assert endpoints(text) == [m.span() for m in plain.finditer(text)], text


def test_long_text_without_a_break():
    for text in ("a" * 1_000_000 + " @", "A1." * 350_000 + "@", "b" * 500_000 + "@x " + "c" * 500_000 + "://", "1.2." * 250_000):
        start = time.perf_counter()
        parts_of(text)
        assert time.perf_counter() - start < 1
