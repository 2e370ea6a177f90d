import os

from fieldglass.llm.token_counts import STRETCH, count_tokens, frequent_pieces, stretches
from fieldglass.llm.tokens import library
from helpers import story
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.01"
TEXTS = [
    "", None, " ", "\n\n  x\n", "a  b   c", "don't they'll I've", "x <|endoftext|> y", "<|endoftext|>", "naïve 東京 1234 ½ Ⅷ",
    "a\u00a0b \u2028 c", "!!! ??? ...", "word " * 700, "\tif x:\n\t\treturn\n", "e\u0301 \U0001f600\U0001f600", "z" * 30000,
]


def test_counts_equal_the_library(docs):
    texts = TEXTS + [story(i, 300) for i in range(40)]
    got = {r["doc_id"]: r for r in count_tokens(docs(*texts, extra=True)).collect()}
    for i, text in enumerate(texts):
        n = len(library().encode(text or "", add_special_tokens=False).ids)
        assert (got[i]["n_bytes"], got[i]["n_tokens"], got[i]["over_limit"]) == (len((text or "").encode()), n, n > 512), text


def test_frequent_pieces(docs):
    assert frequent_pieces(docs("a bb bb bb cc cc", "x bb cc", None), 2) == ["bb", "cc"]
    assert frequent_pieces(docs("", None)) == []


def test_white_space_of_all_kinds(docs):
    kinds = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\u00a0\u1680\u2003\u2028\u2029\u202f\u205f\u3000\u200b\ufeff"
    texts = [f"a{x}b {x}c{x} d {y}{x} e.{x}{y}'s {x}" for x in kinds for y in kinds]
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(docs(*texts)).collect()}
    assert got == {i: len(library().encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_same_as_the_library_on_given_texts(spark):
    texts = spark.read.parquet(os.path.join(SF, "documents.parquet"))
    whole = {r["doc_id"]: r["text"] or "" for r in texts.collect()}
    got = {r["doc_id"]: r["n_tokens"] for r in count_tokens(texts).collect()}
    assert got == {i: len(library().encode(t, add_special_tokens=False).ids) for i, t in whole.items()}


def test_long_texts_in_stretches(docs):
    text = story(5, 2000) * 120 + " " * 3 + "y1" * (STRETCH // 2 + 5)
    assert len(text) > 2 * STRETCH and "".join(stretches(text)) == text
    assert count_tokens(docs(text)).first()["n_tokens"] == len(library().encode(text, add_special_tokens=False).ids)


def test_repeats_nulls_and_empty(docs):
    assert len(count_tokens(docs((None, "a"), (1, "a"), (1, "a"))).collect()) == 3
    assert count_tokens(docs("a").where(F.lit(False))).collect() == []
