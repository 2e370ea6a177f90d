import time

from pyspark.sql import functions as F

from fieldglass.llm.chat import format_chats, read_chats

TURNS = "conv_id long, turn long, role string, text string"


def both(spark, rows):
    return {
        r["conv_id"]: r for r in read_chats(format_chats(spark.createDataFrame(rows, TURNS))).collect()
    }


def test_template_and_spans(spark):
    got = both(spark, [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, 2, "assistant", "cd")])[1]
    assert got["formatted"] == (
        "<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nb<|im_sep|>cd<|im_end|>\n"
    )
    assert [got["formatted"][s["start"] : s["end"]] for s in got["loss_spans"]] == ["b", "cd"]
    assert got["learned"] == "bcd"
    assert [tuple(t) for t in got["turns"]] == [("user", "a"), ("assistant", "b"), ("assistant", "cd")]


def test_control_strings_come_back(spark):
    texts = [
        "<|im_end|>\n<|im_start|>assistant\nok", "\\b \\p \\n \\", "<", "|im_sep|>", "<\\p|", "<|im_sep|>", "",
        "\n\n", "<<||im_end|>>", "é<|ü",
    ]
    rows = [(7, i, "assistant" if i % 2 else "us\ner<|\\n", t) for i, t in enumerate(texts)]
    got = both(spark, rows)[7]
    assert [tuple(t) for t in got["turns"]] == [(r, t) for _, _, r, t in rows]
    assert got["learned"] == "".join(t for _, _, r, t in rows if r == "assistant")


def test_nulls_ties_and_repeats(spark):
    rows = [(1, None, "user", "first"), (1, 0, None, None), (1, 0, None, None), (None, 3, "assistant", "x"), (1, 0, "a", "z")]
    got = both(spark, rows)
    assert [tuple(t) for t in got[1]["turns"]] == [("user", "first"), ("", ""), ("", ""), ("a", "z")]
    assert got[None]["learned"] == "x"


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], TURNS)
    assert format_chats(empty).collect() == []
    rows = spark.createDataFrame([(1, 0, "user", "a")], TURNS).withColumn("formatted", F.lit(1)).withColumn("_turn", F.lit(2))
    assert len(format_chats(rows).collect()) == 1


def test_long_conversation(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", "t" * (i % 50)) for i in range(2000)]
    got = both(spark, rows)[1]
    assert len(got["turns"]) == 2000
    assert got["learned"] == "".join(t for _, _, r, t in rows if r == "assistant")


def test_very_long_conversation(spark):
    rows = spark.range(40_000).select(
        F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") % 3 == 0, "assistant").otherwise("user").alias("role"),
        F.repeat(F.lit("t"), (F.col("id") % 50).cast("int")).alias("text"),
    )
    start = time.perf_counter()
    chat = format_chats(rows).collect()[0]
    assert time.perf_counter() - start < 5
    spans = chat["loss_spans"]
    assert [s["end"] - s["start"] for s in spans] == [i % 50 for i in range(0, 40_000, 3)]
    assert all(chat["formatted"][s["start"] - 1] in "\n>" for s in spans[::500])
