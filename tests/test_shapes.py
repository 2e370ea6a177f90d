"""Documents of one shape are walked once; requests of one archive share its first start."""

import json

import pytest
from fieldglass.functions import json_walk
from fieldglass.operators import nested
from fieldglass.records import web
from pyspark.sql import functions as F

TEXTS = [
    '{"a":[1,{"b":"x"}],"c":null}',
    '{"a":[2,{"b":"<&\\"\\u00e9"}],"c":-0}',
    '{"a":[1.50,{"b":"y"}],"c":1e3}',
    '{"a":1,"b":{"z":[]},"a":{"t":true},"x/y~":"q"}',
    '{"a":2,"b":{"z":[]},"a":{"t":false},"x/y~":"r"}',
    "[]", '"s"', "12", '{"w":{"w":[[[0.5]]]}}', '{"bad":', None,
]


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_one_walk_for_all_documents_of_a_shape():
    walks = []
    shapes = json_walk.Shapes(lambda records, tokens: walks.append(tokens) or records)
    for i in range(100):
        shapes.of(json.dumps({"a": i, "b": [str(i), None]}))
    assert len(walks) == 1
    shapes.of('{"a":1,"b":["x",{}]}')
    assert len(walks) == 2


@pytest.mark.parametrize("most", [50_000, 3])
def test_values_with_and_without_kept_shapes(spark, monkeypatch, most):
    monkeypatch.setattr(json_walk, "SHAPE_TOKENS", most)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, body string")
    rows = json_walk.value_rows(docs, "body").collect()
    got = {}
    for r in rows:
        got.setdefault(r["doc"], []).append((r["path"], r["parent_path"], r["key"], r["depth"], r["ordinal"], r["place"], r["token"], r["filled"]))
    for i, text in enumerate(TEXTS[:9]):
        found = [r for r in json_walk.records_of(text) if not r[0]]
        assert got[i] == [(r[1], r[2], r[3], r[5], r[6], n, r[7], r[8]) for n, r in enumerate(found)]
    assert set(got) == set(range(9))


def test_xml_of_one_shape(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, body string")
    got = dict(nested.json_to_xml(docs, ["doc"], F.col("body")).collect())
    assert got == {
        0: "<root><a><item>1</item><item><b>x</b></item></a><c></c></root>",
        1: "<root><a><item>2</item><item><b>&lt;&amp;&quot;é</b></item></a><c>0</c></root>",
        2: "<root><a><item>1.5</item><item><b>y</b></item></a><c>1000</c></root>",
        3: "<root><b><z></z></b><a><t>true</t></a><x_y_>q</x_y_></root>",
        4: "<root><b><z></z></b><a><t>false</t></a><x_y_>r</x_y_></root>",
        5: "<root></root>", 6: "<root>s</root>", 7: "<root>12</root>",
        8: "<root><w><w><item><item><item>0.5</item></item></item></w></w></root>", 9: None, 10: None,
    }
    # Tags are not spelled record by record in the plan.
    assert "_records" not in plan_of(nested.json_to_xml(docs, ["doc"], F.col("body")))


def test_two_searches_read_the_documents_once(spark):
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc int, body string")
    nodes = nested.node_table(docs, ["doc"], F.col("body"))
    found = nested.match_ancestors(nested.search_nodes(nodes, "x", " ", "T"), ["doc"])
    assert plan_of(found).count("MapInArrow") == 1
    assert {tuple(r) for r in found.collect() if r["doc"] in (0, 3)} == {(0, ""), (0, "/a"), (0, "/a/1"), (3, ""), (3, "/a")}
    assert nested.search_nodes(nodes, " ").count() == 0


def test_first_start_is_taken_before_the_entries_are_unfolded(spark):
    docs = spark.createDataFrame([(1, "{}")], "doc int, body string")
    plan = plan_of(web.har_requests(docs, ["doc"], F.col("body")))
    assert "array_min" in plan and plan.index("Generate") < plan.index("array_min")
