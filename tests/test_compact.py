import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusmill.functions import compact as K
from corpusmill.functions.detect import detect


LONG = "a text of more than twenty characters"
REWRITES = [
    ("minify", '{"b": 1, "a": [1, 2.0]}', '{"a":[1,2.0],"b":1}'),
    ("drop_nulls", '{"a": null, "b": {"c": []}, "d": false, "e": 0, "f": ["", {"g": ""}, 1]}', '{"d":false,"e":0,"f":[1]}'),
    ("flatten", '{"a": {"b": {"c": 1}}, "x": {"y": 1, "z": {"w": 2}}, "l": [{"m": {"n": 1}}]}', '{"a.b.c":1,"l":[{"m.n":1}],"x":{"y":1,"z.w":2}}'),
    ("tabular", '[{"a": 1, "b": null}, {"a": true, "c": "x|y"}]', 'a|b|c\n1|null|\ntrue||"x|y"'),
    ("round_numbers", '{"a": 0.125, "b": 2.675, "c": 3, "d": "1.239"}', '{"a":0.12,"b":2.67,"c":3,"d":"1.239"}'),
    ("strip_quotes", '{"a_b":1,"c d":{"e.f":"g"}}', '{a_b:1,"c d":{e.f:"g"}}'),
    ("dedup_values_with_refs", json.dumps({"x": LONG, "y": LONG, "z": "short"}), '{"_data":{"x":"$R0","y":"$R0","z":"short"},"_refs":{"$R0":"' + LONG + '"}}'),
    ("collapse_whitespace", "one  \n\n\n\ntwo\t\n", "one\n\ntwo\n"),
    ("collapse_whitespace", "\n\n\n\nx\n\n\n```\n\n\n y \n```\n\nz\n\n\n\n", "\n\nx\n```\n\n\n y \n```\nz\n\n"),
    ("collapse_whitespace", " \n\t\n", "\n"),
    ("compact_tables", "# H\n\n## K\n\n| a  | b |\n|----|---|\n|  |  | x |", "# H\n\n## K\n\n|a|b|\n|----|---|\n||x|"),
    ("compact_tables", "# H\n\n## K\n\n```\n| a  |\n```\n| a  |  |  | b |", "# H\n\n## K\n\n```\n| a  |\n```\n|a||b|"),
    ("strip_html_comments", "a\n<!-- gone -->\nb <!-- too --> c\n```\n<!-- kept -->\n```\n", "a\nb  c\n```\n<!-- kept -->\n```\n"),
    ("strip_html_comments", "<!-- a\nb -->x<!-- c --><!-- d\n\n", "x<!-- d\n\n"),
    ("minify", "<r>\n  <a> 1 </a>\n<![CDATA[ x ]]> </r>", "<r><a>1</a>\n<![CDATA[ x ]]></r>"),
]
FORMATS = [
    ("  ", "text"), ('{"a": [1, 2]}', "json"), ("{oops", "text"), ("<?xml version='1.0'?><r/>", "xml"), ("<note x='1'>hi</note>", "xml"), ("<div>hi</div>", "text"), ("<note", "text"),
    ("name: x\nitems:\n  - a\n  - b\n", "yaml"), ("# One\n\nText\n\n## Two\n\nMore", "markdown"), ("|a|b|\n|-|-|\n|1|2|", "markdown"), ("[tool]\nx = 1\n", "toml"), ("a,b\n1,2\n3,4", "csv"), ('a;b\n"1;2"\n', "text"), ("Just a line, with a comma", "text"),
]


@pytest.mark.parametrize(("name", "text", "want"), REWRITES)
def test_rewrites(name, text, want):
    assert K.attempt(name, K.load(text)).text == want


@pytest.mark.parametrize(("text", "want"), [
    ('<a href="/x,">x,</a><a href="/y">y</a>\nEnd, here.', "text"),  # a quote that opens a cell and closes inside it
    ('<a href="/x,">x</a>\nEnd, here.', "csv"), ('a,"b\nc,d', "csv"), ("a,b\n1," + "2" * 200_000, "csv"), ("a,b\x85c\n1,2", "csv"), ('a,b\n"1,2",3', "csv"),
])
def test_quotes_in_grids(text, want):
    assert detect(text) == want


@pytest.mark.parametrize(("text", "want"), FORMATS)
def test_formats(text, want):
    assert detect(text) == want


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "", "  ", "b  ", "```", "```py", "| x |  | y |", "<!-- c -->", "<!-- d", "e -->"]), max_size=12))
def test_text_rewrites_settle(lines):
    d = K.Document("\n".join(lines), "markdown")
    for name in ("collapse_whitespace", "compact_tables"):
        once = K.attempt(name, d)
        assert K.attempt(name, once).text == once.text and len(once.text) <= len(d.text)
    assert len(K.attempt("strip_html_comments", d).text) <= len(d.text)


def test_typed_null_dropping(spark):
    from pyspark.sql import functions as F
    from pyspark.sql import types as T

    inner = T.StructType([T.StructField("x", T.StringType()), T.StructField("n", T.ArrayType(T.LongType()))])
    schema = T.StructType([T.StructField("a", inner), T.StructField("b", T.ArrayType(inner)), T.StructField("c", T.BooleanType()), T.StructField("d", T.LongType())])
    texts = ['{"a":{"x":"","n":[]},"b":[{"x":"k"},{"x":null}],"c":false,"d":0}', '{"a":{"x":"y"}}', "{}", "nonsense", '{"b":[{"n":[null,1]}]}']
    got = [r["t"] for r in spark.createDataFrame([(t,) for t in texts], "text string").select(K.drop_nulls(F.col("text"), schema).alias("t")).collect()]
    assert got == ['{"b":[{"x":"k"}],"c":false,"d":0}', '{"a":{"x":"y"}}', "{}", "{}", '{"b":[{"n":[1]}]}']


def test_keep_if_smaller():
    d, applied = K.chain(K.load('{ "a" : 1 }'), K.PRESETS["safe"])
    assert d.text == '{"a":1}' and applied == ["minify"]
    assert K.chain(K.load('{"a":1}'), K.PRESETS["aggressive"])[1] in ([], ["strip_quotes"])


def test_flatten_depth_and_lists():
    assert K.flattened({"a": {"b": {"c": {"d": 1}}}}, 1) == {"a.b": {"c.d": 1}} or K.flattened({"a": {"b": {"c": {"d": 1}}}}, 1) == {"a.b": {"c": {"d": 1}}}
    assert K.flattened([{"a": {"b": [1]}}]) == [{"a.b": [1]}]


def test_aliases_never_meet_values():
    long = "x" * 30
    out = K.deduplicated({"a": long, "b": long, "c": "$R7"})
    assert list(out["_refs"]) == ["$$R0"] and out["_data"]["c"] == "$R7"
    assert K.deduplicated({"_refs": 1, "a": long, "b": long}) == {"_refs": 1, "a": long, "b": long}


def test_deep_documents_pass_unchanged():
    deep = "[" * 3000 + "]" * 3000
    assert K.chain(K.load(deep), K.PRESETS["moderate"])[0].text in (deep, "[]")


@settings(max_examples=100, deadline=None)
@given(st.recursive(st.none() | st.booleans() | st.integers() | st.text(max_size=5), lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=4), x, max_size=4), max_leaves=20))
def test_cleaning_reaches_a_fixed_point(x):
    once = K.without_empty(x)
    assert K.without_empty(once) == once
    assert json.loads(json.dumps(once)) == once


def test_columns(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([('{"b":  1}',), ("plain",), (None,), ("",)], "text string")
    got = [r["r"] for r in df.select(K.compact(F.col("text")).alias("r")).collect()]
    assert [g["compacted"] for g in got] == ['{"b":1}', "plain", "", ""]
