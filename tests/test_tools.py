import json

from plait.operators import telemetry, tools
from pyspark.sql import functions as F


def test_schemas_are_slimmed(spark):
    wide = {"type": "object", "properties": {f"property{k}": {"type": "string"} for k in range(40)}}
    small = {"type": "object", "title": "t", "required": ["a"], "properties": {"a": {"type": "string", "description": "d"}, "b": True}}
    rows = [("x", "One. Two.", json.dumps(small)), ("y", "no end " * 60, json.dumps(wide)), ("z", None, "not json"), ("n", "", None)]
    got = {r.name: (r.description, r.schema) for r in tools.trim_tools(spark.createDataFrame(rows, "name string, description string, schema string")).collect()}
    assert got["x"] == ("One.", '{"properties":{"a":{"type":"string"},"b":{}},"required":["a"],"type":"object"}')
    assert len(got["y"][0]) == 200 and got["y"][1] == '{"type":"object"}'
    assert got["z"] == (None, '{"type":"object"}') and got["n"] == ("", None)


def test_url_parts(spark):
    urls = {"https://a.b/c/d?x#y": ("a.b", 443, "/c/d"), "http://u:p@h:8080": ("h", 8080, "/"), "http://h?x": ("h", 80, "/")}
    df = spark.createDataFrame([(u,) for u in urls], "u string").select("u", tools.url_parts(F.col("u")).alias("p"))
    assert {r.u: tuple(r.p) for r in df.collect()} == urls


def test_responses_are_replaced_where_it_pays(spark):
    log = "\n".join(f"line {k} of a log that is long enough" for k in range(300))
    rows = [(1, log, False), (2, log, True), (3, "short", False), (4, "x" * 5000, None), (5, None, False)]
    got = {r.doc_id: (r.n_bytes, r.sent_bytes, r.kind) for r in tools.auto_compress(spark.createDataFrame(rows, "doc_id long, text string, is_error boolean")).collect()}
    assert got[1][1] < got[1][0] / 5 and got[1][2] == "text"
    assert got[2][0] == got[2][1] and got[2][2] is None
    assert got[3] == (5, 5, None) and got[4] == (5000, 5000, None) and got[5][1] is None


def test_hook_savings(spark):
    text = "\n".join(f"line {k} of the output of a tool" for k in range(200))
    rows = [("k", 1, "Bash", text), ("k", 2, "Bash", text), ("k", 3, "Bash", text + "\nmore"), ("k", 4, "Bash", "tiny"), ("m", 1, "Read", text)]
    got = {(r.key, r.seq): r.saved for r in tools.hook_savings(spark.createDataFrame(rows, "key string, seq long, tool string, content string")).collect()}
    assert got["k", 1] == 0 and got["m", 1] == 0 and got["k", 4] == 0
    assert got["k", 2] == len(text) - 90 - 15 and got["k", 3] > len(text) * 0.9


def test_tool_lists_and_thresholds(spark):
    calls = spark.createDataFrame([("Bash", 3000, False), ("Bash", 3000, True), ("my-tool", 50, False), ("Denied", 9999, False), ("Read", 2048, None)], "tool string, n_bytes long, is_error boolean")
    deny = spark.createDataFrame([("Denied",)], "tool string")
    least = spark.createDataFrame([("MY_TOOL", 10)], "tool string, min_bytes int")
    assert sorted(r.tool for r in telemetry.allowed(calls, deny, least).collect()) == ["Bash", "my-tool"]
