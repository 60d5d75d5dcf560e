"""Trees, forms and ordered tests."""

import json

from pyspark.sql import functions as F

from ledgerloom.operators import structure as S


def test_structural_diff(spark):
    a = {"x": [1, {"y": "café"}], "t": 1.00000001, "seen": "now", "long": "w " * 200, "gone": 1}
    b = {"x": [1, {"y": "cafe"}], "t": 1.0, "seen": "then", "long": "w  " * 200, "at": 2}
    frame = lambda v: spark.createDataFrame([(1, json.dumps(v), "clash"), (2, None, ""), (3, "{broken", "")], "id int, doc string, path string")
    out = S.structural_diff(frame(a), frame(b), "id", "doc", ignored=frozenset({"at"}), tolerated=("seen",)).collect()
    assert sorted((r["path"], r["level"]) for r in out) == [("gone", "error"), ("seen", "warning"), ("x[1].y", "error")]
    assert S.structural_diff(frame(a), frame(a), "id", "doc").count() == 0


def test_forms(spark):
    assert S.stable_json('{"b": 1, "a": {"d": 2, "c": 3}}', frozenset({"d"})) == '{"a": {"c": 3}, "b": 1}'
    assert S.stable_json("{") is None and S.stable_json(None) is None
    assert [S.canonical_number(x) for x in (0.0, 1.5, 1234567.0)] == ["0", "1.5", "1.23457e+06"]
    rows = spark.createDataFrame([('{"b":1,"a":2}',), (None,)], "d string").select(S.stable_json_udf("d").alias("d")).collect()
    assert [r["d"] for r in rows] == ['{"a": 2, "b": 1}', None]


def test_parameters_and_states(spark):
    df = spark.createDataFrame([("",), ("3",), ("9",), ("x",), (None,)], "v string")
    assert [r[0] for r in df.select(S.bounded_integer(F.col("v"))).collect()] == [2, 3, None, None, 2]
    lists = spark.createDataFrame([(["a", "b", "a"],), ([],), (["a b"],), (["a"] * 4,)], "v array<string>")
    assert [r[0] for r in lists.select(S.valid_list(F.col("v"), 3)).collect()] == [["a", "b"], None, None, None]
    errors = df.select(S.first_match(F.col("v"), [("3|x", "known"), ("x", "late")], "other")).collect()
    assert [r[0] for r in errors] == ["other", "known", "other", "known", "other"]
    states = spark.createDataFrame([(False, True, True, True, True), (True, False, True, True, True), (True, True, False, True, True), (True, True, False, False, True), (True, True, True, True, True), (True, True, True, True, False)], "a boolean, b boolean, c boolean, d boolean, e boolean")
    got = [r[0] for r in states.select(S.reset_state(*[F.col(c) for c in "abcde"])).collect()]
    assert got == ["blocked", "audit-failed", "clean", "catalog-stale", "pending-known", "pending-new"]
    assert [r[0] for r in states.limit(2).select(S.availability(F.col("a"), F.col("b"))).collect()] == ["degraded", "in_db"]


def test_section_of_a_heading_in_a_wrapper():
    from ledgerloom.operators import html

    page = "<div><div><h2>Pay Ratio</h2></div></div><div><p>One two three.</p><p>One two three.</p><div><p>Four five.</p></div></div><h2>Director Compensation</h2><p>Other.</p>"
    got = html.section_below(page, "pay ratio", "^director compensation$", least=10)
    assert (got["text"], got["method"]) == ("One two three.\n\nFour five.", "exact-heading-and-document-flow")
    assert html.section_below(page, "pay ratio", "^director compensation$")["method"] == "heading-only"
    near = "<h2>Pay Ratio</h2><p>Here it is, at length.</p><h2>Director Compensation</h2>"
    assert html.section_below(near, "pay ratio", "^director compensation$", least=10)["method"] == "exact-heading-and-sibling-blocks"
    assert html.section_below("", "x", "y", least=1) is None and html.section_below(None, "x", "y") is None
