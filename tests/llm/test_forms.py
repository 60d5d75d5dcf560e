"""Text forms."""

import pytest

from ledgerloom.llm import forms

CASES = [
    ("ｓａｌａｒｙ of", "salary of"),
    ("𝐃𝐈𝐒𝐂 𝖠𝖽𝗏 ２０１５", "DISC Adv 2015"),
    ("eﬀect ﬁduciary aﬃliate", "effect fiduciary affiliate"),
    ("café über", "café über"),
    ("fis​cal­ ﻿year‎", "fiscal year"),
    ("a b c　d e", "a b c d e"),
    ("equity‑based 81‐month", "equity-based 81-month"),
    ("Finаncial ассount Οfficer", "Financial account Officer"),
]
PLAIN = ["plain text", "line\nbreak\ttab\r\n", "naïve café Übersand", "Общество Полюс", "Ελληνική Ένωση", "東京支店 한빛", "‘quoted’ “text” – dash —", "™ ® № ½ ² …", "", None]


def run(spark, values):
    df = spark.createDataFrame([(i, v, "clash") for i, v in enumerate(values)], "id long, text string, field string")
    return {r["id"]: r["form"] for r in forms.uneven_text(df, ["id"], ["text"]).collect()}


@pytest.mark.parametrize(("value", "form"), CASES)
def test_cases(spark, value, form):
    assert run(spark, [value]) == {0: form}
    assert run(spark, [form]) == {}


def test_plain_values_are_no_cases(spark):
    assert run(spark, PLAIN) == {}


def test_long_repeated_and_empty(spark):
    long = "ab ｃ " * 50_000
    assert run(spark, [long, "x​", "x​"]) == {0: long.replace("ｃ", "c"), 1: "x", 2: "x"}
    assert run(spark, []) == {}
