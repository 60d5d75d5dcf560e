"""Value functions on single values."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import text as T


def one(spark, value, body):
    return spark.createDataFrame([(value,)], "v string").select(body(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize(("value", "number"), [("$1.5 million", 1.5e6), ("98%", 98.0), ("43 to 1", 43.0), ("no payout", None), ("1B", None), ("2 billion", 2e9), ("-3,000", -3000.0), ("", None), (None, None), ("5 millions", 5.0)])
def test_scaled_number(spark, value, number):
    assert one(spark, value, X.scaled_number) == number


@pytest.mark.parametrize(("value", "number"), [("$ 322,918 ", 322918.0), ("98%", None), ("  ", 0.0), ("", None), (None, None), ("1e3", 1000.0), ("—", None), ("Infinity", None), ("7d", None)])
def test_plain_number(spark, value, number):
    assert one(spark, value, X.plain_number) == number


@pytest.mark.parametrize(("value", "yes"), [("Chief Executive Officer", True), ("President andCEO", True), ("co-CEO", True), ("ChiefExecutive Officer", True), ("CEOs of others", True), ("SCEOX", False), ("Chief Financial Officer", False), (None, False)])
def test_chief_executive(spark, value, yes):
    assert one(spark, value, X.is_ceo) is yes


@pytest.mark.parametrize(("value", "key"), [("Acme Holdings, Inc. (NYSE: ACM)", "acme"), ("Inc.", ""), ("The Foo & Bar Co", "the foo bar"), ("", ""), (None, None)])
def test_company_key(spark, value, key):
    assert one(spark, value, X.company_key) == key


@pytest.mark.parametrize(("value", "cell"), [("=1+1", "'=1+1"), ('a "b", c', '"a ""b"", c"'), (None, ""), ("-5", "'-5"), ("plain", "plain")])
def test_csv_cell(spark, value, cell):
    assert one(spark, value, X.csv_cell) == cell


@pytest.mark.parametrize(("value", "ratio"), [("120 times", "120 to 1"), ("120:1", "120 to 1"), ("1 to 98", "98 to 1"), ("45-to-1", "45 to 1")])
def test_pay_ratio(spark, value, ratio):
    assert one(spark, value, X.pay_ratio) == ratio


def test_rounding_and_direction(spark):
    r = spark.range(1).select(X.half_up(F.lit(-2.5)), X.half_up(F.lit(2.5)), X.direction(F.lit(1.2)), X.direction(F.lit(0.9)), X.direction(F.lit(-1.01)), X.percent(F.lit(1.0), F.lit(0.0))).first()
    assert list(r) == [-2, 3, "up", "flat", "down", 0.0]


def test_sentences(spark):
    text = "Mr. Smith of Acme Inc. agreed. It rose $3.5 million! Why?\n\nNew part; see No. 4 below"
    assert one(spark, text, T.sentences) == ["Mr. Smith of Acme Inc. agreed.", "It rose $3.5 million!", "Why?", "New part; see No. 4 below"]
    assert one(spark, "", T.sentences) == []


def test_offsets_and_snippets(spark):
    assert one(spark, "Pay and pay, PAYpay", lambda c: T.offsets(c, "pay")) == [0, 8, 13, 16]
    assert one(spark, "nothing", lambda c: T.offsets(c, "pay")) == []
    assert one(spark, "x" * 200 + " pay  now", lambda c: T.snippet(c, F.lit(201), 3, 5)) == "…xxxx pay now"


def test_similarity(spark):
    df = spark.createDataFrame([("a b c", "a b c"), ("", ""), ("a", ""), ("a b c d e f", "a b c d e x")], "a string, b string")
    got = [r[0] for r in df.select(T.similarity_percent(T.words(F.col("a")), T.words(F.col("b")))).collect()]
    assert got == [100, 100, 0, 60]
