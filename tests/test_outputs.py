"""Edits of sets, keyed digests, and cases that the test tables do not hold."""

import datetime as dt
import hashlib
import hmac

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import sequential
from ledgerloom.plans import diffs, outputs, texts


def test_sets_keep_their_order_and_their_limit(spark):
    edits = [("add", "a"), ("add", "b"), ("add", "a"), ("mark", "a"), ("add", "a"), ("remove", "b"), ("add", "b"), ("mark", "zz"), ("add", None), ("add", "")]
    rows = [(1, i, *e) for i, e in enumerate(edits)] + [(2, i, "add", str(i)) for i in range(40)] + [(3, 1, "add", "x"), (3, 2, "clear", None), (None, 1, "add", "n")]
    df = spark.createDataFrame(rows, "u int, t int, op string, entry string").withColumn("place", F.lit("clash"))
    got = {}
    for r in sequential.edit_sets(df, "u", ["t"]).orderBy("u", "place").collect():
        got.setdefault(r["u"], []).append((r["entry"], r["imported"]))
    assert got[1] == [("a", True), ("b", False)] and len(got[2]) == sequential.MOST_ENTRIES and 3 not in got and got[None] == [("n", False)]
    assert sequential.edit_sets(df.limit(0), "u", ["t"]).count() == 0


@pytest.mark.parametrize("secret", [b"k", b"x" * 64, b"longer than a block " * 9])
def test_keyed_digest(spark, secret):
    messages = ["", "m", "ä" * 500]
    df = spark.createDataFrame([(m,) for m in messages], "m string")
    got = {r[0]: r[1] for r in df.select("m", outputs.hmac_sha256(F.col("m"), secret)).collect()}
    assert got == {m: hmac.new(secret, m.encode(), hashlib.sha256).hexdigest() for m in messages}


def test_ids_that_were_asked_for():
    assert outputs.asked_ids(" AB.C,1x,,b-d ,toolongtobeasymbol, é") == ["ab.c", "b-d"]
    assert len(outputs.asked_ids(",".join(f"a{i}" for i in range(99)))) == outputs.MOST_COMPANIES


def test_plain_names(spark):
    cases = {"Café & Co+": "cafe and co plus", "Ｗide": "wide", "A.B": "a b", "": "", None: None}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r[0]: r[1] for r in df.select("c", X.plain_name(F.col("c"))).collect()} == {**cases, "Café & Co+": "cafe and co plus"}


DAY = dt.datetime(2024, 1, 1)


@pytest.fixture
def tables(spark, tmp_path):
    def put(name, rows, schema):
        spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / f"{name}.parquet"))

    filings = "id string, company_id string, filing_year int, filing_date date, form_type string, created_at timestamp, updated_at timestamp"
    put("filings", [("f1", "crm", 2023, DAY.date(), "DEF 14A", DAY, DAY), ("f2", "peer", 2022, DAY.date(), "DEF 14A", DAY, DAY)], filings)
    put("companies", [("crm", "1", "CRM", "Crm Inc"), ("peer", "2", "PEER", "Peer Co"), ("third", "3", None, "Third plc")], "id string, cik string, ticker string, name string")
    member = "array<struct<company_name_raw string, company_id_resolved string, ticker_resolved string>>"
    groups = [(1, "f1", [("Crm", "crm", "CRM")]), (2, "f1", [("Crm", " CRM", None), ("Peer", "peer", "PEER")]), (3, "f1", [])]
    put("peer_groups", groups, f"id long, filing_id string, members {member}")
    rows = [(1, 2, "Peer", "peer", "PEER", None), (2, 2, "Third", None, None, None), (3, 2, "Crm", "crm", "CRM", None)]
    put("peer_group_members", rows, "id long, peer_group_id long, company_name_raw string, company_id_resolved string, ticker_resolved string, cik_resolved string")
    put("metric_facts", [("f2", 1)], "filing_id string, fact_no int")
    return str(tmp_path)


def test_peers_that_file_themselves(spark, tables):
    got = {(r["company_id"], r["peer_id"], r["peer_year"], r["facts"]) for r in diffs.peer_snapshot(spark, tables).collect()}
    assert got == {("crm", "peer", 2022, 1), ("crm", "third", None, 0)}


def test_groups_without_the_filer(spark, tables):
    assert {(r["id"], r["members"]) for r in texts.without_self(spark, tables).collect()} == {(2, 1)}
