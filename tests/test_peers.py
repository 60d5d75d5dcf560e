"""Peer lists in texts and tables."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import peers

NAMES = ["Zanlester", "Krovemark", "Belanford", "Torwynne", "Quinagate", "Halilobcove", "Morvendale", "Stoaricket", "Praobbury"]


@pytest.fixture(scope="module")
def listed(spark):
    rows = [(f"T{n[:3].upper()}", str(i), f"{n} Foods, Inc.") for i, n in enumerate(NAMES)]
    return spark.createDataFrame(rows, "ticker string, cik string, name string")


def ids(names):
    return [f"t{n[:3].lower()}" for n in names]


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("the list: Alpha Systems, Inc. (ALP), Bank of Beta (BB.A), and Gamma & Delta Co. (GD)", [("Alpha Systems, Inc.", "ALP"), ("Bank of Beta", "BB.A"), ("Gamma & Delta Co.", "GD")]),
        ("as noted (CEO). See Table (A)", []),
        ("We met. Omega plc (OM)", [("Omega plc", "OM")]),
        ("", []),
    ],
)
def test_pairs(text, want):
    assert [(n, s) for _, _, n, s in peers.pairs_in(text)] == want


def test_names_that_end_in_a_form():
    text = "Peers are Alpha Systems Inc., Beta Holdings Corp., Bank of Gamma, N.V.; and Delta & Sons Ltd. The Company grew."
    assert [n for _, _, n, _ in peers.ended_in(text)] == ["Alpha Systems Inc.", "Beta Holdings Corp.", "Bank of Gamma, N.V.", "Delta & Sons Ltd."]


@pytest.mark.parametrize(
    ("text", "way", "members", "year"),
    [
        ("For fiscal 2023 our peer group consisted of: Zanlester Foods, Krovemark Foods and Belanford Foods.", "consisted", NAMES[:3], 2023),
        ("In 2022 we set pay.\n\nThe committee approved the peer group below.\n\nZanlester\n\nKrovemark\n\nBelanford Foods, Inc.\n\nOther text", "approved", NAMES[:3], 2022),
        ("We selected these as our peers: Zanlester, Krovemark, Belanford", "selected", NAMES[:3], None),
        ("We reviewed the following companies: Zanlester, Krovemark, Belanford, Torwynne", "following", NAMES[:4], None),
        ("2024 Peer Group\n\n" + ", ".join(NAMES[:7]), "headed", NAMES[:7], 2024),
        ("Our peer group includes " + ", ".join(NAMES[:8]), "included", NAMES[:8], None),
    ],
)
def test_announced_lists(spark, listed, text, way, members, year):
    df = spark.createDataFrame([(1, text, "x"), (2, None, "x"), (3, "", "x"), (4, "Our peer group consisted of Zanlester and others.", "x")], "id int, text string, members string")
    assert [(r["id"], r["way"], r["members"], r["year"]) for r in peers.text_lists(df, "id", "text", listed).collect()] == [(1, way, ids(members), year)]


def table(names):
    return "<table>" + "".join(f"<tr><td>{i}</td><td>{n} Foods, Inc.</td></tr>" for i, n in enumerate(names)) + "</table>"


@pytest.mark.parametrize(
    ("markup", "way"),
    [
        (f"<h3>2023 Compensation Peer Group</h3><p>text</p>{table(NAMES[:7])}", "headed table"),
        (f"<div><p>In 2023 we chose companies of like size, and this long paragraph says that our peer group has the companies below for all of the year.</p>{table(NAMES[:7])}</div>", "introduced table"),
        (f"<h3>2023 Suppliers</h3>{table(NAMES[:7])}", None),
        (f"<h3>2023 Peer Group</h3>{table(NAMES[:6])}", None),
        ("<table><tr><td>unclosed", None),
    ],
)
def test_lists_in_tables(spark, listed, markup, way):
    df = spark.createDataFrame([(1, markup), (2, None), (3, "")], "id int, html string")
    got = [(r["way"], r["members"], r["year"]) for r in peers.table_lists(df, "id", "html", listed).collect()]
    assert got == ([(way, ids(NAMES[:7]), 2023)] if way else [])


def test_first_company_and_group_names(spark, listed):
    df = spark.createDataFrame([("Krovemark Foods and Zanlester",), ("nobody",), (None,), ("Krovemark Foods and Zanlester",)], "n string")
    assert {(r["n"], r["company_id"]) for r in peers.resolve_first(df, "n", listed).collect()} == {("Krovemark Foods and Zanlester", "tkro"), ("nobody", None), (None, None)}
    assert df.limit(1).select(peers.named_group(F.lit("compensation_peer_group"), F.lit(2023))).first()[0] == "2023 Compensation Peer Group"
