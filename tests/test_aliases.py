"""Names of listed companies in texts: kinds of alias, packing, and a slow search for comparison."""

import os
from pathlib import Path

import pytest

from ledgerloom.operators import aliases
from ledgerloom.plans import catalog
from ledgerloom.sources.tables import table

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_kinds_of_alias():
    of = lambda n: dict(aliases.aliases(n))
    assert of("Casilpont Therapeutics N.V.") == {"casilpont therapeutics n v": 0.99, "casilpont therapeutics": 0.96, "casilpont": 0.92}
    assert of("Merck & Co., Inc.") == {"merck and co inc": 0.99, "merck": 0.96}
    assert of("Alpha Beta Gamma Corp.") == {"alpha beta gamma corp": 0.99, "alpha beta gamma": 0.96, "abg": 0.88}
    assert of("Cascade Bélanger Bank") == {"cascade belanger bank": 0.99, "cbb": 0.88, "cascade": 0.87}
    assert of("Hewlett Financial Inc") == {"hewlett financial inc": 0.99, "hewlett financial": 0.96, "hewlett": 0.9}
    assert of("Global Payments Inc") == {} and of("Global Payments LLC") == {"global payments llc": 0.99}
    assert of("3M Company") == {"3m company": 0.99, "3m": 0.96}


def found(spark, companies, texts):
    listed = spark.createDataFrame([(t, "1", n) for t, n in companies], "ticker string, cik string, name string")
    rows = aliases.mentions(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "id", "text", listed).collect()
    return sorted((r["id"], r["ticker"], r["alias"], r["place"], r["confidence"], r["sharing"]) for r in rows)


def test_initials_count_in_capitals(spark):
    companies = [("IT", "Ilvane Tarfold Stoarick Inc.")]
    assert found(spark, companies, ["the plan and its terms", "the plan of ITS and its terms"]) == [(1, "IT", "its", 4, 0.88, 1)]


def test_mentions_are_packed_and_shared_aliases_counted(spark):
    companies = [("CT", "Casilpont Therapeutics N.V."), ("AB", "Alphabra Software Group, Inc."), ("AC", "Alphabra Software Corp."), ("SF", "Software Foodhart Ltd.")]
    texts = [
        "At Casilpont the plan",
        "of Casilpont (CT), then Casilpont Therapeutics",
        "ALPHABRA\nSoftware Foodhart",
        "Ａlphabra Software Group",
        "alphabra",
        None,
        "",
    ]
    assert found(spark, companies, texts) == [
        (0, "CT", "casilpont", 2, 0.92, 1),
        (1, "CT", "casilpont therapeutics", 4, 0.96, 1),
        (2, "AB", "alphabra software", 1, 0.96, 2),
        (3, "AB", "alphabra software", 1, 0.96, 2),
        (4, "AB", "alphabra", 1, 0.9, 2),
    ]
    assert found(spark, [], ["Casilpont"]) == []


@pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")
def test_query_equals_slow_search(spark):
    listed = table(spark, DATA, "ticker_universe").collect()
    forms = [(r["ticker"], aliases.aliases(r["name"])) for r in listed]
    want = set()
    for s in table(spark, DATA, "sections").where("text IS NOT NULL").collect():
        cased = f" {' '.join(aliases.written(aliases.SYMBOLS.sub(' ', s['text'])))} "
        text = cased.lower()
        hits = []
        for ticker, own in forms:
            at = next(((t.index(f" {b} "), a, c) for a, c in own for t, b in [(cased, a.upper()) if c == 0.88 else (text, a)] if f" {b} " in t), None)
            if at:
                hits.append((at[0], -len(at[1]), -at[2], ticker.lower(), ticker, at[1]))
        end = -1
        for start, size, _, _, ticker, alias in sorted(hits):
            if start >= end:
                want.add((s["id"], ticker, alias))
                end = start - size + 1
    got = catalog.QUERIES["company_mentions"](spark, DATA).collect()
    assert len(got) == len(want) > 0
    assert {(r["section_id"], r["ticker"], r["alias"]) for r in got} == want
