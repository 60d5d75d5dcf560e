"""Mapping of names and linking of spellings."""

import random

import pytest

from ledgerloom.llm import canonical, variants

UNIVERSE = [("BLA", "Belanford Foods plc"), ("BLB", "Belanford Systems & Energy Corp."), ("KRV", "Krovémark Chemical Inc."), ("ZAN", "Zanellster International Group, Inc.")]


def mapped(spark, names, universe=UNIVERSE):
    typed = spark.createDataFrame([(i, n, "x") for i, n in enumerate(names)], "id long, raw string, ticker string")
    listed = spark.createDataFrame([(*u, "clash") for u in universe], "ticker string, name string, raw string")
    return {r["raw"]: r["ticker"] for r in canonical.map_names(typed, "raw", listed).collect()}


FORMS = [
    ("Belanford Foods plc", "BLA"),
    ("THE BELANFORD FOODS PLC (1)", "BLA"),
    ("Belan ford Sys. Corp.", "BLB"),
    ("Systems (Belanford)", "BLB"),
    ("Bealnford Foods Co.", "BLA"),
    ("Krovemark Chem (formerly Oldname Inc.)", "KRV"),
    ("Zane11ster Intl.", "ZAN"),
    ("Zanellster Bakery Group", ""),
    ("Belanford", ""),
    ("Belanford [BLB]", "BLB"),
    ("Quite Another Company", ""),
    ("Sys. (Belanford)", "BLB"),
    ("Intl, Zanellster", "ZAN"),
]


@pytest.fixture(scope="module")
def forms(spark):
    known = [*UNIVERSE, *[(f"T{i}", f"Other{chr(97 + i)}name Foods and Systems Energy International Chemical plc") for i in range(12)]]
    return mapped(spark, [raw for raw, _ in FORMS], known)


@pytest.mark.parametrize(("raw", "ticker"), FORMS)
def test_forms_of_names(forms, raw, ticker):
    assert forms[raw] == ticker


def test_null_empty_repeated_and_long_names(spark):
    long = "x" * 20_000
    out = mapped(spark, [None, "", " ", "Inc.", long, "Belanford Foods plc", "Belanford Foods plc"])
    assert out == {None: "", "": "", " ": "", "Inc.": "", long: "", "Belanford Foods plc": "BLA"}


def test_empty_tables(spark):
    assert mapped(spark, []) == {}
    assert mapped(spark, ["Belanford Foods plc"], []) == {"Belanford Foods plc": ""}


def test_candidates_are_all_stems_within_the_edits(spark):
    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    listed = sorted({word(rng.randint(3, 10)) for _ in range(60)})
    typed = sorted({word(rng.randint(2, 11)) for _ in range(80)})

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    allowed = lambda n: 2 if n >= 6 else 1 if n >= 4 else 0
    want = {(t, u) for t in typed for u in listed if distance(t, u) <= allowed(len(u))}
    frame = lambda xs: spark.createDataFrame([(x,) for x in xs], "stem string")
    got = {(r["typed"], r["listed"]) for r in canonical.stem_candidates(frame(typed), frame(listed)).collect()}
    assert got == want


def persons(spark, names):
    df = spark.createDataFrame([("f", n, 1) for n in names], "g string, n string, name_a int")
    return {(r["name_a"], r["name_b"]) for r in variants.link_persons(df, ["g"], "n").collect()}


def test_spellings_of_persons(spark):
    same = ["Christopher J. Dalumman", "C. J. Dalumman", "Chris Dalumman", "DALUMMAN, CHRISTOPHER J", "Dr. Christopher J. Dalumann", "Christopher J. Dalumman (2)"]
    want = {tuple(sorted((a, b))) for a in same for b in same if a < b}
    assert persons(spark, same) == want


def test_relatives_and_initials(spark):
    assert persons(spark, ["Olga K. Gorandberg", "Bjorn E. Gorandberg"]) == set()
    assert persons(spark, ["Joan Halomby", "Julia Halomby", "J. Halomby"]) == set()
    assert persons(spark, ["Joan A. Halomby", "Julia B. Halomby", "J. A. Halomby"]) == {("J. A. Halomby", "Joan A. Halomby")}
    assert persons(spark, ["Edward Isompska", "Edward Isompska, Jr."]) == set()


def test_null_empty_and_repeated_persons(spark):
    assert persons(spark, [None, "", " ", "Ann Bellwood", "Ann Bellwood", "A. Bellwood"]) == {("A. Bellwood", "Ann Bellwood")}
    assert persons(spark, []) == set()


def test_spellings_of_companies(spark):
    names = ["Belanford Foods plc", "The Belanford Foods Co.", "Foods (Belanford)", "Belan-ford", "Belanford Bakery Ltd.", "Krovemark Foods plc", None, ""]
    df = spark.createDataFrame([("f", n) for n in names], "g string, n string")
    universe = spark.createDataFrame([("T", f"Name{chr(97 + i)}stem Foods plc") for i in range(12)], "ticker string, name string")
    got = {(r["name_a"], r["name_b"]) for r in variants.link_companies(df, ["g"], "n", universe).collect()}
    assert ("Belanford Foods plc", "The Belanford Foods Co.") in got and ("Belanford Foods plc", "Foods (Belanford)") in got
    assert not any("Belanford Bakery Ltd." in p and "Belanford Foods plc" in p for p in got)
    assert not any("Krovemark Foods plc" in p for p in got)
