"""Spellings that leave open who is meant stay linked to each other."""

from ledgerloom.llm import variants


def test_open_spellings_of_a_person(spark):
    names = ["Joan Halomby", "Julia Halomby", "J. Halomby", "J Halomby"]
    rows = variants.link_persons(spark.createDataFrame([("g", n) for n in names], "g string, n string"), ["g"], "n").collect()
    assert {(r["name_a"], r["name_b"]) for r in rows} == {("J Halomby", "J. Halomby")}


def test_open_spellings_of_a_company(spark):
    universe = spark.createDataFrame([("A", "Acmevane Foods Inc."), ("B", "Acmevane Energy Corp."), ("C", "Other Foods and Energy Co.")], "ticker string, name string")
    names = ["Acmevane Foods", "Acmevane Energy", "Acmevane Inc", "Acmevane Incorporated"]
    rows = variants.link_companies(spark.createDataFrame([("g", n) for n in names], "g string, n string"), ["g"], "n", universe).collect()
    assert {(r["name_a"], r["name_b"]) for r in rows} == {("Acmevane Inc", "Acmevane Incorporated")}
