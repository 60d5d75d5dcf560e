"""The word diff covers every changed sentence and every heading, not one heading per section type."""

import datetime as dt

import pytest

from ledgerloom.operators import sequential
from ledgerloom.plans import catalog

FILINGS = "id string, company_id string, accession_number string, form_type string, filing_date date, filing_year int, acceptance_datetime timestamp, created_at timestamp, updated_at timestamp"


@pytest.fixture
def folder(spark, tmp_path):
    at = dt.datetime(2022, 1, 1)
    filings = [(f"f{y}", "c", f"f{y}", "DEF 14A", dt.date(y, 3, 1), y, at, at, at) for y in (2020, 2021)]
    spark.createDataFrame(filings, FILINGS).write.parquet(f"{tmp_path}/filings.parquet")
    sections = [
        (1, "f2020", "cd_and_a", "Pay", "Our policy is unchanged. We rely on three pillars."),
        (2, "f2020", "cd_and_a", "Plan of 2020", "The plan pays in cash only."),
        (3, "f2021", "cd_and_a", "Pay", "Our policy is unchanged. We rely on four pillars. A wholly new one."),
        (4, "f2021", "cd_and_a", "Plan of 2021", "The plan pays in cash and shares only."),
    ]
    spark.createDataFrame(sections, "id long, filing_id string, section_type string, heading string, text string").write.parquet(f"{tmp_path}/sections.parquet")
    return str(tmp_path)


def test_words_of_all_changed_sentences_and_headings(spark, folder):
    rows = {r["part"]: r for r in catalog.QUERIES["changed_words"](spark, folder).collect()}
    counts = {k: (r["words_same"], r["words_ins"], r["words_del"]) for k, r in rows.items()}
    assert counts == {"text": (10, 3, 1), "heading": (3, 1, 1)}
    pairs = rows["text"]["pairs"]
    assert [(p["old"], p["new"]) for p in pairs] == [("We rely on three pillars.", "We rely on four pillars."), ("The plan pays in cash only.", "The plan pays in cash and shares only.")]
    assert [(w["op"], w["word"]) for w in pairs[1]["words"] if w["op"] != "same"] == [("ins", "and"), ("ins", "shares")]


def test_a_change_of_punctuation_is_a_change():
    assert sequential.word_diff("in cash; ‘only’", "In cash, 'only'") == [("same", "In"), ("del", "cash;"), ("ins", "cash,"), ("same", "'only'")]
