"""Reading levels on held-out texts."""

import random

from ledgerloom.llm import reading

EASY = "the plan pays a small sum to us each year and we keep it".split()
HARD = "notwithstanding countervailing indemnificatory recharacterization operationalizes extraterritorial disaggregation thereof".split()


def text(rng, level):
    words, out = 0, []
    while words < 80:
        n = 4 + level * level * 2
        out.append(" ".join(rng.choice(HARD if rng.random() < (level - 1) / 3.2 else EASY) for _ in range(n)).capitalize() + ".")
        words += n
    return " ".join(out)


def levels(spark, rows, labels):
    df = spark.createDataFrame([(k, t, x, 9) for k, t, x in rows], "doc_id long, text string, lang string, level int")
    return {r["doc_id"]: r["level"] for r in reading.reading_levels(df, "doc_id", "text", "lang", spark.createDataFrame(labels, "doc_id long, level int")).collect()}


def test_levels_of_held_out_texts(spark):
    rng = random.Random(2)
    truth = {k: rng.randint(1, 4) for k in range(500)}
    rows = [(k, text(rng, v), rng.choice(["en", "en", None])) for k, v in truth.items()]
    got = levels(spark, rows, [(k, v) for k, v in truth.items() if k < 350])
    held = [k for k in truth if k >= 350]
    assert set(got) == set(truth)
    assert sum(got[k] == truth[k] for k in held) > 0.85 * len(held)


def test_few_labels_odd_texts_and_empty_tables(spark):
    rows = [(1, "123 456 !!!", "en"), (2, "Short.", None), (3, "word " * 30_000, "xx"), (4, "<div>&amp;</div>", "de")]
    got = levels(spark, rows, [(2, 4), (2, None), (99, 1)])
    assert set(got) == {1, 2, 3, 4} and all(1 <= v <= 4 for v in got.values())
    assert levels(spark, [], []) == {}
