"""Near copies against brute force."""

import random
import re

import pytest

from ledgerloom.llm import nearcopies


def brute(texts, words, num, den):
    sets = {}
    for k, t in texts:
        w = re.findall("[a-z0-9]+", (t or "").lower())
        s = frozenset(zip(*(w[i:] for i in range(words))))
        if s:
            sets[k] = s
    keys = sorted(sets)
    return {(a, b) for a in keys for b in keys if a < b and len(sets[a] & sets[b]) * den >= len(sets[a] | sets[b]) * num}


def found(spark, texts, words, at_least):
    df = spark.createDataFrame([(k, t, "clash") for k, t in texts], "id long, text string, tokens string")
    members, pairs = nearcopies.near_copies(df, "id", "text", words=words, at_least=at_least)
    of = {}
    for r in members.collect():
        of.setdefault(r["id"], []).append(r["key"])
    out = {(x, y) for ks in of.values() for x in ks for y in ks if x < y}
    for r in pairs.collect():
        out |= {(min(x, y), max(x, y)) for x in of[r["a"]] for y in of[r["b"]]}
    return out


@pytest.mark.parametrize(("words", "at_least", "vocabulary"), [(3, (3, 5), 12), (3, (3, 5), 400), (5, (4, 5), 60)])
def test_no_pair_is_missed_or_made_up(spark, words, at_least, vocabulary):
    rng = random.Random(vocabulary)
    texts = []
    for k in range(260):
        base = texts[rng.randrange(len(texts))][1].split() if texts and rng.random() < 0.6 else None
        if base is None:
            base = [f"w{int(rng.paretovariate(0.6)) % vocabulary}" for _ in range(rng.choice([2, 5, 18, 60, 150, 300]))]
        for _ in range(rng.choice([0, 1, 1, 2, 6])):
            at = rng.randrange(len(base) + 1)
            base[at : at + rng.randint(0, 2)] = [f"w{rng.randrange(vocabulary)}"] * rng.randint(0, 2)
        texts.append((k, " ".join(base)))
    want = brute(texts, words, *at_least)
    assert want
    assert found(spark, texts, words, at_least) == want


def test_null_empty_short_long_and_repeated_texts(spark):
    long = " ".join(f"w{i}" for i in range(20_000))
    texts = [(1, None), (2, ""), (3, "two words"), (4, "A b c d"), (5, "a, B; c! d"), (6, long), (7, long + " end")]
    assert found(spark, texts, 3, (3, 5)) == {(4, 5), (6, 7)}
    assert found(spark, [], 3, (3, 5)) == set()


def test_every_set_reaches_its_prefix():
    import numpy as np

    rng = np.random.default_rng(1)
    for n_sets in (1, 50, 5_000_000):
        counts = rng.integers(0, n_sets + 1, nearcopies.COUNTERS)
        scheme = nearcopies.Scheme(counts, n_sets, (3, 5))
        for n in (1, 2, 16, 17, 26, 27, 64, 65, 100, 256, 257, 700):
            tokens = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            assert scheme.signatures(tokens)


def test_prefixes_reach_their_depth_at_any_size():
    import numpy as np

    rng = np.random.default_rng(2)
    for sets, at_least in ((50, (3, 5)), (5_000_000, (3, 5)), (5_000_000, (4, 5)), (1_000, (1, 10))):
        num, den = at_least
        scheme = nearcopies.Scheme(rng.integers(1, sets + 1, nearcopies.COUNTERS), sets, at_least)
        for n in (1, 16, 17, 33, 64, 65, 129, 700, 3000):
            tokens = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
            _, _, depth, asks, _ = scheme.all_signatures(tokens, np.array([len(tokens)]))
            assert depth[asks].max() == len(tokens) - -(-len(tokens) * num // den) + 1


def test_wording_that_half_of_the_texts_share(spark, monkeypatch):
    """A paragraph in half of the texts, most of some and little of others, with signatures dealt out."""
    monkeypatch.setattr(nearcopies, "HOT", 30)
    monkeypatch.setattr(nearcopies, "SAMPLED", 1)
    rng = random.Random(7)
    shared = " ".join(f"s{i}" for i in range(60))
    own = lambda n: " ".join(f"w{rng.randrange(500)}" for _ in range(n))
    texts = [(k, f"{shared} {own(rng.choice([5, 20, 38, 45, 90, 300]))}" if k % 2 else own(rng.choice([30, 100, 200]))) for k in range(240)]
    want = brute(texts, 3, 3, 5)
    assert want
    assert found(spark, texts, 3, (3, 5)) == want


def test_pairs_of_a_class_that_holds_a_third_of_the_rows(spark, tmp_path, monkeypatch):
    from ledgerloom.llm import queries
    from ledgerloom.operators import skew

    monkeypatch.setattr(queries, "MEMBERS_A_TASK", 7)
    monkeypatch.setattr(skew, "LEAST", 10)
    copy = " ".join(f"w{i}" for i in range(40))
    texts = [(k, copy if k % 3 == 0 else copy + " end" if k == 1 else f"a{k} b{k} c{k} d{k}") for k in range(120)] + [(200, None), (201, "")]
    spark.createDataFrame(texts, "id long, text string").write.parquet(str(tmp_path / "sections.parquet"))
    got = {(r["section_id_a"], r["section_id_b"]) for r in queries.p2_found(spark, str(tmp_path)).collect()}
    assert got == brute(texts, 3, 3, 5)
    links = {r["section_id"]: r["links"] for r in queries.p2_classes(spark, str(tmp_path)).collect()}
    assert links[0] == links[1] == 1 and links[2] == 0 and 200 not in links


def test_characters_that_separate_words():
    tokens, n = nearcopies.shingles(["A b\0c", "a B C", "", "x", "a b c d", "ä b c", "K b c"], 3)
    assert n.tolist() == [1, 1, 0, 0, 2, 0, 1]
    assert tokens[0] == tokens[1] and tokens[0] in tokens[2:4]
