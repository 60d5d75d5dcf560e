"""Containers: nothing lost, nothing over capacity, little space unused."""

import math
import random
from collections import Counter

import pytest

from ledgerloom.llm import packing


def placed(spark, sizes, capacity):
    df = spark.createDataFrame([(k, s, 0) for k, s in sizes], "doc_id long, tokens long, container int")
    return packing.pack(df, "doc_id", "tokens", capacity).collect()


@pytest.mark.parametrize(("n", "capacity", "mean"), [(400, 64, 20), (700, 2048, 430), (300, 10, 9)])
def test_whole_and_tight(spark, n, capacity, mean):
    rng = random.Random(n)
    sizes = [(i, int(rng.expovariate(1 / mean))) for i in range(n)] + [(n, 5 * capacity + 3), (n + 1, capacity), (n + 2, 3 * capacity)]
    rows = placed(spark, sizes, capacity)
    load, pieces = Counter(), {}
    for r in rows:
        load[r["container"]] += r["tokens"]
        pieces.setdefault(r["doc_id"], []).append((r["part"], r["start"], r["tokens"]))
    assert max(load.values()) <= capacity
    for k, s in sizes:
        at = 0
        for i, (part, start, size) in enumerate(sorted(pieces[k])):
            assert (part, start) == (i, at)
            at += size
        assert at == s and (len(pieces[k]) == 1 or s > capacity)
    used = sum(1 for v in load.values() if v)
    assert used <= math.ceil(sum(s for _, s in sizes) / capacity) * 1.12 + 1


def test_empty_null_and_repeated_items(spark):
    assert placed(spark, [], 10) == []
    rows = placed(spark, [(1, None), (2, 0), (3, 4), (3, 4), (3, 4)], 10)
    assert Counter(r["doc_id"] for r in rows) == {1: 1, 2: 1, 3: 3}
    load = Counter()
    for r in rows:
        load[r["container"]] += r["tokens"]
    assert sorted(load.values()) == [4, 8]


def test_equal_items_take_few_fillings():
    assert packing.fillings({7: 1_000_000_000}, 15) == [(500_000_000, {7: 2})]
    with pytest.raises(ValueError):
        packing.fillings({16: 1}, 15)


def test_two_items_replace_a_smaller_one():
    # greedy takes 6 and 3 of 10; 2 and 2 fill the gap of 3 + 1 exactly
    assert packing.fillings({6: 1, 3: 1, 2: 2}, 10)[0] == (1, {6: 1, 2: 2})
