"""Items of varying size placed into containers of fixed capacity, by best-two-fit.

A container is filled greedily with the largest item that fits; then its smallest item is exchanged for
two unpacked ones that fill the widened gap more tightly, as long as that gains. What decides is
how many items there are of each size, so the plan is made on that histogram: a filling is
repeated as often as its sizes last, and there are at most CAPACITY sizes however many items there are.
Items get their place by their rank among items of their size, without any being moved to the driver.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

CAPACITY = 2048
#: Least parts into which the items of one size are ranked, and items of a part, so that a size that holds most items is no single task.
PARTS, ITEMS_A_PART = 64, 200_000


def _largest(left: np.ndarray, most: int) -> int:
    fits = np.flatnonzero(left[: most + 1])
    return int(fits[-1]) if len(fits) else 0


def _two(left: np.ndarray, most: int) -> tuple[int, int]:
    """Two sizes still left, of the greatest sum up to ``most``; zeros if there are none."""
    sizes = np.flatnonzero(left[:most])
    if not len(sizes):
        return 0, 0
    other = most - sizes
    at = np.searchsorted(sizes, other, side="right") - 1
    good = at >= 0
    partner = sizes[np.maximum(at, 0)]
    # an item can't be its own partner
    alone = good & (partner == sizes) & (left[sizes] < 2)
    at = np.where(alone, at - 1, at)
    good = at >= 0
    partner = sizes[np.maximum(at, 0)]
    total = np.where(good, sizes + partner, 0)
    best = int(total.argmax())
    return (int(sizes[best]), int(partner[best])) if total[best] else (0, 0)


def fillings(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """How often to use which filling ``{size: items}`` so that all of ``counts`` is placed."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for size, n in counts.items():
        if not 0 < size <= capacity:
            raise ValueError("sizes lie between 1 and the capacity")
        left[size] += n
    plan = []
    while left.any():
        used: list[int] = []
        gap = capacity
        while gap and (size := _largest(left, gap)):
            left[size] -= 1
            used.append(size)
            gap -= size
        while gap and used:
            small = min(used)
            a, b = _two(left, gap + small)
            if a + b <= small:
                break
            used.remove(small)
            left[small] += 1
            left[a] -= 1
            left[b] -= 1
            used += [a, b]
            gap += small - a - b
        filling = {s: used.count(s) for s in used}
        more = min(int(left[s]) // k for s, k in filling.items())
        for s, k in filling.items():
            left[s] -= more * k
        plan.append((1 + more, filling))
    return plan


def _slots(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows ``(size, first rank, end rank, first container, items a container)``, and the number of containers."""
    taken: dict[int, int] = {}
    rows, container = [], 0
    for times, filling in fillings(counts, capacity):
        for size, k in filling.items():
            first = taken.get(size, 0)
            taken[size] = first + times * k
            rows.append((size, first, first + times * k, container, k))
        container += times
    return rows, container


def _ranked(df: DataFrame, by: list[str], key: str, name: str, parts: int) -> DataFrame:
    """``df`` with the rank from 0 of each row among the rows equal in ``by``, ordered by hash part and key."""
    part = F.pmod(F.xxhash64(key), F.lit(parts)).alias("_part")
    df = df.withColumn("_part", part)
    sums = df.groupBy(*by, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(W.partitionBy(*by).orderBy("_part")) - F.col("_n")
    starts = sums.select(*by, "_part", before.alias("_start"))
    within = F.row_number().over(W.partitionBy(*by, "_part").orderBy(key)) - 1
    return df.withColumn("_within", within).join(starts, [*by, "_part"]).withColumn(name, F.col("_start") + F.col("_within")).drop("_part", "_start", "_within")


def pack(sizes: DataFrame, key: str, size: str, capacity: int = CAPACITY) -> DataFrame:
    """``key, part, container, start, size``: one row for each placed piece of an item.

    An item larger than the capacity is cut into full pieces and a rest; no other is cut. ``start`` is
    the offset of the piece in its item. An item without size fits anywhere and is spread over the containers
    there are. A null size counts as 0. Repeated rows are items of their own. ``sizes`` is read five times, so
    it should be a stored table.
    """
    spark = sizes.sparkSession
    items = sizes.select(F.col(key).alias("key"), F.coalesce(F.col(size), F.lit(0)).cast("long").alias("all"))
    big = F.col("all") > capacity
    items = items.select("key", "all", F.when(big, F.floor(F.col("all") / capacity)).otherwise(0).alias("full"))
    items = items.withColumn("rest", F.col("all") - F.col("full") * capacity)
    counts = {r["rest"]: r["n"] for r in items.where("rest > 0").groupBy("rest").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows, used = _slots(counts, capacity)
    whole_items = items.where("full > 0").count()
    parts = max(PARTS, -(-max([whole_items, *counts.values()]) // ITEMS_A_PART))
    slots = spark.createDataFrame(rows, "rest long, first long, end long, base long, k long")
    rest = (
        _ranked(items.where("rest > 0"), ["rest"], "key", "rank", parts)
        .join(F.broadcast(slots), "rest")  # at most a few rows per size and filling, whatever the number of items
        .where((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("end")))
        .select("key", F.col("full").alias("part"), (F.col("base") + F.floor((F.col("rank") - F.col("first")) / F.col("k"))).alias("container"), (F.col("full") * capacity).alias("start"), F.col("rest").alias("size"))
    )
    # containers filled by one piece come after the others, numbered by running sums over hash parts
    cut = items.where("full > 0").withColumn("_part", F.pmod(F.xxhash64("key"), F.lit(parts)))
    sums = cut.groupBy("_part").agg(F.sum("full").alias("_n"))
    starts = sums.select("_part", (F.sum("_n").over(W.orderBy("_part")) - F.col("_n")).alias("_start"))
    before = F.sum("full").over(W.partitionBy("_part").orderBy("key").rowsBetween(W.unboundedPreceding, 0)) - F.col("full")
    whole = (
        cut.withColumn("_before", before)
        .join(starts, "_part")
        .select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("full") - 1)).alias("part"), (F.col("_start") + F.col("_before") + used).alias("_first"))
        .select("key", "part", (F.col("_first") + F.col("part")).alias("container"), (F.col("part") * capacity).alias("start"), F.lit(capacity).cast("long").alias("size"))
    )
    zero = F.lit(0).cast("long")
    empty = items.where("all = 0").select("key", zero.alias("part"), F.pmod(F.xxhash64("key"), F.lit(max(1, used))).alias("container"), zero.alias("start"), zero.alias("size"))
    placed = rest.unionByName(whole).unionByName(empty)
    return placed.select(F.col("key").alias(key), "part", "container", "start", F.col("size").alias(size))
