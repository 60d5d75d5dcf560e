"""Differences between two copies of a table, found by descending a tree of checksums.

Keys are hashed into a 60-bit key space whose prefixes are nested ranges. One pass over either side gives
a checksum per key and per small range; the levels above are sums of these. From the root on, only children of
ranges that differ are looked at, and the values themselves are read and compared in the ranges
that still differ at the last level.
"""

from __future__ import annotations

import math
import unicodedata
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ledgerloom.session import cut

#: Unicode white space, as in the property White_Space (fixed values).
SPACES = "\\u0009-\\u000D\\u0020\\u0085\\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000"
BITS = 60
#: Ranges are bisected further while more than this share of them differs.
PAYS = 0.1


@F.pandas_udf(StringType())
def nfc(values: pd.Series) -> pd.Series:
    """Unicode form NFC; null stays null."""
    return values.map(lambda v: unicodedata.normalize("NFC", v), na_action="ignore")


def collapse(column: Column) -> Column:
    """Each run of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(column, f"[{SPACES}]+", " "))


def current_rows(df: DataFrame, keys: list[str], values: list[Column], version: list[str], name: str) -> DataFrame:
    """Of the rows of a key, the one with the greatest ``version``; a null version counts as the least."""
    order = F.struct(*[F.struct(F.col(v).isNotNull(), F.col(v)) for v in version])
    return df.groupBy(*keys).agg(F.max_by(F.struct(*values), order).alias(name))


def _position(keys: list[str]) -> Column:
    return F.shiftrightunsigned(F.xxhash64(*keys), 64 - BITS).cast("long")


def _checksum(fields: list[str]) -> list[Column]:
    # presence flags keep null apart from the empty string
    values = [x for f in fields for x in (F.col(f).isNull(), F.coalesce(collapse(F.col(f)), F.lit("")))]
    return [F.xxhash64(*values).alias("h1"), F.xxhash64(F.lit(7), *values).alias("h2")]


def _key_sums(df: DataFrame, keys: list[str], fields: list[str], version: list[str]) -> DataFrame:
    """``at, x``: the place of each key among the ranges, and the checksum of its row."""
    rows = current_rows(df, keys, _checksum(fields), version, "row")
    return rows.select(_position(keys).alias("at"), F.xxhash64(*keys, "row.h1", "row.h2").alias("x"))


def _leaves(sums: DataFrame, shift: int) -> DataFrame:
    return sums.groupBy(F.shiftright("at", shift).alias("range")).agg(
        F.count(F.lit(1)).alias("n"), F.bit_xor("x").alias("x"), F.sum(F.shiftright("x", 24)).alias("s")
    )


def _level(leaves: DataFrame, shift: int) -> DataFrame:
    return leaves.groupBy(F.shiftright("range", shift).alias("range")).agg(
        F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.sum("s").alias("s")
    )


def _unequal(a: DataFrame, b: DataFrame) -> DataFrame:
    """``parent``: the ranges whose checksums differ."""
    both = a.select("range", F.struct("n", "x", "s").alias("p")).join(b.select("range", F.struct("n", "x", "s").alias("q")), "range", "full_outer")
    return both.where(~F.col("p").eqNullSafe(F.col("q"))).select(F.col("range").alias("parent"))


def differing_ranges(left: DataFrame, right: DataFrame, depth: int, fan: int) -> DataFrame:
    """Ids of the smallest ranges whose checksums differ, reached only through differing parents."""
    found = None
    for level in range(1, depth + 1):
        shift = (depth - level) * fan
        a, b = _level(left, shift), _level(right, shift)
        if found is not None:  # children of the ranges that differed one level up
            a, b = (x.join(found, F.shiftright(x["range"], fan) == F.col("parent"), "left_semi") for x in (a, b))
        found = _unequal(a, b)
    return found.withColumnRenamed("parent", "range")


def copy_differences(
    candidate: DataFrame,
    oracle: DataFrame,
    keys: list[str],
    fields: list[str],
    version: list[str],
    *,
    leaf_rows: int = 64,
    fan: int = 4,
    persist=cut,
) -> DataFrame:
    """One row per key and difference: ``keys, field, candidate, oracle``.

    ``field`` is ``missing_in_candidate``, ``missing_in_oracle`` (both values null) or a differing field.
    Of several rows of a key the greatest ``version`` counts. Values are strings, compared in NFC with white
    space collapsed; null differs from the empty string. Rows whose keys are null are rows like others.
    Two empty tables, or a table against itself, give no row. Other columns are never read.
    ``persist`` stores the checksums by key and by range, which every level reads. Where many of the smallest ranges
    differ, they are bisected further, down to single keys, until what is left to compare field by field is mostly unequal.
    """
    keep = keys + fields + [v for v in version if v not in keys + fields]
    a, b = candidate.select(keep), oracle.select(keep)
    sums = [persist(_key_sums(x, keys, fields, version)) for x in (a, b)]
    rows = max(1, sums[0].count())
    depth = min(BITS // fan, max(1, math.ceil(math.log(max(2, rows / leaf_rows), 2**fan))))
    left, right = (persist(_leaves(x, BITS - depth * fan)) for x in sums)
    ranges = persist(differing_ranges(left, right, depth, fan))
    while depth < BITS // fan and 2 ** (depth * fan) < rows * 2**fan and ranges.count() > PAYS * min(rows, 2 ** (depth * fan)):
        shift, parents = BITS - depth * fan, ranges.withColumnRenamed("range", "parent")
        depth += 1
        inside = [x.join(parents, F.shiftright(x["at"], shift) == F.col("parent"), "left_semi") for x in sums]
        ranges = persist(_unequal(*(_leaves(x, BITS - depth * fan) for x in inside)).withColumnRenamed("parent", "range"))
    leaf = F.shiftright(_position(keys), BITS - depth * fan)

    def at_leaves(x: DataFrame, name: str) -> DataFrame:
        x = x.withColumn("_range", leaf).join(ranges.withColumnRenamed("range", "_range"), "_range", "left_semi")
        return current_rows(x, keys, [F.col(f) for f in fields], version, name)

    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    pairs = (
        at_leaves(a, "p").alias("a").join(at_leaves(b, "q").alias("b"), reduce(Column.__and__, on), "full_outer")
    ).select(*[F.coalesce(f"a.{k}", f"b.{k}").alias(k) for k in keys], "p", "q")
    plain = lambda c: collapse(nfc(c))
    # only values that differ as stored need the comparison of their forms
    unlike = pairs.where(~F.col("p").eqNullSafe(F.col("q"))).select(
        *keys,
        F.explode(
            F.when(F.col("p").isNull(), F.array(_entry("missing_in_candidate")))
            .when(F.col("q").isNull(), F.array(_entry("missing_in_oracle")))
            .otherwise(F.filter(F.array(*[_entry(f, f"p.{f}", f"q.{f}") for f in fields]), lambda e: ~e["candidate"].eqNullSafe(e["oracle"])))
        ).alias("d"),
    ).select(*keys, "d.*")
    missing = F.col("field").isin("missing_in_candidate", "missing_in_oracle")
    return (
        unlike.withColumns({"_a": plain(F.col("candidate")), "_b": plain(F.col("oracle"))})
        .where(missing | ~F.col("_a").eqNullSafe(F.col("_b")))
        .drop("_a", "_b")
    )


def _entry(name: str, a: str | None = None, b: str | None = None) -> Column:
    value = lambda c: (F.col(c) if c else F.lit(None)).cast("string")
    return F.struct(F.lit(name).alias("field"), value(a).alias("candidate"), value(b).alias("oracle"))
