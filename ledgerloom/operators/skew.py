"""Joins that stay balanced when one key holds a large share of the rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

#: A key is hot if it has more than this share of all rows, so there are at most 1 / SHARE hot keys ...
SHARE = 0.001
#: ... and more rows than one task does easily.
LEAST = 20_000


def hot_keys(df: DataFrame, keys: list[str], counts: DataFrame | None = None, n: str = "_n") -> DataFrame:
    """``keys, _salts``: the keys that hold a large share of the rows, and over how many tasks to deal the rows of each.

    At most 1 / ``SHARE`` rows, whatever the size of ``df``; a null key is never hot. ``_salts`` grows with the key's count.
    Where ``counts`` by key are at hand in the column ``n``, ``df`` is not read.
    """
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")) if counts is None else counts.select(*keys, F.col(n).alias("_n"))
    every = counts.agg(F.greatest(F.lit(LEAST), F.coalesce(F.sum("_n"), F.lit(0)) * SHARE).alias("_most"))
    known = counts.where(" AND ".join(f"`{k}` IS NOT NULL" for k in keys))
    return known.join(F.broadcast(every)).where("_n > _most").select(*keys, F.ceil(F.col("_n") / F.col("_most")).cast("int").alias("_salts"))


def salted_lookup(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", counts: DataFrame | None = None, n: str = "_n") -> DataFrame:
    """Join ``big`` to ``small``, of which each key has few rows, with every hot key of ``big`` dealt out over many tasks.

    The rows of a hot key in ``big`` are dealt out by a hash of the whole row, and its rows in ``small`` are repeated per
    salt; other keys are joined as they are. Identical rows of ``big`` share a salt. Which keys are hot is found at once, by a count
    of ``big`` unless ``counts`` of its keys are given, so that it should be a stored table or a plain scan; where none is, the
    join is a plain one. ``how`` is inner, left, left_semi or left_anti.
    """
    found = hot_keys(big.select(*keys), keys, counts, n).collect()  # at most 1 / SHARE rows
    if not found:
        return big.join(small, keys, how)
    types = [big.schema[k] for k in keys]
    hot = F.broadcast(big.sparkSession.createDataFrame([tuple(r) for r in found], StructType([*types, StructField("_salts", IntegerType())])))
    row = F.xxhash64(*[F.col(f"`{c}`") for c in big.columns])
    salts = F.coalesce("_salts", F.lit(1))
    dealt = big.join(hot, keys, "left").withColumn("_salt", F.pmod(row, salts).cast("int")).drop("_salts")
    repeated = small.join(hot, keys, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("_salts")
    return dealt.join(repeated, [*keys, "_salt"], how).drop("_salt")
