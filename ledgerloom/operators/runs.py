"""Runs of matches: gaps, backward lookups and dictionary matches by word sequences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def runs(df: DataFrame, by: list[str], start: str, end: str, gap, least: int, tie: list[str] | None = None) -> DataFrame:
    """``df`` with a ``run`` number per group: a new run begins where the distance to the end before exceeds ``gap``; runs of fewer than ``least`` rows are dropped."""
    w = W.partitionBy(*by).orderBy(start, *(tie or []))
    fresh = (F.col(start) - F.lag(end).over(w)) > gap
    df = df.withColumn("run", F.sum(F.coalesce(fresh.cast("long"), F.lit(0))).over(w))
    return df.withColumn("run_size", F.count(F.lit(1)).over(W.partitionBy(*by, "run"))).where(F.col("run_size") >= least)


def last_before(df: DataFrame, marks: DataFrame, by: list[str], at: str, mark: str, within) -> DataFrame:
    """``df`` with the last of ``marks`` at or before ``at`` and nearer than ``within``, else null: one sort per group, no range join."""
    both = df.withColumn("_mark", F.lit(None).cast(marks.schema[mark].dataType)).withColumn("_kind", F.lit(1)).withColumn("_at", F.col(at))
    other = marks.select(*by, F.col(mark).alias("_mark"), F.lit(0).alias("_kind"), F.col(mark).alias("_at"))
    seen = F.last("_mark", ignorenulls=True).over(W.partitionBy(*by).orderBy("_at", "_kind").rowsBetween(W.unboundedPreceding, 0))
    joined = both.unionByName(other, allowMissingColumns=True).withColumn("last_mark", seen).where("_kind = 1")
    return joined.withColumn("last_mark", F.when(F.col(at) - F.col("last_mark") < within, F.col("last_mark"))).drop("_mark", "_kind", "_at")


def word_sequences(words: Column, longest: int) -> Column:
    """All sequences of one to ``longest`` words with the place of their first word, as ``array<struct<place, words, text>>``."""

    def of_length(ws: Column, n: int) -> Column:
        places = F.when(F.size(ws) >= n, F.sequence(F.lit(1), F.size(ws) - n + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.struct(i.alias("place"), F.lit(n).alias("words"), F.array_join(F.slice(ws, i, F.lit(n)), " ").alias("text")))

    return F.get(F.transform(F.array(words), lambda ws: F.concat(*[of_length(ws, n) for n in range(1, longest + 1)])), 0)
