"""References to records that do not exist, kept as signed counts per key.

Every change to a referring table is a reference delta (+1 insert, -1 delete) and every change to a
referred table an existence delta. The state holds one row per key, so a run folds new deltas into the
old state without reading history again. A key with positive references and no existence is an orphan;
a key that came to exist later than a reference leaves that reference an orphan of its own period.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import salted_lookup

STATE = "target string, key string, refs long, first_ref timestamp, last_ref timestamp, existing long, times map<timestamp,long>, timeless long"


def clean_key(column: Column, *, lower: bool = False, drop: str = "") -> Column:
    """Trimmed key without the characters of ``drop``; null for null and blank keys, which refer to nothing."""
    key = F.trim(column)
    key = F.translate(key, drop, "") if drop else key
    key = F.lower(key) if lower else key
    return F.when(F.trim(key) != "", key)


def reference_deltas(df: DataFrame, target: str, key: Column, at: Column, sign: Column | int = 1) -> DataFrame:
    """Change rows of a referring table; null keys are dropped as they are no references."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return df.select(
        F.lit(target).alias("target"),
        key.alias("key"),
        at.cast("timestamp").alias("at"),
        sign.cast("long").alias("ref_delta"),
        F.lit(0).cast("long").alias("exist_delta"),
    ).where(F.col("key").isNotNull())


def existence_deltas(df: DataFrame, target: str, key: Column, at: Column, sign: Column | int = 1) -> DataFrame:
    """Change rows of a referred table."""
    sign = F.lit(sign) if isinstance(sign, int) else sign
    return df.select(
        F.lit(target).alias("target"),
        key.alias("key"),
        at.cast("timestamp").alias("at"),
        F.lit(0).cast("long").alias("ref_delta"),
        sign.cast("long").alias("exist_delta"),
    ).where(F.col("key").isNotNull())


def fold(deltas: DataFrame, state: DataFrame | None = None) -> DataFrame:
    """Fold deltas into the state; the aggregation is partial on the map side, so a hot key costs one row per task and time.

    Besides the signed counts the state keeps how many rows of each time exist (``times``), so that after a deletion the
    earliest surviving row tells since when the key exists: a key that is deleted and re-created exists since its
    re-creation. A time whose rows are all deleted is dropped from the state. ``timeless`` counts rows without a time.
    A deletion must carry the time of the row it deletes.
    """
    is_ref = F.col("ref_delta") > 0
    rows = deltas.groupBy("target", "key", F.when(F.col("exist_delta") != 0, F.col("at")).alias("time")).agg(
        F.sum("ref_delta").alias("refs"),
        F.min(F.when(is_ref, F.col("at"))).alias("first_ref"),
        F.max(F.when(is_ref, F.col("at"))).alias("last_ref"),
        F.sum("exist_delta").alias("n"),
    )
    if state is not None:
        counts = state.select("target", "key", F.explode(F.map_entries("times")).alias("e")).select("target", "key", F.col("e.key").alias("time"), F.col("e.value").alias("n"))
        bare = state.select("target", "key", F.lit(None).cast("timestamp").alias("time"), "refs", "first_ref", "last_ref", F.col("timeless").alias("n"))
        rows = rows.unionByName(bare).unionByName(counts, allowMissingColumns=True)
    per_time = rows.groupBy("target", "key", "time").agg(F.sum("refs").alias("refs"), F.min("first_ref").alias("first_ref"), F.max("last_ref").alias("last_ref"), F.sum("n").alias("n"))
    kept = F.when(F.col("time").isNotNull() & (F.col("n") != 0), F.struct("time", "n"))
    return per_time.groupBy("target", "key").agg(
        F.coalesce(F.sum("refs"), F.lit(0)).alias("refs"),
        F.min("first_ref").alias("first_ref"),
        F.max("last_ref").alias("last_ref"),
        F.coalesce(F.sum("n"), F.lit(0)).alias("existing"),
        F.map_from_entries(F.collect_list(kept)).alias("times"),
        F.coalesce(F.sum(F.when(F.col("time").isNull(), F.col("n"))), F.lit(0)).alias("timeless"),
    )


def first_seen() -> Column:
    """The time of the earliest row of a key that still exists; null if none has a time."""
    return F.array_min(F.map_keys(F.map_filter("times", lambda t, n: n > 0)))


def orphan_keys(state: DataFrame, *, timed: tuple[str, ...] = ()) -> DataFrame:
    """Keys with positive references that do not exist, and for the targets in ``timed`` those that came late.

    ``since`` is the time from which the key exists: null for never. References before it are orphans.
    """
    missing = F.col("existing") <= 0
    late = F.col("target").isin(*timed) & (F.col("first_ref") < first_seen()) if timed else F.lit(False)
    return state.where((F.col("refs") > 0) & (missing | late)).select("target", "key", F.when(~missing, first_seen()).alias("since"))


def orphan_rows(refs: DataFrame, keys: DataFrame) -> DataFrame:
    """Rows of ``refs(target, key, at, ...)`` that refer to an orphan key at their time.

    Only orphan keys enter the join, and the rows of a key that a large share of them name are dealt out over many tasks
    by its count. A row without a time counts if the key never existed. ``refs`` is read twice.
    """
    hit = salted_lookup(refs, keys.select("target", "key", "since"), ["target", "key"])
    return hit.where(F.col("since").isNull() | (F.col("at") < F.col("since")))
