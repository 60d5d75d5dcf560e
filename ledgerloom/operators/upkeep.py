"""Changes of stored tables, expressed as rewrites: each function returns the table as it is afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(old: DataFrame, new: DataFrame, keys: list[str], version: list[str]) -> DataFrame:
    """Rows of both by key; the greatest ``version`` stays, of equal ones that of ``new``. Null keys are a key of their own."""
    rows = old.withColumn("_from", F.lit(0)).unionByName(new.withColumn("_from", F.lit(1)))
    keep = [c for c in old.columns if c not in keys]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*keep), F.struct(*version, "_from")).alias("_row"))
    return best.select(*keys, "_row.*").select(*old.columns)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """``old`` and those rows of ``new`` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_groups(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of the groups that occur in ``new`` replaced by the rows there."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def carry_forward(old: DataFrame, new: DataFrame, keys: list[str], same: list[str], state: list[str]) -> DataFrame:
    """``new`` with ``state`` taken from ``old`` where a row of its key has equal ``same`` columns; keys are unique in ``old``."""
    known = old.select(*keys, F.struct(*same).alias("_same"), *[F.col(s).alias(f"_{s}") for s in state])
    kept = F.col("_same").isNotNull() & F.struct(*same).eqNullSafe(F.col("_same"))
    rows = new.join(known, keys, "left")
    return rows.withColumns({s: F.when(kept, F.col(f"_{s}")).otherwise(F.col(s)) for s in state}).select(*new.columns)


def update_where(df: DataFrame, test: Column, values: dict[str, Column]) -> DataFrame:
    return df.withColumns({c: F.when(F.coalesce(test, F.lit(False)), v).otherwise(F.col(c)) for c, v in values.items()})


def bounded_delete(df: DataFrame, doomed: DataFrame, keys: list[str], most: int, dry: bool = False) -> DataFrame:
    """``df`` without the keys of ``doomed``; refused beyond ``most`` rows, and unchanged on a dry run."""
    n = df.join(doomed.select(*keys).distinct(), keys, "left_semi").limit(most + 1).count()
    if n > most:
        raise ValueError(f"the deletion would take more than {most} rows")
    return df if dry else df.join(doomed.select(*keys).distinct(), keys, "left_anti")


def reviewed(action: Column) -> Column:
    """The verification state that a review action gives."""
    return F.when(action == "reviewed", "verified").when(action == "flagged", "rejected").otherwise("machine_extracted")
