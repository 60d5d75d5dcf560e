"""Table registry: one Parquet file or folder per table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read ``folder/name.parquet``; column pruning and filters reach the scan."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def latest_load(filings: DataFrame) -> DataFrame:
    """One row per filing id with its earliest load time.

    A filing that was loaded twice keeps the attributes of its first load. Null ids give no row.
    """
    return (
        filings.where(F.col("id").isNotNull())
        .groupBy("id")
        .agg(
            F.min("created_at").alias("created_at"),
            F.min_by("company_id", "created_at").alias("company_id"),
            F.min_by("filing_year", "created_at").alias("filing_year"),
        )
    )
