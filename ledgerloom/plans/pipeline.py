"""Queries of the general training-data operators: orphan references and copy differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import copydiff, orphans
from ledgerloom.session import cut
from ledgerloom.sources.tables import latest_load, table

FACT_FIELDS = [
    "metric_name_raw",
    "metric_name_normalized",
    "metric_category",
    "plan_type",
    "observed_value",
    "source_excerpt",
]


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each reference to a company or filing that is missing, or came later than the reference.

    Repeated rows give one row. A member whose group or filing is unknown has a null period.
    """
    members = table(spark, folder, "peer_group_members").select("id", "peer_group_id", "company_id_resolved")
    asked = table(spark, folder, "ask_interactions").select("id", "filing_id", "created_at")
    universe = table(spark, folder, "ticker_universe")
    filings = table(spark, folder, "filings").select("id", "company_id", "filing_year", "created_at")
    company = orphans.clean_key(F.col("company_id_resolved"), lower=True)
    filing = orphans.clean_key(F.col("filing_id"), drop="-")
    never = F.lit(None).cast("timestamp")
    deltas = (
        orphans.reference_deltas(members, "company", company, never)
        .unionByName(orphans.existence_deltas(universe, "company", F.col("ticker_lower"), never))
        .unionByName(orphans.reference_deltas(asked, "filing", filing, F.col("created_at")))
        .unionByName(orphans.existence_deltas(filings, "filing", F.col("id"), F.col("created_at")))
    )
    keys = orphans.orphan_keys(orphans.fold(deltas), timed=("filing",))
    refs = members.select(
        F.lit("company").alias("target"),
        company.alias("key"),
        never.alias("at"),
        F.lit("peer_group_members").alias("src_table"),
        F.col("id").alias("row_id"),
        F.col("peer_group_id").alias("group_id"),
    ).unionByName(
        asked.select(
            F.lit("filing").alias("target"),
            filing.alias("key"),
            F.col("created_at").cast("timestamp").alias("at"),
            F.lit("ask_interactions").alias("src_table"),
            F.col("id").alias("row_id"),
            F.lit(None).cast("long").alias("group_id"),
        )
    )
    found = orphans.orphan_rows(refs.where(F.col("key").isNotNull()), keys)
    groups = table(spark, folder, "peer_groups").select(F.col("id").alias("group_id"), F.col("filing_id").alias("_filing"))
    years = latest_load(filings).select(F.col("id").alias("_filing"), "filing_year")
    year = F.when(F.col("src_table") == "peer_group_members", F.col("filing_year").cast("string"))
    return (
        found.join(groups.dropDuplicates(["group_id"]), "group_id", "left")
        .join(years, "_filing", "left")
        .select("src_table", "row_id", F.coalesce(year, F.date_format("at", "yyyy-MM")).alias("period"))
        .distinct()
    )


def p3_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphan references counted per table and period."""
    return p3_found(spark, folder).groupBy("src_table", "period").agg(F.count(F.lit(1)).alias("orphans"))


def _differences(spark: SparkSession, folder: str) -> DataFrame:
    return copydiff.copy_differences(
        table(spark, folder, "metric_facts"),
        table(spark, folder, "metric_facts_oracle"),
        ["filing_id", "fact_no"],
        FACT_FIELDS,
        ["updated_at", "id"],
        persist=cut,
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """Each fact missing on a side and each field that differs."""
    return _differences(spark, folder).select("filing_id", "fact_no", "field")


def p6_report(spark: SparkSession, folder: str) -> DataFrame:
    """The same differences with both values as stored."""
    return _differences(spark, folder)


_P3_SQL = """
WITH f AS (SELECT id, min(created_at) AS seen, min(filing_year) AS filing_year FROM filings GROUP BY id),
m AS (
  SELECT DISTINCT 'peer_group_members' AS src_table, m.id AS row_id, CAST(f.filing_year AS VARCHAR) AS period
  FROM peer_group_members m LEFT JOIN peer_groups g ON g.id = m.peer_group_id LEFT JOIN f ON f.id = g.filing_id
  WHERE trim(m.company_id_resolved) <> '' AND lower(trim(m.company_id_resolved)) NOT IN (SELECT ticker_lower FROM ticker_universe)),
a AS (
  SELECT DISTINCT 'ask_interactions' AS src_table, a.id AS row_id, strftime(a.created_at, '%Y-%m') AS period
  FROM ask_interactions a LEFT JOIN f ON f.id = replace(trim(a.filing_id), '-', '')
  WHERE trim(replace(trim(a.filing_id), '-', '')) <> '' AND (f.id IS NULL OR f.seen > a.created_at))
SELECT * FROM m UNION ALL SELECT * FROM a"""

_WS = "[\\x{9}-\\x{D}\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]+"


def _p6_sql(values: bool) -> str:
    def side(name: str) -> str:
        return f"(SELECT * FROM {name} QUALIFY row_number() OVER (PARTITION BY filing_id, fact_no ORDER BY updated_at DESC NULLS LAST, id DESC) = 1)"

    def form(c: str) -> str:
        return f"trim(regexp_replace(nfc_normalize({c}), '{_WS}', ' ', 'g'))"

    extra = lambda f: f", a.{f} AS candidate, b.{f} AS oracle" if values else ""
    none = ", NULL::VARCHAR AS candidate, NULL::VARCHAR AS oracle" if values else ""
    both = f"{side('metric_facts')} a JOIN {side('metric_facts_oracle')} b ON a.filing_id = b.filing_id AND a.fact_no = b.fact_no"
    parts = [
        f"SELECT a.filing_id, a.fact_no, '{f}' AS field{extra(f)} FROM {both} WHERE {form('a.' + f)} IS DISTINCT FROM {form('b.' + f)}"
        for f in FACT_FIELDS
    ]
    for here, there, field in (("metric_facts", "metric_facts_oracle", "missing_in_oracle"), ("metric_facts_oracle", "metric_facts", "missing_in_candidate")):
        parts.append(
            f"SELECT DISTINCT filing_id, fact_no, '{field}' AS field{none} FROM {here} x WHERE NOT EXISTS (SELECT 1 FROM {there} y WHERE y.filing_id = x.filing_id AND y.fact_no = x.fact_no)"
        )
    return " UNION ALL ".join(parts)


QUERIES = {"p3_found": p3_found, "p3_report": p3_report, "p6_found": p6_found, "p6_report": p6_report}
ORACLES = {
    "p3_found": _P3_SQL,
    "p3_report": f"SELECT src_table, period, count(*) AS orphans FROM ({_P3_SQL}) GROUP BY src_table, period",
    "p6_found": _p6_sql(False),
    "p6_report": _p6_sql(True),
}
