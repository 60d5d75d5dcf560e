"""Other sources and sinks: folder trees of JSON, blocks of parallel arrays, blobs, failover and reports."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X


def json_tree(spark: SparkSession, root: str, name: str, schema: str) -> DataFrame:
    """Rows of all ``root/<company>/<filing>/name.json`` files with both keys taken from the path.

    Each file holds an array of rows or one row; a missing file gives no row.
    """
    path = F.col("_metadata.file_path")
    rows = spark.read.schema(schema).option("multiLine", True).option("pathGlobFilter", f"{name}.json").option("recursiveFileLookup", True).json(root)
    part = lambda i: F.element_at(F.split(path, "/"), i)
    return rows.select(part(-3).alias("company_key"), part(-2).alias("filing_key"), "*")


def _file_system(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target, target.getFileSystem(spark._jsc.hadoopConfiguration())


def write_json_tree(df: DataFrame, root: str, keys: list[str]) -> int:
    """Write rows as JSON under a folder per key, and return their number.

    The tree is written beside ``root`` and then takes its place; if the write or the last step fails, the old tree is put
    back, so that a reader finds the old tree or the new one, whole.
    """
    spark, seen = df.sparkSession, Observation()
    new, old = f"{root.rstrip('/')}.new-{uuid.uuid4().hex}", f"{root.rstrip('/')}.old-{uuid.uuid4().hex}"
    at, fs = _file_system(spark, root)
    path = spark._jvm.org.apache.hadoop.fs.Path
    try:
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.partitionBy(*keys).json(new)
        had = fs.exists(at)
        if had and not fs.rename(at, path(old)):
            raise OSError(f"{root} can't be moved")
        if not fs.rename(path(new), at):
            if had:
                fs.rename(path(old), at)
            raise OSError(f"{root} can't be replaced")
    finally:
        fs.delete(path(new), True)
    fs.delete(path(old), True)
    return seen.get["rows"]


def load_tree(spark: SparkSession, root: str, target: str, schemas: dict[str, str]) -> dict[str, int]:
    """Load a tree of JSON files into one Parquet table for each name of ``schemas``; returns the rows of each, counted while written."""
    rows = {}
    for name, schema in schemas.items():
        seen = Observation()
        json_tree(spark, root, name, schema).observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("overwrite").parquet(f"{target}/{name}.parquet")
        rows[name] = seen.get["rows"]
    return rows


def first_available(primary: Callable[[], DataFrame], fallback: Callable[[], DataFrame]) -> DataFrame:
    """The first source, or the second if the first is not there or empty; any other fault of the first is raised."""
    try:
        df = primary()
        if not df.isEmpty():
            return df
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "TABLE_OR_VIEW_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
    return fallback()


def fill_from(primary: DataFrame, fallback: DataFrame, keys: list[str]) -> DataFrame:
    """``primary`` and those rows of ``fallback`` whose keys it lacks."""
    return primary.unionByName(fallback.join(primary.select(*keys).distinct(), keys, "left_anti"))


def submissions(blocks: DataFrame, key: str, forms: list[str]) -> DataFrame:
    """Blocks of parallel arrays opened into one row per filing of the wanted forms; null and ragged arrays give nulls."""
    names = ["accessionNumber", "form", "filingDate", "primaryDocument"]
    rows = blocks.select(key, F.inline(F.arrays_zip(*names)))
    return rows.where(F.col("form").isin(*forms)).select(key, F.col("accessionNumber").alias("accession_number"), F.translate("accessionNumber", "-", "").alias("id"), "form", F.to_date("filingDate").alias("filing_date"), "primaryDocument")


def discover(recent: DataFrame, archived: DataFrame, key: str, most: int) -> DataFrame:
    """The newest filings of each key: the recent block, filled from archives where it has fewer; each accession once.

    Archives are read only for the keys whose recent block falls short, and not at all if there are none.
    """
    rank = lambda df, by: df.withColumn("_place", F.row_number().over(W.partitionBy(key).orderBy(*by, F.desc("filing_date"), F.desc("accession_number"))))
    first = recent.dropDuplicates([key, "accession_number"])
    counts = first.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    full = counts.where(F.col("_n") >= most)
    short = archived.join(full.select(key), key, "left_anti")
    if short.isEmpty():
        return rank(first, []).where(F.col("_place") <= most).drop("_place")
    more = short.dropDuplicates([key, "accession_number"]).join(first.select(key, "accession_number"), [key, "accession_number"], "left_anti")
    rows = first.withColumn("_late", F.lit(0)).unionByName(more.withColumn("_late", F.lit(1)))
    return rank(rows, ["_late"]).where(F.col("_place") <= most).drop("_place", "_late")


def universe(spark: SparkSession, path: str) -> DataFrame:
    """The list of companies from a JSON object of numbered rows: symbol, name and padded number."""
    schema = "map<string, struct<cik_str: long, ticker: string, title: string>>"
    text = spark.read.text(path, wholetext=True)
    rows = text.select(F.explode(F.from_json("value", schema)).alias("k", "r")).select("r.*")
    return rows.select("ticker", F.lower("ticker").alias("ticker_lower"), F.col("title").alias("name"), F.lower("title").alias("name_lower"), F.lpad(F.col("cik_str").cast("string"), 10, "0").alias("cik"))


def blobs(spark: SparkSession, root: str) -> DataFrame:
    """Stored documents with their keys from the path, digest and size."""
    b = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    part = lambda i: F.element_at(F.split("path", "/"), i)
    return b.select(part(-3).alias("company_id"), part(-2).alias("filing_id"), part(-1).alias("name"), F.sha2("content", 256).alias("sha"), "length", "content")


def put_blob(spark: SparkSession, root: str, company: str, filing: str, name: str, content: bytes) -> str:
    """Store a document under its keys, over an older one; returns its path."""
    path = f"{root.rstrip('/')}/{company}/{filing}/{name}"
    target, fs = _file_system(spark, path)
    out = fs.create(target, True)
    try:
        out.write(bytearray(content))
    finally:
        out.close()
    return path


def delete_blob(spark: SparkSession, root: str, company: str, filing: str, name: str) -> bool:
    """Delete a document; whether there was one."""
    target, fs = _file_system(spark, f"{root.rstrip('/')}/{company}/{filing}/{name}")
    return fs.delete(target, False)


def csv_report(parts: list[tuple[str, DataFrame]]) -> DataFrame:
    """A report of several tables as lines ``section_no, line_no, line``: a title, a header and the rows of each, in the order of their columns.

    ``line_no`` rises along the rows of a section; between tasks it has gaps.
    """
    out = None
    for i, (title, df) in enumerate(parts):
        spark = df.sparkSession
        head = spark.createDataFrame([(i, 0, title), (i, 1, ",".join(df.columns))], "section_no int, line_no long, line string")
        cells = F.concat_ws(",", *[X.csv_cell(F.col(c).cast("string")) for c in df.columns])
        body = df.orderBy(*df.columns).select(F.lit(i).alias("section_no"), (F.lit(2) + F.monotonically_increasing_id()).alias("line_no"), cells.alias("line"))
        both = head.unionByName(body)
        out = both if out is None else out.unionByName(both)
    return out.orderBy("section_no", "line_no")
