"""Queries of the operators for training data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import bpe, canonical, forms, nearcopies, packing, reading, variants
from ledgerloom.operators.skew import salted_lookup
from ledgerloom.session import cut
from ledgerloom.sources.tables import latest_load, table

#: Members of one class of copies that meet its other members in one task.
MEMBERS_A_TASK = 2_000


def _mapped_members(spark: SparkSession, folder: str) -> DataFrame:
    """``member_id, raw, ticker`` of the unresolved members."""
    blank = lambda c: F.trim(F.coalesce(c, F.lit(""))) == ""
    members = (
        table(spark, folder, "peer_group_members")
        .where(blank(F.col("company_id_resolved")) & blank(F.col("ticker_resolved")))
        .select(F.col("id").alias("member_id"), F.coalesce("company_name_raw", F.lit("")).alias("raw"))
        .distinct()
    )
    mapped = canonical.map_names(members.select("raw"), "raw", table(spark, folder, "ticker_universe"))
    return salted_lookup(members, mapped, ["raw"])


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """The ticker that each unresolved member means, or the empty string."""
    return _mapped_members(spark, folder).groupBy("member_id").agg(F.max("ticker").alias("ticker"))


def p1_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """The names that mean no entry of the list, and how many unresolved members have each."""
    rows = _mapped_members(spark, folder).where("ticker = ''")
    return rows.groupBy(F.col("raw").alias("company_name_raw")).agg(F.countDistinct("member_id").alias("rows"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of spellings of one executive or peer company within the filings of a filer."""
    filers = latest_load(table(spark, folder, "filings")).select(F.col("id").alias("filing_id"), "company_id")
    executives = table(spark, folder, "exec_comp_rows").select("filing_id", F.col("executive_name").alias("name")).distinct().join(filers, "filing_id")
    groups = table(spark, folder, "peer_groups").select(F.col("id").alias("group_id"), "filing_id", "members")
    nested = groups.select("filing_id", F.explode("members.company_name_raw").alias("name")).distinct()
    flat = (
        table(spark, folder, "peer_group_members")
        .select(F.col("peer_group_id").alias("group_id"), F.col("company_name_raw").alias("name"))
        .distinct()
        .join(groups.select("group_id", "filing_id"), "group_id")
        .select("filing_id", "name")
    )
    members = nested.union(flat).distinct().join(filers, "filing_id")
    persons = variants.link_persons(executives, ["company_id"], "name", cut)
    companies = variants.link_companies(members, ["company_id"], "name", table(spark, folder, "ticker_universe"), cut)
    kind = lambda df, k: df.select(F.lit(k).alias("kind"), "company_id", "name_a", "name_b")
    return kind(persons, "executive").unionByName(kind(companies, "member"))


def _section_copies(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    sections = table(spark, folder, "sections").select("id", "text")
    members, pairs = nearcopies.near_copies(sections, "id", "text", words=3, at_least=(3, 5), persist=cut)
    return cut(members), cut(pairs)


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of sections that share three fifths of their three-word sequences, copies included."""
    members, pairs = _section_copies(spark, folder)
    # one join for both kinds: a class meets itself and the classes it is similar to
    sizes = members.groupBy("id").agg(F.ceil(F.count(F.lit(1)) / MEMBERS_A_TASK).cast("int").alias("salts"))
    links = pairs.unionByName(sizes.select(F.col("id").alias("a"), F.col("id").alias("b"))).join(sizes.withColumnRenamed("id", "b"), "b")
    left = salted_lookup(members.select(F.col("id").alias("a"), F.col("key").alias("key_a")), links, ["a"])
    # both ends of a large class are dealt out: the left one by salt, the right one stands under every salt
    left = left.withColumn("salt", F.pmod(F.xxhash64("key_a"), "salts").cast("int")).drop("salts")
    right = salted_lookup(members, sizes, ["id"]).select(F.col("id").alias("b"), F.col("key").alias("key_b"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    keep = (F.col("a") < F.col("b")) | (F.col("key_a") < F.col("key_b"))
    return left.join(right, ["b", "salt"]).where(keep).select(F.least("key_a", "key_b").alias("section_id_a"), F.greatest("key_a", "key_b").alias("section_id_b"))


def p2_classes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per section with words enough: its class of equal sets and the number of similar classes."""
    members, pairs = _section_copies(spark, folder)
    links = pairs.select("a").unionAll(pairs.select("b")).groupBy(F.col("a").alias("id")).agg(F.count(F.lit(1)).alias("links"))
    return salted_lookup(members, links, ["id"], "left").select(F.col("key").alias("section_id"), F.col("id").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """Section texts and headings with characters that look plain but are not."""
    sections = table(spark, folder, "sections")
    return forms.uneven_text(sections, ["id"], ["text", "heading"]).select(F.col("id").alias("section_id"), "field").distinct()


def p4_forms(spark: SparkSession, folder: str) -> DataFrame:
    """The same values with their one form."""
    sections = table(spark, folder, "sections")
    return forms.uneven_text(sections, ["id"], ["text", "heading"]).select(F.col("id").alias("section_id"), "field", "form")


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    """Token ids of every document."""
    return bpe.encode(table(spark, folder, "documents"), "doc_id", "text")


def p7_round_trip(spark: SparkSession, folder: str) -> DataFrame:
    """Documents whose decoded ids are their text, which should be all."""
    documents = table(spark, folder, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    decoded = bpe.decode(bpe.encode(documents, "doc_id", "text"), "doc_id").withColumnRenamed("text", "decoded")
    return documents.join(decoded, "doc_id").select("doc_id", (F.col("text") == F.col("decoded")).alias("same"))


def p8_containers(spark: SparkSession, folder: str) -> DataFrame:
    """The place of each document, or of each piece of one beyond the capacity."""
    sizes = cut(bpe.count_tokens(table(spark, folder, "documents"), "doc_id", "text"))
    return packing.pack(sizes, "doc_id", "tokens")


def p8_fill(spark: SparkSession, folder: str) -> DataFrame:
    """Containers, tokens and unused space in all."""
    placed = p8_containers(spark, folder).where("tokens > 0")
    used = placed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    return used.agg(F.count(F.lit(1)).alias("containers"), F.sum("tokens").alias("tokens"), F.sum(packing.CAPACITY - F.col("tokens")).alias("unused"))


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    documents = table(spark, folder, "documents")
    prose = documents.where(F.col("text").rlike("[^\\s\\x85\\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000]") & ~F.col("doc_type").isin("figures", "fragment"))
    return reading.reading_levels(prose, "doc_id", "text", "lang", table(spark, folder, "reading_labels"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    """Reading level of every prose text."""
    return _levels(spark, folder).select("doc_id", "level")


def p9_profile(spark: SparkSession, folder: str) -> DataFrame:
    """How many texts there are of each level and document type, and by which model they were rated."""
    documents = table(spark, folder, "documents").select("doc_id", "doc_type")
    return documents.join(_levels(spark, folder), "doc_id").groupBy("doc_type", "level", "model").agg(F.count(F.lit(1)).alias("documents"))


def p9_formula(spark: SparkSession, folder: str) -> DataFrame:
    """The published formula beside the fitted one: how many texts get which pair of levels."""
    return _levels(spark, folder).groupBy("level", "formula").agg(F.count(F.lit(1)).alias("documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_unmatched, p2_found, p2_classes, p4_found, p4_forms, p5_found, p7_ids, p7_round_trip, p8_containers, p8_fill, p9_found, p9_profile, p9_formula)}
ORACLES = {
    "p4_found": f"SELECT DISTINCT section_id, field FROM ({forms.sql(['id AS section_id'], ['text', 'heading'], 'sections')})",
    "p4_forms": f"SELECT section_id, field, form FROM ({forms.sql(['id AS section_id'], ['text', 'heading'], 'sections')})",
    "p2_found": """
WITH w AS (SELECT id, regexp_extract_all(lower(text), '[a-z0-9]+') AS ws FROM sections),
s AS (SELECT DISTINCT id, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS sh FROM (SELECT id, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) >= 3)),
n AS (SELECT id, count(*) AS n FROM s GROUP BY id),
c AS (SELECT a.id AS a, b.id AS b, count(*) AS common FROM s a JOIN s b ON a.sh = b.sh AND a.id < b.id GROUP BY a.id, b.id)
SELECT c.a AS section_id_a, c.b AS section_id_b FROM c JOIN n x ON x.id = c.a JOIN n y ON y.id = c.b WHERE common * 5 >= (x.n + y.n - common) * 3""",
}
