"""Lookups, predicates, formats and reports: what a screen, an export or a job asks of the tables."""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators.orphans import clean_key
from ledgerloom.operators.sequential import edit_sets
from ledgerloom.plans.reads import _CEO, _EXECS, _FILINGS, _RANKED, _cell_sql, exec_rows, filings_of, ranked_filings
from ledgerloom.sources.tables import table


# lookups


def company_by_key(spark: SparkSession, folder: str, cik: str = "0004299268") -> DataFrame:
    """The company of a key: a point lookup that the scan filters by."""
    return table(spark, folder, "companies").where(F.col("cik") == cik).select("id", "cik", "ticker", "name", "sector").limit(1)


def filings_of_one(spark: SparkSession, folder: str, company: str = "aqqsp") -> DataFrame:
    """The filings of a company, latest first."""
    rows = filings_of(spark, folder).where(F.col("company_id") == company)
    place = F.row_number().over(W.orderBy(F.desc("filing_date"), F.desc("id")))  # one company's filings
    return rows.select(F.col("id").alias("filing_id"), F.date_format("filing_date", "yyyy-MM-dd").alias("filed"), "form_type", place.cast("long").alias("place"))


def filing_parts(spark: SparkSession, folder: str) -> DataFrame:
    """Each filing with the ids of its sections, facts, groups and pay rows, and the members of its groups."""
    parts = {"sections": "sections", "facts": "metric_facts", "groups": "peer_groups", "pay_rows": "exec_comp_rows"}
    rows = filings_of(spark, folder).select(F.col("id").alias("filing_id"))
    joined = lambda ids: F.array_join(F.array_sort(F.collect_set(ids)).cast("array<string>"), ",")
    for name, source in parts.items():
        rows = rows.join(table(spark, folder, source).groupBy("filing_id").agg(joined("id").alias(name)), "filing_id", "left")
    groups = table(spark, folder, "peer_groups").select(F.col("id").alias("peer_group_id"), "filing_id")
    members = table(spark, folder, "peer_group_members").select("peer_group_id", "id").join(groups, "peer_group_id").groupBy("filing_id").agg(joined("id").alias("members"))
    names = [*parts, "members"]
    return rows.join(members, "filing_id", "left").select("filing_id", *[F.coalesce(n, F.lit("")).alias(n) for n in names])


def mapped_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Filings and facts as a reader gets them: decimals as numbers, days and instants as ISO texts or null."""
    f = filings_of(spark, folder)
    loaded = table(spark, folder, "filings").groupBy("id").agg(F.min_by("acceptance_datetime", "created_at").alias("accepted"))
    iso = F.date_format("accepted", "yyyy-MM-dd'T'HH:mm:ss")
    return f.join(loaded, "id").select("id", F.date_format("filing_date", "yyyy-MM-dd").alias("filed"), iso.alias("accepted"), F.year("filing_date").cast("long").alias("year_of_day"), F.col("filing_year").cast("long").alias("year"))


def filtered_sections(spark: SparkSession, folder: str, company: str = "all", year: str = "2022", section: str = "cd_and_a") -> DataFrame:
    """Sections by company, year and kind; "all" sets no filter. Years are compared as texts."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id", F.col("filing_year").cast("string").alias("year"))
    rows = table(spark, folder, "sections").select("id", "filing_id", "section_type").join(f, "filing_id")
    for column, wanted in (("company_id", company), ("year", year), ("section_type", section)):
        rows = rows if wanted == "all" else rows.where(F.col(column) == wanted)
    return rows.select("id", "company_id", "year", "section_type")


def companies_by_either(spark: SparkSession, folder: str, ids: tuple[str, ...] = ("APPFJ", "nobody"), symbols: tuple[str, ...] = ("aqqsp", "bqcms")) -> DataFrame:
    """Companies whose id or symbol is in a list; ids are compared in lower, symbols in upper case."""
    test = F.col("id").isin(*[i.lower() for i in ids]) | F.col("ticker").isin(*[s.upper() for s in symbols])
    return table(spark, folder, "companies").where(test).select("id", "ticker")


def entry_by_symbol_or_number(spark: SparkSession, folder: str) -> DataFrame:
    """Each member's list entry by symbol, else by number."""
    m = table(spark, folder, "peer_group_members").select("id", F.upper(F.trim("ticker_resolved")).alias("symbol"), F.lpad(F.trim("cik_resolved"), 10, "0").alias("number")).distinct()
    u = table(spark, folder, "ticker_universe")
    rows = m.join(u.select(F.col("ticker").alias("symbol"), F.col("ticker_lower").alias("t1")), "symbol", "left").join(u.select(F.col("cik").alias("number"), F.col("ticker_lower").alias("t2")), "number", "left")
    how = F.when(F.col("t1").isNotNull(), "symbol").when(F.col("t2").isNotNull(), "number").otherwise("none")
    return rows.select("id", F.coalesce("t1", "t2").alias("entry"), how.alias("found_by"))


ASKED = ("AQQSP", "bqcms", "airlines", "manufacturing", "nothing at all")


def resolved_names(spark: SparkSession, folder: str, asked: tuple[str, ...] = ASKED) -> DataFrame:
    """What was asked for and the company it means: an exact symbol, else an exact id, else the first name that contains it."""
    q = spark.createDataFrame([(a,) for a in asked], "asked string")  # what one reader typed
    c = table(spark, folder, "companies").select("id", "ticker", "name")
    low = F.lower("asked")
    rank = F.when(F.lower("ticker") == low, 0).when(F.col("id") == low, 1).when(F.contains(F.lower("name"), low), 2)
    hits = c.join(F.broadcast(q), F.lit(True)).withColumn("rank", rank).where("rank IS NOT NULL")
    best = hits.groupBy("asked").agg(F.min_by(F.struct("id", "rank"), F.struct("rank", "name", "id")).alias("b"))
    return q.join(best, "asked", "left").select("asked", F.col("b.id").alias("company_id"), F.col("b.rank").cast("long").alias("rank"))


def resolver_ids(spark: SparkSession, folder: str) -> DataFrame:
    """The companies that names are resolved to, with one id each: the symbol, else the number, else the name, in lower case."""
    rows = table(spark, folder, "ticker_universe").select("ticker", "cik", "name").unionByName(table(spark, folder, "companies").select("ticker", "cik", "name"))
    given = lambda c: F.nullif(F.trim(F.lower(c)), F.lit(""))
    return rows.select(F.coalesce(given("ticker"), given("cik"), given("name")).alias("id"), "name").distinct()


GLOSSARY = {
    "clawback": "Recovery of pay that was awarded on wrong figures",
    "hedging": "Transactions that offset a fall in the share price",
    "pledging": "Shares given as collateral",
    "peer group": "Companies that pay is compared with",
    "say on pay": "Advisory vote of holders on pay",
    "shareholder return": "Change of price and dividends over a period",
}


def glossary_uses(spark: SparkSession, folder: str) -> DataFrame:
    """Terms with their meaning and the number of sections that use them."""
    s = table(spark, folder, "sections").select(F.lower("text").alias("t"))
    counts = s.agg(*[F.count_if(F.contains("t", F.lit(term))).alias(term) for term in GLOSSARY])
    cells = F.array(*[F.struct(F.lit(t).alias("term"), F.lit(m).alias("meaning"), F.col(f"`{t}`").alias("sections")) for t, m in GLOSSARY.items()])
    return counts.select(F.inline(cells))


# predicates and formats


def key_shapes(spark: SparkSession, folder: str) -> DataFrame:
    """How many digests of users have the shape of a token, and how many members' symbols that of a symbol."""
    tokens = table(spark, folder, "events").select(F.substring(F.sha2(F.col("user_id").cast("string"), 256), 1, 24).alias("v")).distinct()
    symbols = table(spark, folder, "peer_group_members").select(F.col("company_id_resolved").alias("v")).distinct()
    rate = lambda df, kind, test: df.where("v IS NOT NULL").groupBy(F.lit(kind).alias("kind")).agg(F.count_if(test).alias("good"), F.count_if(~test).alias("bad"))
    return rate(tokens, "token", F.col("v").rlike("^[a-f0-9]{24}$")).unionByName(rate(symbols, "symbol", X.ticker_shape(F.col("v"))))


MESSAGES = {"error": "The source could not be read", "purchase": "The work was done"}


def safe_messages(spark: SparkSession, folder: str) -> DataFrame:
    """Codes of events as they may be shown: only known codes, with their message; any other is hidden."""
    e = table(spark, folder, "events").select("event_id", "event_type")
    known = F.create_map(*[F.lit(x) for kv in MESSAGES.items() for x in kv])
    return e.select("event_id", F.when(F.col("event_type").isin(*MESSAGES), F.col("event_type")).alias("code"), F.try_element_at(known, F.col("event_type")).alias("message"))


def officer_flags(spark: SparkSession, folder: str) -> DataFrame:
    """Positions with the strict and the loose test for a chief executive, and whether the position is a former one."""
    p = table(spark, folder, "exec_comp_rows").select("principal_position").distinct().where("principal_position IS NOT NULL")
    c = F.col("principal_position")
    former = c.rlike(r"(?i)\b(former|outgoing|retired|departing|interim)\b.*\b(ceo|chief\s+executive)")
    return p.select(c, X.is_ceo(c).alias("strict"), c.rlike(r"(?i)\bexecutive\s+officer\b").alias("loose"), former.alias("former"))


def neo_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Per filing the officers named in its latest year."""
    e = table(spark, folder, "exec_comp_rows").select("filing_id", "year", "executive_name").distinct()
    latest = e.groupBy("filing_id", "year").agg(F.count(F.lit(1)).alias("officers"))
    return latest.groupBy("filing_id").agg(F.max("year").cast("long").alias("year"), F.max_by("officers", "year").alias("officers"))


def formatted_pay(spark: SparkSession, folder: str) -> DataFrame:
    """Totals as they are shown: with a dollar sign, as whole dollars, and as a signed change from the officer's year before."""
    e = exec_rows(spark, folder)
    raw = table(spark, folder, "exec_comp_rows").groupBy("id").agg(F.min("total").alias("text"))
    shown = F.when(F.coalesce(F.trim("text"), F.lit("")) == "", "—").when(F.startswith("text", F.lit("$")), F.col("text")).otherwise(F.concat(F.lit("$"), "text"))
    before = F.lag("total").over(W.partitionBy("filing_id", "executive_name").orderBy("year", "id"))
    change = F.round(F.col("total") - F.col("before")).cast("long")
    signed = F.concat(F.when(change < 0, "-$").otherwise("+$"), F.format_number(F.abs(change), 0))
    rows = e.withColumn("before", before).join(raw, "id")
    return rows.select("id", shown.alias("shown"), F.concat(F.lit("$"), F.format_number(F.round("total").cast("long"), 0)).alias("dollars"), signed.alias("change"))


def fact_sources(spark: SparkSession, folder: str) -> DataFrame:
    """Where sections' values come from: what follows the colon in the method, else the main section, with its label."""
    labels = {"cd_and_a": "Discussion", "ceo_pay_ratio": "Pay ratio", "say_on_pay": "Advisory vote"}
    s = table(spark, folder, "sections").select(F.when(F.col("section_type") == "cd_and_a", F.col("extraction_method")).otherwise(F.concat_ws(":", "extraction_method", "section_type")).alias("method"))
    source = F.when(F.coalesce(F.instr("method", ":"), F.lit(0)) > 0, F.regexp_extract("method", "^[^:]*:(.*)$", 1)).otherwise("cd_and_a")
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in labels.items() for x in kv]), F.col("source")), F.col("source"))
    return s.select(source.alias("source")).groupBy("source").agg(F.count(F.lit(1)).alias("sections")).select("source", label.alias("label"), "sections")


def group_titles(spark: SparkSession, folder: str) -> DataFrame:
    """The display name of each group: its year and its type in words."""
    g = table(spark, folder, "peer_groups")
    kind = F.initcap(F.translate(F.concat(F.coalesce("peer_group_type", F.lit("compensation")), F.lit("_peer_group")), "_", " "))
    return g.select("id", F.concat_ws(" ", F.col("disclosed_year").cast("string"), kind).alias("title"))


KINDS = {"section": "Section", "metric": "Metric", "policy": "Policy", "peer_member": "Peer", "exec": "Pay"}


def citation_labels(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of each answer with a number and a label by kind."""
    a = table(spark, folder, "ask_interactions").where("citations IS NOT NULL").select("id", "citations").distinct()
    c = a.select("id", F.posexplode(F.from_json("citations", "array<struct<kind string>>")).alias("n", "c"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), F.col("c.kind")), F.lit("Source"))
    return c.select("id", (F.col("n") + 1).cast("long").alias("no"), F.concat(F.lit("["), (F.col("n") + 1).cast("string"), F.lit("] "), label).alias("label"))


def first_hops(spark: SparkSession, folder: str) -> DataFrame:
    """The first of a chain of names, trimmed: what a forwarding header is read for."""
    g = table(spark, folder, "peer_groups").select("id", F.array_join("members.company_name_raw", " , ").alias("chain"))
    return g.select("id", F.nullif(F.trim(F.element_at(F.split("chain", ","), 1)), F.lit("")).alias("first"))


SECRET, EXPIRES_S, SKEW_S = b"a secret for tests", 8 * 3600, 60


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """Keyed digest in hex: both pads of the key are constants of the plan, so nothing leaves the JVM."""
    key = (hashlib.sha256(secret).digest() if len(secret) > 64 else secret).ljust(64, b"\0")
    pad = lambda x: F.lit(bytearray(b ^ x for b in key))
    inner = F.unhex(F.sha2(F.concat(pad(0x36), F.encode(message, "UTF-8")), 256))
    return F.sha2(F.concat(pad(0x5C), inner), 256)


def session_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Events read as sessions signed at their time, as seen at the latest event: how many are valid, forged, expired or from the future.

    A session of an error event carries a signature of another message; one of a signup is dated an hour later.
    """
    e = table(spark, folder, "events").select("event_id", "user_id", "event_type", (F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long").alias("at"))
    now = e.agg(F.max("at").alias("now"))
    issued = F.when(F.col("event_type") == "signup", F.col("at") + 3600).otherwise(F.col("at"))
    e = e.withColumn("issued", issued)
    message = F.concat_ws("|", F.col("user_id").cast("string"), F.col("issued").cast("string"))
    given = hmac_sha256(F.when(F.col("event_type") == "error", F.concat(message, F.lit("x"))).otherwise(message), SECRET)
    rows = e.join(F.broadcast(now)).select("*", given.alias("given"), hmac_sha256(message, SECRET).alias("due"))
    state = (
        F.when(F.col("given") != F.col("due"), "forged")
        .when(F.col("issued") - F.col("now") > SKEW_S, "future")
        .when(F.col("now") - F.col("issued") > EXPIRES_S, "expired")
        .otherwise("valid")
    )
    return rows.groupBy(state.alias("state")).agg(F.count(F.lit(1)).alias("sessions"))


# choices and orders


def material_first(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each filing in the order of a report: those that differ from the other copy first, then by name."""
    def side(name: str, as_: str) -> DataFrame:
        m = table(spark, folder, name).where("metric_name_normalized <> ''")
        return m.groupBy("filing_id", "metric_name_normalized").agg(F.max_by("observed_value", F.struct("updated_at", "id")).alias(as_))

    keys = ["filing_id", "metric_name_normalized"]
    j = side("metric_facts", "a").join(side("metric_facts_oracle", "b"), keys, "full_outer").withColumn("changed", ~F.col("a").eqNullSafe(F.col("b")))
    place = F.row_number().over(W.partitionBy("filing_id").orderBy(F.desc("changed"), "metric_name_normalized"))
    return j.select(*keys, "changed", place.cast("long").alias("place"))


def primary_groups(spark: SparkSession, folder: str) -> DataFrame:
    """The group that stands for a filing: one of primary type, else the first that is no return or index list, else the first."""
    g = table(spark, folder, "peer_groups").select("id", "filing_id", F.lower(F.coalesce("peer_group_type", F.lit(""))).alias("type")).distinct()
    rank = F.when(F.contains("type", F.lit("compensation")), 0).when(~F.col("type").rlike("performance|return|index"), 1).otherwise(2)
    return g.groupBy("filing_id").agg(F.min_by("id", F.struct(rank, "id")).alias("group_id"), F.min(rank).cast("long").alias("rank"))


def next_open(spark: SparkSession, folder: str) -> DataFrame:
    """For each company the next one by id without a symbol, from the beginning again after the last."""
    c = table(spark, folder, "companies").select("id", F.col("ticker").isNull().alias("open"))
    first = c.where("open").agg(F.min("id").alias("first"))
    chain = c.withColumn("part", F.substring("id", 1, 1))
    # the next open one within the first letter by one window, over letters by another: no task orders all companies
    inside = F.min(F.when(F.col("open"), F.col("id"))).over(W.partitionBy("part").orderBy("id").rowsBetween(1, W.unboundedFollowing))
    letters = chain.groupBy("part").agg(F.min(F.when(F.col("open"), F.col("id"))).alias("p"))
    later = letters.select("part", F.first("p", ignorenulls=True).over(W.orderBy("part").rowsBetween(1, W.unboundedFollowing)).alias("later"))
    return chain.withColumn("inside", inside).join(F.broadcast(later), "part").join(F.broadcast(first)).select("id", F.coalesce("inside", "later", "first").alias("next_id"))


def paid_order(spark: SparkSession, folder: str) -> DataFrame:
    """Officers of each filing in the order of a report: the chief executive first, then by the size of the change in pay, then by name."""
    e = exec_rows(spark, folder).withColumn("who", F.lower(X.display_name(F.col("executive_name"))))
    years = e.groupBy("filing_id", "who", "year").agg(F.max("total").alias("total"), F.max(X.is_ceo(F.coalesce("principal_position", F.lit("")))).alias("ceo"))
    w = W.partitionBy("filing_id", "who").orderBy("year")
    last = years.withColumn("delta", F.col("total") - F.lag("total").over(w)).groupBy("filing_id", "who").agg(F.max_by(F.struct("ceo", "delta"), "year").alias("l"))
    order = W.partitionBy("filing_id").orderBy(F.desc("l.ceo"), F.desc(F.coalesce(F.abs("l.delta"), F.lit(0.0))), "who")
    return last.select("filing_id", "who", F.col("l.ceo").alias("ceo"), F.row_number().over(order).cast("long").alias("place"))


def refresh_chunks(spark: SparkSession, folder: str, chunks: int = 5) -> DataFrame:
    """Companies with the part of a weekly refresh that they belong to, dealt out by a digest of their id, and the size of the part."""
    c = table(spark, folder, "companies").select("id")
    part = F.pmod(F.conv(F.substring(F.md5("id"), 1, 8), 16, 10).cast("long"), F.lit(chunks))
    rows = c.select("id", part.alias("part"))
    sizes = rows.groupBy("part").agg(F.count(F.lit(1)).alias("companies"))  # one row a part
    return rows.join(F.broadcast(sizes), "part").select("id", "part", "companies")


def gaps(spark: SparkSession, folder: str, least: int = 2) -> DataFrame:
    """Filings with fewer sections or groups than there should be."""
    n = lambda name, c: table(spark, folder, name).groupBy(F.col("filing_id")).agg(F.countDistinct("id").alias(c))
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"))
    rows = f.join(n("sections", "sections"), "filing_id", "left").join(n("peer_groups", "groups"), "filing_id", "left").fillna(0)
    return rows.where((F.col("sections") < least) | (F.col("groups") < least)).select("filing_id", "sections", "groups", (F.col("sections") >= least).alias("sections_ok"), (F.col("groups") >= least).alias("groups_ok"))


def job_progress(spark: SparkSession, folder: str) -> DataFrame:
    """What a poll of a job shows: its state, seconds since its start, and a message only if it failed."""
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    j = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("at", "event_id")).alias("status"), F.min("at").alias("since"), F.max("at").alias("till"))
    return j.select("user_id", "status", F.floor((F.col("till") - F.col("since")) / 1_000_000).alias("seconds"), F.when(F.col("status") == "error", MESSAGES["error"]).alias("message"))


# texts


def text_contexts(spark: SparkSession, folder: str, query: str = "committee", around: int = 40, most: int = 3) -> DataFrame:
    """The first matches of a word in each section with the characters around them; case is ignored."""
    s = table(spark, folder, "sections").where(F.contains(F.lower("text"), F.lit(query))).select("id", "text")
    pieces = s.select("id", "text", F.posexplode(F.slice(F.split(F.lower("text"), f"\\Q{query}\\E"), 1, most)).alias("no", "piece"), F.size(F.split(F.lower("text"), f"\\Q{query}\\E")).alias("n"))
    at = F.sum(F.length("piece") + len(query)).over(W.partitionBy("id").orderBy("no").rowsBetween(W.unboundedPreceding, 0)) - len(query)
    hits = pieces.where(F.col("no") < F.col("n") - 1).withColumn("at", at)
    start = F.greatest(F.col("at") - around, F.lit(0))
    return hits.select("id", F.col("no").cast("long").alias("no"), F.col("at").cast("long").alias("at"), F.substr("text", (start + 1).cast("int"), (F.col("at") - start + len(query) + around).cast("int")).alias("context"))


def highlight_rows(spark: SparkSession, folder: str, query: str = "committee") -> DataFrame:
    """The headings that hold a word as parts in order, each a match or not; case is ignored and empty parts are left out."""
    s = table(spark, folder, "sections").where(F.contains(F.lower("heading"), F.lit(query))).select("id", "heading")
    rule = f"(?i)\\Q{query}\\E"
    plain = s.select("id", F.posexplode(F.split("heading", rule)).alias("n", "part")).select("id", (F.col("n") * 2).alias("no"), "part", F.lit(False).alias("hit"))
    hits = s.select("id", F.posexplode(F.regexp_extract_all("heading", F.lit(rule), F.lit(0))).alias("n", "part")).select("id", (F.col("n") * 2 + 1).alias("no"), "part", F.lit(True).alias("hit"))
    return plain.unionByName(hits).where("part <> ''").select("id", F.col("no").cast("long").alias("no"), "part", "hit")


def capped_search(spark: SparkSession, folder: str, query: str = "committee", cap: int = 30) -> DataFrame:
    """The first sections in order of id that hold a word, up to a cap, and whether there are as many as that."""
    s = table(spark, folder, "sections").where(F.contains(F.lower("text"), F.lit(query))).select("id")
    first = s.orderBy("id").limit(cap)
    return first.join(F.broadcast(first.agg((F.count(F.lit(1)) >= cap).alias("truncated"))))


CAPS = {"source": 280, "basic": 220, "policy": 600, "opener": 1200}


def excerpt_caps(spark: SparkSession, folder: str) -> DataFrame:
    """Lengths of the excerpts of each section under the caps of the places where they are shown."""
    s = table(spark, folder, "sections").where("text IS NOT NULL")
    flat = X.collapse(F.col("text"))
    return s.select("id", *[F.length(F.substring(flat if k == "source" else F.col("text"), 1, n)).cast("long").alias(k) for k, n in CAPS.items()])


POLICY_TYPES = {
    "hedging": "hedging",
    "pledging": "pledging",
    "clawback": "clawback|recoupment|erroneously awarded",
    "stock_ownership_guidelines": "ownership (guidelines|policy|requirements)|share retention",
    "change_in_control": "change[ -](in|of)[ -]control",
    "compensation_consultant": "(compensation|independent) consultant",
    "compensation_committee": "compensation committee",
}


def _policies(spark: SparkSession, folder: str) -> DataFrame:
    """``filing_id`` and a column for each policy: how the filing's sections speak of it, or null."""
    s = table(spark, folder, "sections").select("filing_id", F.lower("text").alias("t"))
    value = lambda rule: F.when(F.col("t").rlike(rule), F.when(F.col("t").rlike("prohibit"), "prohibited").otherwise("present"))
    return s.groupBy("filing_id").agg(*[F.max(value(rule)).alias(name) for name, rule in POLICY_TYPES.items()])


def policy_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Policies of each company's latest filing against those of the one before, by type: added, removed, changed or unchanged."""
    pairs = ranked_filings(spark, folder).where("rank <= 2").select("company_id", F.col("id").alias("filing_id"), "rank")
    stack = F.array(*[F.struct(F.lit(n).alias("policy"), F.col(n).alias("value")) for n in POLICY_TYPES])
    rows = pairs.join(_policies(spark, folder), "filing_id").select("company_id", "rank", F.inline(stack)).where("value IS NOT NULL")
    side = lambda r, c: rows.where(F.col("rank") == r).select("company_id", "policy", F.col("value").alias(c))
    two = pairs.groupBy("company_id").agg(F.count(F.lit(1)).alias("n")).where("n = 2").select("company_id")
    j = side(1, "new").join(side(2, "old"), ["company_id", "policy"], "full_outer").join(two, "company_id", "left_semi")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "unchanged").otherwise("changed")
    return j.select("company_id", "policy", "old", "new", status.alias("status"))


METRIC_AXES = ["relative_tsr", "revenue", "operating_income", "free_cash_flow", "organic_growth", "net_promoter_score", "safety_rate", "ebit_margin", "adjusted_eps", "roic"]


def facts_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Each filing's policies and metrics as columns: a value, "Disclosed" for one without value, "Not extracted" for none."""
    m = table(spark, folder, "metric_facts").where(F.col("metric_name_normalized").isin(*METRIC_AXES))
    last = m.groupBy("filing_id", "metric_name_normalized").agg(F.max_by(F.coalesce("observed_value", F.lit("Disclosed")), F.struct("updated_at", "id")).alias("v"))
    wide = last.groupBy("filing_id").pivot("metric_name_normalized", METRIC_AXES).agg(F.first("v"))
    rows = filings_of(spark, folder).select(F.col("id").alias("filing_id")).join(_policies(spark, folder), "filing_id", "left").join(wide, "filing_id", "left")
    return rows.select("filing_id", *[F.coalesce(n, F.lit("Not extracted")).alias(n) for n in [*POLICY_TYPES, *METRIC_AXES]])


# The lines of the sheet; a title of a part stands alone, and a blank line comes before it.
SHEET = [
    ("Filing year", "year"), ("Filing URL", "url"), ("Ingested", "ingested"),
    ("— Executive pay —", None), ("CEO name", "ceo_name"), ("CEO total", "ceo_total"), ("CEO year", "ceo_year"), ("NEOs reported", "officers"),
    ("CEO base %", "base"), ("CEO cash incentive %", "bonus"), ("CEO equity %", "equity"), ("CEO other %", "other"), ("CEO at-risk %", "at_risk"),
    ("— Peer disclosure —", None), ("Primary peer count", "peers"),
    ("— Performance metrics —", None), *[(n.replace("_", " ").capitalize(), n) for n in METRIC_AXES],
    ("— Governance —", None), *[(n.replace("_", " ").capitalize(), n) for n in POLICY_TYPES],
]
SHEET_IDS = "appfj, AQQSP,bqcms,!bad!,zodmg,mcrsw,ndezf,oerfp,toolongtobeasymbol"
MOST_COMPANIES = 30


def asked_ids(text: str, most: int = MOST_COMPANIES) -> list[str]:
    """Ids of a list separated by commas: trimmed, in lower case, only those of the shape of a symbol, up to a limit."""
    ids = [x.strip().lower() for x in text.split(",")]
    return [x for x in ids if re.fullmatch(r"[a-z][a-z0-9.\-]{0,7}", x)][:most]


def company_axes(spark: SparkSession, folder: str) -> DataFrame:
    """One row per company with all axes of the sheet, of its latest filing, as texts; null where there is none."""
    f = ranked_filings(spark, folder).where("rank = 1").select("company_id", F.col("id").alias("filing_id"), F.col("filing_year").cast("string").alias("year"))
    urls = table(spark, folder, "filings").groupBy(F.col("id").alias("filing_id")).agg(F.min_by("primary_document_url", "created_at").alias("url"))
    e = exec_rows(spark, folder)
    ceo = e.where(X.is_ceo(F.coalesce("principal_position", F.lit("")))).groupBy("filing_id").agg(F.max_by(F.struct("id", "executive_name", "total", "year"), F.struct("year", F.coalesce("total", F.lit(-1.0)), "id")).alias("c"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    mix = e.select("id", zero("salary").alias("base"), (zero("bonus") + zero("non_equity_incentive_plan_compensation")).alias("bonus"), (zero("stock_awards") + zero("option_awards")).alias("equity"), zero("all_other_compensation").alias("other"))
    whole = F.col("base") + F.col("bonus") + F.col("equity") + F.col("other")
    percent = lambda c: F.when(whole > 0, X.half_up(c / whole * 100).cast("long").cast("string"))
    mix = mix.select("id", *[percent(F.col(c)).alias(c) for c in ("base", "bonus", "equity", "other")], percent(F.col("bonus") + F.col("equity")).alias("at_risk"))
    paid = ceo.select("filing_id", "c.*").withColumnRenamed("year", "ceo_year_").join(mix, "id").select("filing_id", F.col("executive_name").alias("ceo_name"), F.round("total").cast("long").cast("string").alias("ceo_total"), F.col("ceo_year_").cast("string").alias("ceo_year"), "base", "bonus", "equity", "other", "at_risk")
    officers = neo_counts(spark, folder).select("filing_id", F.col("officers").cast("string").alias("officers"))
    sizes = table(spark, folder, "peer_groups").select(F.col("id").alias("group_id"), F.size("members").cast("string").alias("peers"))
    peers = primary_groups(spark, folder).join(sizes, "group_id").select("filing_id", "peers")
    c = table(spark, folder, "companies").select(F.col("id").alias("company_id"), "name", "ticker")
    rows = c.join(f, "company_id", "left")
    for part in (urls, paid, officers, peers, facts_matrix(spark, folder)):
        rows = rows.join(part, "filing_id", "left")
    return rows.withColumn("ingested", F.when(F.col("filing_id").isNotNull(), "yes").otherwise("no"))


def peer_sheet(spark: SparkSession, folder: str, ids: str = SHEET_IDS) -> DataFrame:
    """The transposed sheet of a list of companies as CSV lines: an axis a line, a company a column, in the order asked for.

    Ids of the wrong shape are dropped; a company that is not there has a column of its own with "no" as ingested.
    """
    wanted = asked_ids(ids)
    order = spark.createDataFrame(list(enumerate(wanted)), "n long, company_id string")  # at most MOST_COMPANIES
    rows = F.broadcast(order).join(company_axes(spark, folder).where(F.col("company_id").isin(*wanted)), "company_id", "left").withColumn("ingested", F.coalesce("ingested", F.lit("no")))
    head = F.coalesce(F.concat(F.col("name"), F.coalesce(F.concat(F.lit(" ("), F.col("ticker"), F.lit(")")), F.lit(""))), F.upper("company_id"))
    cells = [F.struct(F.lit(0).alias("line_no"), F.lit("Axis").alias("axis"), head.alias("cell"))]
    for line, (title, axis) in zip(_line_numbers(), SHEET):
        cells.append(F.struct(F.lit(line).alias("line_no"), F.lit(title).alias("axis"), (F.coalesce(F.col(axis), F.lit("")) if axis else F.lit("")).alias("cell")))
    long = rows.select("n", F.inline(F.array(*cells)))
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", X.csv_cell(F.col("cell")).alias("cell")))), lambda x: x["cell"]), ",")
    lines = long.groupBy("line_no", "axis").agg(joined.alias("cells")).select(F.col("line_no").cast("long").alias("line_no"), F.concat_ws(",", X.csv_cell(F.col("axis")), "cells").alias("line"))
    blank = spark.createDataFrame([(n, "") for n in _blank_lines()], "line_no long, line string")
    return lines.unionByName(blank)


def _line_numbers() -> list[int]:
    out, line = [], 0
    for _, axis in SHEET:
        line += 1 if axis else 2
        out.append(line)
    return out


def _blank_lines() -> list[int]:
    return [n - 1 for n, (_, axis) in zip(_line_numbers(), SHEET) if axis is None]


def peer_sets(spark: SparkSession, folder: str) -> DataFrame:
    """The set of entries that each user's events leave: added once in order, removed, cleared, or marked as imported.

    views and clicks add an entry, errors remove it, signups clear the set, purchases mark it as imported for good. A set has a
    limit of entries; what is added beyond it is dropped.
    """
    e = table(spark, folder, "events").select("user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), "event_id", "event_type", (F.get_json_object("props", "$.k").cast("long") % 20).alias("k"))
    op = F.when(F.col("event_type").isin("view", "click"), "add").when(F.col("event_type") == "error", "remove").when(F.col("event_type") == "signup", "clear").otherwise("mark")
    return edit_sets(e.select("user_id", "at", "event_id", op.alias("op"), F.col("k").cast("string").alias("entry")), "user_id", ["at", "event_id"])


def quality_notes(spark: SparkSession, folder: str, least: int = 3) -> DataFrame:
    """Groups with symbols that are not listed, but for pairs of a filer and a symbol that at least so many groups name: state and note."""
    g = table(spark, folder, "peer_groups").select(F.col("id").alias("peer_group_id"), "filing_id").distinct()
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id")
    symbol = F.nullif(F.upper(F.trim(F.coalesce("ticker_resolved", "company_id_resolved"))), F.lit(""))
    m = table(spark, folder, "peer_group_members").select("peer_group_id", symbol.alias("symbol")).where("symbol IS NOT NULL").distinct()
    odd = m.join(table(spark, folder, "ticker_universe").select(F.col("ticker").alias("symbol")), "symbol", "left_anti").join(g.join(f, "filing_id"), "peer_group_id")
    pairs = odd.groupBy("company_id", "symbol").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)
    suspect = odd.join(pairs, ["company_id", "symbol"], "left_anti").groupBy("peer_group_id").agg(F.array_join(F.array_sort(F.collect_set("symbol")), ", ").alias("symbols"))
    note = F.concat(F.lit("Set aside: unknown symbols "), "symbols", F.lit("."))
    return g.join(suspect, "peer_group_id", "left").select("peer_group_id", F.when(F.col("symbols").isNotNull(), "flagged").otherwise("unreviewed").alias("review"), note.alias("note"))


def citations_resolved(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of answers by kind: found in the filing named, else in the company's filing before it, else rejected."""
    a = table(spark, folder, "ask_interactions").select("id", clean_key(F.col("filing_id"), drop="-").alias("filing_id"), "citations").distinct()
    c = a.select("id", "filing_id", F.posexplode(F.from_json("citations", "array<struct<kind string>>")).alias("n", "c")).select("id", "n", "filing_id", F.col("c.kind").alias("kind"))
    w = W.partitionBy("company_id").orderBy("filing_date", "id")
    prior = filings_of(spark, folder).select(F.col("id").alias("filing_id"), F.lag("id").over(w).alias("prior_id"))
    has = lambda n, k: table(spark, folder, n).select("filing_id", F.lit(k).alias("kind")).distinct()
    known = has("sections", "section").unionByName(has("metric_facts", "metric")).unionByName(has("peer_groups", "peer_member")).unionByName(has("exec_comp_rows", "exec"))
    j = c.join(prior, "filing_id", "left").join(known.withColumn("here", F.lit(True)), ["filing_id", "kind"], "left")
    j = j.join(known.select(F.col("filing_id").alias("prior_id"), "kind", F.lit(True).alias("before")), ["prior_id", "kind"], "left")
    found = F.when(F.col("here"), "this filing").when(F.col("before"), "prior filing").otherwise("rejected")
    return j.groupBy("kind", found.alias("found")).agg(F.count(F.lit(1)).alias("citations"))


QUERIES = {
    f.__name__: f
    for f in (
        company_by_key, filings_of_one, filing_parts, mapped_rows, filtered_sections, companies_by_either, entry_by_symbol_or_number, resolved_names, resolver_ids, glossary_uses, key_shapes, safe_messages,
        officer_flags, neo_counts, formatted_pay, fact_sources, group_titles, citation_labels, first_hops, session_checks, material_first, primary_groups, next_open, paid_order, refresh_chunks, gaps, job_progress,
        text_contexts, highlight_rows, capped_search, excerpt_caps, policy_diff, facts_matrix, peer_sheet, peer_sets, quality_notes, citations_resolved,
    )
}


# the same in SQL


def _ids_sql(source: str) -> str:
    return f"(SELECT filing_id, array_to_string(list_sort(list(DISTINCT id)), ',') AS ids FROM {source} GROUP BY 1)"


_GROUP_MEMBERS = "(SELECT g.filing_id, m.id FROM peer_group_members m JOIN peer_groups g ON g.id = m.peer_group_id)"
_PARTS = {"sections": "sections", "facts": "metric_facts", "groups": "peer_groups", "pay_rows": "exec_comp_rows", "members": _GROUP_MEMBERS}
_KNOWN = "(SELECT DISTINCT filing_id, 'section' AS kind FROM sections UNION SELECT DISTINCT filing_id, 'metric' FROM metric_facts UNION SELECT DISTINCT filing_id, 'peer_member' FROM peer_groups UNION SELECT DISTINCT filing_id, 'exec' FROM exec_comp_rows)"
_CITED = "(SELECT id, filing_id, generate_subscripts(l, 1) AS n, unnest(l) AS kind FROM (SELECT DISTINCT id, filing_id, citations, CAST(json_extract_string(citations, '$[*].kind') AS VARCHAR[]) AS l FROM ask_interactions WHERE citations IS NOT NULL))"


def _case(pairs: dict[str, str], column: str, otherwise: str = "NULL") -> str:
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in pairs.items()) + f" ELSE {otherwise} END"


def _asked_sql(asked: tuple[str, ...] = ASKED) -> str:
    rows = ", ".join(f"('{a}')" for a in asked)
    rank = "CASE WHEN lower(c.ticker) = lower(q.asked) THEN 0 WHEN c.id = lower(q.asked) THEN 1 WHEN contains(lower(c.name), lower(q.asked)) THEN 2 END"
    return (
        f"WITH q AS (SELECT * FROM (VALUES {rows}) t(asked)), h AS (SELECT q.asked, c.id, c.name, {rank} AS rank FROM q, companies c), "
        "b AS (SELECT * FROM h WHERE rank IS NOT NULL QUALIFY row_number() OVER (PARTITION BY asked ORDER BY rank, name, id) = 1) "
        "SELECT q.asked, b.id AS company_id, CAST(b.rank AS BIGINT) AS rank FROM q LEFT JOIN b ON b.asked = q.asked"
    )


def _session_sql() -> str:
    key = SECRET.ljust(64, b"\0")
    pad = lambda x: f"unhex('{bytes(b ^ x for b in key).hex()}')"
    mac = lambda m: f"sha256({pad(0x5C)} || unhex(sha256({pad(0x36)} || encode({m}))))"
    return (
        "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) // 1000000 AS came FROM events), "
        "i AS (SELECT *, came + CASE WHEN event_type = 'signup' THEN 3600 ELSE 0 END AS issued, (SELECT max(came) FROM e) AS now FROM e), "
        "m AS (SELECT *, CAST(user_id AS VARCHAR) || '|' || CAST(issued AS VARCHAR) AS message FROM i), "
        f"g AS (SELECT *, {mac(chr(40) + 'message || CASE WHEN event_type = ' + chr(39) + 'error' + chr(39) + ' THEN ' + chr(39) + 'x' + chr(39) + ' ELSE ' + chr(39) * 2 + ' END)')} AS given, {mac('message')} AS due FROM m) "
        f"SELECT CASE WHEN given <> due THEN 'forged' WHEN issued - now > {SKEW_S} THEN 'future' WHEN now - issued > {EXPIRES_S} THEN 'expired' ELSE 'valid' END AS state, count(*) AS sessions FROM g GROUP BY 1"
    )


_PRIMARY = "(SELECT filing_id, arg_min(id, (r, id)) AS group_id, CAST(min(r) AS BIGINT) AS rank FROM (SELECT id, filing_id, CASE WHEN contains(t, 'compensation') THEN 0 WHEN NOT regexp_matches(t, 'performance|return|index') THEN 1 ELSE 2 END AS r FROM (SELECT id, filing_id, lower(coalesce(peer_group_type, '')) AS t FROM peer_groups)) GROUP BY filing_id)"
_OFFICERS = "(SELECT filing_id, CAST(max(year) AS BIGINT) AS year, arg_max(n, year) AS officers FROM (SELECT filing_id, year, count(DISTINCT executive_name) AS n FROM exec_comp_rows GROUP BY 1, 2) GROUP BY 1)"
_POLICIES = "(SELECT filing_id, " + ", ".join(f"max(CASE WHEN regexp_matches(lower(text), '{rule}') THEN CASE WHEN contains(lower(text), 'prohibit') THEN 'prohibited' ELSE 'present' END END) AS {name}" for name, rule in POLICY_TYPES.items()) + " FROM sections GROUP BY 1)"
_FACTS = "(SELECT f.id AS filing_id, " + ", ".join(f"coalesce(p.{n}, 'Not extracted') AS {n}" for n in POLICY_TYPES) + ", " + ", ".join(f"coalesce(m.{n}, 'Not extracted') AS {n}" for n in METRIC_AXES) + f" FROM {_FILINGS} f LEFT JOIN {_POLICIES} p ON p.filing_id = f.id LEFT JOIN (SELECT filing_id, " + ", ".join(f"arg_max(coalesce(observed_value, 'Disclosed'), (updated_at, id)) FILTER (metric_name_normalized = '{n}') AS {n}" for n in METRIC_AXES) + " FROM metric_facts GROUP BY 1) m ON m.filing_id = f.id)"


def _sheet_sql() -> str:
    ids = asked_ids(SHEET_IDS)
    part = lambda c, a: f"CASE WHEN w > 0 THEN CAST(CAST(floor({c} / w * 100 + 0.5) AS BIGINT) AS VARCHAR) END AS {a}"
    mix = "(SELECT *, base + bonus + equity + other AS w FROM (SELECT id, filing_id, executive_name, principal_position, year, total, coalesce(salary, 0) AS base, coalesce(bonus, 0) + coalesce(non_equity_incentive_plan_compensation, 0) AS bonus, coalesce(stock_awards, 0) + coalesce(option_awards, 0) AS equity, coalesce(all_other_compensation, 0) AS other FROM " + _EXECS + "))"
    axes = ", ".join(f"coalesce({axis}, '') AS c{i}" if axis else f"'' AS c{i}" for i, (_, axis) in enumerate(SHEET))
    lines = " UNION ALL ".join(
        f"SELECT CAST({line} AS BIGINT) AS line_no, {_cell_sql(chr(39) + title + chr(39))} || ',' || string_agg({_cell_sql(f'c{i}')}, ',' ORDER BY n) AS line FROM x"
        for i, (line, (title, _)) in enumerate(zip(_line_numbers(), SHEET))
    )
    blanks = " UNION ALL ".join(f"SELECT {n}, ''" for n in _blank_lines())
    wanted = ", ".join(f"({n}, '{i}')" for n, i in enumerate(ids))
    return f"""
WITH w AS (SELECT * FROM (VALUES {wanted}) t(n, company_id)),
ceo AS (SELECT filing_id, executive_name AS ceo_name, CAST(CAST(round(total) AS BIGINT) AS VARCHAR) AS ceo_total, CAST(year AS VARCHAR) AS ceo_year, {part('base', 'base')}, {part('bonus', 'bonus')}, {part('equity', 'equity')}, {part('other', 'other')}, {part('(bonus + equity)', 'at_risk')}
  FROM (SELECT *, coalesce(principal_position, '') AS p FROM {mix}) WHERE {_CEO} QUALIFY row_number() OVER (PARTITION BY filing_id ORDER BY year DESC, coalesce(total, -1) DESC, id DESC) = 1),
x AS (
  SELECT w.n, coalesce(c.name || coalesce(' (' || c.ticker || ')', ''), upper(w.company_id)) AS head, q.*
  FROM w LEFT JOIN companies c ON c.id = w.company_id LEFT JOIN (
    SELECT f.company_id, CAST(f.filing_year AS VARCHAR) AS year, u.url, 'yes' AS ingested, ceo.* EXCLUDE (filing_id), CAST(o.officers AS VARCHAR) AS officers, CAST(len(g.members) AS VARCHAR) AS peers, m.* EXCLUDE (filing_id)
    FROM {_RANKED} f JOIN (SELECT id, arg_min(struct_pack(v := primary_document_url), created_at).v AS url FROM filings GROUP BY 1) u ON u.id = f.id LEFT JOIN ceo ON ceo.filing_id = f.id LEFT JOIN {_OFFICERS} o ON o.filing_id = f.id
    LEFT JOIN {_PRIMARY} p ON p.filing_id = f.id LEFT JOIN peer_groups g ON g.id = p.group_id LEFT JOIN {_FACTS} m ON m.filing_id = f.id WHERE f.rank = 1) q ON q.company_id = w.company_id),
y AS (SELECT * REPLACE (coalesce(ingested, 'no') AS ingested) FROM x),
z AS (SELECT n, head, {axes} FROM y)
SELECT CAST(0 AS BIGINT) AS line_no, 'Axis,' || string_agg({_cell_sql('head')}, ',' ORDER BY n) AS line FROM z UNION ALL {lines.replace(' FROM x', ' FROM z')} UNION ALL {blanks}"""


ORACLES = {
    "company_by_key": "SELECT id, cik, ticker, name, sector FROM companies WHERE cik = '0004299268'",
    "filings_of_one": f"SELECT id AS filing_id, strftime(filing_date, '%Y-%m-%d') AS filed, form_type, row_number() OVER (ORDER BY filing_date DESC, id DESC) AS place FROM {_FILINGS} WHERE company_id = 'aqqsp'",
    "filing_parts": f"SELECT f.id AS filing_id, " + ", ".join(f"coalesce({n}.ids, '') AS {n}" for n in _PARTS) + f" FROM {_FILINGS} f " + " ".join(f"LEFT JOIN {_ids_sql(src)} {n} ON {n}.filing_id = f.id" for n, src in _PARTS.items()),
    "mapped_rows": "SELECT id, strftime(arg_min(filing_date, created_at), '%Y-%m-%d') AS filed, strftime(arg_min(struct_pack(v := acceptance_datetime), created_at).v, '%Y-%m-%dT%H:%M:%S') AS accepted, year(arg_min(filing_date, created_at)) AS year_of_day, CAST(arg_min(filing_year, created_at) AS BIGINT) AS year FROM filings GROUP BY id",
    "filtered_sections": f"SELECT s.id, f.company_id, CAST(f.filing_year AS VARCHAR) AS year, s.section_type FROM sections s JOIN {_FILINGS} f ON f.id = s.filing_id WHERE f.filing_year = 2022 AND s.section_type = 'cd_and_a'",
    "companies_by_either": "SELECT id, ticker FROM companies WHERE id IN ('appfj', 'nobody') OR ticker IN ('AQQSP', 'BQCMS')",
    "entry_by_symbol_or_number": "SELECT m.id, coalesce(a.ticker_lower, b.ticker_lower) AS entry, CASE WHEN a.ticker IS NOT NULL THEN 'symbol' WHEN b.ticker IS NOT NULL THEN 'number' ELSE 'none' END AS found_by FROM (SELECT DISTINCT id, upper(trim(ticker_resolved)) AS s, lpad(trim(cik_resolved), 10, '0') AS n FROM peer_group_members) m LEFT JOIN ticker_universe a ON a.ticker = m.s LEFT JOIN ticker_universe b ON b.cik = m.n",
    "resolved_names": _asked_sql(),
    "resolver_ids": "SELECT DISTINCT coalesce(nullif(trim(lower(ticker)), ''), nullif(trim(lower(cik)), ''), nullif(trim(lower(name)), '')) AS id, name FROM (SELECT ticker, cik, name FROM ticker_universe UNION ALL SELECT ticker, cik, name FROM companies)",
    "glossary_uses": " UNION ALL ".join(f"SELECT '{t}' AS term, '{m}' AS meaning, count(*) AS sections FROM sections WHERE contains(lower(text), '{t}')" for t, m in GLOSSARY.items()),
    "key_shapes": "SELECT 'token' AS kind, count(*) FILTER (regexp_matches(v, '^[a-f0-9]{24}$')) AS good, count(*) FILTER (NOT regexp_matches(v, '^[a-f0-9]{24}$')) AS bad FROM (SELECT DISTINCT substr(sha256(CAST(user_id AS VARCHAR)), 1, 24) AS v FROM events WHERE user_id IS NOT NULL) UNION ALL SELECT 'symbol', count(*) FILTER (regexp_matches(trim(v), '^[A-Za-z][A-Za-z0-9.\\-]{0,7}$')), count(*) FILTER (NOT regexp_matches(trim(v), '^[A-Za-z][A-Za-z0-9.\\-]{0,7}$')) FROM (SELECT DISTINCT company_id_resolved AS v FROM peer_group_members WHERE company_id_resolved IS NOT NULL)",
    "safe_messages": f"SELECT event_id, CASE WHEN event_type IN ('error', 'purchase') THEN event_type END AS code, {_case(MESSAGES, 'event_type')} AS message FROM events",
    "officer_flags": f"SELECT p AS principal_position, {_CEO} AS strict, regexp_matches(p, '\\bexecutive\\s+officer\\b', 'i') AS loose, regexp_matches(p, '\\b(former|outgoing|retired|departing|interim)\\b.*\\b(ceo|chief\\s+executive)', 'i') AS former FROM (SELECT DISTINCT principal_position AS p FROM exec_comp_rows WHERE principal_position IS NOT NULL)",
    "neo_counts": f"SELECT * FROM {_OFFICERS}",
    "formatted_pay": f"WITH e AS (SELECT *, lag(total) OVER (PARTITION BY filing_id, executive_name ORDER BY year, id) AS before FROM {_EXECS}), r AS (SELECT id, min(total) AS text FROM exec_comp_rows GROUP BY id), c AS (SELECT *, CAST(round(total - before) AS BIGINT) AS d FROM e) SELECT c.id, CASE WHEN coalesce(trim(r.text), '') = '' THEN '—' WHEN starts_with(r.text, '$') THEN r.text ELSE '$' || r.text END AS shown, '$' || format('{{:,}}', CAST(round(c.total) AS BIGINT)) AS dollars, CASE WHEN d < 0 THEN '-$' ELSE '+$' END || format('{{:,}}', abs(d)) AS change FROM c JOIN r ON r.id = c.id",
    "fact_sources": "WITH m AS (SELECT CASE WHEN section_type = 'cd_and_a' THEN extraction_method ELSE concat_ws(':', extraction_method, section_type) END AS method FROM sections), s AS (SELECT CASE WHEN contains(method, ':') THEN substr(method, instr(method, ':') + 1) ELSE 'cd_and_a' END AS source FROM m) SELECT source, CASE source WHEN 'cd_and_a' THEN 'Discussion' WHEN 'ceo_pay_ratio' THEN 'Pay ratio' WHEN 'say_on_pay' THEN 'Advisory vote' ELSE source END AS label, count(*) AS sections FROM s GROUP BY 1",
    "group_titles": "SELECT id, concat_ws(' ', CAST(disclosed_year AS VARCHAR), upper(k[1]) || substr(k, 2) || ' Peer Group') AS title FROM (SELECT id, disclosed_year, lower(coalesce(peer_group_type, 'compensation')) AS k FROM peer_groups)",
    "citation_labels": f"SELECT id, n AS no, '[' || CAST(n AS VARCHAR) || '] ' || {_case(KINDS, 'kind', chr(39) + 'Source' + chr(39))} AS label FROM {_CITED}",
    "first_hops": "SELECT id, nullif(trim(string_split(array_to_string(list_transform(members, lambda m: m.company_name_raw), ' , '), ',')[1]), '') AS first FROM peer_groups",
    "session_checks": _session_sql(),
    "material_first": "WITH a AS (SELECT filing_id, metric_name_normalized, arg_max(struct_pack(v := observed_value), (updated_at, id)).v AS v FROM metric_facts WHERE metric_name_normalized <> '' GROUP BY 1, 2), b AS (SELECT filing_id, metric_name_normalized, arg_max(struct_pack(v := observed_value), (updated_at, id)).v AS v FROM metric_facts_oracle WHERE metric_name_normalized <> '' GROUP BY 1, 2), j AS (SELECT filing_id, metric_name_normalized, a.v IS DISTINCT FROM b.v AS changed FROM a FULL JOIN b USING (filing_id, metric_name_normalized)) SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY changed DESC, metric_name_normalized) AS place FROM j",
    "primary_groups": f"SELECT * FROM {_PRIMARY}",
    "next_open": "SELECT c.id, coalesce((SELECT min(d.id) FROM companies d WHERE d.ticker IS NULL AND d.id > c.id), (SELECT min(id) FROM companies WHERE ticker IS NULL)) AS next_id FROM companies c",
    "paid_order": f"WITH e AS (SELECT *, coalesce(principal_position, '') AS p, lower(trim(regexp_replace(executive_name, '\\s*(?:{'|'.join(X.TITLES)})\\s*$', '', 'i'))) AS who FROM {_EXECS}), y AS (SELECT filing_id, who, year, max(total) AS total, bool_or({_CEO}) AS ceo FROM e GROUP BY 1, 2, 3), d AS (SELECT *, total - lag(total) OVER (PARTITION BY filing_id, who ORDER BY year) AS delta FROM y), l AS (SELECT * FROM d QUALIFY row_number() OVER (PARTITION BY filing_id, who ORDER BY year DESC) = 1) SELECT filing_id, who, ceo, row_number() OVER (PARTITION BY filing_id ORDER BY ceo DESC, coalesce(abs(delta), 0) DESC, who) AS place FROM l",
    "refresh_chunks": "WITH p AS (SELECT id, CAST('0x' || substr(md5(id), 1, 8) AS BIGINT) % 5 AS part FROM companies) SELECT id, part, count(*) OVER (PARTITION BY part) AS companies FROM p",
    "gaps": f"SELECT f.id AS filing_id, coalesce(s.n, 0) AS sections, coalesce(g.n, 0) AS groups, coalesce(s.n, 0) >= 2 AS sections_ok, coalesce(g.n, 0) >= 2 AS groups_ok FROM {_FILINGS} f LEFT JOIN (SELECT filing_id, count(DISTINCT id) AS n FROM sections GROUP BY 1) s ON s.filing_id = f.id LEFT JOIN (SELECT filing_id, count(DISTINCT id) AS n FROM peer_groups GROUP BY 1) g ON g.filing_id = f.id WHERE coalesce(s.n, 0) < 2 OR coalesce(g.n, 0) < 2",
    "job_progress": f"WITH j AS (SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS status, epoch_us(min(ts)) AS a, epoch_us(max(ts)) AS b FROM events GROUP BY 1) SELECT user_id, status, (b - a) // 1000000 AS seconds, CASE WHEN status = 'error' THEN '{MESSAGES['error']}' END AS message FROM j",
    "text_contexts": "WITH s AS (SELECT id, text, string_split(lower(text), 'committee') AS p FROM sections WHERE contains(lower(text), 'committee')), h AS (SELECT id, text, unnest(range(0, least(3, len(p) - 1))) AS no, p FROM s), a AS (SELECT id, text, no, CAST(length(array_to_string(p[1:no + 1], 'committee')) AS BIGINT) AS \"at\" FROM h) SELECT id, no, \"at\", substr(text, greatest(\"at\" - 40, 0) + 1, \"at\" - greatest(\"at\" - 40, 0) + 49) AS context FROM a",
    "highlight_rows": "WITH s AS (SELECT id, heading FROM sections WHERE contains(lower(heading), 'committee')), p AS (SELECT id, string_split_regex(heading, '(?i)committee') AS l, regexp_extract_all(heading, '(?i)committee') AS h FROM s), x AS (SELECT id, (generate_subscripts(l, 1) - 1) * 2 AS no, unnest(l) AS part, false AS hit FROM p UNION ALL SELECT id, (generate_subscripts(h, 1) - 1) * 2 + 1, unnest(h), true FROM p) SELECT * FROM x WHERE part <> ''",
    "capped_search": "WITH f AS (SELECT id FROM sections WHERE contains(lower(text), 'committee') ORDER BY id LIMIT 30) SELECT id, (SELECT count(*) FROM f) >= 30 AS truncated FROM f",
    "excerpt_caps": "SELECT id, length(substr(trim(regexp_replace(text, '[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')), 1, 280)) AS source, " + ", ".join(f"length(substr(text, 1, {n})) AS {k}" for k, n in CAPS.items() if k != "source") + " FROM sections WHERE text IS NOT NULL",
    "policy_diff": f"WITH r AS (SELECT company_id, id, rank FROM {_RANKED} WHERE rank <= 2), p AS (SELECT r.company_id, r.rank, u.policy, u.value FROM r JOIN (UNPIVOT {_POLICIES} ON {', '.join(POLICY_TYPES)} INTO NAME policy VALUE value) u ON u.filing_id = r.id), j AS (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.policy, b.policy) AS policy, b.value AS old, a.value AS new FROM (SELECT * FROM p WHERE rank = 1) a FULL JOIN (SELECT * FROM p WHERE rank = 2) b ON a.company_id = b.company_id AND a.policy = b.policy) SELECT *, CASE WHEN old IS NULL THEN 'added' WHEN new IS NULL THEN 'removed' WHEN old = new THEN 'unchanged' ELSE 'changed' END AS status FROM j WHERE company_id IN (SELECT company_id FROM r GROUP BY 1 HAVING count(*) = 2)",
    "facts_matrix": f"SELECT * FROM {_FACTS}",
    "peer_sheet": _sheet_sql(),
    "peer_sets": "WITH e AS (SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn, event_type AS t, CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 20 AS VARCHAR) AS entry FROM events), c AS (SELECT user_id, max(rn) AS rn FROM e WHERE t = 'signup' GROUP BY 1), r AS (SELECT user_id, entry, max(rn) AS rn FROM e WHERE t = 'error' GROUP BY 1, 2), s AS (SELECT e.user_id, e.entry, min(e.rn) AS rn FROM e LEFT JOIN c ON c.user_id = e.user_id LEFT JOIN r ON r.user_id = e.user_id AND r.entry = e.entry WHERE e.t IN ('view', 'click') AND e.rn > coalesce(c.rn, 0) AND e.rn > coalesce(r.rn, 0) GROUP BY 1, 2), m AS (SELECT user_id, entry, max(rn) AS rn FROM e WHERE t = 'purchase' GROUP BY 1, 2) SELECT s.user_id, row_number() OVER (PARTITION BY s.user_id ORDER BY s.rn) AS place, s.entry, coalesce(m.rn > s.rn, false) AS imported FROM s LEFT JOIN m ON m.user_id = s.user_id AND m.entry = s.entry",
    "quality_notes": f"WITH m AS (SELECT DISTINCT peer_group_id, nullif(upper(trim(coalesce(ticker_resolved, company_id_resolved))), '') AS symbol FROM peer_group_members), o AS (SELECT m.*, f.company_id FROM m JOIN peer_groups g ON g.id = m.peer_group_id JOIN {_FILINGS} f ON f.id = g.filing_id WHERE symbol IS NOT NULL AND symbol NOT IN (SELECT ticker FROM ticker_universe)), s AS (SELECT peer_group_id, array_to_string(list_sort(list(symbol)), ', ') AS symbols FROM (SELECT *, count(*) OVER (PARTITION BY company_id, symbol) AS n FROM o) WHERE n < 3 GROUP BY 1) SELECT g.id AS peer_group_id, CASE WHEN symbols IS NOT NULL THEN 'flagged' ELSE 'unreviewed' END AS review, 'Set aside: unknown symbols ' || symbols || '.' AS note FROM peer_groups g LEFT JOIN s ON s.peer_group_id = g.id",
    "citations_resolved": f"WITH p AS (SELECT id, lag(id) OVER (PARTITION BY company_id ORDER BY filing_date, id) AS prior FROM {_FILINGS}), c AS (SELECT DISTINCT id, n, kind, nullif(replace(trim(filing_id), '-', ''), '') AS f FROM {_CITED}), j AS (SELECT c.kind, EXISTS (SELECT 1 FROM {_KNOWN} k WHERE k.filing_id = c.f AND k.kind = c.kind) AS here, EXISTS (SELECT 1 FROM {_KNOWN} k WHERE k.filing_id = p.prior AND k.kind = c.kind) AS before FROM c LEFT JOIN p ON p.id = c.f) SELECT kind, CASE WHEN here THEN 'this filing' WHEN before THEN 'prior filing' ELSE 'rejected' END AS found, count(*) AS citations FROM j GROUP BY 1, 2",
}
