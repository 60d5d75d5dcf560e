"""Reads over companies, filings and their artifacts: scans, joins, aggregates, ranks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators.orphans import clean_key
from ledgerloom.sources.tables import table

# DuckDB forms of shared expressions
_FILINGS = "(SELECT id, min(created_at) AS created_at, arg_min(company_id, created_at) AS company_id, arg_min(filing_year, created_at) AS filing_year, arg_min(filing_date, created_at) AS filing_date, arg_min(form_type, created_at) AS form_type FROM filings GROUP BY id)"
_SHOWN = "NOT (review_status = 'flagged' OR verification_status = 'rejected')"


def num_sql(c: str) -> str:
    t = f"trim(regexp_replace({c}, '[,$]', '', 'g'))"
    return f"CASE WHEN {c} = '' THEN NULL WHEN {t} = '' THEN 0.0::DOUBLE WHEN regexp_matches({t}, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$') THEN TRY_CAST({t} AS DOUBLE) END"


def filings_of(spark: SparkSession, folder: str) -> DataFrame:
    """Filings once each, as first loaded."""
    cols = ["company_id", "filing_year", "filing_date", "form_type"]
    rows = table(spark, folder, "filings").groupBy("id")
    return rows.agg(F.min("created_at").alias("created_at"), *[F.min_by(c, "created_at").alias(c) for c in cols])


def ranked_filings(spark: SparkSession, folder: str) -> DataFrame:
    """Filings with their rank within the company, latest first."""
    latest = W.partitionBy("company_id").orderBy(F.desc("filing_date"), F.desc("id"))
    return filings_of(spark, folder).withColumn("rank", F.row_number().over(latest))


_RANKED = f"(SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, id DESC) AS rank FROM {_FILINGS})"


def exec_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Compensation rows once each, with money as numbers."""
    money = ["salary", "bonus", "stock_awards", "option_awards", "non_equity_incentive_plan_compensation", "all_other_compensation", "total"]
    keep = ["id", "filing_id", "executive_name", "principal_position", "year"]
    return table(spark, folder, "exec_comp_rows").select(*keep, *[X.plain_number(F.col(m)).alias(m) for m in money]).dropDuplicates(["id"])


_EXECS = "(SELECT DISTINCT id, filing_id, executive_name, principal_position, year, " + ", ".join(
    f"{num_sql(m)} AS {m}" for m in ("salary", "bonus", "stock_awards", "option_awards", "non_equity_incentive_plan_compensation", "all_other_compensation", "total")
) + " FROM exec_comp_rows)"


def company_scan(spark: SparkSession, folder: str) -> DataFrame:
    """All companies in order of name."""
    return table(spark, folder, "companies").select("id", "cik", "ticker", "name", "sector").orderBy("name", "id")


def filings_by_company(spark: SparkSession, folder: str) -> DataFrame:
    """Filings per company, latest first, with the count and the share of annual statements."""
    f = filings_of(spark, folder)
    return f.groupBy("company_id").agg(
        F.count(F.lit(1)).alias("filings"),
        F.max("filing_date").cast("string").alias("latest"),
        F.min("filing_year").cast("long").alias("first_year"),
        F.count_if(F.col("form_type") == "DEF 14A").alias("statements"),
    )


def latest_and_prior(spark: SparkSession, folder: str) -> DataFrame:
    """Each company's latest filing and the one before."""
    ranked = ranked_filings(spark, folder).where("rank <= 2")
    return ranked.groupBy("company_id").agg(F.max(F.when(F.col("rank") == 1, F.col("id"))).alias("latest"), F.max(F.when(F.col("rank") == 2, F.col("id"))).alias("prior"))


def filing_as_of(spark: SparkSession, folder: str, year: int = 2018) -> DataFrame:
    """Per company the newest filing up to a year, else the newest of all."""
    f = filings_of(spark, folder)
    newest = lambda c: F.max_by("id", F.when(c, F.struct("filing_date", "id")))
    return f.groupBy("company_id").agg(F.coalesce(newest(F.col("filing_year") <= year), newest(F.lit(True))).alias("filing_id"))


def members_nested(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with their members in order of id; a group without members has an empty list."""
    members = table(spark, folder, "peer_group_members").select("id", "peer_group_id", "company_name_raw").distinct()
    lists = members.groupBy("peer_group_id").agg(F.array_sort(F.collect_list(F.struct("id", "company_name_raw"))).alias("m"))
    groups = table(spark, folder, "peer_groups").select(F.col("id").alias("group_id"), "filing_id")
    nested = groups.join(lists, groups["group_id"] == lists["peer_group_id"], "left")
    return nested.select("group_id", "filing_id", F.coalesce(F.size("m"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join("m.company_name_raw", "|"), F.lit("")).alias("names"))


def filing_detail(spark: SparkSession, folder: str) -> DataFrame:
    """One row per filing with counts of all its artifacts: each child is aggregated before the join."""
    out = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id", F.col("filing_year").cast("long").alias("filing_year"))
    for name in ("sections", "peer_groups", "metric_facts", "exec_comp_rows"):
        child = table(spark, folder, name).select("filing_id", "id").distinct().groupBy("filing_id").agg(F.count(F.lit(1)).alias(name))
        out = out.join(child, "filing_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return out


def visible_groups(spark: SparkSession, folder: str) -> DataFrame:
    """Groups that are neither flagged nor rejected."""
    return table(spark, folder, "peer_groups").where(X.hide_flagged(F.col("review_status"), F.col("verification_status"))).select("id", "filing_id", "peer_group_name")


def suspect_members(spark: SparkSession, folder: str) -> DataFrame:
    """Members resolved to a symbol unlike their list entry's, by company: rows, filings and the symbols."""
    m = table(spark, folder, "peer_group_members").where(F.col("ticker_resolved").isNotNull()).select("id", "peer_group_id", "ticker_resolved", "company_id_resolved").distinct()
    odd = m.where(F.lower("ticker_resolved") != F.lower(F.trim("company_id_resolved")))
    g = table(spark, folder, "peer_groups").select(F.col("id").alias("peer_group_id"), "filing_id")
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id")
    c = table(spark, folder, "companies").select(F.col("id").alias("company_id"), "name")
    rows = odd.join(g, "peer_group_id").join(f, "filing_id").join(c, "company_id")
    return rows.groupBy("company_id", "name").agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("filing_id").alias("filings"), F.array_join(F.array_sort(F.collect_set("ticker_resolved")), ",").alias("symbols")
    )


def lookup_cascade(spark: SparkSession, folder: str) -> DataFrame:
    """Each member's list entry: by id, else by symbol, else by compared name; and where it was found."""
    m = table(spark, folder, "peer_group_members").select("id", "company_name_raw", F.lower(F.trim("company_id_resolved")).alias("by_id"), F.lower("ticker_resolved").alias("by_symbol")).distinct()
    u = table(spark, folder, "ticker_universe")
    ids, symbols = u.select(F.col("ticker_lower").alias("by_id"), F.col("ticker_lower").alias("t1")), u.select(F.col("ticker_lower").alias("by_symbol"), F.col("ticker_lower").alias("t2"))
    first = u.select(X.company_key(F.col("name")).alias("key"), "ticker_lower").where("key <> ''").groupBy("key").agg(F.min("ticker_lower").alias("t3"))
    rows = m.withColumn("key", X.company_key(F.col("company_name_raw"))).join(ids, "by_id", "left").join(symbols, "by_symbol", "left").join(first, "key", "left")
    how = F.when(F.col("t1").isNotNull(), "id").when(F.col("t2").isNotNull(), "symbol").when(F.col("t3").isNotNull(), "name").otherwise("none")
    return rows.select("id", F.coalesce("t1", "t2", "t3").alias("entry"), how.alias("found_by"))


def _key_sql(c: str) -> str:
    bare = f"regexp_replace({c}, '\\((nyse|nasdaq|nse|amex|otc|tsx|lse|tse|otcbb|otcqb|otcqx)\\s*[:.-]?\\s*[a-z0-9.-]{{1,8}}\\)', ' ', 'gi')"
    words = f"trim(regexp_replace(lower({bare}), '[^a-z0-9]+', ' ', 'g'))"
    forms = "incorporated|corporation|limited|holdings|holding|company|companies|international|group|and co|plc|llc|ltd|inc|corp|co|sa|nv|ag"
    return f"trim(regexp_replace({words}, '((^| )({forms}))+$', ''))"


def listed_filers(spark: SparkSession, folder: str) -> DataFrame:
    """Companies with a flag whether their symbol is listed."""
    u = table(spark, folder, "ticker_universe").select(F.col("ticker_lower"), F.lit(True).alias("listed"))
    c = table(spark, folder, "companies").select("id", F.lower("ticker").alias("ticker_lower"))
    return c.join(u, "ticker_lower", "left").select("id", F.coalesce("listed", F.lit(False)).alias("listed"))


def absent_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of the oracle copy whose name the candidate's filing lacks: what an append would add."""
    keys = ["filing_id", "metric_name_normalized"]
    a, b = (table(spark, folder, n).select(*keys).where("metric_name_normalized IS NOT NULL").distinct() for n in ("metric_facts_oracle", "metric_facts"))
    return a.join(b, keys, "left_anti")


def untracked_to_null(spark: SparkSession, folder: str) -> DataFrame:
    """Members with the resolved id in its one form, nulled unless it is listed; no row is lost."""
    key = clean_key(F.col("company_id_resolved"), lower=True)
    m = table(spark, folder, "peer_group_members").select("id", "company_id_resolved").distinct().select("id", key.alias("key"))
    u = table(spark, folder, "ticker_universe").select(F.col("ticker_lower").alias("key"), F.lit(True).alias("known"))
    return m.join(u, "key", "left").select("id", F.when(F.col("known"), F.col("key")).alias("tracked_id"))


def with_defaults(spark: SparkSession, folder: str) -> DataFrame:
    """Every listed symbol with its filer's name and latest year, and defaults where there is none."""
    u = table(spark, folder, "ticker_universe").select(F.col("ticker_lower").alias("id"), "name")
    c = table(spark, folder, "companies").select(F.lower("ticker").alias("id"), F.col("id").alias("company_id"))
    all_ids = u.unionByName(c.join(u, "id", "left_anti").select("id", F.lit(None).cast("string").alias("name"))).where("id IS NOT NULL")
    years = filings_of(spark, folder).groupBy("company_id").agg(F.max("filing_year").alias("year"))
    rows = all_ids.join(c, "id", "left").join(years, "company_id", "left")
    return rows.select("id", F.coalesce("name", F.lit("Not listed")).alias("name"), F.coalesce(F.col("year").cast("string"), F.lit("Not ingested")).alias("year"), F.col("company_id").isNull().alias("absent"))


def pay_mix(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of base, bonus, equity and other pay in percent; no shares without a positive total."""
    e = exec_rows(spark, folder)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    e = e.select("id", zero("salary").alias("base"), (zero("bonus") + zero("non_equity_incentive_plan_compensation")).alias("bonus"), (zero("stock_awards") + zero("option_awards")).alias("equity"), zero("all_other_compensation").alias("other"))
    total = F.col("base") + F.col("bonus") + F.col("equity") + F.col("other")
    return e.select("id", *[F.when(total > 0, X.half_up(F.col(c) / total * 100)).cast("long").alias(c) for c in ("base", "bonus", "equity", "other")])


def pay_trend(spark: SparkSession, folder: str) -> DataFrame:
    """Total pay per filer and year against the year before, with the direction on the unrounded change."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id")
    sums = exec_rows(spark, folder).join(f, "filing_id").groupBy("company_id", "year").agg(F.sum("total").alias("total"))
    prior = F.lag("total").over(W.partitionBy("company_id").orderBy("year"))
    pct = X.change_percent(F.col("total"), F.col("prior"))
    rows = sums.withColumn("prior", prior)
    return rows.select("company_id", F.col("year").cast("long").alias("year"), X.half_up(pct).cast("long").alias("pct"), X.direction(pct).alias("direction"))


_PCT = "CASE WHEN total IS NOT NULL AND prior IS NOT NULL AND prior <> 0 THEN (total - prior) / prior * 100 END"


def top_paid(spark: SparkSession, folder: str, k: int = 6) -> DataFrame:
    """The best paid of each filing's latest year, chief executive first, then by total."""
    e = exec_rows(spark, folder)
    e = e.withColumn("last", F.max("year").over(W.partitionBy("filing_id"))).where("year = last")
    order = W.partitionBy("filing_id").orderBy("role", F.col("total").desc_nulls_last(), "executive_name", "id")
    rows = e.withColumn("role", X.role_rank(F.coalesce("principal_position", F.lit(""))).cast("long")).withColumn("place", F.row_number().over(order).cast("long"))
    return rows.where(F.col("place") <= k).select("filing_id", "place", "executive_name", "role", "total")


_CEO = "(regexp_matches(regexp_replace(p, '([a-z])([A-Z])', '\\1 \\2', 'g'), 'chief\\s+executive\\s+officer|co-ceo', 'i') OR regexp_matches(p, '(^|[^A-Z])CEO([^A-Z]|$)'))"
_ROLE = f"CASE WHEN {_CEO} THEN 0 WHEN regexp_matches(p, 'chief\\s+financial\\s+officer', 'i') OR regexp_matches(p, '(^|[^A-Z])CFO([^A-Z]|$)') THEN 1 ELSE 2 END"


def facts_wide(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of each filing as columns, one for each of five names; the last version of a fact counts."""
    names = ["revenue", "relative_tsr", "free_cash_flow", "net_promoter_score", "safety_rate"]
    m = table(spark, folder, "metric_facts").where(F.col("metric_name_normalized").isin(*names))
    last = m.groupBy("filing_id", "metric_name_normalized").agg(F.max_by(F.coalesce("observed_value", F.lit("Disclosed")), F.struct("updated_at", "id")).alias("v"))
    wide = last.groupBy("filing_id").pivot("metric_name_normalized", names).agg(F.first("v"))
    return wide.select("filing_id", *[F.coalesce(n, F.lit("Not extracted")).alias(n) for n in names])


def status_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """Review states per artifact; no state counts as unreviewed."""
    parts = [
        table(spark, folder, n).select("id", "review_status").distinct().groupBy(F.lit(n).alias("artifact")).agg(
            F.count_if(F.coalesce("review_status", F.lit("unreviewed")) == "unreviewed").alias("unreviewed"),
            F.count_if(F.col("review_status") == "reviewed").alias("reviewed"),
            F.count_if(F.col("review_status") == "flagged").alias("flagged"),
            F.count(F.lit(1)).alias("all_rows"),
        )
        for n in ("sections", "peer_groups", "exec_comp_rows")
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def filing_rollup(spark: SparkSession, folder: str) -> DataFrame:
    """Per filing the extractor versions seen and flags for artifacts that are lacking."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"))
    s = table(spark, folder, "sections").groupBy("filing_id").agg(F.countDistinct("id").alias("sections"), F.array_join(F.array_sort(F.collect_set("extractor_version")), ",").alias("versions"))
    g = table(spark, folder, "peer_groups").groupBy("filing_id").agg(F.countDistinct("id").alias("groups"), F.sum(F.size("members")).alias("members"))
    rows = f.join(s, "filing_id", "left").join(g, "filing_id", "left").fillna(0, ["sections", "groups", "members"]).fillna("", ["versions"])
    flags = F.array_join(F.array_compact(F.array(F.when(F.col("sections") == 0, F.lit("no_sections")), F.when(F.col("groups") == 0, F.lit("no_groups")), F.when(F.col("members") == 0, F.lit("no_members")))), ",")
    return rows.withColumn("issues", flags)


def section_text(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of a filing's sections of one type joined in order of id; empty ones are left out."""
    s = table(spark, folder, "sections").where(F.coalesce("text", F.lit("")) != "")
    lists = s.groupBy("filing_id", "section_type").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    return lists.select("filing_id", "section_type", F.size("x").cast("long").alias("n"), F.md5(F.array_join("x.text", "\n\n")).alias("digest"))


def dedupe_forms(spark: SparkSession, folder: str) -> DataFrame:
    """Of the rows of an executive and year within a filing: the first, the last and the one of the largest total."""
    e = exec_rows(spark, folder).withColumn("who", F.lower(X.display_name(F.col("executive_name"))))
    return e.groupBy("filing_id", "who", "year").agg(
        F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.max_by("id", F.struct(F.coalesce("total", F.lit(-1.0)), -F.col("id"))).alias("largest_id")
    ).withColumn("year", F.col("year").cast("long"))


def best_fact(spark: SparkSession, folder: str) -> DataFrame:
    """Per filing and category the fact of the greatest confidence; a value, then a shorter excerpt decide ties."""
    m = table(spark, folder, "metric_facts").where("metric_category IS NOT NULL")
    order = F.struct(F.coalesce(F.col("confidence_score").cast("double"), F.lit(0.0)), F.col("observed_value").isNotNull(), -F.length(F.coalesce("source_excerpt", F.lit(""))), -F.col("id"))
    return m.groupBy("filing_id", "metric_category").agg(F.max_by("id", order).alias("id"))


def nested_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Members per group from the nested column, and how many of them are resolved."""
    g = table(spark, folder, "peer_groups")
    return g.select("id", F.size("members").cast("long").alias("members"), F.size(F.filter("members", lambda m: m["ticker_resolved"].isNotNull())).cast("long").alias("resolved"))


def pages(spark: SparkSession, folder: str, page: int = 3, size: int = 20) -> DataFrame:
    """One page of companies by id, with the offset of the next."""
    c = table(spark, folder, "companies").select("id").orderBy("id").offset((page - 1) * size).limit(size)
    return c.withColumn("next_offset", F.lit(page * size).cast("long"))


def chunks(spark: SparkSession, folder: str, size: int = 4) -> DataFrame:
    """Each filer's filings dealt out in runs of four by date."""
    f = filings_of(spark, folder)
    place = F.row_number().over(W.partitionBy("company_id").orderBy("filing_date", "id")) - 1
    return f.select("id", "company_id", F.floor(place / size).cast("long").alias("chunk"))


def first_peers(spark: SparkSession, folder: str, k: int = 4) -> DataFrame:
    """The first four distinct resolved peers of each filer's latest filing, without the filer."""
    latest = ranked_filings(spark, folder).where("rank = 1").select(F.col("id").alias("filing_id"), "company_id")
    g = table(spark, folder, "peer_groups").where(X.hide_flagged(F.col("review_status"), F.col("verification_status"))).select(F.col("id").alias("peer_group_id"), "filing_id")
    m = table(spark, folder, "peer_group_members").where("ticker_resolved IS NOT NULL").select("id", "peer_group_id", F.lower("ticker_resolved").alias("peer"))
    rows = m.join(g, "peer_group_id").join(latest, "filing_id").where("peer <> company_id").groupBy("company_id", "peer").agg(F.min("id").alias("id"))
    place = F.row_number().over(W.partitionBy("company_id").orderBy("id")).cast("long")
    return rows.withColumn("place", place).where(F.col("place") <= k).select("company_id", "place", "peer")


def ticker_search(spark: SparkSession, folder: str, query: str = "bel", k: int = 10) -> DataFrame:
    """List entries ranked by how a query meets symbol or name; filers first, then by name."""
    q = query.lower().replace(".", "-")
    u = table(spark, folder, "ticker_universe")
    ticker, name = F.translate("ticker_lower", ".", "-"), F.col("name_lower")
    word = F.regexp_instr(name, F.lit(f"(^|[ &/-]){q}"))
    at, inside = F.when(word == 0, None).otherwise(F.greatest(word - 1, F.lit(0))), F.instr(name, q) - 1
    score = (
        F.when(ticker == q, 1000)
        .when(F.startswith(ticker, F.lit(q)), 900 - (F.length(ticker) - len(q)))
        .when(at.isNotNull(), 700 - F.least(at, F.lit(200)))
        .when(inside >= 0, 500 - F.least(inside, F.lit(200)))
        .when(F.contains(ticker, F.lit(q)), 400)
    )
    c = table(spark, folder, "companies").select(F.lower("ticker").alias("ticker_lower"), F.lit(1).alias("here")).distinct()
    rows = u.join(c, "ticker_lower", "left").select("ticker", "name", score.cast("long").alias("score"), F.coalesce("here", F.lit(0)).cast("long").alias("in_db"))
    return rows.where("score IS NOT NULL").orderBy(F.desc("score"), F.desc("in_db"), "name", "ticker").limit(k)


def compare_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Axis by company in long form: what a transposed sheet holds, each cell ready for CSV."""
    c = table(spark, folder, "companies").select(F.col("id").alias("company_id"), "name", "sector", "ticker")
    f = ranked_filings(spark, folder).where("rank = 1").select("company_id", F.col("filing_year").cast("string").alias("year"), "form_type")
    rows = c.join(f, "company_id", "left")
    axes = ["name", "ticker", "sector", "year", "form_type"]
    cells = F.array(*[F.struct(F.lit(i).cast("long").alias("axis_no"), F.lit(a).alias("axis"), X.csv_cell(F.coalesce(F.col(a), F.lit("—"))).alias("cell")) for i, a in enumerate(axes)])
    return rows.select("company_id", F.inline(cells))


def exec_csv(spark: SparkSession, folder: str) -> DataFrame:
    """Compensation rows as CSV lines."""
    e = table(spark, folder, "exec_comp_rows").dropDuplicates(["id"])
    cols = ["executive_name", "principal_position", "salary", "total"]
    return e.select("id", F.concat_ws(",", *[X.csv_cell(F.col(c)) for c in cols]).alias("line"))


def _cell_sql(c: str) -> str:
    t = f"coalesce({c}, '')"
    safe = f"(CASE WHEN regexp_matches({t}, '^[=+\\-@\\t\\r]') THEN '''' || {t} ELSE {t} END)"
    return f"(CASE WHEN regexp_matches({safe}, '[,\"\\n\\r]') THEN '\"' || replace({safe}, '\"', '\"\"') || '\"' ELSE {safe} END)"


def scaled_values(spark: SparkSession, folder: str) -> DataFrame:
    """Observed values read as numbers, both ways, with their kind and their cleaned form."""
    m = table(spark, folder, "metric_facts").select("observed_value").where("observed_value IS NOT NULL").distinct()
    v = F.col("observed_value")
    return m.select(v, X.scaled_number(v).alias("scaled"), X.plain_number(v).alias("plain"), X.value_kind(v).alias("kind"))


def canonical_digest(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of document texts with white space collapsed."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    return d.select("doc_id", F.sha2(X.collapse(F.col("text")), 256).alias("digest"), F.length(X.collapse(F.col("text"))).cast("long").alias("chars"))


_WS = "[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+"


def client_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Salted hashes of users, blank as anonymous, and how many events each has."""
    e = table(spark, folder, "events")
    who = F.when(F.coalesce(F.col("user_id").cast("string"), F.lit("")) == "", "anon").otherwise(F.substring(F.sha2(F.concat_ws("|", F.lit("salt"), F.col("user_id").cast("string")), 256), 1, 24))
    return e.groupBy(who.alias("client")).agg(F.count(F.lit(1)).alias("events"))


def submissions_to_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks of parallel arrays per filer opened into rows of the wanted forms, newest first per filer."""
    f = filings_of(spark, folder)
    block = f.groupBy("company_id").agg(F.array_sort(F.collect_list(F.struct("filing_date", "id", "form_type"))).alias("x"))
    arrays = block.select("company_id", F.col("x.id").alias("accession"), F.col("x.form_type").alias("form"), F.col("x.filing_date").alias("filed"))
    rows = arrays.select("company_id", F.inline(F.arrays_zip("accession", "form", "filed")))
    wanted = rows.where(F.col("form").isin("DEF 14A", "DEF 14C"))
    place = F.row_number().over(W.partitionBy("company_id").orderBy(F.desc("filed"), F.desc("accession"))).cast("long")
    return wanted.select("company_id", "accession", "form", place.alias("place"))


def filing_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Archive addresses built from padded numbers."""
    c = table(spark, folder, "companies").select(F.col("id").alias("company_id"), "cik")
    f = filings_of(spark, folder).join(c, "company_id")
    bare = F.regexp_replace("cik", "^0+", "")
    return f.select("id", F.concat_ws("/", F.lit(""), F.lit("archive"), bare, F.regexp_replace("id", "-", "")).alias("url"), F.lpad("cik", 10, "0").alias("padded"))


QUERIES = {
    f.__name__: f
    for f in (company_scan, filings_by_company, latest_and_prior, filing_as_of, members_nested, filing_detail, visible_groups, suspect_members, lookup_cascade, listed_filers, absent_facts, untracked_to_null, with_defaults, pay_mix, pay_trend, top_paid, facts_wide, status_histogram, filing_rollup, section_text, dedupe_forms, best_fact, nested_counts, pages, chunks, first_peers, ticker_search, compare_matrix, exec_csv, scaled_values, canonical_digest, client_hashes, submissions_to_rows, filing_urls)
}

_T = "trim(regexp_replace(observed_value, '[,$]', '', 'g'))"
_SCALED = f"regexp_extract({_T}, '^([+-]?[0-9]+(?:\\.[0-9]+)?)\\s*(billion|million|trillion)?(?:[^A-Za-z0-9_]|$)', ['d', 's'], 'i')"
_WIDE = ["revenue", "relative_tsr", "free_cash_flow", "net_promoter_score", "safety_rate"]

ORACLES = {
    "company_scan": "SELECT id, cik, ticker, name, sector FROM companies",
    "filings_by_company": f"SELECT company_id, count(*) AS filings, CAST(max(filing_date) AS VARCHAR) AS latest, CAST(min(filing_year) AS BIGINT) AS first_year, count(*) FILTER (form_type = 'DEF 14A') AS statements FROM {_FILINGS} GROUP BY company_id",
    "latest_and_prior": f"SELECT company_id, max(id) FILTER (rank = 1) AS latest, max(id) FILTER (rank = 2) AS prior FROM {_RANKED} GROUP BY company_id",
    "filing_as_of": f"SELECT company_id, coalesce(arg_max(id, (filing_date, id)) FILTER (filing_year <= 2018), arg_max(id, (filing_date, id))) AS filing_id FROM {_FILINGS} GROUP BY company_id",
    "members_nested": "SELECT g.id AS group_id, g.filing_id, count(m.id) AS n, coalesce(string_agg(m.company_name_raw, '|' ORDER BY m.id), '') AS names FROM peer_groups g LEFT JOIN (SELECT DISTINCT id, peer_group_id, company_name_raw FROM peer_group_members) m ON m.peer_group_id = g.id GROUP BY g.id, g.filing_id",
    "filing_detail": f"SELECT f.id AS filing_id, f.company_id, CAST(f.filing_year AS BIGINT) AS filing_year, "
    + ", ".join(f"(SELECT count(DISTINCT x.id) FROM {n} x WHERE x.filing_id = f.id) AS {n}" for n in ("sections", "peer_groups", "metric_facts", "exec_comp_rows"))
    + f" FROM {_FILINGS} f",
    "visible_groups": f"SELECT id, filing_id, peer_group_name FROM peer_groups WHERE {_SHOWN}",
    "suspect_members": f"SELECT c.id AS company_id, c.name, count(*) AS rows, count(DISTINCT f.id) AS filings, array_to_string(list_sort(list(DISTINCT m.ticker_resolved)), ',') AS symbols FROM (SELECT DISTINCT id, peer_group_id, ticker_resolved, company_id_resolved FROM peer_group_members) m JOIN peer_groups g ON g.id = m.peer_group_id JOIN {_FILINGS} f ON f.id = g.filing_id JOIN companies c ON c.id = f.company_id WHERE lower(m.ticker_resolved) <> lower(trim(m.company_id_resolved)) GROUP BY c.id, c.name",
    "lookup_cascade": f"SELECT m.id, coalesce(a.ticker_lower, b.ticker_lower, n.t) AS entry, CASE WHEN a.ticker_lower IS NOT NULL THEN 'id' WHEN b.ticker_lower IS NOT NULL THEN 'symbol' WHEN n.t IS NOT NULL THEN 'name' ELSE 'none' END AS found_by FROM (SELECT DISTINCT id, company_name_raw, company_id_resolved, ticker_resolved FROM peer_group_members) m LEFT JOIN ticker_universe a ON a.ticker_lower = lower(trim(m.company_id_resolved)) LEFT JOIN ticker_universe b ON b.ticker_lower = lower(m.ticker_resolved) LEFT JOIN (SELECT {_key_sql('name')} AS k, min(ticker_lower) AS t FROM ticker_universe GROUP BY 1) n ON n.k = {_key_sql('m.company_name_raw')} AND n.k <> ''",
    "listed_filers": "SELECT id, coalesce(lower(ticker) IN (SELECT ticker_lower FROM ticker_universe), false) AS listed FROM companies",
    "absent_facts": "SELECT DISTINCT filing_id, metric_name_normalized FROM metric_facts_oracle WHERE metric_name_normalized IS NOT NULL EXCEPT SELECT filing_id, metric_name_normalized FROM metric_facts",
    "untracked_to_null": "SELECT m.id, u.ticker_lower AS tracked_id FROM (SELECT DISTINCT id, company_id_resolved FROM peer_group_members) m LEFT JOIN ticker_universe u ON u.ticker_lower = lower(trim(m.company_id_resolved))",
    "with_defaults": f"WITH a AS (SELECT ticker_lower AS id, name FROM ticker_universe UNION ALL SELECT lower(ticker), NULL FROM companies WHERE ticker IS NOT NULL AND lower(ticker) NOT IN (SELECT ticker_lower FROM ticker_universe)) SELECT a.id, coalesce(a.name, 'Not listed') AS name, coalesce(CAST(y.year AS VARCHAR), 'Not ingested') AS year, c.id IS NULL AS absent FROM a LEFT JOIN companies c ON lower(c.ticker) = a.id LEFT JOIN (SELECT company_id, max(filing_year) AS year FROM filings GROUP BY 1) y ON y.company_id = c.id",
    "pay_mix": f"WITH e AS (SELECT id, coalesce(salary, 0) AS a, coalesce(bonus, 0) + coalesce(non_equity_incentive_plan_compensation, 0) AS b, coalesce(stock_awards, 0) + coalesce(option_awards, 0) AS c, coalesce(all_other_compensation, 0) AS d FROM {_EXECS}) SELECT id, "
    + ", ".join(f"CAST(CASE WHEN a + b + c + d > 0 THEN floor({x} / (a + b + c + d) * 100 + 0.5) END AS BIGINT) AS {n}" for x, n in zip("abcd", ("base", "bonus", "equity", "other")))
    + " FROM e",
    "pay_trend": f"WITH s AS (SELECT f.company_id, e.year, sum(e.total) AS total FROM {_EXECS} e JOIN {_FILINGS} f ON f.id = e.filing_id GROUP BY 1, 2), p AS (SELECT *, lag(total) OVER (PARTITION BY company_id ORDER BY year) AS prior FROM s), q AS (SELECT company_id, year, {_PCT} AS pct FROM p) SELECT company_id, CAST(year AS BIGINT) AS year, CAST(floor(pct + 0.5) AS BIGINT) AS pct, CASE WHEN pct > 1 THEN 'up' WHEN pct < -1 THEN 'down' WHEN pct IS NOT NULL THEN 'flat' END AS direction FROM q",
    "top_paid": f"WITH e AS (SELECT *, coalesce(principal_position, '') AS p, max(year) OVER (PARTITION BY filing_id) AS last FROM {_EXECS}), r AS (SELECT *, CAST({_ROLE} AS BIGINT) AS role FROM e WHERE year = last), o AS (SELECT *, row_number() OVER (PARTITION BY filing_id ORDER BY role, total DESC NULLS LAST, executive_name, id) AS place FROM r) SELECT filing_id, place, executive_name, role, total FROM o WHERE place <= 6",
    "facts_wide": "WITH m AS (SELECT filing_id, metric_name_normalized AS n, arg_max(coalesce(observed_value, 'Disclosed'), (updated_at, id)) AS v FROM metric_facts WHERE metric_name_normalized IN (" + ", ".join(f"'{n}'" for n in _WIDE) + ") GROUP BY 1, 2) SELECT filing_id, " + ", ".join(f"coalesce(max(v) FILTER (n = '{n}'), 'Not extracted') AS {n}" for n in _WIDE) + " FROM m GROUP BY filing_id",
    "status_histogram": " UNION ALL ".join(f"SELECT '{n}' AS artifact, count(*) FILTER (coalesce(review_status, 'unreviewed') = 'unreviewed') AS unreviewed, count(*) FILTER (review_status = 'reviewed') AS reviewed, count(*) FILTER (review_status = 'flagged') AS flagged, count(*) AS all_rows FROM (SELECT DISTINCT id, review_status FROM {n})" for n in ("sections", "peer_groups", "exec_comp_rows")),
    "filing_rollup": f"WITH r AS (SELECT f.id AS filing_id, coalesce(s.n, 0) AS sections, coalesce(s.v, '') AS versions, coalesce(g.n, 0) AS groups, CAST(coalesce(g.m, 0) AS BIGINT) AS members FROM {_FILINGS} f LEFT JOIN (SELECT filing_id, count(DISTINCT id) AS n, array_to_string(list_sort(list(DISTINCT extractor_version) FILTER (extractor_version IS NOT NULL)), ',') AS v FROM sections GROUP BY 1) s ON s.filing_id = f.id LEFT JOIN (SELECT filing_id, count(DISTINCT id) AS n, sum(len(members)) AS m FROM peer_groups GROUP BY 1) g ON g.filing_id = f.id) SELECT *, concat_ws(',', CASE WHEN sections = 0 THEN 'no_sections' END, CASE WHEN groups = 0 THEN 'no_groups' END, CASE WHEN members = 0 THEN 'no_members' END) AS issues FROM r",
    "section_text": "SELECT filing_id, section_type, count(*) AS n, md5(string_agg(text, chr(10) || chr(10) ORDER BY id)) AS digest FROM sections WHERE coalesce(text, '') <> '' GROUP BY 1, 2",
    "dedupe_forms": f"WITH e AS (SELECT *, lower(trim(regexp_replace(executive_name, '\\s*(?:{'|'.join(X.TITLES)})\\s*$', '', 'i'))) AS who FROM {_EXECS}) SELECT filing_id, who, CAST(year AS BIGINT) AS year, min(id) AS first_id, max(id) AS last_id, arg_max(id, (coalesce(total, -1), -id)) AS largest_id FROM e GROUP BY ALL",
    "best_fact": "SELECT filing_id, metric_category, arg_max(id, (coalesce(CAST(confidence_score AS DOUBLE), 0), observed_value IS NOT NULL, -length(coalesce(source_excerpt, '')), -id)) AS id FROM metric_facts WHERE metric_category IS NOT NULL GROUP BY 1, 2",
    "nested_counts": "SELECT id, len(members) AS members, len(list_filter(members, lambda m: m.ticker_resolved IS NOT NULL)) AS resolved FROM peer_groups",
    "pages": "SELECT id, CAST(60 AS BIGINT) AS next_offset FROM companies ORDER BY id LIMIT 20 OFFSET 40",
    "chunks": f"SELECT id, company_id, CAST(floor((row_number() OVER (PARTITION BY company_id ORDER BY filing_date, id) - 1) / 4) AS BIGINT) AS chunk FROM {_FILINGS}",
    "first_peers": f"WITH r AS (SELECT f.company_id, lower(m.ticker_resolved) AS peer, min(m.id) AS id FROM peer_group_members m JOIN peer_groups g ON g.id = m.peer_group_id AND {_SHOWN.replace('review_status', 'g.review_status').replace('verification_status', 'g.verification_status')} JOIN {_RANKED} f ON f.id = g.filing_id AND f.rank = 1 WHERE m.ticker_resolved IS NOT NULL AND lower(m.ticker_resolved) <> f.company_id GROUP BY 1, 2), o AS (SELECT *, row_number() OVER (PARTITION BY company_id ORDER BY id) AS place FROM r) SELECT company_id, place, peer FROM o WHERE place <= 4",
    "ticker_search": "WITH u AS (SELECT *, replace(ticker_lower, '.', '-') AS t, name_lower AS n FROM ticker_universe), w AS (SELECT *, CASE WHEN starts_with(n, 'bel') THEN 0 ELSE nullif(list_min(list_filter([instr(n, ' bel'), instr(n, '&bel'), instr(n, '/bel'), instr(n, '-bel')], lambda x: x > 0)), 0) - 1 END AS pos FROM u), s AS (SELECT ticker, name, CASE WHEN t = 'bel' THEN 1000 WHEN starts_with(t, 'bel') THEN 900 - (length(t) - 3) WHEN pos IS NOT NULL THEN 700 - least(pos, 200) WHEN instr(n, 'bel') > 0 THEN 500 - least(instr(n, 'bel') - 1, 200) WHEN contains(t, 'bel') THEN 400 END AS score, CASE WHEN ticker_lower IN (SELECT lower(ticker) FROM companies WHERE ticker IS NOT NULL) THEN 1 ELSE 0 END AS in_db FROM w) SELECT ticker, name, CAST(score AS BIGINT) AS score, CAST(in_db AS BIGINT) AS in_db FROM s WHERE score IS NOT NULL ORDER BY score DESC, in_db DESC, name, ticker LIMIT 10",
    "compare_matrix": f"WITH r AS (SELECT c.id AS company_id, c.name, c.ticker, c.sector, CAST(f.filing_year AS VARCHAR) AS year, f.form_type FROM companies c LEFT JOIN {_RANKED} f ON f.company_id = c.id AND f.rank = 1) " + " UNION ALL ".join(f"SELECT company_id, CAST({i} AS BIGINT) AS axis_no, '{a}' AS axis, {_cell_sql(f'coalesce({a}, chr(8212))')} AS cell FROM r" for i, a in enumerate(("name", "ticker", "sector", "year", "form_type"))),
    "exec_csv": "SELECT DISTINCT id, " + " || ',' || ".join(_cell_sql(c) for c in ("executive_name", "principal_position", "salary", "total")) + " AS line FROM exec_comp_rows",
    "scaled_values": f"WITH v AS (SELECT DISTINCT observed_value FROM metric_facts WHERE observed_value IS NOT NULL), x AS (SELECT observed_value, {_SCALED} AS m, {num_sql('observed_value')} AS p FROM v) SELECT observed_value, TRY_CAST(nullif(m.d, '') AS DOUBLE) * CASE lower(m.s) WHEN 'billion' THEN 1e9::DOUBLE WHEN 'million' THEN 1e6::DOUBLE WHEN 'trillion' THEN 1e12::DOUBLE ELSE 1.0::DOUBLE END AS scaled, p AS plain, CASE WHEN regexp_matches(observed_value, 'percentile', 'i') THEN 'percentile' WHEN starts_with(observed_value, '$') THEN 'currency' WHEN contains(observed_value, '%') THEN 'percent' ELSE 'other' END AS kind FROM x",
    "canonical_digest": f"SELECT doc_id, sha256(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS digest, length(trim(regexp_replace(text, '{_WS}', ' ', 'g'))) AS chars FROM documents WHERE text IS NOT NULL",
    "client_hashes": "SELECT CASE WHEN user_id IS NULL THEN 'anon' ELSE substr(sha256('salt|' || CAST(user_id AS VARCHAR)), 1, 24) END AS client, count(*) AS events FROM events GROUP BY 1",
    "submissions_to_rows": f"SELECT company_id, id AS accession, form_type AS form, row_number() OVER (PARTITION BY company_id ORDER BY filing_date DESC, id DESC) AS place FROM {_FILINGS} WHERE form_type IN ('DEF 14A', 'DEF 14C')",
    "filing_urls": f"SELECT f.id, '/archive/' || ltrim(c.cik, '0') || '/' || replace(f.id, '-', '') AS url, lpad(c.cik, 10, '0') AS padded FROM {_FILINGS} f JOIN companies c ON c.id = f.company_id",
}
