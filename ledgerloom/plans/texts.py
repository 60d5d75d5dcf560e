"""Search, facts and entities in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import text as T
from ledgerloom.operators import aliases, html, rules, runs
from ledgerloom.plans.diffs import sentences_sql
from ledgerloom.plans.reads import _FILINGS, _SHOWN, _key_sql, filings_of
from ledgerloom.sources.tables import table


def text_search(spark: SparkSession, folder: str, query: str = "succession plan", cap: int = 30) -> DataFrame:
    """The first hits of a phrase in order of filer, date, section and place, with snippets."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id", "filing_date")
    s = table(spark, folder, "sections").where(F.contains(F.lower("text"), F.lit(query.lower()))).select("id", "filing_id", "section_type", "text")
    hits = s.select("*", F.explode(T.offsets(F.col("text"), query)).alias("at")).join(f, "filing_id")
    top = hits.orderBy("company_id", F.desc("filing_date"), "filing_id", "id", "at").limit(cap)
    return top.select("company_id", "filing_id", F.col("id").alias("section_id"), F.col("at").cast("long").alias("char_offset"), T.snippet(F.col("text"), F.col("at"), len(query)).alias("snippet"))


def search_counts(spark: SparkSession, folder: str, query: str = "vesting") -> DataFrame:
    """Hits of a word per filer and section type over all sections."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id")
    s = table(spark, folder, "sections").select("filing_id", "section_type", F.size(T.offsets(F.coalesce("text", F.lit("")), query)).alias("hits"))
    return s.join(f, "filing_id").groupBy("company_id", "section_type").agg(F.sum("hits").alias("hits"))


def highlight_parts(spark: SparkSession, folder: str, query: str = "award") -> DataFrame:
    """Each section as parts that match a word and parts that do not: how many of either."""
    s = table(spark, folder, "sections").where("text IS NOT NULL")
    parts = F.split(F.lower("text"), "\\Q" + query + "\\E")
    return s.select("id", (F.size(parts) - 1).cast("long").alias("matching"), F.size(F.filter(parts, lambda p: p != "")).cast("long").alias("other"))


def sentence_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences per section and the length of the longest."""
    s = table(spark, folder, "sections").where("text IS NOT NULL")
    sizes = s.select("id", F.transform(T.sentences(F.col("text")), lambda x: F.length(x)).alias("n"))
    return sizes.select("id", F.size("n").cast("long").alias("sentences"), F.coalesce(F.array_max("n"), F.lit(0)).cast("long").alias("longest"))


def section_openers(spark: SparkSession, folder: str, chars: int = 1200) -> DataFrame:
    """The opening of each discussion section, and how many blocks it has."""
    s = table(spark, folder, "sections").where("section_type = 'cd_and_a' AND text IS NOT NULL")
    blocks = F.filter(F.transform(F.split("text", "\n\n"), lambda b: F.trim(b)), lambda b: b != "")
    return s.select("id", F.substring("text", 1, chars).alias("opener"), F.size(blocks).cast("long").alias("blocks"))


def policy_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Sections that name each policy."""
    s = table(spark, folder, "sections").where("text IS NOT NULL").select("text")
    tests = [F.count_if(F.lower("text").rlike(w)).alias(n) for n, w in (("hedging", "hedging"), ("clawback", "clawback|recoupment"), ("consultant", "independent consultant"), ("change_in_control", "change[ -](in|of)[ -]control"))]
    return s.agg(*tests)


def policies_of(sections: DataFrame) -> DataFrame:
    """Policies found in section texts, the main section first: one row per filing and policy."""
    found = rules.candidates(sections, rules.POLICIES).withColumn("value", rules.policy_value(F.col("rule"), F.col("excerpt")))
    scored = found.withColumn("score", rules.score(rules.POLICIES, F.col("rule"), F.col("excerpt"), F.col("value")))
    return rules.cascade(rules.best(scored, ("filing_id", "section_id")), sections)


def metrics_of(sections: DataFrame) -> DataFrame:
    """Metrics found in section texts, the main section first: one row per filing and metric."""
    found = rules.candidates(sections, rules.METRICS).withColumn("value", rules.metric_value(F.col("rule"), F.col("value")))
    scored = found.withColumn("score", rules.metric_score(F.col("rule"), F.col("excerpt"), F.col("value"), F.col("points")))
    best = rules.best(scored, ("filing_id", "section_id"))
    return rules.cascade(best.where(rules.kept(rules.METRICS, F.col("rule"), F.col("excerpt"), F.col("value"))), sections)


def policy_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Policies of each filing."""
    return policies_of(table(spark, folder, "sections"))


def policy_matches(spark: SparkSession, folder: str) -> DataFrame:
    """How often each filing's sections, with their headings, hold the anchor of each policy."""
    found = rules.candidates(table(spark, folder, "sections"), rules.POLICIES)
    return found.groupBy("filing_id", F.col("rule").alias("policy")).agg(F.count(F.lit(1)).alias("matches"))


def metric_facts_found(spark: SparkSession, folder: str) -> DataFrame:
    """Metrics of each filing."""
    return metrics_of(table(spark, folder, "sections"))


def alias_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """List entries named in section texts by full or suffix-stripped name of two words or more: first place and confidence. `company_mentions` has every kind of alias.

    Only words that begin an alias meet the aliases, in a hash join; the rest of the name is compared where they do.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))
    u = table(spark, folder, "ticker_universe")
    forms = F.array(F.struct(clean(F.col("name")).alias("text"), F.lit(0.99).alias("confidence")), F.struct(X.company_key(F.col("name")).alias("text"), F.lit(0.96).alias("confidence")))
    alias = u.select("ticker", F.inline(forms)).where(F.size(F.split("text", " ")) >= 2).groupBy("text", "ticker").agg(F.max("confidence").alias("confidence"))
    alias = alias.select(F.split("text", " ").alias("name"), "ticker", "confidence").withColumn("first", F.get("name", 0))
    s = table(spark, folder, "sections").where("text IS NOT NULL").select("id", T.words(F.col("text")).alias("ws"))
    # the list of companies is of fixed size; so the words of a text stay where they are, and only hits are compared further
    begun = s.select("id", "ws", F.posexplode("ws").alias("place", "first")).join(F.broadcast(alias), "first")
    hits = begun.where(F.slice("ws", F.col("place") + 1, F.size("name")) == F.col("name"))
    return hits.groupBy(F.col("id").alias("section_id"), "ticker").agg((F.min("place") + 1).cast("long").alias("place"), F.max("confidence").cast("double").alias("confidence"))


def company_mentions(spark: SparkSession, folder: str) -> DataFrame:
    """Listed companies named in section texts by any kind of alias, none within the place of another."""
    s = table(spark, folder, "sections").where("text IS NOT NULL").select(F.col("id").alias("section_id"), "text")
    return aliases.mentions(s, "section_id", "text", table(spark, folder, "ticker_universe"))


def event_runs(spark: SparkSession, folder: str, gap_s: int = 600, least: int = 3) -> DataFrame:
    """Runs of a user's events without a gap of more than ten minutes, at least three long."""
    e = table(spark, folder, "events").select("user_id", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    found = runs.runs(e, ["user_id"], "at", "at", gap_s * 1_000_000, least, ["event_id"])
    return found.groupBy("user_id", "run").agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"))


def purchase_after_signup(spark: SparkSession, folder: str) -> DataFrame:
    """For each event of type purchase the user's last signup at or before it, within one day."""
    e = table(spark, folder, "events").select("user_id", "event_id", "event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    marks = e.where("event_type = 'signup'").select("user_id", F.col("at").alias("mark"))
    rows = runs.last_before(e.where("event_type = 'purchase'"), marks, ["user_id"], "at", "mark", 86_400_000_000)
    return rows.select("event_id", F.col("last_mark").alias("signup_at"))


def name_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Distinct member names beside the list entry of the same compared name."""
    u = table(spark, folder, "ticker_universe").select(X.company_key(F.col("name")).alias("key"), "ticker").where("key <> ''").groupBy("key").agg(F.min("ticker").alias("ticker"))
    m = table(spark, folder, "peer_group_members").select("company_name_raw").distinct()
    return m.withColumn("key", X.company_key(F.col("company_name_raw"))).join(u, "key", "left").select("company_name_raw", "key", "ticker")


def quality_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Groups with members whose symbol is not listed, with these symbols, and the state they get."""
    u = table(spark, folder, "ticker_universe").select(F.col("ticker").alias("ticker_resolved"))
    m = table(spark, folder, "peer_group_members").where("ticker_resolved IS NOT NULL").select("peer_group_id", "ticker_resolved").distinct()
    odd = m.join(u, "ticker_resolved", "left_anti").groupBy("peer_group_id").agg(F.array_join(F.array_sort(F.collect_set("ticker_resolved")), ",").alias("suspects"))
    g = table(spark, folder, "peer_groups").select(F.col("id").alias("peer_group_id"), "review_status", "verification_status")
    flagged = F.col("suspects").isNotNull()
    return g.join(odd, "peer_group_id", "left").select("peer_group_id", F.coalesce("suspects", F.lit("")).alias("suspects"), F.when(flagged, "flagged").otherwise(F.col("review_status")).alias("review_status"), F.when(flagged, "rejected").otherwise(F.col("verification_status")).alias("verification_status"))


def group_overlaps(spark: SparkSession, folder: str) -> DataFrame:
    """Groups of one filing compared in pairs: overlap, superset and similarity of their resolved members."""
    g = table(spark, folder, "peer_groups").select("id", "filing_id", F.array_distinct(F.filter(F.transform("members.company_id_resolved", lambda m: F.lower(F.trim(m))), lambda m: m != "")).alias("ids"))
    a, b = g.select("filing_id", F.col("id").alias("a"), F.col("ids").alias("x")), g.select("filing_id", F.col("id").alias("b"), F.col("ids").alias("y"))
    p = a.join(b, "filing_id").where("a < b AND size(x) > 0 AND size(y) > 0")
    common, every = F.size(F.array_intersect("x", "y")), F.size(F.array_union("x", "y"))
    milli = lambda c: F.floor(c * 1000 + 0.5).cast("long")
    return p.select("a", "b", milli(common / F.greatest(F.size("x"), F.size("y"))).alias("overlap"), milli(common / every).alias("jaccard"), (F.size(F.array_except("y", "x")) == 0).alias("contains_b"))


def without_self(spark: SparkSession, folder: str) -> DataFrame:
    """Groups without the filer itself among the members; groups left empty are gone."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"), "company_id")
    g = table(spark, folder, "peer_groups").select("id", "filing_id", F.col("members.company_id_resolved").alias("ids")).join(f, "filing_id")
    kept = g.select("id", F.filter("ids", lambda m: m.isNull() | (F.lower(F.trim(m)) != F.col("company_id"))).alias("ids"))
    return kept.select("id", F.size("ids").cast("long").alias("members")).where("members > 0")


def panel_verdicts(spark: SparkSession, folder: str) -> DataFrame:
    """Each filing's peer panel as clean, partially or fully polluted, empty or absent."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"))
    u = table(spark, folder, "ticker_universe").select(F.col("ticker").alias("t"), F.lit(True).alias("known"))
    g = table(spark, folder, "peer_groups").where(X.hide_flagged(F.col("review_status"), F.col("verification_status")))
    rows = g.select("filing_id", F.explode_outer("members.ticker_resolved").alias("t")).join(u, "t", "left")
    counts = rows.groupBy("filing_id").agg(F.count("t").alias("named"), F.count_if(F.col("t").isNotNull() & F.col("known").isNull()).alias("odd"))
    n, odd = F.col("named"), F.col("odd")
    verdict = F.when(n.isNull(), "no-panel").when(n == 0, "empty").when(odd == 0, "clean").when(odd == n, "fully-polluted").otherwise("partially-polluted")
    return f.join(counts, "filing_id", "left").select("filing_id", verdict.alias("verdict"))


def catalog_reconcile(spark: SparkSession, folder: str) -> DataFrame:
    """Symbols of the two copies of group members, flat and nested: which are in both, and which in one alone."""
    flat = table(spark, folder, "peer_group_members").where("ticker_resolved IS NOT NULL").select("peer_group_id", F.col("ticker_resolved").alias("t")).distinct().withColumn("a", F.lit(1))
    nested = table(spark, folder, "peer_groups").select(F.col("id").alias("peer_group_id"), F.explode("members.ticker_resolved").alias("t")).where("t IS NOT NULL").distinct().withColumn("b", F.lit(1))
    j = flat.join(nested, ["peer_group_id", "t"], "full_outer")
    return j.groupBy(F.when(F.col("b").isNull(), "flat only").when(F.col("a").isNull(), "nested only").otherwise("both").alias("status")).agg(F.count(F.lit(1)).alias("n"))


def tag_histogram(spark: SparkSession, folder: str) -> DataFrame:
    """How often each tag opens in the fragments."""
    s = table(spark, folder, "sections").where("html_fragment IS NOT NULL")
    tags = s.select(F.explode(F.regexp_extract_all(F.lower("html_fragment"), F.lit("<([a-z][a-z0-9]*)"), F.lit(1))).alias("tag"))
    return tags.groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


def fragment_text(spark: SparkSession, folder: str) -> DataFrame:
    """Text of the fragments without markup."""
    s = table(spark, folder, "sections").where("html_fragment IS NOT NULL")
    return s.select("id", X.html_text(F.col("html_fragment")).alias("plain"))


def fragment_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """Block nodes of the fragments, counted per section and tag."""
    s = table(spark, folder, "sections").where("html_fragment IS NOT NULL").select("id", F.col("html_fragment").alias("html"))
    return html.nodes(s, "id", "html").groupBy("id", "tag").agg(F.count(F.lit(1)).alias("nodes"))


def heading_types(spark: SparkSession, folder: str) -> DataFrame:
    """Headings read as kinds of section, against the kinds they are stored under."""
    h = X.collapse(F.lower(F.regexp_replace(F.coalesce("heading", F.lit("")), r"\p{Cf}", "")))
    kind = F.lit("other")
    for k in reversed(html.KINDS):
        kind = F.when(h.rlike(k.heading) & ~h.rlike(k.never), k.name).otherwise(kind)
    return table(spark, folder, "sections").groupBy("section_type", kind.alias("heading_type")).agg(F.count(F.lit(1)).alias("sections"))


def grep_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of documents that state an amount in dollars, with their numbers."""
    d = table(spark, folder, "documents").where("text IS NOT NULL")
    rows = d.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.where(F.col("line").rlike("\\$[0-9]")).select("doc_id", (F.col("i") + 1).cast("long").alias("line_no"), F.length("line").cast("long").alias("chars"))


QUERIES = {
    f.__name__: f
    for f in (text_search, search_counts, highlight_parts, sentence_counts, section_openers, policy_mentions, policy_facts, policy_matches, metric_facts_found, alias_mentions, company_mentions, event_runs, purchase_after_signup, name_matches, quality_gate, group_overlaps, without_self, panel_verdicts, catalog_reconcile, tag_histogram, fragment_text, fragment_nodes, heading_types, grep_lines)
}

_HEAD = "trim(regexp_replace(lower(regexp_replace(coalesce(heading, ''), '\\p{Cf}', '', 'g')), '[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g'))"
_KINDS = "CASE " + " ".join(f"WHEN regexp_matches(h, '{k.heading}') AND NOT regexp_matches(h, '{k.never}') THEN '{k.name}'" for k in html.KINDS) + " ELSE 'other' END"

_Q = "succession plan"
_CLEAN = "trim(regexp_replace(lower({0}), '[^a-z0-9]+', ' ', 'g'))"
_WS_LIST = "list_filter(string_split(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"

ORACLES = {
    "policy_matches": "SELECT * FROM (" + " UNION ALL ".join(f"SELECT filing_id, '{r.name}' AS policy, CAST(sum(len(regexp_extract_all(CASE WHEN coalesce(heading, '') <> '' THEN heading || chr(10) || chr(10) ELSE '' END || text, '(?i){r.anchor}'))) AS BIGINT) AS matches FROM sections WHERE text <> '' GROUP BY 1" for r in rules.POLICIES) + ") WHERE matches > 0",
    "text_search": f"""WITH s AS (SELECT x.id, x.filing_id, x.text, string_split(lower(x.text), '{_Q}') AS p FROM sections x WHERE contains(lower(x.text), '{_Q}')),
k AS (SELECT *, unnest(range(1, len(p))) AS k FROM s), h AS (SELECT k.*, f.company_id, f.filing_date, CAST(list_sum(list_transform(p[1:k], lambda z: length(z))) + (k - 1) * {len(_Q)} AS BIGINT) AS at_ FROM k JOIN {_FILINGS} f ON f.id = k.filing_id),
t AS (SELECT * FROM h ORDER BY company_id, filing_date DESC, filing_id, id, at_ LIMIT 30), b AS (SELECT *, greatest(at_ - 140, 0) AS lo, least(at_ + {len(_Q)} + 140, length(text)) AS hi FROM t)
SELECT company_id, filing_id, id AS section_id, at_ AS char_offset, (CASE WHEN lo > 0 THEN '…' ELSE '' END) || trim(regexp_replace(substr(text, CAST(lo + 1 AS BIGINT), CAST(hi - lo AS BIGINT)), '[\\t-\\r \\x{{A0}}]+', ' ', 'g')) || (CASE WHEN hi < length(text) THEN '…' ELSE '' END) AS snippet FROM b""",
    "search_counts": f"SELECT f.company_id, s.section_type, CAST(sum(len(string_split(lower(coalesce(s.text, '')), 'vesting')) - 1) AS BIGINT) AS hits FROM sections s JOIN {_FILINGS} f ON f.id = s.filing_id GROUP BY 1, 2",
    "highlight_parts": "SELECT id, len(string_split(lower(text), 'award')) - 1 AS matching, len(list_filter(string_split(lower(text), 'award'), lambda p: p <> '')) AS other FROM sections WHERE text IS NOT NULL",
    "sentence_counts": f"SELECT id, len(x) AS sentences, coalesce(list_max(list_transform(x, lambda s: length(s))), 0) AS longest FROM (SELECT id, {sentences_sql('text')} AS x FROM sections WHERE text IS NOT NULL)",
    "section_openers": "SELECT id, substr(text, 1, 1200) AS opener, len(list_filter(list_transform(string_split(text, chr(10) || chr(10)), lambda b: trim(b)), lambda b: b <> '')) AS blocks FROM sections WHERE section_type = 'cd_and_a' AND text IS NOT NULL",
    "policy_mentions": "SELECT count(*) FILTER (regexp_matches(lower(text), 'hedging')) AS hedging, count(*) FILTER (regexp_matches(lower(text), 'clawback|recoupment')) AS clawback, count(*) FILTER (regexp_matches(lower(text), 'independent consultant')) AS consultant, count(*) FILTER (regexp_matches(lower(text), 'change[ -](in|of)[ -]control')) AS change_in_control FROM sections WHERE text IS NOT NULL",
    "alias_mentions": f"""WITH u AS (SELECT ticker, {_CLEAN.format('name')} AS text, 0.99::DOUBLE AS confidence FROM ticker_universe UNION ALL SELECT ticker, {_key_sql('name')}, 0.96::DOUBLE FROM ticker_universe), a AS (SELECT text, ticker, max(confidence) AS confidence FROM u WHERE len(string_split(text, ' ')) >= 2 GROUP BY 1, 2),
w AS (SELECT id, {_WS_LIST} AS ws FROM sections WHERE text IS NOT NULL), g AS (SELECT id, n, i, array_to_string(ws[i:i + n - 1], ' ') AS text FROM (SELECT id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, (SELECT unnest([2, 3, 4, 5, 6]) AS n)))
SELECT g.id AS section_id, a.ticker, min(g.i) AS place, max(a.confidence) AS confidence FROM g JOIN a ON a.text = g.text GROUP BY 1, 2""",
    "event_runs": "WITH e AS (SELECT user_id, event_id, epoch_us(ts) AS a FROM events), l AS (SELECT *, a - lag(a) OVER (PARTITION BY user_id ORDER BY a, event_id) > 600000000 AS fresh FROM e), r AS (SELECT *, CAST(sum(coalesce(CAST(fresh AS INT), 0)) OVER (PARTITION BY user_id ORDER BY a, event_id) AS BIGINT) AS run FROM l) SELECT user_id, run, count(*) AS events, min(event_id) AS first_event FROM r GROUP BY 1, 2 HAVING count(*) >= 3",
    "purchase_after_signup": "SELECT p.event_id, max(epoch_us(s.ts)) AS signup_at FROM events p LEFT JOIN events s ON s.user_id = p.user_id AND s.event_type = 'signup' AND s.ts <= p.ts AND epoch_us(p.ts) - epoch_us(s.ts) < 86400000000 WHERE p.event_type = 'purchase' GROUP BY p.event_id",
    "name_matches": f"SELECT m.company_name_raw, m.key, u.ticker FROM (SELECT DISTINCT company_name_raw, {_key_sql('company_name_raw')} AS key FROM peer_group_members) m LEFT JOIN (SELECT {_key_sql('name')} AS key, min(ticker) AS ticker FROM ticker_universe GROUP BY 1) u ON u.key = m.key AND u.key <> ''",
    "quality_gate": "WITH o AS (SELECT peer_group_id, array_to_string(list_sort(list(DISTINCT ticker_resolved)), ',') AS s FROM peer_group_members WHERE ticker_resolved IS NOT NULL AND ticker_resolved NOT IN (SELECT ticker FROM ticker_universe) GROUP BY 1) SELECT g.id AS peer_group_id, coalesce(o.s, '') AS suspects, CASE WHEN o.s IS NOT NULL THEN 'flagged' ELSE g.review_status END AS review_status, CASE WHEN o.s IS NOT NULL THEN 'rejected' ELSE g.verification_status END AS verification_status FROM peer_groups g LEFT JOIN o ON o.peer_group_id = g.id",
    "group_overlaps": "WITH g AS (SELECT id, filing_id, list_distinct(list_filter(list_transform(members, lambda m: lower(trim(m.company_id_resolved))), lambda x: x <> '')) AS ids FROM peer_groups), p AS (SELECT a.id AS a, b.id AS b, a.ids AS x, b.ids AS y, len(list_intersect(a.ids, b.ids)) AS c FROM g a JOIN g b ON a.filing_id = b.filing_id AND a.id < b.id WHERE len(a.ids) > 0 AND len(b.ids) > 0) SELECT a, b, CAST(floor(c / greatest(len(x), len(y)) * 1000 + 0.5) AS BIGINT) AS overlap, CAST(floor(c / (len(x) + len(y) - c) * 1000 + 0.5) AS BIGINT) AS jaccard, c = len(y) AS contains_b FROM p",
    "without_self": f"WITH g AS (SELECT g.id, len(list_filter(g.members, lambda m: m.company_id_resolved IS NULL OR lower(trim(m.company_id_resolved)) <> f.company_id)) AS members FROM peer_groups g JOIN {_FILINGS} f ON f.id = g.filing_id) SELECT id, members FROM g WHERE members > 0",
    "panel_verdicts": f"WITH r AS (SELECT filing_id, unnest(CASE WHEN len(members) = 0 THEN [NULL] ELSE list_transform(members, lambda m: m.ticker_resolved) END) AS t FROM peer_groups WHERE {_SHOWN}), c AS (SELECT filing_id, count(t) AS n, count(*) FILTER (t IS NOT NULL AND t NOT IN (SELECT ticker FROM ticker_universe)) AS odd FROM r GROUP BY 1) SELECT f.id AS filing_id, CASE WHEN c.n IS NULL THEN 'no-panel' WHEN c.n = 0 THEN 'empty' WHEN c.odd = 0 THEN 'clean' WHEN c.odd = c.n THEN 'fully-polluted' ELSE 'partially-polluted' END AS verdict FROM {_FILINGS} f LEFT JOIN c ON c.filing_id = f.id",
    "catalog_reconcile": "WITH a AS (SELECT DISTINCT peer_group_id, ticker_resolved AS t FROM peer_group_members WHERE ticker_resolved IS NOT NULL), b AS (SELECT DISTINCT id AS peer_group_id, m.ticker_resolved AS t FROM (SELECT id, unnest(members) AS m FROM peer_groups) WHERE m.ticker_resolved IS NOT NULL) SELECT CASE WHEN b.t IS NULL THEN 'flat only' WHEN a.t IS NULL THEN 'nested only' ELSE 'both' END AS status, count(*) AS n FROM a FULL JOIN b ON a.peer_group_id = b.peer_group_id AND a.t = b.t GROUP BY 1",
    "tag_histogram": "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html_fragment), '<([a-z][a-z0-9]*)', 1)) AS tag FROM sections WHERE html_fragment IS NOT NULL) GROUP BY 1",
    "fragment_text": "SELECT id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(html_fragment, '<[^>]*>', ' ', 'g'), '&nbsp;', ' '), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&amp;', '&'), '[\\t-\\r \\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}\\x{FEFF}]+', ' ', 'g')) AS plain FROM sections WHERE html_fragment IS NOT NULL",
    "heading_types": f"SELECT section_type, {_KINDS} AS heading_type, count(*) AS sections FROM (SELECT section_type, {_HEAD} AS h FROM sections) GROUP BY 1, 2",
    "grep_lines": "SELECT doc_id, CAST(i AS BIGINT) AS line_no, length(l[i]) AS chars FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)) WHERE regexp_matches(l[i], '\\$[0-9]')",
}
