"""Year-over-year differences between a filer's latest filing and the one before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.functions import text as T
from ledgerloom.operators import sequential
from ledgerloom.plans.reads import _EXECS, _RANKED, _key_sql, exec_rows, ranked_filings
from ledgerloom.sources.tables import table


def _pairs(spark: SparkSession, folder: str) -> DataFrame:
    """``filing_id, company_id, side`` of the two latest filings of filers that have two."""
    two = ranked_filings(spark, folder).withColumn("n", F.count(F.lit(1)).over(W.partitionBy("company_id"))).where("rank <= 2 AND n > 1")
    return two.select(F.col("id").alias("filing_id"), "company_id", F.when(F.col("rank") == 1, "new").otherwise("old").alias("side"))


_PAIRS = f"(SELECT id AS filing_id, company_id, CASE WHEN rank = 1 THEN 'new' ELSE 'old' END AS side FROM {_RANKED} WHERE rank <= 2 AND company_id IN (SELECT company_id FROM {_RANKED} WHERE rank = 2))"


def _sides(df: DataFrame, keys: list[str]) -> DataFrame:
    """Full outer join of the old and new rows of ``df(side, keys..., v)`` as ``old`` and ``new``."""
    old, new = (df.where(F.col("side") == s).select(*keys, F.col("v").alias(s)) for s in ("old", "new"))
    return old.join(new, keys, "full_outer")


def _status(same: Column) -> Column:
    return F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(same, "unchanged").otherwise("changed")


def exec_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Executives of both filings by cleaned name, with the change of their total; the latest year of each side counts."""
    e = exec_rows(spark, folder).join(_pairs(spark, folder), "filing_id")
    e = e.withColumn("who", F.lower(X.display_name(F.col("executive_name"))))
    last = e.groupBy("company_id", "who", "side").agg(F.max_by(F.struct("total", "year"), F.struct("year", -F.col("id"))).alias("v"))
    j = _sides(last, ["company_id", "who"])
    rows = j.select("company_id", "who", F.col("old.total").alias("old_total"), F.col("new.total").alias("new_total"), _status(F.col("old.total").eqNullSafe(F.col("new.total"))).alias("status"))
    return rows.withColumn("delta", F.col("new_total") - F.col("old_total")).withColumn("pct", X.half_up(X.change_percent(F.col("new_total"), F.col("old_total"))).cast("long"))


def yoy_change_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Per filer how many executives came, went, changed or stayed, and by how much pay moved."""
    d = exec_diff(spark, folder)
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return d.groupBy("company_id").agg(n("added"), n("removed"), n("changed"), n("unchanged"), F.coalesce(F.sum("delta"), F.lit(0.0)).alias("net_delta"))


_EXEC_DIFF = f"""WITH e AS (SELECT x.*, p.company_id, p.side, lower(trim(regexp_replace(executive_name, '\\s*(?:{'|'.join(X.TITLES)})\\s*$', '', 'i'))) AS who FROM {_EXECS} x JOIN {_PAIRS} p ON p.filing_id = x.filing_id),
l AS (SELECT company_id, who, side, arg_max({{'t': total}}, (year, -id)) AS v FROM e GROUP BY ALL),
j AS (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.who, b.who) AS who, a.v.t AS old_total, b.v.t AS new_total, CASE WHEN a.who IS NULL THEN 'added' WHEN b.who IS NULL THEN 'removed' WHEN a.v.t IS NOT DISTINCT FROM b.v.t THEN 'unchanged' ELSE 'changed' END AS status
  FROM (SELECT * FROM l WHERE side = 'old') a FULL JOIN (SELECT * FROM l WHERE side = 'new') b ON a.company_id = b.company_id AND a.who = b.who),
d AS (SELECT *, new_total - old_total AS delta, CAST(floor(CASE WHEN old_total <> 0 THEN (new_total - old_total) / old_total * 100 END + 0.5) AS BIGINT) AS pct FROM j)"""


def metric_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Facts of both filings by name; the last row of a name counts. Values are compared as text, and as numbers where they are."""
    m = table(spark, folder, "metric_facts").join(_pairs(spark, folder), "filing_id")
    key = F.coalesce("metric_name_normalized", "metric_name_raw")
    m = m.withColumn("metric", key).where("metric IS NOT NULL")
    last = m.groupBy("company_id", "metric", "side").agg(F.max_by(F.struct(F.col("observed_value").alias("value")), F.struct("updated_at", "id")).alias("v"))
    j = _sides(last, ["company_id", "metric"])
    same = F.coalesce("old.value", F.lit("")) == F.coalesce("new.value", F.lit(""))
    delta = X.scaled_number(F.col("new.value")) - X.scaled_number(F.col("old.value"))
    return j.select("company_id", "metric", _status(same).alias("status"), X.half_up(delta * 1000).cast("long").alias("delta_milli"))


def member_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Peers of both filings: how many rows are new, gone or kept. Rows count, not names."""
    g = table(spark, folder, "peer_groups").join(_pairs(spark, folder), "filing_id")
    key = lambda m: F.lower(F.coalesce(m["company_id_resolved"], m["company_name_raw"]))
    rows = g.select("company_id", "side", F.explode(F.transform("members", key)).alias("peer"))
    counts = rows.groupBy("company_id", "peer").pivot("side", ["old", "new"]).agg(F.count(F.lit(1))).fillna(0)
    return counts.groupBy("company_id").agg(
        F.sum(F.when(F.col("old") == 0, F.col("new")).otherwise(0)).alias("added"),
        F.sum(F.when(F.col("new") == 0, F.col("old")).otherwise(0)).alias("removed"),
        F.sum(F.when(F.col("old") > 0, F.col("new")).otherwise(0)).alias("kept"),
    )


def _texts(spark: SparkSession, folder: str) -> DataFrame:
    s = table(spark, folder, "sections").where(F.coalesce("text", F.lit("")) != "").join(_pairs(spark, folder), "filing_id")
    lists = s.groupBy("company_id", "section_type", "side").agg(F.array_sort(F.collect_list(F.struct("id", "text"))).alias("x"))
    return lists.select("company_id", "section_type", "side", F.array_join("x.text", "\n\n").alias("v"))


_TEXTS = f"(SELECT p.company_id, s.section_type, p.side, string_agg(s.text, chr(10) || chr(10) ORDER BY s.id) AS v FROM sections s JOIN {_PAIRS} p ON p.filing_id = s.filing_id WHERE coalesce(s.text, '') <> '' GROUP BY ALL)"


def section_similarity(spark: SparkSession, folder: str) -> DataFrame:
    """Similarity in percent of the texts of each section type in both filings; a missing text is empty."""
    j = _sides(_texts(spark, folder), ["company_id", "section_type"])
    split = j.select("company_id", "section_type", *[T.words(F.coalesce(s, F.lit(""))).alias(s) for s in ("old", "new")])
    pair = T.bound(F.struct("old", "new"), lambda p: T.similarity_percent(p["old"], p["new"]))
    return split.select("company_id", "section_type", pair.cast("long").alias("similarity"))


def sentence_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Sentences of both filings equal up to case and quotes, each occurrence paired once."""
    rows = _texts(spark, folder).select("company_id", "section_type", "side", F.explode(T.sentences(F.col("v"))).alias("s"))
    keyed = rows.groupBy("company_id", "section_type", T.sentence_key(F.col("s")).alias("k")).agg(F.count_if(F.col("side") == "old").alias("o"), F.count_if(F.col("side") == "new").alias("n"))
    return keyed.groupBy("company_id", "section_type").agg(F.sum(F.least("o", "n")).alias("unchanged"), F.sum(F.greatest(F.col("n") - F.col("o"), F.lit(0))).alias("fresh"), F.sum(F.greatest(F.col("o") - F.col("n"), F.lit(0))).alias("gone"))


def _sentence_ops(spark: SparkSession, folder: str) -> DataFrame:
    """Each sentence of both filings' section types as ``d``, a struct of ``op, old, new``, with its ``place`` in the diff."""
    j = _sides(_texts(spark, folder), ["company_id", "section_type"])
    parts = j.select("company_id", "section_type", *[T.sentences(F.coalesce(s, F.lit(""))).alias(s) for s in ("old", "new")])
    keys = [F.transform(s, T.sentence_key) for s in ("old", "new")]
    ops = sequential.sentence_diff_udf(keys[0], F.col("old"), keys[1], F.col("new"))
    return parts.select("company_id", "section_type", F.posexplode(ops).alias("place", "d"))


def sentence_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Sentence diff of each section type: unchanged, changed, added and removed sentences."""
    rows = _sentence_ops(spark, folder)
    return rows.groupBy("company_id", "section_type").agg(*[F.count_if(F.col("d.op") == o).alias(o) for o in ("unchanged", "changed", "added", "removed")])


def changed_words(spark: SparkSession, folder: str) -> DataFrame:
    """Word diff of each changed sentence of a section type in both filings, and of its headings joined in order of section: counts, and the pairs in order with their words."""
    s = table(spark, folder, "sections").where("heading IS NOT NULL").join(_pairs(spark, folder), "filing_id")
    lists = s.groupBy("company_id", "section_type", "side").agg(F.array_sort(F.collect_list(F.struct("id", "heading"))).alias("x"))
    heads = _sides(lists.select("company_id", "section_type", "side", F.array_join("x.heading", "\n").alias("v")), ["company_id", "section_type"]).where("old IS NOT NULL AND new IS NOT NULL")
    texts = _sentence_ops(spark, folder).where("d.op = 'changed'").select("company_id", "section_type", F.lit("text").alias("part"), "place", "d.old", "d.new")
    pairs = texts.unionByName(heads.select("company_id", "section_type", F.lit("heading").alias("part"), F.lit(0).alias("place"), "old", "new"))
    rows = pairs.withColumn("words", sequential.word_diff_udf("old", "new"))
    n = lambda k: F.sum(F.size(F.filter("words", lambda w: w["op"] == k))).alias(f"words_{k}")
    return rows.groupBy("company_id", "section_type", "part").agg(*[n(k) for k in ("same", "ins", "del")], F.array_sort(F.collect_list(F.struct("place", "old", "new", "words"))).alias("pairs"))


def group_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Peer groups of both filings matched one to one, with members added, removed and kept."""
    g = table(spark, folder, "peer_groups").join(_pairs(spark, folder), "filing_id")
    key = lambda m: F.lower(F.coalesce(m["company_id_resolved"], m["company_name_raw"]))
    return sequential.grouped_matches(g.select("company_id", "side", "id", F.col("peer_group_type").alias("type"), F.col("peer_group_name").alias("name"), F.transform("members", key).alias("members")))


def merged_lists(spark: SparkSession, folder: str) -> DataFrame:
    """Peer lists of a filing folded into distinct groups, methods of extraction in order."""
    g = table(spark, folder, "peer_groups")
    return sequential.merged_groups(g.select("filing_id", F.coalesce("extraction_method", F.lit("")).alias("path"), "id", F.col("members.company_id_resolved").alias("members")))


def prior_pay(spark: SparkSession, folder: str) -> DataFrame:
    """Each row of compensation beside the same person's latest earlier year in the filing."""
    e = exec_rows(spark, folder).withColumn("who", F.lower(X.display_name(F.col("executive_name"))))
    years = e.groupBy("filing_id", "who", "year").agg(F.max("total").alias("total"))
    w = W.partitionBy("filing_id", "who").orderBy("year")
    return years.select("filing_id", "who", F.col("year").cast("long").alias("year"), F.lag("total").over(w).alias("prior_total"), F.lag("year").over(w).cast("long").alias("prior_year"))


def peer_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    """Peers of latest filings that file themselves, by symbol, number or compared name, with their own latest year and number of facts."""
    latest = ranked_filings(spark, folder).where("rank = 1").select(F.col("id").alias("filing_id"), "company_id", "filing_year")
    g = table(spark, folder, "peer_groups").select(F.col("id").alias("peer_group_id"), "filing_id")
    keys = lambda symbol, number, name: F.explode(F.array_distinct(F.array(F.concat(F.lit("s:"), F.lower(F.trim(symbol))), F.concat(F.lit("n:"), F.trim(number)), F.concat(F.lit("k:"), F.nullif(X.company_key(name), F.lit(""))))))
    c = table(spark, folder, "companies").select(F.col("id").alias("peer_id"), "name", keys(F.col("ticker"), F.col("cik"), F.col("name")).alias("key")).where("key IS NOT NULL")
    m = table(spark, folder, "peer_group_members").select("peer_group_id", keys(F.coalesce("ticker_resolved", "company_id_resolved"), F.col("cik_resolved"), F.col("company_name_raw")).alias("key")).where("key IS NOT NULL")
    facts = table(spark, folder, "metric_facts").groupBy("filing_id").agg(F.count(F.lit(1)).alias("facts"))
    own = latest.select(F.col("company_id").alias("peer_id"), F.col("filing_year").cast("long").alias("peer_year"), "filing_id").join(facts, "filing_id", "left").drop("filing_id")
    rows = m.join(c, "key").join(g, "peer_group_id").join(latest.select("filing_id", "company_id"), "filing_id").where("peer_id <> company_id").select("company_id", "peer_id", "name").distinct()
    return rows.join(own, "peer_id", "left").select("company_id", "peer_id", "name", "peer_year", F.coalesce("facts", F.lit(0)).alias("facts"))


QUERIES = {f.__name__: f for f in (yoy_change_summary, exec_diff, metric_diff, member_diff, section_similarity, sentence_matches, sentence_diff, changed_words, group_matches, merged_lists, prior_pay, peer_snapshot)}

_SCALE = lambda c: f"(CASE WHEN x.{c} IS NULL THEN NULL ELSE TRY_CAST(nullif(regexp_extract(trim(regexp_replace(x.{c}, '[,$]', '', 'g')), '^([+-]?[0-9]+(?:\\.[0-9]+)?)\\s*(?:billion|million|trillion)?(?:[^A-Za-z0-9_]|$)', 1, 'i'), '') AS DOUBLE) * CASE lower(regexp_extract(trim(regexp_replace(x.{c}, '[,$]', '', 'g')), '^[+-]?[0-9]+(?:\\.[0-9]+)?\\s*(billion|million|trillion)', 1, 'i')) WHEN 'billion' THEN 1e9 WHEN 'million' THEN 1e6 WHEN 'trillion' THEN 1e12 ELSE 1 END END)"


def sentences_sql(c: str) -> str:
    """DuckDB form of the sentence rule."""
    from ledgerloom.functions.text import ABBREVIATIONS

    names = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    x = f"regexp_replace(replace({c}, chr(13) || chr(10), chr(10)), '\\n\\s*\\n', chr(2), 'g')"
    x = f"regexp_replace({x}, '[\\t-\\r \\x{{A0}}]+', ' ', 'g')"
    x = f"regexp_replace({x}, '(^|[^A-Za-z.])({names})\\. ', '\\1\\2' || chr(1) || ' ', 'g')"
    x = f"regexp_replace({x}, '([.!?]) ', '\\1' || chr(2), 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(2)), lambda s: trim(replace(s, chr(1), '.'))), lambda s: s <> '')"


_WORDS = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '')"
_KEY = "trim(regexp_replace(lower(translate(s, '‘’“”', '''''\"\"')), ' +', ' ', 'g'))"
_MEMBERS = f"(SELECT p.company_id, p.side, lower(coalesce(m.company_id_resolved, m.company_name_raw)) AS peer FROM (SELECT filing_id, unnest(members) AS m FROM peer_groups) g JOIN {_PAIRS} p ON p.filing_id = g.filing_id)"

ORACLES = {
    "peer_snapshot": f"WITH l AS (SELECT * FROM {_RANKED} WHERE rank = 1), k AS (SELECT id AS peer_id, name, unnest(['s:' || lower(trim(ticker)), 'n:' || trim(cik), 'k:' || nullif({_key_sql('name')}, '')]) AS key FROM companies), m AS (SELECT peer_group_id, unnest(['s:' || lower(trim(coalesce(ticker_resolved, company_id_resolved))), 'n:' || trim(cik_resolved), 'k:' || nullif({_key_sql('company_name_raw')}, '')]) AS key FROM peer_group_members), r AS (SELECT DISTINCT l.company_id, k.peer_id, k.name FROM m JOIN k ON k.key = m.key JOIN peer_groups g ON g.id = m.peer_group_id JOIN l ON l.id = g.filing_id WHERE k.peer_id <> l.company_id) SELECT r.*, CAST(o.filing_year AS BIGINT) AS peer_year, coalesce((SELECT count(*) FROM metric_facts f WHERE f.filing_id = o.id), 0) AS facts FROM r LEFT JOIN l o ON o.company_id = r.peer_id",
    "exec_diff": f"{_EXEC_DIFF} SELECT company_id, who, old_total, new_total, status, delta, pct FROM d",
    "yoy_change_summary": f"{_EXEC_DIFF} SELECT company_id, " + ", ".join(f"count(*) FILTER (status = '{s}') AS {s}" for s in ("added", "removed", "changed", "unchanged")) + ", coalesce(sum(delta), 0.0::DOUBLE) AS net_delta FROM d GROUP BY company_id",
    "metric_diff": f"""WITH l AS (SELECT p.company_id, coalesce(metric_name_normalized, metric_name_raw) AS metric, p.side, arg_max({{'v': observed_value}}, (updated_at, id)) AS v FROM metric_facts m JOIN {_PAIRS} p ON p.filing_id = m.filing_id WHERE coalesce(metric_name_normalized, metric_name_raw) IS NOT NULL GROUP BY ALL),
x AS (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.metric, b.metric) AS metric, a.v.v AS o, b.v.v AS n, CASE WHEN a.metric IS NULL THEN 'added' WHEN b.metric IS NULL THEN 'removed' WHEN coalesce(a.v.v, '') = coalesce(b.v.v, '') THEN 'unchanged' ELSE 'changed' END AS status FROM (SELECT * FROM l WHERE side = 'old') a FULL JOIN (SELECT * FROM l WHERE side = 'new') b ON a.company_id = b.company_id AND a.metric = b.metric)
SELECT company_id, metric, status, CAST(floor(({_SCALE('n')} - {_SCALE('o')}) * 1000 + 0.5) AS BIGINT) AS delta_milli FROM x""",
    "member_diff": f"WITH c AS (SELECT company_id, peer, count(*) FILTER (side = 'old') AS o, count(*) FILTER (side = 'new') AS n FROM {_MEMBERS} GROUP BY 1, 2) SELECT company_id, CAST(sum(CASE WHEN o = 0 THEN n ELSE 0 END) AS BIGINT) AS added, CAST(sum(CASE WHEN n = 0 THEN o ELSE 0 END) AS BIGINT) AS removed, CAST(sum(CASE WHEN o > 0 THEN n ELSE 0 END) AS BIGINT) AS kept FROM c GROUP BY company_id",
    "section_similarity": f"""WITH j AS (SELECT coalesce(a.company_id, b.company_id) AS company_id, coalesce(a.section_type, b.section_type) AS section_type, {_WORDS.format('a.v')} AS o, {_WORDS.format('b.v')} AS n FROM (SELECT * FROM {_TEXTS} WHERE side = 'old') a FULL JOIN (SELECT * FROM {_TEXTS} WHERE side = 'new') b ON a.company_id = b.company_id AND a.section_type = b.section_type),
k AS (SELECT *, CASE WHEN least(len(o), len(n)) >= 16 THEN 8 WHEN least(len(o), len(n)) >= 6 THEN 3 ELSE 1 END AS w FROM j),
s AS (SELECT company_id, section_type, len(o) AS lo, len(n) AS ln, list_distinct(list_transform(range(1, len(o) - w + 2), lambda i: array_to_string(o[i:i + w - 1], ' '))) AS x, list_distinct(list_transform(range(1, len(n) - w + 2), lambda i: array_to_string(n[i:i + w - 1], ' '))) AS y FROM k)
SELECT company_id, section_type, CAST(CASE WHEN lo = 0 AND ln = 0 THEN 100 WHEN lo = 0 OR ln = 0 THEN 0 ELSE floor(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y))) * 100 + 0.5) END AS BIGINT) AS similarity FROM s""",
    "sentence_matches": f"WITH r AS (SELECT company_id, section_type, side, unnest({sentences_sql('v')}) AS s FROM {_TEXTS}), k AS (SELECT company_id, section_type, {_KEY} AS k, count(*) FILTER (side = 'old') AS o, count(*) FILTER (side = 'new') AS n FROM r GROUP BY ALL) SELECT company_id, section_type, CAST(sum(least(o, n)) AS BIGINT) AS unchanged, CAST(sum(greatest(n - o, 0)) AS BIGINT) AS fresh, CAST(sum(greatest(o - n, 0)) AS BIGINT) AS gone FROM k GROUP BY 1, 2",
    "prior_pay": f"WITH y AS (SELECT filing_id, lower(trim(regexp_replace(executive_name, '\\s*(?:{'|'.join(X.TITLES)})\\s*$', '', 'i'))) AS who, year, max(total) AS total FROM {_EXECS} GROUP BY ALL) SELECT a.filing_id, a.who, CAST(a.year AS BIGINT) AS year, (arg_max({{'t': b.total}}, b.year)).t AS prior_total, CAST(max(b.year) AS BIGINT) AS prior_year FROM y a LEFT JOIN y b ON a.filing_id = b.filing_id AND a.who = b.who AND b.year < a.year GROUP BY ALL",
}
