"""Table maintenance, job states over event time, citations and structural differences."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import upkeep
from ledgerloom.plans.reads import _FILINGS, filings_of
from ledgerloom.plans.streams import GATE_SQL
from ledgerloom.sources.tables import table

KEYS = ["filing_id", "fact_no"]
FACT = ["id", "filing_id", "fact_no", "observed_value", "verification_status", "updated_at"]
MICROS = 1_000_000
STALE_S = 90


def _facts(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Facts once each: the latest version."""
    m = table(spark, folder, name).select(*FACT)
    rest = [c for c in FACT if c not in KEYS]
    return m.groupBy(*KEYS).agg(F.max_by(F.struct(*rest), F.struct("updated_at", "id")).alias("r")).select(*KEYS, "r.*")


def _facts_sql(name: str) -> str:
    return f"(SELECT id, filing_id, fact_no, observed_value, verification_status, updated_at FROM {name} QUALIFY row_number() OVER (PARTITION BY filing_id, fact_no ORDER BY updated_at DESC, id DESC) = 1)"


def _out(df: DataFrame) -> DataFrame:
    return df.select("id", "filing_id", F.col("fact_no").cast("long").alias("fact_no"), "observed_value", "verification_status")


_OUT = "id, filing_id, CAST(fact_no AS BIGINT) AS fact_no, observed_value, verification_status"


def facts_upserted(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate's facts after an upsert of the oracle's."""
    return _out(upkeep.upsert(_facts(spark, folder, "metric_facts"), _facts(spark, folder, "metric_facts_oracle"), KEYS, ["updated_at"]))


def facts_inserted(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate's facts with those that only the oracle has."""
    return _out(upkeep.insert_absent(_facts(spark, folder, "metric_facts"), _facts(spark, folder, "metric_facts_oracle"), KEYS))


def filings_replaced(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate's facts with all filings since 2020 replaced by the oracle's rows."""
    recent = filings_of(spark, folder).where("filing_year >= 2020").select(F.col("id").alias("filing_id"))
    new = _facts(spark, folder, "metric_facts_oracle").join(recent, "filing_id", "left_semi")
    return _out(upkeep.replace_groups(_facts(spark, folder, "metric_facts"), new, ["filing_id"]))


def review_carried(spark: SparkSession, folder: str) -> DataFrame:
    """The oracle's facts with the candidate's verification where the value did not change."""
    return _out(upkeep.carry_forward(_facts(spark, folder, "metric_facts"), _facts(spark, folder, "metric_facts_oracle"), KEYS, ["observed_value"], ["verification_status"]))


def unreviewed_updated(spark: SparkSession, folder: str) -> DataFrame:
    """The candidate's facts: unverified ones take the oracle's differing value, and facts it lacks are added."""
    old, new = _facts(spark, folder, "metric_facts"), _facts(spark, folder, "metric_facts_oracle")
    theirs = new.select(*KEYS, F.lit(True).alias("_there"), F.col("observed_value").alias("_value"))
    open_ = F.col("_there") & (F.col("verification_status") == "machine_extracted") & ~F.col("_value").eqNullSafe(F.col("observed_value"))
    changed = upkeep.update_where(old.join(theirs, KEYS, "left"), open_, {"observed_value": F.col("_value")}).drop("_there", "_value")
    return _out(upkeep.insert_absent(changed, new, KEYS))


def rejected_deleted(spark: SparkSession, folder: str, most: int = 1_000_000) -> DataFrame:
    """Filings with rejected groups: groups before and after their bounded deletion."""
    g = table(spark, folder, "peer_groups").select("id", "filing_id", "verification_status")
    kept = upkeep.bounded_delete(g, g.where("verification_status = 'rejected'").select("id"), ["id"], most)
    after = kept.groupBy("filing_id").agg(F.count(F.lit(1)).alias("after"))
    before = g.groupBy("filing_id").agg(F.count(F.lit(1)).alias("before"))
    return before.join(after, "filing_id", "left").select("filing_id", "before", F.coalesce("after", F.lit(0)).alias("after")).where("before > after")


def review_states(spark: SparkSession, folder: str) -> DataFrame:
    """The verification that each group's review state asks for, against the one it has."""
    g = table(spark, folder, "peer_groups")
    asked = upkeep.reviewed(F.col("review_status"))
    return g.groupBy("review_status", asked.alias("asked")).agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("verification_status") == asked).alias("as_asked"))


def _events(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select("event_id", "user_id", "event_type", "value", "props", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))


def rate_window(spark: SparkSession, folder: str, cap: int = 1) -> DataFrame:
    """Seconds with more events than the cap, in tumbling windows."""
    e = _events(spark, folder).groupBy(F.floor(F.col("at") / MICROS).alias("second")).agg(F.count(F.lit(1)).alias("events"))
    return e.where(F.col("events") > cap)


def hourly_cap(spark: SparkSession, folder: str, cap: int = 1) -> DataFrame:
    """Events of a user that come when the hour before already holds the cap."""
    w = W.partitionBy("user_id").orderBy("at").rangeBetween(-3600 * MICROS, 0)
    e = _events(spark, folder).withColumn("within", F.count(F.lit(1)).over(w))
    return e.where(F.col("within") > cap).select("event_id", "user_id", "within")


def recent_repeats(spark: SparkSession, folder: str) -> DataFrame:
    """Events of a user and type within ten minutes of the one before."""
    w = W.partitionBy("user_id", "event_type").orderBy("at", "event_id")
    e = _events(spark, folder).withColumn("before", F.lag("at").over(w))
    return e.where(F.col("at") - F.col("before") <= 600 * MICROS).select("event_id", "user_id", "event_type")


def in_flight_gate(spark: SparkSession, folder: str) -> DataFrame:
    """Of each user's events, those that may start a job: none while another runs that is less than 90 seconds old.

    Rows stream through in order with the running job as the only state, so no user's events are held at once.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        user, since = None, None
        for pdf in batches:
            started = []
            for u, at in zip(pdf["user_id"].tolist(), pdf["at"].tolist()):
                free = u != user or since is None or at - since >= STALE_S * MICROS
                user, since = u, at if free else since
                started.append(free)
            yield pdf[["event_id", "user_id"]].assign(started=started)

    e = _events(spark, folder).select("event_id", "user_id", "at").repartition("user_id").sortWithinPartitions("user_id", "at", "event_id")
    return e.mapInPandas(run, "event_id long, user_id long, started boolean")


def job_states(spark: SparkSession, folder: str) -> DataFrame:
    """The last state of each user's job and whether it is final; later events win."""
    e = _events(spark, folder)
    last = e.groupBy("user_id").agg(F.max_by("event_type", F.struct("at", "event_id")).alias("status"), F.max("at").alias("at"), F.count(F.lit(1)).alias("steps"))
    return last.select("user_id", "status", F.col("status").isin("purchase", "error").alias("final"), "at", "steps")


def stale_jobs(spark: SparkSession, folder: str, minutes: int = 5) -> DataFrame:
    """Jobs whose last state is not final and older than the limit, seen from the latest event."""
    limit = min(60, max(2, minutes)) * 60 * MICROS
    jobs = job_states(spark, folder)
    now = _events(spark, folder).agg(F.max("at").alias("now"))
    return jobs.crossJoin(F.broadcast(now)).where(~F.col("final") & (F.col("now") - F.col("at") > limit)).select("user_id", "status", F.lit("failed").alias("becomes"))


def merged_details(spark: SparkSession, folder: str) -> DataFrame:
    """The detail of each user: keys of all events merged, later ones over earlier."""
    e = _events(spark, folder).select("user_id", "at", "event_id", F.get_json_object("props", "$.k").cast("long").alias("k"), "event_type")
    per = e.groupBy("user_id", "event_type").agg(F.max_by("k", F.struct("at", "event_id")).alias("k"))
    return per.groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws("=", "event_type", F.col("k").cast("string")))), ";").alias("detail"))


def citation_checks(spark: SparkSession, folder: str) -> DataFrame:
    """Citations of answers by kind: valid if the filing named has such an artifact, else rejected."""
    a = table(spark, folder, "ask_interactions").select("id", F.translate(F.trim("filing_id"), "-", "").alias("filing_id"), "citations").distinct()
    c = a.select("id", "filing_id", F.explode(F.from_json("citations", "array<struct<kind string>>")).alias("c")).select("id", "filing_id", "c.kind")
    has = lambda n, k: table(spark, folder, n).select("filing_id", F.lit(k).alias("kind")).distinct()
    known = has("sections", "section").unionByName(has("metric_facts", "metric")).unionByName(has("peer_groups", "peer_member")).unionByName(has("exec_comp_rows", "exec"))
    j = c.join(known.withColumn("valid", F.lit(1)), ["filing_id", "kind"], "left")
    return j.groupBy("kind").agg(F.count("valid").alias("valid"), (F.count(F.lit(1)) - F.count("valid")).alias("rejected"))


def answer_outcomes(spark: SparkSession, folder: str) -> DataFrame:
    """Answers per model: refused, flagged or plain."""
    a = table(spark, folder, "ask_interactions").select("id", "model", "answer", "scope_violation").distinct()
    outcome = F.when(F.col("answer").isNull(), "refused").when(F.col("scope_violation"), "flagged").otherwise("plain")
    return a.groupBy("model", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("answers"))


def structural_diff(spark: SparkSession, folder: str) -> DataFrame:
    """Summaries of a company's consecutive questions compared as trees: each path whose values differ."""
    a = table(spark, folder, "ask_interactions").where("company_id IS NOT NULL AND context_summary IS NOT NULL").select("id", "company_id", "context_summary").distinct()
    w = W.partitionBy("company_id").orderBy("id")
    pairs = a.select("id", F.lag("context_summary").over(w).alias("before"), F.col("context_summary").alias("after")).where("before IS NOT NULL")
    leaf = lambda c: pairs.select("id", F.explode(F.from_json(c, "map<string,string>")).alias("path", c))
    j = leaf("before").join(leaf("after"), ["id", "path"], "full_outer")
    return j.where(~F.col("before").eqNullSafe(F.col("after"))).select("id", "path", "before", "after")


def fact_pack(spark: SparkSession, folder: str) -> DataFrame:
    """A bounded summary of each filing: opening of its discussion, six members, number of facts."""
    f = filings_of(spark, folder).select(F.col("id").alias("filing_id"))
    s = table(spark, folder, "sections").where("section_type = 'cd_and_a'").groupBy("filing_id").agg(F.substring(F.min_by("text", "id"), 1, 600).alias("opener"))
    m = table(spark, folder, "peer_groups").groupBy("filing_id").agg(F.min_by("members", "id").alias("m"))
    facts = table(spark, folder, "metric_facts").groupBy("filing_id").agg(F.countDistinct("fact_no").alias("facts"))
    rows = f.join(s, "filing_id", "left").join(m, "filing_id", "left").join(facts, "filing_id", "left")
    return rows.select("filing_id", F.coalesce("opener", F.lit("")).alias("opener"), F.coalesce(F.array_join(F.slice(F.col("m.company_name_raw"), 1, 6), "|"), F.lit("")).alias("peers"), F.coalesce("facts", F.lit(0)).alias("facts"))


def replay_deltas(spark: SparkSession, folder: str) -> DataFrame:
    """Facts per filing in both copies and whether the candidate fell below the oracle."""
    n = lambda name, c: table(spark, folder, name).groupBy("filing_id").agg(F.countDistinct("fact_no").alias(c))
    j = n("metric_facts", "candidate").join(n("metric_facts_oracle", "oracle"), "filing_id", "full_outer").fillna(0)
    return j.select("filing_id", "candidate", "oracle", (F.col("candidate") - F.col("oracle")).alias("delta"), (F.col("candidate") < F.col("oracle")).alias("regressed"))


def cohort(spark: SparkSession, folder: str) -> DataFrame:
    """Companies by symbol, or id where there is none, with their number of filings."""
    n = filings_of(spark, folder).groupBy("company_id").agg(F.count(F.lit(1)).alias("filings"))
    c = table(spark, folder, "companies").select("id", F.coalesce("ticker", "id").alias("label"))
    return c.join(n, c["id"] == n["company_id"], "left").select("id", "label", F.coalesce("filings", F.lit(0)).alias("filings"))


def order_revenue(spark: SparkSession, folder: str) -> DataFrame:
    """Revenue per nation and year over orders and their lines: the widest join of the set."""
    li = table(spark, folder, "lineitem").select("l_orderkey", "l_suppkey", F.round(F.col("l_extendedprice") * (1 - F.col("l_discount")) * 100).cast("long").alias("cents"))
    o = table(spark, folder, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.year("o_orderdate").cast("long").alias("year"))
    s = table(spark, folder, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name")
    # lines are summed per order and supplier nation only after the small sides are joined
    rows = li.join(s, "l_suppkey").join(n, "s_nationkey").join(o, "l_orderkey")
    return rows.groupBy("n_name", "year").agg(F.sum("cents").alias("cents"))


QUERIES = {
    f.__name__: f
    for f in (facts_upserted, facts_inserted, filings_replaced, review_carried, unreviewed_updated, rejected_deleted, review_states, rate_window, hourly_cap, recent_repeats, in_flight_gate, job_states, stale_jobs, merged_details, citation_checks, answer_outcomes, structural_diff, fact_pack, replay_deltas, cohort, order_revenue)
}

_A, _B = _facts_sql("metric_facts"), _facts_sql("metric_facts_oracle")
_ON = "a.filing_id = b.filing_id AND a.fact_no = b.fact_no"
_ONLY_B = f"SELECT {_OUT} FROM {_B} b WHERE NOT EXISTS (SELECT 1 FROM metric_facts a WHERE {_ON})"
_JOBS = "(SELECT user_id, arg_max(event_type, (epoch_us(ts), event_id)) AS status, arg_max(event_type, (epoch_us(ts), event_id)) IN ('purchase', 'error') AS final, max(epoch_us(ts)) AS at, count(*) AS steps FROM events GROUP BY 1)".replace(" AS at,", ' AS "at",')

ORACLES = {
    "in_flight_gate": GATE_SQL,
    "facts_upserted": f"WITH x AS (SELECT *, 0 AS src FROM {_A} UNION ALL SELECT *, 1 FROM {_B}) SELECT {_OUT} FROM x QUALIFY row_number() OVER (PARTITION BY filing_id, fact_no ORDER BY updated_at DESC, src DESC) = 1",
    "facts_inserted": f"SELECT {_OUT} FROM {_A} UNION ALL {_ONLY_B}",
    "filings_replaced": f"WITH r AS (SELECT {_OUT} FROM {_B} WHERE filing_id IN (SELECT id FROM {_FILINGS} WHERE filing_year >= 2020)) SELECT {_OUT} FROM {_A} WHERE filing_id NOT IN (SELECT filing_id FROM r) UNION ALL SELECT * FROM r",
    "review_carried": f"SELECT b.id, b.filing_id, CAST(b.fact_no AS BIGINT) AS fact_no, b.observed_value, CASE WHEN a.id IS NOT NULL AND a.observed_value IS NOT DISTINCT FROM b.observed_value THEN a.verification_status ELSE b.verification_status END AS verification_status FROM {_B} b LEFT JOIN {_A} a ON {_ON}",
    "unreviewed_updated": f"SELECT a.id, a.filing_id, CAST(a.fact_no AS BIGINT) AS fact_no, CASE WHEN b.id IS NOT NULL AND a.verification_status = 'machine_extracted' THEN b.observed_value ELSE a.observed_value END AS observed_value, a.verification_status FROM {_A} a LEFT JOIN {_B} b ON {_ON} UNION ALL {_ONLY_B}",
    "rejected_deleted": "SELECT filing_id, count(*) AS before, count(*) FILTER (verification_status IS DISTINCT FROM 'rejected') AS after FROM peer_groups GROUP BY 1 HAVING count(*) FILTER (verification_status = 'rejected') > 0",
    "review_states": "WITH g AS (SELECT *, CASE review_status WHEN 'reviewed' THEN 'verified' WHEN 'flagged' THEN 'rejected' ELSE 'machine_extracted' END AS asked FROM peer_groups) SELECT review_status, asked, count(*) AS rows, count(*) FILTER (verification_status = asked) AS as_asked FROM g GROUP BY 1, 2",
    "rate_window": "SELECT epoch_us(ts) // 1000000 AS second, count(*) AS events FROM events GROUP BY 1 HAVING count(*) > 1",
    "hourly_cap": "WITH e AS (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(ts) RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) AS within FROM events) SELECT * FROM e WHERE within > 1",
    "recent_repeats": "WITH e AS (SELECT event_id, user_id, event_type, epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts), event_id) AS d FROM events) SELECT event_id, user_id, event_type FROM e WHERE d <= 600000000",
    "job_states": f"SELECT * FROM {_JOBS}",
    "stale_jobs": f"SELECT user_id, status, 'failed' AS becomes FROM {_JOBS} WHERE NOT final AND (SELECT max(epoch_us(ts)) FROM events) - \"at\" > 300000000",
    "merged_details": "WITH p AS (SELECT user_id, event_type, arg_max(CAST(json_extract_string(props, '$.k') AS BIGINT), (epoch_us(ts), event_id)) AS k FROM events GROUP BY 1, 2) SELECT user_id, string_agg(event_type || '=' || k, ';' ORDER BY event_type || '=' || k) AS detail FROM p GROUP BY 1",
    "citation_checks": "WITH a AS (SELECT DISTINCT id, replace(trim(filing_id), '-', '') AS filing_id, citations FROM ask_interactions), c AS (SELECT id, filing_id, json_extract_string(x, '$.kind') AS kind FROM (SELECT id, filing_id, unnest(CAST(citations AS JSON[])) AS x FROM a WHERE citations IS NOT NULL)), k AS (SELECT DISTINCT filing_id, 'section' AS kind FROM sections UNION ALL SELECT DISTINCT filing_id, 'metric' FROM metric_facts UNION ALL SELECT DISTINCT filing_id, 'peer_member' FROM peer_groups UNION ALL SELECT DISTINCT filing_id, 'exec' FROM exec_comp_rows) SELECT c.kind, count(k.kind) AS valid, count(*) - count(k.kind) AS rejected FROM c LEFT JOIN k ON k.filing_id = c.filing_id AND k.kind = c.kind GROUP BY 1",
    "answer_outcomes": "SELECT model, CASE WHEN answer IS NULL THEN 'refused' WHEN scope_violation THEN 'flagged' ELSE 'plain' END AS outcome, count(*) AS answers FROM (SELECT DISTINCT id, model, answer, scope_violation FROM ask_interactions) GROUP BY 1, 2",
    "structural_diff": "WITH a AS (SELECT DISTINCT id, company_id, context_summary FROM ask_interactions WHERE company_id IS NOT NULL AND context_summary IS NOT NULL), p AS (SELECT id, lag(context_summary) OVER (PARTITION BY company_id ORDER BY id) AS b, context_summary AS c FROM a), k AS (SELECT id, b, c, unnest(list_distinct(list_concat(json_keys(b), json_keys(c)))) AS path FROM p WHERE b IS NOT NULL), v AS (SELECT id, path, json_extract_string(b, '$.' || path) AS before, json_extract_string(c, '$.' || path) AS after FROM k) SELECT * FROM v WHERE before IS DISTINCT FROM after",
    "fact_pack": f"SELECT f.id AS filing_id, coalesce(s.t, '') AS opener, coalesce(array_to_string(list_transform(m.m[1:6], lambda x: x.company_name_raw), '|'), '') AS peers, coalesce(n.n, 0) AS facts FROM {_FILINGS} f LEFT JOIN (SELECT filing_id, substr(arg_min(text, id), 1, 600) AS t FROM sections WHERE section_type = 'cd_and_a' GROUP BY 1) s ON s.filing_id = f.id LEFT JOIN (SELECT filing_id, arg_min(members, id) AS m FROM peer_groups GROUP BY 1) m ON m.filing_id = f.id LEFT JOIN (SELECT filing_id, count(DISTINCT fact_no) AS n FROM metric_facts GROUP BY 1) n ON n.filing_id = f.id",
    "replay_deltas": "SELECT coalesce(a.filing_id, b.filing_id) AS filing_id, coalesce(a.n, 0) AS candidate, coalesce(b.n, 0) AS oracle, coalesce(a.n, 0) - coalesce(b.n, 0) AS delta, coalesce(a.n, 0) < coalesce(b.n, 0) AS regressed FROM (SELECT filing_id, count(DISTINCT fact_no) AS n FROM metric_facts GROUP BY 1) a FULL JOIN (SELECT filing_id, count(DISTINCT fact_no) AS n FROM metric_facts_oracle GROUP BY 1) b ON a.filing_id = b.filing_id",
    "cohort": f"SELECT c.id, coalesce(c.ticker, c.id) AS label, count(f.id) AS filings FROM companies c LEFT JOIN {_FILINGS} f ON f.company_id = c.id GROUP BY 1, 2",
    "order_revenue": "SELECT n.n_name, CAST(year(o.o_orderdate) AS BIGINT) AS year, CAST(sum(CAST(round(l.l_extendedprice * (1 - l.l_discount) * 100) AS BIGINT)) AS BIGINT) AS cents FROM lineitem l JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey GROUP BY 1, 2",
}
