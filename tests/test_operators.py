"""Operators on small tables: order-dependent ones, markup, lists, rewrites, general training-data operators."""

import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import copydiff, html, orphans, peers, rules, runs, sequential, upkeep
from ledgerloom.operators.skew import salted_lookup
from ledgerloom.sources import trees
from ledgerloom.streaming import jobs

DAY = lambda n: dt.datetime(2021, 1, n)


# orphan references


def orphan_case(spark, refs, things):
    r = spark.createDataFrame([(i, k, t, "clash") for i, (k, t) in enumerate(refs)], "id int, key string, at timestamp, target string")
    e = spark.createDataFrame(things, "key string, at timestamp")
    deltas = orphans.reference_deltas(r, "t", orphans.clean_key(F.col("key")), F.col("at")).unionByName(orphans.existence_deltas(e, "t", F.col("key"), F.col("at")))
    keys = orphans.orphan_keys(orphans.fold(deltas), timed=("t",))
    rows = r.select(F.lit("t").alias("target"), orphans.clean_key(F.col("key")).alias("key"), "at", "id")
    return sorted(x["id"] for x in orphans.orphan_rows(rows.where("key IS NOT NULL"), keys).collect())


def test_orphans_missing_late_and_blank(spark):
    refs = [("a", DAY(5)), (" a ", DAY(1)), ("b", DAY(2)), (None, DAY(2)), (" ", DAY(2)), ("b", None), ("a", DAY(5))]
    assert orphan_case(spark, refs, [("a", DAY(3)), ("a", DAY(9)), (None, DAY(1))]) == [1, 2, 5]
    assert orphan_case(spark, [], []) == []
    assert orphan_case(spark, [("a", DAY(1))], []) == [0]


def test_signed_counts_fold_like_all_at_once(spark):
    rng = random.Random(1)
    rows = [("t", rng.choice("abcd"), DAY(rng.randint(1, 28)), rng.choice([1, 1, -1]), rng.choice([0, 1, -1])) for _ in range(80)]
    schema = "target string, key string, at timestamp, ref_delta long, exist_delta long"
    whole = orphans.fold(spark.createDataFrame(rows, schema))
    state = None
    for i in range(0, 80, 20):
        state = orphans.fold(spark.createDataFrame(rows[i : i + 20], schema), state)
    assert sorted(whole.collect()) == sorted(state.collect())


# copy differences


def diffs(spark, a, b):
    frame = lambda rows: spark.createDataFrame(rows, "id long, k string, n int, x string, y string, u timestamp, field string")
    out = copydiff.copy_differences(frame(a), frame(b), ["k", "n"], ["x", "y"], ["u", "id"], leaf_rows=2)
    return sorted((r["k"], r["n"], r["field"], r["candidate"], r["oracle"]) for r in out.collect())


def test_copy_differences(spark):
    row = lambda i, k, x, y="y", n=1, u=1: (i, k, n, x, y, DAY(u), "clash")
    a = [row(1, "a", "1"), row(2, "b", "café x"), row(3, "c", None), row(4, "d", "old"), row(5, "d", "new", u=2), row(6, "e", "1"), row(7, "e", "1")]
    b = [row(8, "a", "1"), row(9, "b", " café  x "), row(10, "c", ""), row(11, "d", "new"), row(12, "f", "1")]
    assert diffs(spark, a, b) == [("c", 1, "x", None, ""), ("e", 1, "missing_in_oracle", None, None), ("f", 1, "missing_in_candidate", None, None)]
    assert diffs(spark, a, a) == [] and diffs(spark, [], []) == []
    assert len(diffs(spark, a, [])) == 5


def test_copy_differences_equal_brute_force(spark):
    rng = random.Random(7)
    make = lambda: {(f"k{rng.randrange(60)}", rng.randrange(3)): (rng.choice("pq"), rng.choice(["", None, "z"])) for _ in range(150)}
    a, b = make(), make()
    want = set()
    for k in a.keys() | b.keys():
        if k not in a or k not in b:
            want.add((*k, "missing_in_candidate" if k not in a else "missing_in_oracle"))
        else:
            want |= {(*k, f) for f, v, w in zip("xy", a[k], b[k]) if v != w}
    rows = lambda d: [(i, k, n, *v, DAY(1), "") for i, ((k, n), v) in enumerate(d.items())]
    assert {r[:3] for r in diffs(spark, rows(a), rows(b))} == want


def test_salted_lookup(spark):
    big = spark.createDataFrame([(i, "hot" if i % 3 else None) for i in range(90)], "i int, k string")
    small = spark.createDataFrame([("hot", 1), ("cold", 2)], "k string, v int")
    assert salted_lookup(big, small, ["k"]).count() == 60
    assert salted_lookup(big, small, ["k"], "left_anti").count() == 30


# order-dependent operators


def test_match_groups():
    g = lambda i, t, n: {"id": i, "type": t, "name": n}
    old = [g(1, "p", "A"), g(2, "p", "B"), g(3, "q", "C")]
    new = [g(4, "p", "b"), g(5, "p", "X"), g(6, "r", "c"), g(7, "s", None)]
    ids = [(o and o["id"], n and n["id"]) for o, n in sequential.match_groups(old, new)]
    assert ids == [(2, 4), (1, 5), (3, 6), (None, 7)]
    assert sequential.match_groups(old[:1], []) == [(old[0], None)]


def test_merge_groups():
    m = sequential.merge_groups
    assert m([["a", "b", "c"]], [["a", "b", "c", "d"]]) == [["a", "b", "c", "d"]]
    assert m([["a", "b", "c"]], [["a", "b", "c", "d", None]]) == [["a", "b", "c"]]
    assert m([["a", "b"]], [["x", "y"], ["x", "y", "z"]]) == [["a", "b"], ["x", "y", "z"]]
    assert m([], [["a"]]) == [["a"]]


def test_pack_intervals():
    found = [(0, 5, 0.9, "A"), (0, 9, 0.8, "B"), (4, 12, 0.9, "C"), (10, 12, 0.9, "B"), (13, 15, 0.5, "D")]
    assert [x[3] for x in sequential.pack_intervals(found)] == ["B", "D"]


def test_word_and_sentence_diff():
    assert sequential.word_diff("we rely on three pillars", "We rely on four pillars") == [("same", "We"), ("same", "rely"), ("same", "on"), ("del", "three"), ("ins", "four"), ("same", "pillars")]
    pair = lambda *xs: [(x.lower(), x) for x in xs]
    old = pair("We rely on three pillars here.", "Same one.", "Same one.", "Gone for good now.")
    new = pair("same one.", "We rely on four pillars here.", "Entirely fresh words.")
    assert [x[0] for x in sequential.sentence_diff(old, new)] == ["unchanged", "changed", "added", "removed", "removed"]
    assert sequential.sentence_diff([], []) == []


def test_gate():
    assert sequential.gate([0, 10, 95, 100, 200], [None] * 5) == [True, False, True, False, True]
    assert sequential.gate([0, 10, 20], [5, None, None]) == [True, True, False]


# runs


def test_runs_and_last_before(spark):
    rows = [("a", x, x + 2) for x in (0, 5, 9, 700, 1500, 1505)]
    df = spark.createDataFrame(rows, "k string, s long, e long")
    found = runs.runs(df, ["k"], "s", "e", 600, 2).groupBy("run").count().collect()
    assert sorted(r["count"] for r in found) == [2, 3] or sorted(r["count"] for r in found) == [2, 4]
    marks = spark.createDataFrame([("a", 4), ("a", 690), ("b", 1)], "k string, m long")
    got = {r["s"]: r["last_mark"] for r in runs.last_before(df, marks, ["k"], "s", "m", 500).collect()}
    assert got == {0: None, 5: 4, 9: 4, 700: 690, 1500: None, 1505: None}


def test_word_sequences(spark):
    got = spark.range(1).select(runs.word_sequences(F.split(F.lit("a b c"), " "), 2).alias("g")).first()["g"]
    assert [(x["place"], x["text"]) for x in got] == [(1, "a"), (2, "b"), (3, "c"), (1, "a b"), (2, "b c")]


# markup

TABLE = """<p>See the Summary Compensation Table below.</p><h3>Summary Compensation Table</h3>
<table><tr><th>Name andPrincipal Position</th><th>FiscalYear</th><th>Salary($)</th><th>Total Stock Awards</th><th>Total($)</th></tr>
<tr><td rowspan=2>Ann Bell<br>Chief Executive Officer</td><td>2024-25</td><td>1,000</td><td>5</td><td>$9,000</td></tr>
<tr><td></td><td>2024</td><td>900</td><td>4</td><td>8,000</td></tr>
<tr><td>Carl DreyChair and Founder</td><td>2025<br>2024</td><td>1<br>2</td><td>3<br>4</td><td>50<br>60</td></tr>
<tr><td>Eve Fox</td></tr><tr><td>Former CEO</td></tr>
<tr><td></td><td>2025</td><td>7</td><td>8</td><td>70</td></tr>
<tr><td></td><td>2025</td><td>7</td><td>8</td><td>75</td></tr></table>"""


def test_compensation_table(spark):
    got = {(r["name"], r["year"]): (r["position"], r["total"]) for r in html.compensation_rows(TABLE)}
    assert got == {
        ("Ann Bell", 2025): ("Chief Executive Officer", "$9,000"),
        ("Ann Bell", 2024): ("Chief Executive Officer", "8,000"),
        ("Carl Drey", 2025): ("Chair and Founder", "50"),
        ("Carl Drey", 2024): ("Chair and Founder", "60"),
        ("Eve Fox", 2025): ("Former CEO", "75"),
    }
    df = spark.createDataFrame([(1, TABLE), (2, None), (3, "<p>no table")], "id int, html string")
    assert html.compensation(df, "id", "html").count() == 5
    assert html.cells(df, "id", "html").where("id = 1").count() == 32  # six rows of five cells and two of one


@pytest.mark.parametrize(("cell", "parts"), [("Marc BelloffChair of the Board", ("Marc Belloff", "Chair of the Board")), ("Robert Iger2Chief Executive Officer", ("Robert Iger", "Chief Executive Officer")), ("Jane Roe (1)", ("Jane Roe", ""))])
def test_split_name(cell, parts):
    assert html.split_name(cell) == parts


def test_section_below(spark):
    page = '<a href="#x">CEO Pay Ratio</a><table><tr><td>CEO Pay Ratio</td></tr></table><div><h2 id="x">CEO Pay Ratio</h2><p>It is 10 to 1.<p>It is 10 to 1.<p>More.<h2>Next Part</h2><p>Other.</div>'
    got = html.section_below(page, "pay ratio", "^next part")
    assert got == {"heading": "CEO Pay Ratio", "text": "It is 10 to 1.\n\nMore.", "confidence": 0.9, "method": "exact-heading-and-sibling-blocks"}
    assert html.section_below("<p>nothing", "pay ratio", "x") is None and html.section_below(None, "a", "b") is None
    assert html.section_below("<h1>Pay Ratio</h1>", "pay ratio", "x")["method"] == "heading-only"
    df = spark.createDataFrame([(1, page), (2, "")], "id int, html string")
    assert html.sections(df, "id", "html", "pay ratio", "^next part").count() == 1


def test_all_sections(spark):
    page = (
        "<h2>Frequency of Say-on-Pay</h2><p>Other.</p><h2>Proposal 2: Advisory Vote to Approve Executive Compensation</h2><p>" + "We ask for a vote. " * 40 + "</p><h2>Director Compensation</h2><p>No.</p>"
        "<h1>Compensation Discussion and Analysis</h1><h2>Report of the Compensation Committee</h2><p>We have reviewed it.</p>"
    )
    df = spark.createDataFrame([(1, page), (2, None)], "id int, html string")
    got = {r["section_type"]: (r["heading"], r["text"][:20], r["method"]) for r in html.all_sections(df, "id", "html").collect()}
    assert got["say_on_pay"] == ("Proposal 2: Advisory Vote to Approve Executive Compensation", "We ask for a vote. W", "exact-heading-and-sibling-blocks")
    assert got["compensation_committee_report"][1] == "We have reviewed it."
    assert got["cd_and_a"][0] == "Compensation Discussion and Analysis" and "ceo_pay_ratio" not in got


# lists of peers


def test_symbol_runs(spark):
    names = [(f"AB{c}", f"{c}lpha Corp") for c in "CDEFGHIJ"]
    universe = spark.createDataFrame(names, "ticker string, name string")
    text = "Our compensation peer group: " + ", ".join(f"{n} ({t})" for t, n in names)
    df = spark.createDataFrame([(1, text), (2, text.replace("peer group", "list")), (3, None), (4, "peer group Dlpha Corp (ABD)")], "id int, text string")
    assert {(r["id"], r["symbol"]) for r in peers.symbol_runs(df, "id", "text", universe).collect()} == {(1, t) for t, _ in names}


def test_form_runs_and_enumerations(spark):
    names = [(f"T{c}", f"{c}lpha Systems Inc.") for c in "CDEFGHIJ"]
    universe = spark.createDataFrame(names, "ticker string, name string")
    text = "The peer group consists of " + ", ".join(n for _, n in names) + ".\n\nOther text."
    df = spark.createDataFrame([(1, text), (2, "")], "id int, text string")
    assert peers.form_runs(df, "id", "text", universe, X.company_key).count() == 8
    assert peers.enumerations(df, "id", "text", universe, X.company_key).count() == 8


def test_rules(spark):
    text = "Intro here. We prohibit hedging by officers; other matters. The CEO pay ratio was 43 to 1.\n\n• Hedging is discussed"
    sections = spark.createDataFrame([("f", 1, "cd_and_a", text), ("f", 2, "ceo_pay_ratio", "The pay ratio is 99:1."), ("f", 3, "say_on_pay", None)], "filing_id string, id long, section_type string, text string")
    found = rules.candidates(sections, rules.POLICIES).withColumn("value", rules.policy_value(F.col("rule"), F.col("excerpt")))
    best = rules.best(found.withColumn("score", rules.score(rules.POLICIES, F.col("rule"), F.col("excerpt"), F.col("value")))).collect()
    assert [(r["rule"], r["value"], r["excerpt"], r["candidates"]) for r in best] == [("hedging", "prohibited", "We prohibit hedging by officers", 2)]
    m = rules.candidates(sections, rules.METRICS).withColumn("score", F.lit(1.0))
    assert [(r["rule"], r["value"]) for r in rules.cascade(m, sections).collect()] == [("ceo_pay_ratio", "43 to 1")]


# rewrites, sources, streams


def test_rewrites(spark):
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 5)], "k int, v string, t int")
    new = spark.createDataFrame([(2, "c", 4), (3, "d", 1)], "k int, v string, t int")
    s = lambda df: sorted(tuple(r) for r in df.collect())
    assert s(upkeep.upsert(old, new, ["k"], ["t"])) == [(1, "a", 1), (2, "b", 5), (3, "d", 1)]
    assert s(upkeep.insert_absent(old, new, ["k"])) == [(1, "a", 1), (2, "b", 5), (3, "d", 1)]
    assert s(upkeep.replace_groups(old, new, ["k"])) == [(1, "a", 1), (2, "c", 4), (3, "d", 1)]
    assert s(upkeep.bounded_delete(old, new, ["k"], 1)) == [(1, "a", 1)]
    assert s(upkeep.bounded_delete(old, new, ["k"], 1, dry=True)) == s(old)
    with pytest.raises(ValueError):
        upkeep.bounded_delete(old, old, ["k"], 1)


def test_sources(spark, tmp_path):
    for c, f in itertools.product("ab", "xy"):
        d = tmp_path / "t" / c / f
        d.mkdir(parents=True)
        (d / "sections.json").write_text('[{"id": 1, "text": "t"}, {"id": 2}]')
        (d / "other.json").write_text("[]")
    got = trees.json_tree(spark, str(tmp_path / "t"), "sections", "id int, text string")
    assert got.count() == 8 and {(r["company_key"], r["filing_key"]) for r in got.collect()} == set(itertools.product("ab", "xy"))
    (tmp_path / "u.json").write_text('{"0": {"cik_str": 12, "ticker": "AB", "title": "Ab Inc"}}')
    assert [tuple(r) for r in trees.universe(spark, str(tmp_path / "u.json")).collect()] == [("AB", "ab", "Ab Inc", "ab inc", "0000000012")]
    assert trees.blobs(spark, str(tmp_path / "t")).count() == 8
    assert trees.first_available(lambda: got.where("false"), lambda: got).count() == 8
    assert trees.first_available(lambda: spark.read.parquet(str(tmp_path / "missing")), lambda: got).count() == 8
    with pytest.raises(ZeroDivisionError):  # a fault is no missing source
        trees.first_available(lambda: 1 / 0, lambda: got)
    lines = [r["line"] for r in trees.csv_report([("One", spark.createDataFrame([("a,b", None)], "x string, y string"))]).collect()]
    assert lines == ["One", "x,y", '"a,b",']


def test_trees_are_replaced_whole(spark, tmp_path):
    root = str(tmp_path / "tree")
    rows = spark.createDataFrame([("a", "x", 1), ("b", "y", 2)], "company string, filing string, id int")
    assert trees.write_json_tree(rows, root, ["company", "filing"]) == 2
    assert trees.write_json_tree(rows.where("id = 1"), root, ["company", "filing"]) == 1
    assert [r["id"] for r in spark.read.json(root).collect()] == [1]
    with pytest.raises(Exception, match="broken"):
        trees.write_json_tree(rows.select("company", "filing", F.raise_error(F.lit("broken")).alias("id")), root, ["company", "filing"])
    assert [r["id"] for r in spark.read.json(root).collect()] == [1] and [p.name for p in tmp_path.iterdir()] == ["tree"]


def test_load_and_blobs(spark, tmp_path):
    d = tmp_path / "t" / "a" / "x"
    d.mkdir(parents=True)
    (d / "sections.json").write_text('[{"id": 1}, {"id": 2}]')
    (d / "empty.json").write_text("[]")
    assert trees.load_tree(spark, str(tmp_path / "t"), str(tmp_path / "out"), {"sections": "id int", "empty": "id int"}) == {"sections": 2, "empty": 0}
    assert spark.read.parquet(str(tmp_path / "out" / "sections.parquet")).count() == 2
    trees.put_blob(spark, str(tmp_path / "b"), "a", "x", "doc.html", b"old")
    trees.put_blob(spark, str(tmp_path / "b"), "a", "x", "doc.html", b"new")
    assert [(r["name"], bytes(r["content"])) for r in trees.blobs(spark, str(tmp_path / "b")).collect()] == [("doc.html", b"new")]
    assert trees.delete_blob(spark, str(tmp_path / "b"), "a", "x", "doc.html")
    assert not trees.delete_blob(spark, str(tmp_path / "b"), "a", "x", "doc.html")


def test_scratch_is_deleted(spark):
    import pathlib

    from ledgerloom.session import cut, scratch, shared_dir

    folder = pathlib.Path(shared_dir(spark).removeprefix("file://"))
    before = set(folder.iterdir())
    with scratch(spark):
        assert cut(spark.range(3)).count() == 3
        assert set(folder.iterdir()) > before
    assert set(folder.iterdir()) == before


def test_discovery(spark):
    blocks = spark.createDataFrame([("c", ["1-1", "1-2"], ["DEF 14A", "8-K"], ["2021-02-01", "2021-01-01"], ["a", "b"])], "k string, accessionNumber array<string>, form array<string>, filingDate array<string>, primaryDocument array<string>")
    recent = trees.submissions(blocks, "k", ["DEF 14A"])
    assert [(r["id"], str(r["filing_date"])) for r in recent.collect()] == [("11", "2021-02-01")]
    old = recent.withColumn("accession_number", F.lit("0-9")).unionByName(recent)
    assert [r["accession_number"] for r in trees.discover(recent, old, "k", 2).collect()] == ["1-1", "0-9"]
    # an archive is not read once the recent block is enough
    unread = old.withColumn("form", F.raise_error(F.lit("read")).cast("string"))
    assert [r["accession_number"] for r in trees.discover(recent, unread, "k", 1).collect()] == ["1-1"]


def test_streams_equal_batch(spark):
    folder = "/root/testdata/sf0.001"
    import os

    if not os.path.exists(folder):
        pytest.skip("no test tables")
    from ledgerloom.plans import upkeep as plans

    s = lambda df: sorted(map(str, (tuple(r) for r in df.collect())))
    gate = jobs.run_available(jobs.in_flight_gate(jobs.events(spark, folder))).select("event_id", "user_id", "started")
    assert s(gate) == s(plans.in_flight_gate(spark, folder).select("event_id", "user_id", "started"))
    batch = plans._events(spark, folder).groupBy(F.floor(F.col("at") / 1_000_000).alias("second")).count()
    last = batch.agg(F.max("second")).first()[0]
    assert s(jobs.run_available(jobs.rate_window(jobs.events(spark, folder))).where(F.col("second") < last - 1)) == s(batch.where(F.col("second") < last - 1))


def test_repeats_by_a_stream_of_several_batches(spark, tmp_path):
    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    # kept unless the event before is within ten minutes, whether or not that one was kept
    minutes = [0, 8, 16, 27, 27, 60, 70, 81]
    rows = [(i, at(m), 1, "a", 0.0, "{}") for i, m in enumerate(minutes)] + [(100 + i, at(m), 1, "b", 0.0, "{}") for i, m in enumerate([0, 5, 500])]
    df = spark.createDataFrame(rows, jobs.EVENTS)
    folder = tmp_path / "events.parquet"
    for a, b in ((0, 20), (20, 65), (65, 999)):  # three files in order of time
        part = df.where((F.col("ts") >= F.lit(at(a))) & (F.col("ts") < F.lit(at(b))))
        part.coalesce(1).write.mode("append").parquet(str(folder))
    want = [0, 3, 5, 7, 100, 102]
    assert sorted(r["event_id"] for r in jobs.run_available(jobs.first_in_ten_minutes(jobs.events(spark, str(tmp_path)))).collect()) == want
    assert sorted(r["event_id"] for r in jobs.run_available(jobs.first_in_ten_minutes(jobs.events(spark, str(tmp_path), 1))).collect()) == want
    empty = tmp_path / "none"
    df.limit(0).write.parquet(str(empty / "events.parquet"))
    assert jobs.run_available(jobs.first_in_ten_minutes(jobs.events(spark, str(empty)))).count() == 0


def test_key_deleted_and_created_again(spark):
    refs = spark.createDataFrame([("k", DAY(5), 1), ("k", DAY(9), 2)], "key string, at timestamp, id int")
    there = spark.createDataFrame([("k", DAY(1), 1), ("k", DAY(1), -1), ("k", DAY(7), 1)], "key string, at timestamp, sign int")
    deltas = orphans.reference_deltas(refs, "t", F.col("key"), F.col("at"))
    exist = orphans.existence_deltas(there, "t", F.col("key"), F.col("at"), F.col("sign"))
    rows = refs.select(F.lit("t").alias("target"), "key", "at", "id")
    for state in (orphans.fold(deltas.unionByName(exist)), orphans.fold(exist.where("exist_delta < 0"), orphans.fold(deltas.unionByName(exist.where("exist_delta > 0"))))):
        assert [r["id"] for r in orphans.orphan_rows(rows, orphans.orphan_keys(state, timed=("t",))).collect()] == [1]


def test_salted_lookup_of_hot_keys(spark, monkeypatch):
    from ledgerloom.operators import skew

    monkeypatch.setattr(skew, "LEAST", 5)
    big = spark.createDataFrame([("hot" if i % 3 else f"k{i}", i) for i in range(60)] + [(None, 99)], "k string, v int")
    small = spark.createDataFrame([("hot", 1), ("hot", 2), ("k3", 3), (None, 4)], "k string, w int")
    assert {r["k"]: r["_salts"] for r in skew.hot_keys(big, ["k"]).collect()} == {"hot": 8}
    plain = lambda df: sorted(map(str, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert plain(salted_lookup(big, small, ["k"], how)) == plain(big.join(small, "k", how))
    counts = big.groupBy("k").agg(F.count(F.lit(1)).alias("c"))
    assert plain(salted_lookup(big, small, ["k"], counts=counts, n="c")) == plain(big.join(small, "k"))
