"""Rules as data: anchors in section texts, an excerpt around each match, a value, a score, and the best candidate per rule.

Matching and cutting of excerpts happen per text in Python, as Spark has no expression for all matches
with their positions; values, scores, filters and the choice among candidates are column expressions and aggregates.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import factrules
from ledgerloom.operators.factrules import METRICS, POLICIES, Rule  # noqa: F401

#: Places where an excerpt may begin or end, all found in one scan of a text.
MARKS = re.compile(r"(?P<bullet>[•◦])|(?P<paragraph>\n\n)|(?P<colon>: )|(?P<semicolon>; )|(?P<stop>\.(?=\s|\Z))")


@dataclass(frozen=True)
class Edge:
    """A kind of mark, how far it may lie from the match, and how many of its characters are left out of (or kept in) the excerpt."""

    mark: str
    within: float
    skip: int


@dataclass(frozen=True)
class Cut:
    """How an excerpt is cut: of the first group of edges with a mark in reach the nearest one, else a fixed distance."""

    before: tuple[tuple[Edge, ...], ...]
    after: tuple[Edge, ...]
    back: float
    ahead: int
    longest: int
    #: In the last group, a place farther back than the first number gives way to the second.
    far: tuple[int, int] | None = None


# Marks and distances of both kinds of excerpt.
FAR = float("inf")
POLICY_CUT = Cut(
    before=((Edge("bullet", 80, 1),), (Edge("paragraph", 260, 2),), (Edge("stop", 260, 2), Edge("semicolon", 260, 2), Edge("colon", 260, 2))),
    after=(Edge("bullet", FAR, 0), Edge("stop", FAR, 0), Edge("paragraph", FAR, 0), Edge("semicolon", FAR, 0)),
    back=FAR, ahead=260, longest=900, far=(220, 160),
)
METRIC_CUT = Cut(
    before=((Edge("bullet", 220, 1), Edge("paragraph", 320, 2), Edge("colon", 260, 2), Edge("stop", 320, 1)),),
    after=(Edge("bullet", 420, 0), Edge("stop", 420, 1), Edge("paragraph", 420, 0)),
    back=220, ahead=420, longest=900,
)
ENDS = " •◦;:"
#: An excerpt shorter than this is replaced by the words around the match.
LEAST, AROUND, WIDEST = 25, 320, 1500


class Marked:
    """A text with its marks."""

    def __init__(self, text: str):
        self.text = text
        self.places: dict[str, list[int]] = {}
        for m in MARKS.finditer(text):
            self.places.setdefault(m.lastgroup, []).append(m.start())

    def excerpt(self, start: int, end: int, cut: Cut) -> str:
        left = None
        for group in cut.before:
            reached = [p + e.skip for e in group if (p := self._last(e, start)) is not None]
            if reached:
                left = max(reached)
                if cut.far and group is cut.before[-1] and start - left > cut.far[0]:
                    left = max(0, start - cut.far[1])
                break
        if left is None:
            left = 0 if cut.back == FAR else max(0, start - int(cut.back))
        reached = [p + e.skip for e in cut.after if (p := self._next(e, end)) is not None]
        right = min(reached) if reached else min(len(self.text), end + cut.ahead)
        return " ".join(self.text[left:right].split()).strip(ENDS)

    def _last(self, edge: Edge, start: int) -> int | None:
        places = self.places.get(edge.mark, ())
        at = bisect.bisect_right(places, start - max(1, edge.skip)) - 1
        return places[at] if at >= 0 and start - places[at] <= edge.within else None

    def _next(self, edge: Edge, end: int) -> int | None:
        places = self.places.get(edge.mark, ())
        at = bisect.bisect_left(places, end)
        return places[at] if at < len(places) and places[at] - end <= edge.within else None

    def around(self, start: int, end: int) -> str:
        """The words that lie wholly within ``AROUND`` characters of a match."""
        left, right = max(0, start - AROUND), min(len(self.text), end + AROUND)
        before, after = self.text[left:start], self.text[end:right]
        if left and (m := re.search(r"\s", before)):
            before = before[m.end() :]
        if right < len(self.text) and (m := re.search(r"\s\S*\Z", after)):
            after = after[: m.start()]
        return " ".join(f"{before}{self.text[start:end]}{after}".split())


def focused(rule: Rule, excerpt: str, longest: int) -> str:
    """The excerpt from the first phrase on that the rule points to."""
    low = excerpt.lower()
    return excerpt[min((i for f in rule.focus if (i := low.find(f)) >= 0), default=0) :].strip(ENDS)[:longest]


def policy_excerpt(marked: Marked, start: int, end: int, rule: Rule) -> str:
    return focused(rule, marked.excerpt(start, end, POLICY_CUT)[: POLICY_CUT.longest], POLICY_CUT.longest)


def metric_excerpt(marked: Marked, start: int, end: int, rule: Rule) -> str:
    if rule.focus:
        near = focused(rule, marked.excerpt(start, end, METRIC_CUT), METRIC_CUT.longest)
        if len(near) >= LEAST:
            return near
    return focused(rule, marked.around(start, end), WIDEST)


def _in_row(segment: str, name: str) -> str | None:
    """The amount at the place that a label has in a row of labels followed by their amounts."""
    labels = sorted((m.start(), k) for k, p in factrules.TABLE_LABELS.items() if (m := re.search(p, segment, re.I)))
    amounts = list(re.finditer(factrules.USD, segment, re.I))
    order = [k for _, k in labels]
    if len(labels) < 2 or len(amounts) < 2 or name not in order or labels[-1][0] > amounts[0].start():
        return None
    at = order.index(name)
    return amounts[at].group() if at < len(amounts) else None


def value_near(text: str, start: int, end: int, rule: Rule) -> str | None:
    """The first value by the rule's kinds after a match, else anywhere around it."""
    flat = lambda a, b: " ".join(text[max(0, a) : b].split())
    after, around, before = flat(end, end + rule.reach), flat(start - 160, end + rule.reach), flat(start - 160, start)
    if rule.name in factrules.TABLE_LABELS and (found := _in_row(around, rule.name)):
        return found
    for segment in (around, after, before) if rule.around_first else (after, around, before):
        for kind in rule.values:
            if m := re.search(rf"(?<!\w){kind}", segment, re.I | re.ASCII):
                return m.group()
    return None


def settled(text: str, rule: Rule, forms: list[re.Pattern]) -> tuple[re.Match, str, float] | None:
    """The first of the rule's sentence forms in a text, its value and its points."""
    for form in forms:
        if m := form.search(text):
            return m, m["value"], 100.0
    return None


def _time_mix(text: str, performance: list[re.Pattern]) -> tuple[re.Match, str, float] | None:
    """The time-based share as what a stated performance-based share leaves, or all of an award in shares only."""
    for form in performance:
        if m := form.search(text):
            share = 100 - float(m["value"].rstrip("% \t\n"))
            return (m, f"{share:.0f}%", 99.0) if 0 <= share <= 100 else None
    if (m := re.search(factrules.SHARES_ONLY, text, re.I)) and not re.search(factrules.PERFORMANCE_AWARD, text, re.I):
        return m, "100%", 98.0
    return None


def _named(rule: Rule, value: str, excerpt: str) -> str:
    if rule.name != "annual_incentive_payout":
        return value
    if value.lower() == "no bonus payment":
        return "no payout"
    low = excerpt.lower()
    return next((f"{value} {name}" for phrase, name in factrules.PAYOUT_NAMES if "%" in value and phrase in low), value)


def candidates(sections: DataFrame, rules: list[Rule]) -> DataFrame:
    """``filing_id, section_id, rule, position, excerpt, value, points``: every match of every rule.

    A sentence form of a rule stands for all its matches in that text, with ``points`` of its own. A heading, where
    ``sections`` has them, is read as the first paragraph. Null texts match nothing.
    """
    schema = "filing_id string, section_id long, rule string, position int, excerpt string, value string, points double"
    columns = ["filing_id", "section_id", "rule", "position", "excerpt", "value", "points"]
    text = F.concat(F.when(F.col("heading") != "", F.concat("heading", F.lit("\n\n"))).otherwise(""), "text") if "heading" in sections.columns else F.col("text")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        compiled = [(r, re.compile(r.anchor, re.I | re.ASCII), [factrules.compile_form(f) for f in r.forms]) for r in rules]
        performance = next((forms[1:] for r, _, forms in compiled if r.name == "performance_equity_mix"), [])

        def of(text: str) -> Iterator[tuple]:
            marked = Marked(text)
            for r, anchor, forms in compiled:
                metric = bool(r.values)
                cut = metric_excerpt if metric else policy_excerpt
                known = settled(text, r, forms) if forms else None
                if known is None and r.name == "time_equity_mix":
                    known = _time_mix(text, performance)
                if known:
                    m, value, points = known
                    excerpt = cut(marked, *m.span(), r)
                    yield r.name, m.start(), excerpt, _named(r, " ".join(value.split()), excerpt), points
                elif not r.forms_only:
                    for m in anchor.finditer(text):
                        yield r.name, m.start(), cut(marked, *m.span(), r), value_near(text, *m.span(), r) if metric else None, None

        for pdf in batches:
            rows = [(f, i, *x) for f, i, t in zip(pdf["filing_id"], pdf["id"], pdf["text"]) if t for x in of(t)]
            yield pd.DataFrame(rows, columns=columns)

    return sections.select("filing_id", "id", text.alias("text")).mapInPandas(run, schema)


def policy_value(rule: Column, text: Column) -> Column:
    """The normalised value that an excerpt gives a policy."""
    has = lambda s: F.contains(F.lower(text), F.lit(s))
    any_of = lambda *phrases: F.lower(text).rlike("|".join(phrases))
    none = any_of("no change of control payments", "no change in control payments", "not entitled to acceleration", "not entitled to payments", "none of our named executive officers is entitled")
    clawback = F.when(has("discretionary") & has("required"), "required_and_discretionary").when(has("discretionary"), "discretionary").otherwise("present")
    named = F.coalesce(*[F.when(text.rlike(rf"(?i)\b{re.sub('[ ,]+', '[ ,]+', q)}\s+Compensation\s+Committee\b"), f"{q} Compensation Committee") for q in factrules.COMMITTEES])
    tail = F.regexp_extract(text, r"\bCompensation((?:[,&\s]+(?:and\s+)?[A-Z][a-zA-Z]+){1,4})(?:\s+\([A-Z][A-Za-z]*\))?\s+Committee\b", 1)
    wrong = F.arrays_overlap(F.split(tail, r"[\s,&]+"), F.array(*map(F.lit, factrules.NO_COMMITTEE)))
    wide = F.when((tail != "") & ~wrong, F.concat(F.lit("Compensation"), F.regexp_replace(tail, r"\s+", " "), F.lit(" Committee")))
    plain = F.when(text.rlike(r"\bCompensation\s+Committee\b"), "Compensation Committee").when(has("human capital committee"), "Human Capital Committee")
    return (
        F.when(rule.isin("hedging", "pledging"), F.when(has("prohibit"), "prohibited"))
        .when(rule == "change_in_control", F.when(none, "none"))
        .when(rule == "clawback", clawback)
        .when(rule == "stock_ownership_guidelines", "present")
        .when(rule == "compensation_consultant", F.when(has("independent"), "independent"))
        .when(rule == "compensation_committee", F.coalesce(named, wide, plain))
    )


def metric_value(rule: Column, value: Column) -> Column:
    """A found value in its one form."""
    clean = X.clean_value(value)
    return F.when(rule == "ceo_pay_ratio", X.pay_ratio(clean)).otherwise(clean)


def score(rules: list[Rule], rule: Column, text: Column, value: Column, *, hint: float = 1.25, against: float = -2.0) -> Column:
    """1 for a value, ``hint`` for each phrase that speaks for the excerpt, ``against`` for each against it, and the rule's own points."""
    low, kind = F.lower(text), X.value_kind(value)
    total = F.when(value.isNotNull(), 1.0).otherwise(0.0)
    for r in rules:
        phrases = [(h, hint) for h in r.positive] + [(h, against) for h in r.negative] + list(r.extra)
        points = [F.when(F.contains(low, F.lit(h)), p).otherwise(0.0) for h, p in phrases] + [F.when(kind == k, p).otherwise(0.0) for k, p in r.kinds]
        if r.name in factrules.SETTLED:
            settled_value, p = factrules.SETTLED[r.name]
            points.append(F.when(value == settled_value, p).otherwise(0.0))
        if points:
            total = total + F.when(rule == r.name, sum(points, F.lit(0.0))).otherwise(0.0)
    return total


def metric_score(rule: Column, text: Column, value: Column, points: Column) -> Column:
    """The points of a sentence form, else the score by the hints of the metrics."""
    return F.coalesce(points, score(METRICS, rule, text, value, hint=1.1, against=-2.25))


def kept(rules: list[Rule], rule: Column, text: Column, value: Column) -> Column:
    """Whether a candidate makes a fact: it has the value and the phrases its rule needs and none that bars it."""
    low, fails = F.lower(text), F.lit(False)
    has = lambda s: F.contains(low, F.lit(s))
    for r in rules:
        lacks = [value.isNull()] if r.needs_value else []
        if r.needs:
            lacks.append(~F.coalesce(sum((has(p).cast("int") for p in r.needs), F.lit(0)) > 0, F.lit(False)))
        lacks += [has(p) & ~has(excuse) for p, excuse in r.barred]
        for lack in lacks:
            fails = fails | ((rule == r.name) & lack)
    return ~fails


def best(found: DataFrame, by: tuple[str, ...] = ("filing_id",)) -> DataFrame:
    """Per filing (or ``by``) and rule the candidate of the greatest score; a value, a longer value, a shorter excerpt and an earlier place decide ties."""
    order = F.struct("score", F.col("value").isNotNull(), F.length(F.coalesce("value", F.lit(""))), -F.length("excerpt"), -F.col("section_id"), -F.col("position"))
    keep = F.struct(*[c for c in ("section_id", "position", "excerpt", "value", "score") if c not in by])
    return found.groupBy(*by, "rule").agg(F.max_by(keep, order).alias("b"), F.count(F.lit(1)).alias("candidates")).select(*by, "rule", "b.*", "candidates")


@dataclass(frozen=True)
class Cascade:
    """Which rules a section of another type may still answer when the main section has no value."""

    main: str = "cd_and_a"
    scoped: dict[str, tuple[str, ...]] = field(default_factory=lambda: {"ceo_pay_ratio": ("ceo_pay_ratio", "median_employee_compensation"), "say_on_pay": ("say_on_pay",), "compensation_committee_report": ("compensation_committee",)})

    def allowed(self, section_type: Column, rule: Column) -> Column:
        test = section_type == self.main
        for kind, names in self.scoped.items():
            test = test | ((section_type == kind) & rule.isin(*names))
        return test


def cascade(found: DataFrame, sections: DataFrame, order: Cascade = Cascade()) -> DataFrame:
    """The best candidate per filing and rule, the main section first: another section counts only with a value, and only where the main one has none."""
    kinds = sections.select(F.col("id").alias("section_id"), "section_type").distinct()
    rows = found.join(kinds, "section_id").where(order.allowed(F.col("section_type"), F.col("rule")))
    main = F.col("section_type") == order.main
    rows = rows.where(main | F.col("value").isNotNull()).withColumn("stage", F.when(main & F.col("value").isNotNull(), 2).when(~main, 1).otherwise(0))
    keep = F.struct("section_id", "section_type", "position", "excerpt", "value", "score")
    place = F.struct("stage", "score", F.length(F.coalesce("value", F.lit(""))), -F.length("excerpt"), -F.col("section_id"), -F.col("position"))
    return rows.groupBy("filing_id", "rule").agg(F.max_by(keep, place).alias("b")).select("filing_id", "rule", "b.*")
