"""The rules for facts in filings, as data: what is looked for, how an excerpt is cut, what speaks for it.

Sentence forms are written with a few signs: a blank is any white space, ``~n`` a gap of up to n characters without a full stop,
``~~n`` one with any characters, and ``{name}`` one of the kinds of value in ``KINDS``, the first of which is the value found.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

# Kinds of value.
KINDS = {
    "nth": r"\d+(?:\.\d+)?\s*(?:st|nd|rd|th)\s+percentile\b",
    "pct": r"\d+(?:\.\d+)?\s*%",
    "about": r"(?:(?:over|approximately|about|around|nearly|more than|less than|under)\s+)?\d+(?:\.\d+)?\s*%",
    "usd": r"\$\s*\d[\d,]*(?:\.\d+)?(?:\s*(?:billion|million|trillion)\b)?",
    "dollars": r"\$\s*\d{1,3}(?:,\d{3})+(?:\.\d+)?",
    "ratio": r"\d{1,5}(?:\.\d+)?\s*(?:to|:|-)\s*1\b",
    "either": r"(?:1\s*(?:-\s*to\s*-?|to|:|-)\s*\d{1,5}(?:\.\d+)?|\d{1,5}(?:\.\d+)?\s*(?:-\s*to\s*-?|to|:|-)\s*1)\b",
    "times": r"\d{1,5}(?:\.\d+)?\s+times\b",
    "none": r"no bonus payment\b",
    "most": r"maximum payout(?: opportunity)?\b",
    "number": r"maximum number\b",
}
# Words that sentence forms share.
STAFF = "median (?:compensated |annual |hourly )?(?:employee|associate|worker|teammate)"
BOSS = "(?:chief executive officer|ceos?)"
IS = "(?:was|is)(?: approximately)?"


@dataclass(frozen=True)
class Rule:
    name: str
    anchor: str
    confidence: float
    values: tuple[str, ...] = ()
    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    category: str | None = None
    plan: str | None = None
    #: An excerpt begins at the first of these that it holds.
    focus: tuple[str, ...] = ()
    #: Sentence forms that settle the value; the first form found counts.
    forms: tuple[str, ...] = ()
    #: Points for the kind of value, and for phrases beside the hints.
    kinds: tuple[tuple[str, float], ...] = ()
    extra: tuple[tuple[str, float], ...] = ()
    #: Characters after the anchor in which a value is looked for, and whether the whole surroundings come first.
    reach: int = 700
    around_first: bool = False
    #: A fact needs a value, one of these phrases if there are any, and none of those barred, unless what excuses them is there.
    needs_value: bool = False
    needs: tuple[str, ...] = ()
    barred: tuple[tuple[str, str], ...] = ()
    #: Whether an anchor alone makes a fact, or only a sentence form does.
    forms_only: bool = False


def compile_form(form: str) -> re.Pattern:
    """A sentence form as a regular expression with the group ``value``."""
    out, first = [], True
    for part in re.split(r"(\{[a-z]+\}|~~?\d+| )", form):
        if m := re.fullmatch(r"\{([a-z]+)\}", part):
            out.append(f"(?P<value>{KINDS[m[1]]})" if first else f"(?:{KINDS[m[1]]})")
            first = False
        elif m := re.fullmatch(r"(~~?)(\d+)", part):
            out.append(rf"{'.' if m[1] == '~~' else '[^.]'}{{0,{m[2]}}}?")
        else:
            out.append(r"\s+" if part == " " else part.replace(" ", r"\s+"))
    return re.compile("".join(out), re.I | re.S | re.ASCII)


# Anchors, confidences, hints and focus phrases of the policies.
POLICIES = [
    Rule("hedging", r"\bhedging\b", 0.93, positive=("prohibit", "hedging activities", "transactions in derivatives"), focus=("prohibition on hedging", "we prohibit hedging", "hedging activities")),
    Rule("pledging", r"\bpledging\b", 0.93, positive=("prohibit", "pledging", "collateral for loans", "margin accounts"), focus=("prohibition on hedging, pledging", "we prohibit short sales, transactions in derivatives, hedging, and pledging", "pledging of company securities")),
    Rule(
        "clawback",
        r"\b(?:recoupment|clawback|erroneously awarded)\b",
        0.96,
        positive=("clawback policy", "recoupment policy", "allows for recoupment", "recovery of any erroneously awarded", "recovery of annual cash incentives"),
        negative=("assisted by our stock ownership policy",),
        focus=("clawback policy", "compensation recoupment policies", "recoupment policy", "recovery of any erroneously awarded"),
    ),
    Rule(
        "stock_ownership_guidelines",
        r"\b(?:(?:stock |share |equity )?ownership (?:guidelines?|policy|requirements?)|stockholding (?:guidelines?|policy|requirements?)|share retention|executive stock ownership|minimum (?:share |stock |equity )?holdings)\b",
        0.94,
        positive=(
            "stock ownership guidelines", "stock ownership policy", "maintain significant ownership", "requiring stock ownership", "15x base salary", "ten times annual base salary",
            "reinforces the alignment", "robust stock ownership policy", "share retention", "share ownership requirements", "equity ownership requirements", "ownership requirements",
            "minimum holdings", "minimum share holdings", "minimum stock holdings", "minimum equity holdings", "stockholding guidelines", "executive stock ownership",
        ),
        negative=("assisted by our stock ownership policy", "risk-taking", "compensation recovery"),
        focus=(
            "stock ownership guidelines", "maintain a robust stock ownership policy", "maintain a stock ownership policy", "our executives are subject to stock ownership guidelines", "share retention",
            "share ownership requirements", "equity ownership requirements", "ownership requirements", "stockholding guidelines", "executive stock ownership", "minimum holdings",
        ),
        extra=(("maintain", 0.75),),
    ),
    Rule(
        "change_in_control",
        r"\bchange[ -](?:in|of)[ -]control\b",
        0.92,
        positive=("no change in control payments", "no change of control payments", "not entitled to acceleration", "not entitled to payments", "none of our named executive officers is entitled"),
        focus=("no change in control payments", "no change of control payments", "none of our named executive officers is entitled"),
    ),
    Rule(
        "compensation_consultant",
        r"\b(?:compensation|independent) consultant\b",
        0.86,
        positive=("independent compensation consultant", "retains an independent compensation consultant", "engages an independent compensation consultant"),
        focus=("independent compensation consultant", "retain an independent compensation consultant", "retains an independent compensation consultant", "engages an independent compensation consultant"),
        extra=(("independent", 1.0),),
    ),
    Rule("compensation_committee", r"\b(?:(?:[a-z]+,? (?:and |& )?){0,4}compensation(?:[,&\s]+(?:and\s+)?[a-z]+){0,4}?(?:\s+\([a-z]+\))?|human capital) committee\b", 0.85),
]
#: Points for a normalised value that settles a policy.
SETTLED = {"change_in_control": ("none", 2.0), "hedging": ("prohibited", 1.5), "pledging": ("prohibited", 1.5)}
# First words of committee names, and words that no committee's name holds.
COMMITTEES = [
    "Human Capital Management and", "Leadership Development, Inclusion and", "Leadership Development and", "Human Resources and", "Human Capital and", "Management Development and", "Talent Development and",
    "People and", "Talent and", "Personnel and", "Executive", "HR and", "Compensation and Talent", "Compensation and Leadership Development",
]
NO_COMMITTEE = [
    "Risk", "Assessment", "Considerations", "Recoupment", "Recovery", "Audit", "Report", "Charter", "Process", "Discussion", "Analysis", "Disclosure", "Policy", "Practices", "Program", "Plan", "Plans",
    "Decision", "Decisions", "Determination", "Determinations", "Approval", "Review", "Consultant", "Consultants", "The",
]

NTH, PCT, ABOUT, USD, RATIO, DOLLARS = (KINDS[k] for k in ("nth", "pct", "about", "usd", "ratio", "dollars"))
MIX = ("each named executive officer", "other neos’ long-term equity award mix", "other neos' long-term equity award mix", "100% of our ceo")
VESTED = ("vested in", "vested on", "vested upon", "earned prsu shares vested", "maximum number of performance-based rsus", "maximum vesting")
TSR_RESULT = ("was at the", "based on this result", "achieving a relative total shareholder return at the", "our tsr relative to", "our tsr for the", "relative total shareholder return modifier payout")
HIGHLIGHTS = "fiscal year 20\\d\\d business performance(?: highlights)?(?: percentages are year-over-year)? revenue operating income net income diluted earnings per share"
# Anchors, kinds of value, hints, focus phrases, sentence forms and points of the metrics.
METRICS = [
    Rule(
        "relative_tsr", r"\brelative\s+(?:tsr|total\s+shareholder\s+return)\b", 0.95, (NTH, PCT),
        ("percentile", "s&p 500", "peer group index", "modifier", "was at the", "based on this result", "achieving a relative total shareholder return at the", "our tsr relative to", "our tsr for the"),
        ("must be above", "at or above the", "require outperformance", "to earn target payouts", "performance levels and payout scales", "open performance periods", "may be earned", "will be determined following the end"),
        "shareholder_return", "long_term_incentive",
        focus=("our tsr relative to", "our tsr for the", "total shareholder return relative to", "achieving a relative total shareholder return at the", "relative total shareholder return modifier payout"),
        forms=("achieving a relative total shareholder return at the {nth}", r"\bour tsr\b~~280 was at the {nth}", r"relative total shareholder return modifier payout\b~~240\b{nth}", r"\brelative tsr\b~~240 (?:was at|above) the {nth}"),
        kinds=(("percentile", 3.0), ("percent", 0.75)), needs_value=True, needs=TSR_RESULT,
    ),
    Rule(
        "tsr", r"\btotal\s+shareholder\s+return\b", 0.88, (PCT, NTH, USD), ("cumulative", "shareholder return", "through june", "market capitalization", "ceo tenure"), (),
        "shareholder_return", "long_term_incentive",
        forms=(r"\bcumulative total shareholder return\b~~400\b{about}", "fiscal year 20\\d\\d total shareholder return of {about}"),
        kinds=(("percent", 2.8), ("percentile", 1.5)), extra=(("cumulative total shareholder return", 0.8), ("relative tsr", -1.75)), forms_only=True,
    ),
    Rule(
        "revenue", r"\b(?:revenue|net\s+sales)\b", 0.88, (USD, PCT),
        ("strong financial performance", "financial performance", "strong business execution", "business performance highlights", "total revenue", "all-time revenue record", "reported net sales", "reported revenue"),
        ("peer group", "selection criteria", "minimum revenue", "market capitalization", "threshold", "talent competitor", "incentive plan revenue", "microsoft cloud revenue", "linkedin revenue", "search and news advertising revenue", "xbox content and services revenue"),
        "financial", "annual",
        forms=(f"{HIGHLIGHTS} {{usd}}", "all-time revenue record of {usd}", "total revenue of {usd}", "reported (?:net sales|revenue) of {usd}", "tripling revenue to {usd}"),
        kinds=(("currency", 3.2), ("percent", -0.75)), extra=(("minimum revenue", -3.0), ("cloud revenue", -1.8)),
    ),
    Rule(
        "operating_income", r"\boperating\s+income\b", 0.90, (USD, PCT), ("strong financial performance", "financial performance", "business performance highlights", "operating income results"),
        ("peer group", "selection criteria", "incentive plan operating income"), "financial", "annual",
        forms=(rf"{HIGHLIGHTS} \$[\d.]+(?: billion| million| trillion)? {{usd}}", "operating income results of {usd}", "reported operating income of {usd}"),
        kinds=(("currency", 3.2), ("percent", -0.75)),
    ),
    Rule(
        "annual_incentive_payout", r"\b(?:cash\s+incentive\s+plan|bonus\s+plan|overall\s+bonus|company\s+performance\s+percentage)\b", 0.90, (PCT,),
        ("maximum payout", "company performance percentage", "cash incentive plan", "bonus payouts", "bonus payouts equal to", "no bonus payment", "overall bonus", "payout under", "award funding of", "translated into award funding"),
        ("say on pay", "target cash incentive", "target bonus percentage", "target bonus opportunit", "cash bonus opportunity", "base salary", "multiplied by", "required for 100% payout", "for 100% payout", "threshold financial performance"),
        "annual_incentive", "annual",
        focus=("bonus payouts equal to", "received no bonus payment", "resulting in a maximum payout", "final cash incentive plan payout", "weighted payout", "company performance percentage", "overall bonus", "award funding of"),
        forms=(
            r"\b{pct} payout under (?:our )?(?:\d{4} )?(?:annual )?(?:variable cash plan|cash incentive plan)", r"award funding of {pct}~~160(?:acip|cash incentive plan)\b", "final cash incentive plan payout of {pct}",
            "weighted payout of {pct}(?= as a percentage of target)", "overall bonus: {pct}", "bonus payouts equal to {pct}", "(?:approved|determined) (?:a )?company performance percentage of {pct}", "received {none}", "resulting in a {most}~~140 cash incentive plan",
        ),
        kinds=(("percent", 1.4),), reach=120, needs_value=True,
        barred=(("target bonus opportunit", "bonus payouts equal to"), ("cash bonus opportunity", "no bonus payment"), ("multiplied by", "no bonus payment")),
    ),
    Rule(
        "performance_rsu_vesting", r"\bperformance-based\s+(?:rsus?|equity\s+awards?)\b", 0.90, (PCT,), ("vested in", "target performance-based rsus", "maximum number of performance-based rsus"), ("subject to performance-based vesting",),
        "equity", "long_term_incentive", focus=("as a result", *VESTED), kinds=(("percent", 1.6),), needs_value=True, needs=VESTED,
        forms=("vested in {pct} of the target performance-based rsus?", "vested in the {number} of performance-based rsus?", r"\b{pct} of the target prsus?\b~~220\bvested\b"),
    ),
    Rule(
        "performance_equity_mix", r"\bperformance-based\s+(?:rsus?|stock\s+award)\b", 0.84, (PCT,), ("each named executive officer", "performance-based and", "other named executives"), ("vested in", "maximum number of performance-based rsus"),
        "equity", "long_term_incentive", focus=MIX, kinds=(("percent", 1.6),),
        forms=(r"each named executive officer~~220 of {pct} performance-based and", r"performance-based stock award \({pct} for our other named executives\)", "long-term equity award mix~~220 maintaining a {pct} performance-based weighting"),
    ),
    Rule(
        "time_equity_mix", r"\btime-based\s+(?:rsus?|stock\s+awards?)\b", 0.82, (PCT,), ("each named executive officer", "time-based rsus", "time-based vesting"), ("vested in",), "equity", "long_term_incentive", focus=MIX, kinds=(("percent", 1.6),),
        forms=(r"each named executive officer~~220 of [\d.]+% performance-based and {pct} time-based rsus?",),
    ),
    Rule(
        "say_on_pay", r"\bsay[ -]on[ -]pay\b", 0.84, (ABOUT,), ("votes cast", "in favor", "annual meeting", "advisory proposal", "shareholder vote"), ("say on frequency",), "governance", None,
        focus=("at our", "say-on-pay proposal", "say on pay proposal", "votes cast"), kinds=(("percent", 3.0),), extra=(("say on frequency", -3.0),), around_first=True,
        forms=(
            r"{about} of (?:the )?votes cast~~160\bsay on pay\b", r"{about} of (?:the )?votes cast (?:approved|supported|were in favor of|voting in favor of|in favor of)\b~~240(?:say[ -]on[ -]pay|advisory (?:resolution|vote)|neo compensation|compensation of our (?:named executive|neo))",
            "say[ -]on[ -]pay proposal (?:received|resulted in) {about} support",
        ),
    ),
    Rule(
        "ceo_pay_ratio", rf"\b(?:ceo|chief\s+executive\s+officer)\s+pay\s+ratio\b|\bpay\s+ratio\b|\bratio\s+of\s+(?:our\s+)?(?:ceo|chief\s+executive\s+officer)\b", 0.94, (RATIO,), (), (), "pay_ratio", None,
        forms=(
            rf"\bratio of ~200{BOSS}\b~200 to ~200median\b~200\b{{ratio}}", rf"\bratio of ~200median\b~200 to ~200{BOSS}\b~200 {IS} {{either}}", rf"\b20\d\d pay ratio {IS} {{ratio}}",
            "ratio of (?:these|those) amounts (?:is|was|of) {either}", rf"\bratio (?:calculated~150|set forth above|reported above)? ?{IS} {{ratio}}", "in (?:a )?ratio of (?:approximately )?{ratio}",
            "pay ratio (?:for (?:fiscal )?20\\d\\d )?(?:is|was) (?:estimated (?:to be|at) )?{ratio}", "estimated to be {ratio}", r"\bceo ~40compensation \$[\d,]+ ratio {ratio}", "pay ratio (?:of|was|is) (?:approximately )?{ratio}",
            rf"\bratio of (?:mr|mrs|ms|dr)\.~80(?:pay|compensation) to ~120median~60\b{{ratio}}", r"\bwas (?:approximately )?{times} ~60median\b",
        ),
    ),
    Rule(
        "median_employee_compensation", r"\bmedian\s+(?:compensated\s+|annual\s+|hourly\s+)?(?:employee|associate|worker|teammate)\b", 0.90, (DOLLARS,), (), (), "pay_ratio", None,
        forms=(
            rf"\b{STAFF}(?:['’]s)? (?:annual )?total(?: annual)? compensation (?:in 20\d\d )?(?:\([^)]{{0,200}}\) )?(?:was |is |of )?{{dollars}}", rf"annual total compensation (?:of|for) (?:the |our )?{STAFF}\b~150 (?:was|is) {{dollars}}",
            r"\bmedian of the (?:annual )?total compensation of all ~~120 (?:was|is) {dollars}", rf"\b{STAFF}(?:['’]s)? {{dollars}}",
        ),
    ),
]
# Labels of a row of figures that are followed by their values in the same order.
TABLE_LABELS = {"revenue": r"\brevenue\b", "operating_income": r"\boperating\s+income\b", "net_income": r"\bnet\s+income\b", "diluted_eps": r"\bdiluted\s+earnings\s+per\s+share\b"}
# An award in shares only, which means that all of it is time-based unless a performance award is named.
SHARES_ONLY = r"\bequity-based\s+compensation\s+in\s+the\s+form\s+of\s+rsus?\b"
PERFORMANCE_AWARD = r"\bperformance-based\s+(?:rsus?|stock\s+award)\b"
# What a form's value is called if the excerpt has the phrase.
PAYOUT_NAMES = (("company performance percentage", "company performance"), ("bonus payouts equal to", "of target"), ("weighted payout", "of target"), ("overall bonus", "overall bonus"))
