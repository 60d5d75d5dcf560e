"""Facts by rules, on sentences of the kinds that filings use."""

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import exprs as X
from ledgerloom.operators import factrules, rules
from ledgerloom.plans import texts

# Golden cases: name of the metric, text, value.
METRICS = [
    ("revenue", "Fiscal year 2024 business performance highlights percentages are year-over-year revenue operating income net income diluted earnings per share $416.2 billion $109.4 billion $88.1 billion $11.86 ", "$416.2 billion"),
    ("operating_income", "Fiscal year 2024 business performance highlights revenue operating income net income diluted earnings per share $416.2 billion $109.4 billion $88.1 billion $11.86 ", "$109.4 billion"),
    ("revenue", "In fiscal 2024 we delivered strong financial performance, with total revenue of $98.0 billion, up 12% year-over-year.", "$98.0 billion"),
    ("revenue", "We reported revenue of $34.9 billion for the year, reflecting strong business execution across all segments.", "$34.9 billion"),
    ("operating_income", "Our strong financial performance was driven by operating income results of $57.4 billion, a 12% increase over the prior year.", "$57.4 billion"),
    ("operating_income", "We reported operating income of $22.6 billion in fiscal 2024, demonstrating the operating leverage of our model.", "$22.6 billion"),
    ("relative_tsr", "Based on this result, our TSR relative to the S&P 500 was at the 81.20th percentile, which produced a positive relative total shareholder return modifier payout.", "81.20th percentile"),
    ("relative_tsr", "Our financial performance translated into award funding consistent with achieving a relative total shareholder return at the 65th percentile of our peer group index.", "65th percentile"),
    ("annual_incentive_payout", "The Committee approved bonus payouts equal to 132% of the total target bonus opportunity, resulting in a 132% payout under our 2024 cash incentive plan.", "132% of target"),
    ("annual_incentive_payout", "After evaluating annual performance against our pre-established metrics, the Committee approved a company performance percentage of 105% for the annual cash incentive plan.", "105% company performance"),
    ("performance_rsu_vesting", "As a result of relative performance against our peer group, the NEOs vested in 156% of the target performance-based RSUs granted in fiscal 2022.", "156%"),
    ("say_on_pay", "At our 2024 annual meeting, our say-on-pay proposal received the support of 92.2% of the votes cast in favor of the advisory resolution on NEO compensation.", "92.2%"),
    ("say_on_pay", "Our say-on-pay proposal received approximately 95% support at our 2023 annual meeting of stockholders, reflecting continued confidence.", "95%"),
    ("ceo_pay_ratio", "The ratio of the annual total compensation of our CEO to the annual total compensation of our median employee was 312 to 1 for fiscal 2024.", "312 to 1"),
    ("performance_equity_mix", "We set a long-term equity award mix for the year, maintaining a 60% performance-based weighting.", "60%"),
    ("time_equity_mix", "We set a long-term equity award mix for the year, maintaining a 60% performance-based weighting.", "40%"),
    ("time_equity_mix", "The director gets equity-based compensation in the form of RSUs.", "100%"),
    # ratio and median of one disclosure
    ("ceo_pay_ratio", "For fiscal 2025, the median of the annual total compensation of all of\n the Company's associates, other than Mr. Ashe, was $19,531, which equals the pay of our median associate. Based on this information, the CEO Pay Ratio is estimated to be 640 to 1.", "640 to 1"),
    ("median_employee_compensation", "For fiscal 2025, the median of the annual total compensation of all of\n the Company's associates, other than Mr. Ashe, was $19,531, which equals the pay of our median associate.", "$19,531"),
    ("ceo_pay_ratio", "The total compensation of our median employee for fiscal 2024 was\n $52,400. The pay ratio for fiscal 2024 is estimated at 125 to 1.", "125 to 1"),
    ("median_employee_compensation", "The total compensation of our median employee for fiscal 2024 was\n $52,400. The pay ratio for fiscal 2024 is estimated at 125 to 1.", "$52,400"),
    ("ceo_pay_ratio", "Our median associate's total annual compensation was $30,500. The ratio of our CEO's total annual\n compensation to the median associate's total annual compensation was\n 958 to 1.", "958 to 1"),
    ("median_employee_compensation", "Our median associate's total annual compensation was $30,500. Our CEO's total annual compensation was $29,200,000.", "$30,500"),
    ("ceo_pay_ratio", "The ratio of our CEO's total annual compensation to that of our\n median worker is 320 to 1.", "320 to 1"),
    ("ceo_pay_ratio", "The annual total compensation of our median employee for 2025 was $95,307. The resulting ratio of the annual total compensation of our median employee to the annual total compensation of our CEO for 2025 is 1:178.", "178 to 1"),
    ("ceo_pay_ratio", "Therefore, the ratio of Ms. Peck's pay to our median employee's\n pay was 236 to 1.", "236 to 1"),
    ("ceo_pay_ratio", "As a result, we estimate that Mr. Bakker's annual compensation was approximately 161 times\n that of Hubbell's median employee.", "161 to 1"),
    ("median_employee_compensation", "Hubbell's median employee's annual total compensation for 2025 was estimated as $64,210.", "$64,210"),
    ("ceo_pay_ratio", "The resulting ratio of Mr. Demchak's annual total\n compensation to the annual total compensation of our median employee is 226 to 1.", "226 to 1"),
    ("ceo_pay_ratio", "Median Employee Annual Total Compensation $89,658 CEO Annual Total Compensation $12,124,358 Ratio 135:1", "135 to 1"),
    ("median_employee_compensation", "Median Employee Annual Total Compensation $89,658 CEO Annual Total Compensation $12,124,358 Ratio 135:1", "$89,658"),
    ("ceo_pay_ratio", "Ms. Rumsey's compensation for 2025 was 312 times the similarly\n calculated compensation of our median employee.", "312 to 1"),
    ("ceo_pay_ratio", "The ratio of those amounts of 1-to-43 is of note. See the pay ratio.", "43 to 1"),
    # what makes no fact
    ("relative_tsr", "Relative TSR must be above the 55th percentile for target payouts.", None),
    ("annual_incentive_payout", "The cash incentive plan pays base salary multiplied by 150%.", None),
    ("tsr", "Total shareholder return was 12%.", None),
    ("performance_rsu_vesting", "Performance-based RSUs are 50% of awards.", None),
]
POLICIES = [
    ("hedging", "We prohibit our directors and executives from engaging in any hedging transactions.", "prohibited"),
    ("hedging", "Prohibition on Hedging, Pledging, and Short Sales. We prohibit short sales and transactions in derivatives of our securities.", "prohibited"),
    ("pledging", "We prohibit short sales, transactions in derivatives, hedging, and pledging by our named executive officers and directors.", "prohibited"),
    ("clawback", "Our clawback policy allows the Committee to recoup incentive compensation in the event of a restatement.", "present"),
    ("clawback", "We have adopted a recoupment policy requiring the recovery of erroneously awarded compensation.", "present"),
    ("stock_ownership_guidelines", "Our executives are subject to a share retention policy that requires them to hold shares.", "present"),
    ("stock_ownership_guidelines", "The Board has established minimum holdings for executives equal to a multiple of base salary.", "present"),
    ("change_in_control", "There are no change in control payments.", "none"),
    ("compensation_consultant", "The board retains an independent compensation consultant.", "independent"),
    ("compensation_committee", "The LEADERSHIP DEVELOPMENT AND COMPENSATION COMMITTEE met.", "Leadership Development and Compensation Committee"),
    ("compensation_committee", "The Compensation, Nominating & Governance Committee met.", "Compensation, Nominating & Governance Committee"),
    ("compensation_committee", "Our Compensation Risk Assessment The Committee reviews; the Compensation Committee agrees.", "Compensation Committee"),
]


def frame(spark, cases):
    rows = [(str(i), i, "cd_and_a", None, text) for i, (_, text, _) in enumerate(cases)]
    return spark.createDataFrame(rows, "filing_id string, id long, section_type string, heading string, text string")


def test_metrics(spark):
    got = {(r["filing_id"], r["rule"]): r["value"] for r in texts.metrics_of(frame(spark, METRICS)).collect()}
    assert {(i, n): got.get((str(i), n)) for i, (n, _, _) in enumerate(METRICS)} == {(i, n): v for i, (n, _, v) in enumerate(METRICS)}


def test_policies(spark):
    got = {(r["filing_id"], r["rule"]): r["value"] for r in texts.policies_of(frame(spark, POLICIES)).collect()}
    assert {(i, n): got.get((str(i), n)) for i, (n, _, _) in enumerate(POLICIES)} == {(i, n): v for i, (n, _, v) in enumerate(POLICIES)}


def test_another_section_answers_where_the_main_one_has_no_value(spark):
    rows = [
        ("f", 1, "cd_and_a", None, "The pay ratio is set out below."),
        ("f", 2, "ceo_pay_ratio", "Pay ratio", "Our pay ratio was 43:1."),
        ("f", 3, "say_on_pay", None, "Our pay ratio was 44:1."),
        ("g", 4, "cd_and_a", None, None),
        ("g", 5, "cd_and_a", "", ""),
    ]
    df = spark.createDataFrame(rows, "filing_id string, id long, section_type string, heading string, text string")
    assert [(r["filing_id"], r["section_id"], r["value"]) for r in texts.metrics_of(df).collect()] == [("f", 2, "43 to 1")]
    assert texts.metrics_of(df.limit(0)).count() == 0


def test_excerpts():
    rule = factrules.Rule("r", "x", 1.0)
    far = "word " * 100
    cut = lambda text: rules.policy_excerpt(rules.Marked(text), text.index("HIT"), text.index("HIT") + 3, rule)
    assert cut(f"{far}HIT {far}").startswith("word word") and len(cut(f"{far}HIT.")) == 503
    assert cut("Before. One HIT two. After.") == "One HIT two"
    assert cut("Before: • one HIT two • three") == "one HIT two"
    assert cut("Head\n\nPara one: HIT; rest") == "Para one: HIT"
    metric = lambda text: rules.metric_excerpt(rules.Marked(text), text.index("HIT"), text.index("HIT") + 3, factrules.Rule("r", "x", 1.0, focus=("zz",)))
    assert metric("Before it all. One that has the HIT with two more. After.") == "One that has the HIT with two more."
    assert metric("aa. HIT. bb") == "aa. HIT. bb"


@pytest.mark.parametrize(
    ("raw", "key"),
    [
        ("Carlisle Companies Incorporated", "carlisle"),
        ("Brown & Co.", "brown"),
        ("Inc.", ""),
        ("Company", ""),
        ("Welltower Inc. (NYSE: WELL)", "welltower"),
        ("Public Storage (nyse:psa)", "public storage"),
        ("Acme (Holdings) Inc.", "acme"),
        ("  Acuity Brands,   Inc.  ", "acuity brands"),
        ("Smith and Co", "smith"),
        ("Lincoln Electric Holdings, Inc.", "lincoln electric"),
        ("", ""),
        (None, None),
    ],
)
def test_company_keys(spark, raw, key):
    assert spark.createDataFrame([(raw,)], "c string").select(X.company_key(F.col("c"))).first()[0] == key


def test_values(spark):
    cases = {"over 95 %": "95%", "$ 5 million": "$5 million", "81.20 th percentile": "81.20th percentile", "maximum payout opportunity": "maximum payout", "about  $1,234.5": "$1,234.5", "no payout": "no payout"}
    df = spark.createDataFrame([(c,) for c in cases], "c string")
    assert {r[0]: r[1] for r in df.select("c", X.clean_value(F.col("c"))).collect()} == cases
    ratios = {"1:178": "178 to 1", "1-to-43": "43 to 1", "161 times": "161 to 1", "43 to 1": "43 to 1", "1.5 : 1": "1.5 to 1", "50-60": "50 to 60", "n/a": "n/a"}
    df = spark.createDataFrame([(c,) for c in ratios], "c string")
    assert {r[0]: r[1] for r in df.select("c", X.pay_ratio(F.col("c"))).collect()} == ratios
