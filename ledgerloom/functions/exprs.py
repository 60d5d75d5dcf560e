"""Column functions for values kept as text: numbers, names, cells, ratios. All stay inside Catalyst."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space that the text functions treat as one kind, and letters that make a word.
SPACE = "[\\t-\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF]"
WORD_END = "(?![A-Za-z0-9_])"
# Trailing legal forms that names are compared without.
NAME_SUFFIXES = ["incorporated", "corporation", "limited", "holdings", "holding", "company", "companies", "international", "group", "and co", "plc", "llc", "ltd", "inc", "corp", "co", "sa", "nv", "ag"]
# Exchanges whose symbol may follow a name in brackets.
EXCHANGES = ["NYSE", "NASDAQ", "NSE", "AMEX", "OTC", "TSX", "LSE", "TSE", "OTCBB", "OTCQB", "OTCQX"]
# Titles that may trail a name.
TITLES = ["co-", "Chief", "President", "Senior Vice President", "SVP", "EVP", "Chairman", "Chair", "Officer"]


def collapse(c: Column) -> Column:
    """White space of any kind as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def half_up(c: Column) -> Column:
    """Round to a whole number, halves toward positive infinity."""
    return F.floor(c + 0.5)


def scaled_number(c: Column) -> Column:
    """Number at the start of a text, times million, billion or trillion if named; null if there is none."""
    text = F.trim(F.regexp_replace(c, "[,$]", ""))
    rule = rf"(?i)^([+-]?\d+(?:\.\d+)?)\s*(billion|million|trillion)?{WORD_END}"
    number = F.expr("try_cast(null as double)")
    digits, scale = F.regexp_extract(text, rule, 1), F.lower(F.regexp_extract(text, rule, 2))
    number = F.when(digits != "", digits).try_cast("double")
    return number * F.when(scale == "billion", 1e9).when(scale == "million", 1e6).when(scale == "trillion", 1e12).otherwise(1.0)


def plain_number(c: Column) -> Column:
    """A text that is a number once commas and dollar signs are gone; blank is 0, empty and anything else null."""
    text = F.trim(F.regexp_replace(c, "[,$]", ""))
    number = F.when(text.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"), text).try_cast("double")
    return F.when(c == "", F.lit(None)).when(text == "", 0.0).otherwise(number)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent; 0 of nothing."""
    return F.when(whole == 0, 0.0).otherwise(part / whole * 100)


def change_percent(new: Column, old: Column) -> Column:
    """Change against ``old`` in percent; null without both values or against 0."""
    return F.when(new.isNotNull() & old.isNotNull() & (old != 0), (new - old) / old * 100)


def direction(pct: Column) -> Column:
    """up or down beyond one percent, else flat."""
    return F.when(pct > 1, "up").when(pct < -1, "down").when(pct.isNotNull(), "flat")


def display_name(c: Column) -> Column:
    """A name without one trailing title."""
    return F.trim(F.regexp_replace(c, f"(?i){SPACE}*(?:{'|'.join(TITLES)}){SPACE}*$", ""))


def company_key(c: Column) -> Column:
    """A company name for comparison: no exchange symbol in brackets, punctuation or trailing legal forms; a bare form gives the empty string."""
    x = F.lower(F.regexp_replace(c, rf"(?i)\((?:{'|'.join(EXCHANGES)})\s*[:.-]?\s*[A-Z0-9.-]{{1,8}}\)", " "))
    x = F.trim(F.regexp_replace(x, "[^a-z0-9]+", " "))
    return F.trim(F.regexp_replace(x, f"(?:(?:^| )(?:{'|'.join(NAME_SUFFIXES)}))+$", ""))


def ticker_shape(c: Column) -> Column:
    return F.trim(c).rlike(r"^[A-Za-z][A-Za-z0-9.\-]{0,7}$")


def pay_ratio(c: Column) -> Column:
    """A ratio in the form "N to 1", whichever side has the 1; "N times" is a ratio too, anything else stays."""
    sides = F.regexp_extract_all(c, F.lit(r"\d[\d,]*(?:\.\d+)?"), F.lit(0))
    other = F.when(F.element_at(sides, -1) == "1", F.get(sides, 0)).when(F.get(sides, 0) == "1", F.element_at(sides, -1))
    times = F.when((F.size(sides) == 1) & c.rlike(r"(?i)^\s*[\d,.]+\s*times"), F.get(sides, 0))
    two = F.when(F.size(sides) == 2, F.coalesce(F.concat(other, F.lit(" to 1")), F.array_join(sides, " to ")))
    return F.coalesce(F.concat(times, F.lit(" to 1")), two, c)


def csv_cell(c: Column) -> Column:
    """A text as a CSV cell; a leading formula sign is disarmed, and quotes are set where needed."""
    text = F.coalesce(c, F.lit(""))
    safe = F.when(text.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), text)).otherwise(text)
    return F.when(safe.rlike('[,"\n\r]'), F.concat(F.lit('"'), F.replace(safe, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(safe)


def is_ceo(c: Column) -> Column:
    """Strict test of a position for the chief executive; words run together are taken apart first."""
    apart = F.regexp_replace(F.regexp_replace(c, "([a-z])([A-Z])", "$1 $2"), "(?i)(officer|president|chairman|director)(and|of|or|the)" + WORD_END, "$1 $2")
    named = apart.rlike(r"(?i)chief\s+executive\s+officer|co-ceo")
    return F.coalesce(named | c.rlike("(?<![A-Z])CEO(?![A-Z])"), F.lit(False))


def role_rank(c: Column) -> Column:
    """0 for the chief executive, 1 for the chief financial officer, else 2."""
    return F.when(is_ceo(c), 0).when(c.rlike(r"(?i)chief\s+financial\s+officer|(?<![A-Z])CFO(?![A-Z])"), 1).otherwise(2)


# Words before a number that hedge it, and values that go by another name.
HEDGES = ["over", "approximately", "about", "around", "nearly", "more than", "less than", "under"]
VALUE_NAMES = {"maximum number": "maximum vesting", "maximum payout opportunity": "maximum payout"}


def clean_value(c: Column) -> Column:
    """An extracted value read as hedge, sign, number, unit and rest, and put together without the hedge and inner spaces."""
    x = collapse(c)
    rule = rf"(?i)^(?:(?:{'|'.join(HEDGES)}) )?(\$?) ?(\d[\d,]*(?:\.\d+)?)(?: ?(%|(?:st|nd|rd|th)\b))?(.*)$"
    read = F.concat(*[F.regexp_extract(x, rule, i) for i in (1, 2, 3, 4)])
    names = F.create_map(*[F.lit(v) for kv in VALUE_NAMES.items() for v in kv])
    return F.when(read != "", read).otherwise(F.coalesce(F.try_element_at(names, F.lower(x)), x))


def value_kind(c: Column) -> Column:
    low = F.lower(c)
    return F.when(F.contains(low, F.lit("percentile")), "percentile").when(F.startswith(c, F.lit("$")), "currency").when(F.contains(c, F.lit("%")), "percent").otherwise(F.when(c.isNotNull(), "other"))


def hide_flagged(review: Column, verification: Column) -> Column:
    """True for rows that may be shown."""
    return ~((review == "flagged") | (verification == "rejected"))


def html_text(c: Column) -> Column:
    """Text of markup: tags become spaces, five entities are resolved, white space is collapsed."""
    x = F.regexp_replace(c, "<[^>]*>", " ")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        x = F.replace(x, F.lit(entity), F.lit(plain))
    return collapse(x)


@F.pandas_udf(T.StringType())
def _decomposed(c: pd.Series) -> pd.Series:
    """Compatibility decomposition; Spark has no normal forms."""
    return c.map(lambda x: unicodedata.normalize("NFKD", x), na_action="ignore")


def plain_name(c: Column) -> Column:
    """A name in lower case with "and" and "plus" for their signs, and blanks for all but a-z and 0-9; decomposed first where it is not plain."""
    plain = c.rlike("^[ -~]*$")
    x = F.when(plain, c).otherwise(_decomposed(F.when(~plain, c)))
    x = F.replace(F.replace(x, F.lit("&"), F.lit(" and ")), F.lit("+"), F.lit(" plus "))
    return F.trim(F.regexp_replace(F.lower(x), "[^a-z0-9]+", " "))
