"""Text functions: sentences, shingles, offsets. Arrays that a lambda reads are bound once, so that no text is split per element."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose full stop ends no sentence.
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "St", "Inc", "Ltd", "Corp", "Co", "LLC", "LP", "LLP", "Jr", "Sr", "Bros", "Ph", "U.S", "U.K", "vs", "etc", "e.g", "i.e", "No", "Nos", "et", "al", "approx", "Reg"]
#: Characters that occur in no text: they hold the place of a protected stop and of a sentence end.
KEEP, CUT = "\u0001", "\u0002"


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once per row."""
    return F.get(F.transform(F.array(value), body), 0)


def sentences(text: Column) -> Column:
    """Sentences of a text: they end at a blank line, or at . ! ? before white space unless that stop belongs to an abbreviation."""
    x = F.replace(text, F.lit("\r\n"), F.lit("\n"))
    x = F.regexp_replace(x, "\n[\\s]*\n", CUT)
    x = F.regexp_replace(x, "[\\t-\\r  ]+", " ")
    names = "|".join(a.replace(".", "\\.") for a in ABBREVIATIONS)
    x = F.regexp_replace(x, f"(^|[^A-Za-z.])({names})\\. ", f"$1$2{KEEP} ")
    x = F.regexp_replace(x, f"([.!?]) ", f"$1{CUT}")
    parts = F.transform(F.split(x, CUT), lambda s: F.trim(F.replace(s, F.lit(KEEP), F.lit("."))))
    return F.filter(parts, lambda s: s != "")


def sentence_key(s: Column) -> Column:
    """A sentence for comparison: lower case, plain quotes, single spaces."""
    return F.trim(F.regexp_replace(F.lower(F.translate(s, "‘’“”", "''\"\"")), " +", " "))


def words(text: Column) -> Column:
    """Words of a-z and 0-9 in order."""
    return F.filter(F.split(F.regexp_replace(F.lower(text), "[^a-z0-9]+", " "), " "), lambda w: w != "")


def shingle_set(ws: Column, n: Column) -> Column:
    """Distinct runs of ``n`` words."""
    return F.when(F.size(ws) >= n, F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(ws) - n + 1), lambda i: F.array_join(F.slice(ws, i, n), " ")))).otherwise(F.array().cast("array<string>"))


def similarity_percent(a: Column, b: Column) -> Column:
    """Rounded Jaccard similarity of the shingles of two word arrays, the shingle length fitting the shorter one."""
    least = F.least(F.size(a), F.size(b))
    n = F.when(least >= 16, 8).when(least >= 6, 3).otherwise(1)

    def rate(p: Column) -> Column:
        common, every = F.size(F.array_intersect(p["x"], p["y"])), F.size(F.array_union(p["x"], p["y"]))
        return F.floor(common / every * 100 + 0.5).cast("long")

    both = bound(F.struct(shingle_set(a, n).alias("x"), shingle_set(b, n).alias("y")), rate)
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 100).when((F.size(a) == 0) | (F.size(b) == 0), 0).otherwise(both)


def offsets(text: Column, query: str) -> Column:
    """Offsets from 0 of the occurrences of ``query``, case ignored, none overlapping another."""
    quoted = "\\Q" + query.lower() + "\\E"

    def ends(parts: Column) -> Column:
        at = lambda k: F.aggregate(F.slice(parts, F.lit(1), k), F.lit(0), lambda s, p: s + F.length(p)) + (k - 1) * len(query)
        return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), at)).otherwise(F.array().cast("array<int>"))

    return bound(F.split(F.lower(text), quoted), ends)


def snippet(text: Column, at: Column, length: int, radius: int = 140) -> Column:
    """The surroundings of a hit, marked where they are cut, with single spaces."""
    start = F.greatest(at - radius, F.lit(0))
    stop = F.least(at + length + radius, F.length(text))
    inner = F.trim(F.regexp_replace(F.substr(text, start + 1, stop - start), "[\\t-\\r  ]+", " "))
    return F.concat(F.when(start > 0, F.lit("…")).otherwise(""), inner, F.when(stop < F.length(text), F.lit("…")).otherwise(""))
