"""JSON texts compared as trees and brought to one form; states read off ordered tests."""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Texts longer than this are compared by the digest of their form with single spaces.
LONG = 200
SPACES = re.compile(r"\s+")


def canonical_text(text: str) -> str:
    """NFC with each run of white space as one space."""
    return SPACES.sub(" ", unicodedata.normalize("NFC", text)).strip()


def canonical_number(x: float) -> str:
    """Six significant digits, without an exponent's or fraction's idle zeros."""
    return "0" if x == 0 else f"{x:.6g}"


def leaves(value: object, path: str = "", ignored: frozenset[str] = frozenset()) -> Iterator[tuple[str, str]]:
    """``(path, value)`` of every leaf; arrays by index, keys in order, empty containers as themselves."""
    if isinstance(value, dict) and value:
        for k in sorted(value):
            if k not in ignored:
                yield from leaves(value[k], f"{path}.{k}" if path else k, ignored)
    elif isinstance(value, list) and value:
        for i, x in enumerate(value):
            yield from leaves(x, f"{path}[{i}]", ignored)
    elif isinstance(value, str):
        form = canonical_text(value) if len(value) > LONG else value
        yield path, hashlib.sha256(form.encode()).hexdigest() if len(value) > LONG else json.dumps(value, ensure_ascii=False)
    elif isinstance(value, float):
        yield path, canonical_number(value)
    else:
        yield path, json.dumps(value)


def stable_json(text: str | None, ignored: frozenset[str] = frozenset()) -> str | None:
    """JSON with sorted keys and without ignored ones; null for null and for what is no JSON."""

    def strip(x: object) -> object:
        if isinstance(x, dict):
            return {k: strip(v) for k, v in x.items() if k not in ignored}
        return [strip(v) for v in x] if isinstance(x, list) else x

    try:
        return None if text is None else json.dumps(strip(json.loads(text)), sort_keys=True, ensure_ascii=False)
    except ValueError:
        return None


@F.pandas_udf(T.StringType())
def stable_json_udf(texts: pd.Series) -> pd.Series:
    return texts.map(stable_json, na_action="ignore")


def flatten(df: DataFrame, key: str, text: str, ignored: frozenset[str] = frozenset()) -> DataFrame:
    """``key, path, value`` of all leaves; null and broken texts give no row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, t in zip(pdf[key], pdf[text]):
                try:
                    rows += [(k, p, v) for p, v in leaves(json.loads(t), "", ignored)] if t else []
                except ValueError:
                    continue
            yield pd.DataFrame(rows, columns=[key, "path", "value"])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, path string, value string")


def structural_diff(left: DataFrame, right: DataFrame, key: str, text: str, *, ignored: frozenset[str] = frozenset(), tolerated: tuple[str, ...] = ()) -> DataFrame:
    """``key, path, left, right, level`` of the leaves that differ; differences in ``tolerated`` fields are warnings."""
    a = flatten(left, key, text, ignored).withColumnRenamed("value", "left")
    b = flatten(right, key, text, ignored).withColumnRenamed("value", "right")
    field = F.regexp_extract("path", r"([^.\[\]]+)(?:\[\d+\])*$", 1)
    level = F.when(field.isin(*tolerated), "warning").otherwise("error") if tolerated else F.lit("error")
    return a.join(b, [key, "path"], "full_outer").where(~F.col("left").eqNullSafe(F.col("right"))).withColumn("level", level)


def bounded_integer(c: Column, default: int = 2, least: int = 1, most: int = 5) -> Column:
    """A parameter as a number: empty gives the default; what is no number in bounds gives null."""
    text = F.trim(F.coalesce(c, F.lit("")))
    n = F.when(text.rlike(r"^\d{1,3}$"), text).try_cast("int")
    return F.when(text == "", default).when(n.between(least, most), n)


def valid_list(c: Column, most: int, longest: int = 32) -> Column:
    """A list without repetitions, in order; null if it is empty, too long or holds a value of another shape."""
    good = (F.size(c) > 0) & (F.size(c) <= most) & F.forall(c, lambda x: (F.length(x) <= longest) & x.rlike(r"^[A-Za-z0-9.\-]+$"))
    return F.when(good, F.array_distinct(c))


def availability(in_db: Column, degraded: Column) -> Column:
    return F.when(in_db, "in_db").when(degraded, "degraded").otherwise("available")


def first_match(c: Column, tests: list[tuple[str, str]], otherwise: str) -> Column:
    """The label of the first pattern that a text matches, case ignored."""
    out = None
    for pattern, label in tests:
        hit = F.coalesce(c, F.lit("")).rlike(f"(?i){pattern}")
        out = F.when(hit, label) if out is None else out.when(hit, label)
    return out.otherwise(otherwise)


def reset_state(alive: Column, audit_ok: Column, polluted: Column, catalog_empty: Column, known: Column) -> Column:
    """Which step of a recovery is due: the tests hold in this order."""
    return (
        F.when(~alive, "blocked")
        .when(~audit_ok, "audit-failed")
        .when(~polluted & catalog_empty, "clean")
        .when(~polluted, "catalog-stale")
        .when(known, "pending-known")
        .otherwise("pending-new")
    )
