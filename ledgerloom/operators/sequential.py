"""Operators whose result depends on an order of steps; each runs within one filing, group or pair of texts.

The functions on plain values are the definition; the DataFrame forms apply them to groups that one filing bounds.
"""

from __future__ import annotations

from collections import defaultdict, deque

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Share of the larger set from which two groups count as one.
OVERLAP = 0.6
#: Word similarity above which a sentence counts as changed rather than new.
CHANGED = 0.5
PLAIN_QUOTES = str.maketrans("‘’“”", "''\"\"")


def match_groups(old: list[dict], new: list[dict]) -> list[tuple[dict | None, dict | None]]:
    """Pairs of old and new groups (``type``, ``name``): same type and name, else same type, else same name.

    Each old group is used once; new groups choose in order, and old ones left over come last.
    """
    free = list(old)
    lower = lambda g: (g["name"] or "").lower()
    out: list[tuple[dict | None, dict | None]] = []
    for g in new:
        tests = [
            lambda o: o["type"] == g["type"] and lower(o) == lower(g),
            lambda o: o["type"] == g["type"],
            lambda o: bool(lower(g)) and lower(o) == lower(g),
        ]
        found = next((o for t in tests for o in free if t(o)), None)
        if found is not None:
            free.remove(found)
        out.append((found, g))
    return out + [(o, None) for o in free]


def merge_groups(first: list[list[str | None]], second: list[list[str | None]]) -> list[list[str | None]]:
    """Lists of member ids merged in order; null stands for a member that is not resolved.

    A list of ``second`` that overlaps one at hand replaces it only as a strictly larger, wholly resolved
    superset, and is dropped otherwise; one that overlaps none is added.
    """
    if not first or not second:
        return [list(g) for g in first or second]
    out = [list(g) for g in first]
    sets = [{m for m in g if m is not None} for g in out]
    for g in second:
        ids = {m for m in g if m is not None}
        share = lambda s: len(ids & s) / max(len(ids), len(s)) if ids and s else 0.0
        at = next((i for i, s in enumerate(sets) if share(s) >= OVERLAP), None)
        if at is None:
            out.append(list(g))
            sets.append(ids)
        elif len(ids) > len(sets[at]) and ids >= sets[at] and None not in g:
            out[at], sets[at] = list(g), ids
    return out


def pack_intervals(found: list[tuple[int, int, float, str]]) -> list[tuple[int, int, float, str]]:
    """Matches ``(start, end, confidence, company)`` that neither overlap nor repeat a company: earlier, longer, surer first."""
    taken, seen, end = [], set(), -1
    for m in sorted(found, key=lambda m: (m[0], m[0] - m[1], -m[2], m[3])):
        if m[0] >= end and m[3] not in seen:
            taken.append(m)
            seen.add(m[3])
            end = m[1]
    return taken


def word_diff(old: str, new: str) -> list[tuple[str, str]]:
    """Words as same, del or ins along a longest common subsequence; a tie deletes before it inserts."""
    a, b = old.split(), new.split()
    key = lambda w: w.lower().translate(PLAIN_QUOTES)
    x, y = [key(w) for w in a], [key(w) for w in b]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            best[i][j] = best[i + 1][j + 1] + 1 if x[i] == y[j] else max(best[i + 1][j], best[i][j + 1])
    out, i, j = [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and x[i] == y[j]:
            out.append(("same", b[j]))
            i, j = i + 1, j + 1
        elif i < len(a) and (j == len(b) or best[i + 1][j] >= best[i][j + 1]):
            out.append(("del", a[i]))
            i += 1
        else:
            out.append(("ins", b[j]))
            j += 1
    return out


def sentence_diff(old: list[tuple[str, str]], new: list[tuple[str, str]]) -> list[tuple[str, str | None, str | None]]:
    """Sentences ``(key, text)`` as unchanged, changed, added or removed, with their old and new texts.

    Equal keys are paired first, the first unused old one each; then each new sentence in order takes the most
    similar old one left, if their words agree by more than half. Words in an inverted index keep
    sentences that share none from being compared.
    """
    unused = defaultdict(deque)
    for i, (k, _) in enumerate(old):
        unused[k].append(i)
    partner: list[int | None] = [unused[k].popleft() if unused[k] else None for k, _ in new]
    free = set(range(len(old))) - {i for i in partner if i is not None}
    bags = {i: set(old[i][0].split()) for i in free}
    having = defaultdict(set)
    for i, bag in bags.items():
        for w in bag:
            having[w].add(i)
    out = []
    for (k, text), i in zip(new, partner):
        if i is not None:
            out.append(("unchanged", old[i][1], text))
            continue
        bag, common = set(k.split()), defaultdict(int)
        for w in bag:
            for i in having[w]:
                if i in free:
                    common[i] += 1
        rate = lambda i: common[i] / (len(bag) + len(bags[i]) - common[i])
        best = max(common, key=lambda i: (rate(i), -i), default=None)
        if best is not None and rate(best) > CHANGED:
            free.discard(best)
            out.append(("changed", old[best][1], text))
        else:
            out.append(("added", None, text))
    return out + [("removed", old[i][1], None) for i in sorted(free)]


def gate(times: list[float], done: list[float | None], stale: float = 90.0) -> list[bool]:
    """Which requests of one key start a job: none while another is in flight, unless that one is stale."""
    out, busy_since, busy_until = [], None, None
    for t, d in zip(times, done):
        free = busy_since is None or (busy_until is not None and busy_until <= t) or t - busy_since >= stale
        out.append(free)
        if free:
            busy_since, busy_until = t, d
    return out


def grouped_matches(groups: DataFrame) -> DataFrame:
    """``match_groups`` per company over ``company_id, side, id, type, name, members array<string>``; side is old or new."""
    schema = "company_id string, old_id long, new_id long, added long, removed long, kept long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("id").to_dict("records")
        pairs = match_groups([r for r in rows if r["side"] == "old"], [r for r in rows if r["side"] == "new"])
        out = []
        for o, n in pairs:
            a, b = list(o["members"]) if o else [], list(n["members"]) if n else []
            x, y = set(a), set(b)
            out.append((rows[0]["company_id"], o and o["id"], n and n["id"], sum(m not in x for m in b), sum(m not in y for m in a), sum(m in x for m in b)))
        return pd.DataFrame(out, columns=["company_id", "old_id", "new_id", "added", "removed", "kept"]).astype({"old_id": "Int64", "new_id": "Int64"})

    return groups.groupBy("company_id").applyInPandas(run, schema)


def merged_groups(lists: DataFrame) -> DataFrame:
    """``merge_groups`` per filing over ``filing_id, path, id, members array<string>``: paths are folded in order."""
    schema = "filing_id string, place long, members array<string>"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        out: list[list[str | None]] = []
        for _, part in pdf.sort_values(["path", "id"]).groupby("path", sort=True):
            out = merge_groups(out, [list(m) for m in part["members"]])
        return pd.DataFrame({"filing_id": pdf["filing_id"].iloc[0], "place": range(len(out)), "members": out})

    return lists.groupBy("filing_id").applyInPandas(run, schema)


DIFF = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("old", T.StringType()), T.StructField("new", T.StringType())]))
WORD_OPS = T.ArrayType(T.StructType([T.StructField("op", T.StringType()), T.StructField("word", T.StringType())]))


@F.pandas_udf(DIFF)
def sentence_diff_udf(old_keys: pd.Series, old: pd.Series, new_keys: pd.Series, new: pd.Series) -> pd.Series:
    side = lambda k, t: [] if k is None else list(zip(k, t))
    return pd.Series([[dict(zip(("op", "old", "new"), x)) for x in sentence_diff(side(a, b), side(c, d))] for a, b, c, d in zip(old_keys, old, new_keys, new)])


@F.pandas_udf(WORD_OPS)
def word_diff_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "word": w} for o, w in word_diff(a or "", b or "")] for a, b in zip(old, new)])


#: Entries that a set holds at most.
MOST_ENTRIES = 25


def edit_set(entries: dict[str, bool], op: str, entry: str | None, most: int = MOST_ENTRIES) -> None:
    """Apply one edit to a set in order of insertion, ``{entry: imported}``: an entry that is there keeps its place and its mark."""
    if op == "clear":
        entries.clear()
    elif not entry:
        return
    elif op == "remove":
        entries.pop(entry, None)
    elif op == "mark" and entry in entries:
        entries[entry] = True
    elif op == "add" and entry not in entries and len(entries) < most:
        entries[entry] = False


def edit_sets(edits: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``key, place, entry, imported`` of the set that the edits ``(key, op, entry)`` of each key leave, applied in order.

    Rows stream through sorted, with the set of one key as the only state. A null or empty entry changes nothing.
    """
    kind = edits.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own, entries, fresh = None, {}, True
        rows = lambda: [(own, i + 1, e, m) for i, (e, m) in enumerate(entries.items())]
        for pdf in batches:
            out = []
            for k, op, entry in zip(pdf[key].tolist(), pdf["op"].tolist(), pdf["entry"].tolist()):
                if fresh or k != own:
                    out += rows()
                    own, entries, fresh = k, {}, False
                edit_set(entries, op, entry)
            yield pd.DataFrame(out, columns=[key, "place", "entry", "imported"])
        yield pd.DataFrame(rows(), columns=[key, "place", "entry", "imported"])

    ordered = edits.select(key, *order, "op", "entry").repartition(key).sortWithinPartitions(key, *order)
    return ordered.mapInPandas(run, f"`{key}` {kind}, place long, entry string, imported boolean")
