"""Peer lists: runs of "Name (SYM)", runs of names that end in a legal form, lists that a text announces, and lists in tables.

Places in texts come from one pass per text: a bracket or a legal form is found, and the name is read backwards from it, word by
word. Runs, headings, validity and thresholds are windows and joins.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.operators import aliases, html
from ledgerloom.operators.runs import last_before, runs

# Legal forms, words that join parts of a name, words that begin no name, and the bounds of each kind of list.
FORMS = frozenset("inc incorporated corp corporation company companies co llc ltd limited group plc holdings holding nv".split())
JOINERS = frozenset("of and the de &".split())
NOISE = frozenset("see page table note item figure chart exhibit graph".split())
LEAST, PAIR_GAP, PAIR_NEAR, ENDED_GAP, ENDED_NEAR = 7, 600, 40_000, 250, 12_000
#: Words that a name has at most before its legal form or symbol.
WORDS = 8
# What heads or announces a list of peers, and the least members of each kind of announcement.
HEADING = re.compile(r"\b(?:compensation\s+peer|peer\s+(?:group|companies|company|set|composition)|comparator\s+group)\b", re.I)
PEERS = r"(?:peer\s+(?:group|companies)|comparator\s+group|comparison\s+group)"
ANNOUNCED = [
    ("included", 7, rf"\b{PEERS}\b[^.:]{{0,120}}?\b(?:includ(?:es|ed|ing)|compris(?:es|ed)(?:\s+of)?)\s*:?"),
    ("consisted", 3, rf"\b{PEERS}\b[^.:]{{0,120}}?\bconsist(?:s|ed|ing)\s+of\b\s*:?"),
    ("approved", 3, rf"\bapproved\b[^.:]{{0,120}}?\b{PEERS}\b[^.:]{{0,60}}?(?:\bbelow\b|:)"),
    ("selected", 3, rf"\bselected\b[^.:]{{0,120}}?\b(?:as\s+(?:our\s+)?peers|{PEERS})\b[^.:]{{0,40}}?:?"),
    ("considered", 5, r"\bconsidered\b[^.:]{0,80}?\b(?:compensation|pay)\b[^.:]{0,60}?\b(?:at|of)\s+the\s+following\b\s*:?"),
    ("following", 3, rf"\bfollowing\s+(?:\w+\s+)?(?:companies|peers)\b[^.:]{{0,80}}?:?"),
    ("list", 5, rf"\b{PEERS}\b[^.:]{{0,120}}?\b(?:are|following|as\s+follows|listed\s+below)\s*:?"),
]
ANNOUNCED = [(name, least, re.compile(rule, re.I)) for name, least, rule in ANNOUNCED]
REASON = re.compile(r"[^.\n]*\b(?:because|based\s+on|criteria|similar(?:ity)?|comparable)\b[^.\n]*\.?", re.I)
YEAR = re.compile(r"\b(?:fiscal\s+(?:year\s+)?)?(20\d\d)\b", re.I)
TYPES = [("performance_peer_group", re.compile(r"\b(?:tsr|shareholder\s+return|performance)\s+peer", re.I)), ("index", re.compile(r"\bindex\b", re.I))]
#: Blocks that a list may run on to, blocks in which its year is looked for, and the longest block that is a heading.
FOLLOWING, YEARS_WITHIN, HEAD_CHARS = 4, 3, 90
#: Elements between a heading and its table, and between an introduction and its table.
HEADED_WITHIN, INTRODUCED_WITHIN = 400, 10
_SYMBOL = re.compile(r"\(([A-Z]{1,5}(?:[.-]?[A-Z])?)\)")
_WORD = re.compile(r"\S+")


def _is_form(word: str) -> bool:
    return word.strip(".,;:()").replace(".", "").lower() in FORMS


def name_before(text: str, end: int) -> tuple[int, str] | None:
    """The start and the words of the name that ends at ``end``: read backwards while words are capitalised or join such."""
    words = list(_WORD.finditer(text, max(0, end - 160), end))
    if end > 160 and words and words[0].start() == end - 160 and not text[end - 161].isspace():
        words = words[1:]  # the first word is cut off
    taken: list[re.Match] = []
    for m in reversed(words):
        w = m.group()
        capital = w[0].isupper() and w[1:2] != ")"
        if not capital and w.lower() not in JOINERS and not _is_form(w):
            break
        after = taken[-1].group() if taken else ""
        # a comma parts names unless a legal form comes next; other marks part them unless the word is a form or initial
        if taken and (w[-1] in ";:" or (w[-1] == "," and not _is_form(after)) or (w[-1] == "." and not _is_form(w) and len(w) > 2)):
            break
        if taken and _is_form(w) and not _is_form(after) and w[-1] in ".,":
            break
        taken.append(m)
        if len(taken) > WORDS:
            break
    while taken and taken[-1].group().lower() in JOINERS:
        taken.pop()
    if not taken or taken[-1].group().strip(".,").lower() in NOISE:
        return None
    start = taken[-1].start()
    name = text[start:end].strip().rstrip(",;:")
    return (start, name) if name[0].isupper() else None


def pairs_in(text: str) -> Iterator[tuple[int, int, str, str | None]]:
    """``start, end, name, symbol`` of each "Name (SYM)"."""
    for m in _SYMBOL.finditer(text):
        if found := name_before(text, m.start()):
            yield found[0], m.end(), found[1], m[1]


def ended_in(text: str) -> Iterator[tuple[int, int, str, str | None]]:
    """``start, end, name, None`` of each name that ends in a legal form."""
    words = list(_WORD.finditer(text))
    for i, m in enumerate(words):
        follows = i + 1 < len(words) and _is_form(words[i + 1].group()) and m.group()[-1] not in ";:"
        if not _is_form(m.group()) or follows or i == 0:
            continue
        end = m.start() + len(m.group().rstrip(",;:)"))
        found = name_before(text, end)
        if found and not _is_form(found[1].split()[0]):
            yield found[0], end, found[1], None


def _places(df: DataFrame, key: str, text: str, find, names: list[str], types: str) -> DataFrame:
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *x) for k, t in zip(pdf[key], pdf[text]) if t for x in find(t)], columns=[key, *names])

    return df.select(key, text).mapInPandas(run, f"`{key}` {kind}, {types}")


def _matches(df: DataFrame, key: str, text: str, find) -> DataFrame:
    return _places(df, key, text, find, ["at", "till", "name", "symbol"], "at long, till long, name string, symbol string")


def _headings(df: DataFrame, key: str, text: str) -> DataFrame:
    return _places(df, key, text, lambda t: ((m.start(),) for m in HEADING.finditer(t)), ["mark"], "mark long")


def _once(rows: DataFrame, key: str) -> DataFrame:
    once = rows.groupBy(key, "run", "symbol").agg(F.min("at").alias("at"), F.min_by("name", "at").alias("name"))
    return once.withColumn("members", F.count(F.lit(1)).over(W.partitionBy(key, "run")))


def _below_heading(df: DataFrame, found: DataFrame, key: str, text: str, near: int) -> DataFrame:
    started = found.withColumn("start", F.min("at").over(W.partitionBy(key, "run")))
    return last_before(started, _headings(df, key, text), [key], "start", "mark", near).where("last_mark IS NOT NULL")


def symbol_runs(df: DataFrame, key: str, text: str, universe: DataFrame) -> DataFrame:
    """Members of runs of at least seven "Name (SYM)" below a peer heading, with listed symbols, each once.

    A symbol of one letter counts only if the list's name begins with the first word given. A run with fewer than
    seven members left is dropped. Null and empty texts have no run.
    """
    found = _below_heading(df, runs(_matches(df, key, text, pairs_in), [key], "at", "till", PAIR_GAP, LEAST), key, text, PAIR_NEAR)
    listed = universe.select(F.col("ticker").alias("symbol"), F.col("name").alias("listed_name")).dropDuplicates(["symbol"])
    ok = (F.length("symbol") > 1) | F.startswith(F.lower("listed_name"), F.lower(F.element_at(F.split("name", " "), 1)))
    return _once(found.join(listed, "symbol").where(ok), key).where(F.col("members") >= LEAST)


def _by_key(universe: DataFrame, key_of) -> DataFrame:
    return universe.select(key_of(F.col("name")).alias("_key"), "ticker").where("_key <> ''").groupBy("_key").agg(F.min("ticker").alias("symbol"))


def form_runs(df: DataFrame, key: str, text: str, universe: DataFrame, key_of) -> DataFrame:
    """Members of runs of at least seven names with legal forms below a peer heading that the list knows by compared name."""
    found = _matches(df, key, text, ended_in).withColumn("_key", key_of(F.col("name"))).drop("symbol")
    grouped = runs(found.join(_by_key(universe, key_of), "_key"), [key], "at", "till", ENDED_GAP, LEAST)
    return _once(_below_heading(df, grouped, key, text, ENDED_NEAR), key).where(F.col("members") >= LEAST)


def announcements(text: str) -> Iterator[tuple[str, int, str, str | None, int | None, str]]:
    """``way, least members, what follows, reason, year, type`` of each place where a text announces a list.

    What follows is the rest of its block and up to ``FOLLOWING`` blocks more. A short block that names peers is a heading; it
    announces the blocks below. The year is the one in the block, else the nearest within ``YEARS_WITHIN`` blocks.
    """
    blocks = [b.strip() for b in re.split(r"\n\s*\n", text)]
    for i, block in enumerate(blocks):
        headed = len(block) <= HEAD_CHARS and HEADING.search(block) and not block.endswith(".")
        if headed:
            way, least, rest = "headed", LEAST, ""
        else:
            hit = min(((m.end(), w, n) for w, n, rule in ANNOUNCED if (m := rule.search(block))), default=None)
            if hit is None:
                continue
            way, least, rest = hit[1], hit[2], block[hit[0] :]
        near = sorted(range(max(0, i - YEARS_WITHIN), min(len(blocks), i + YEARS_WITHIN + 1)), key=lambda j: (abs(j - i), j))
        year = next((int(m[1]) for j in near if (m := YEAR.search(blocks[j]))), None)
        kind = next((name for name, rule in TYPES if rule.search(block)), "compensation_peer_group")
        reason = REASON.search(block)
        yield way, least, "\n\n".join([rest, *blocks[i + 1 : i + 1 + FOLLOWING]]), reason.group().strip() if reason else None, year, kind


def _members(following: str, least: int, find) -> list[str]:
    """Members named in the first block, with as many of the next ones as it takes to have the least."""
    blocks = following.split("\n\n")
    for n in range(1, len(blocks) + 1):
        found = find("\n\n".join(blocks[:n]))
        if len(found) >= least:
            return found
    return []


LISTS = "way string, run long, type string, year int, reason string, members array<string>"


def _finder(listed: DataFrame):
    """A broadcast index of the listed companies and a function from a text to the ids of the companies it names, in order."""
    company = F.coalesce(F.nullif(F.trim(F.lower("ticker")), F.lit("")), "cik", F.lower("name"))
    rows = listed.where("trim(name) <> ''").select(company.alias("id"), "ticker", "name").distinct().collect()  # the list of companies, a fixed size
    shared = listed.sparkSession.sparkContext.broadcast(aliases.index(sorted(map(tuple, rows), key=str)))
    return lambda text: [c for _, _, _, c, _ in aliases.find(text, shared.value[0])]


def text_lists(df: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """Lists that a text announces, as ``key, way, run, type, year, reason, members``; equal lists of one text count once.

    ``listed(ticker, cik, name)`` is the list of companies; a member is its first name's id. Null and empty texts have none.
    """
    find = _finder(listed)

    def of(t: str) -> Iterator[tuple]:
        seen = set()
        for way, least, following, reason, year, kind in announcements(t):
            members = _members(following, least, find)
            if members and tuple(members) not in seen:
                seen.add(tuple(members))
                yield way, len(seen) - 1, kind, year, reason, members

    return _places(df, key, text, of, ["way", "run", "type", "year", "reason", "members"], LISTS)


def table_lists(df: DataFrame, key: str, markup: str, listed: DataFrame) -> DataFrame:
    """Lists in tables of markup, in the form of ``text_lists``: tables with at least seven cells that name a listed company.

    Such a table counts if a peer heading stands within ``HEADED_WITHIN`` elements above it, with no other such table between, or if
    an element that speaks of peers is among the ``INTRODUCED_WITHIN`` before it.
    """
    find = _finder(listed)

    def of(t: str) -> Iterator[tuple]:
        recent: list[tuple[int, str]] = []
        heading, place, run, inside = None, 0, 0, None
        for node in html.parse(t).walk():
            place += 1
            if inside is not None and any(a is inside for a in node.above()):
                continue
            if node.tag == "table":
                inside = node
                members = list(dict.fromkeys(c for table in html.table_cells(node)[:1] for row in table for cell in row for c in find(cell)[:1]))
                intro = next((x for at, x in reversed(recent) if place - at <= INTRODUCED_WITHIN and HEADING.search(x)), None)
                head = heading[1] if heading and place - heading[0] <= HEADED_WITHIN else None
                if len(members) >= LEAST and (head or intro):
                    about = head or intro
                    year = next((int(m[1]) for x in (about, *(x for _, x in reversed(recent))) if (m := YEAR.search(x))), None)
                    kind = next((name for name, rule in TYPES if rule.search(about)), "compensation_peer_group")
                    yield "headed table" if head else "introduced table", run, kind, year, None, members
                    run, heading = run + 1, None
                continue
            words = node.clean() if node.tag in html.HEADINGS or node.tag == "li" else ""
            if words and not any(isinstance(c, html.Node) and c.tag in (*html.BLOCKS, "table") for c in node.children):
                recent = [*recent[-INTRODUCED_WITHIN:], (place, words)]
                if len(words) <= HEAD_CHARS and HEADING.search(words):
                    heading = (place, words)

    return _places(df, key, markup, of, ["way", "run", "type", "year", "reason", "members"], LISTS)


def enumerations(df: DataFrame, key: str, text: str, universe: DataFrame, key_of, least: int = 3) -> DataFrame:
    """Members of lists that a sentence announces, known to the list by compared name rather than by alias."""

    def of(t: str) -> Iterator[tuple]:
        for i, (_, _, following, *_) in enumerate(announcements(t)):
            names = re.split(r"[;\n•]|,\s+(?!Inc|Ltd|LLC|Corp|L\.P)|\s+and\s+(?=[A-Z][a-z]+\s+[A-Z])", following.split("\n\n")[0])
            yield from ((i, j, n.strip(" .:")) for j, n in enumerate(names) if n.strip(" .:"))

    found = _places(df, key, text, of, ["run", "at", "name"], "run long, at long, name string").withColumn("_key", key_of(F.col("name")))
    return _once(found.join(_by_key(universe, key_of), "_key"), key).where(F.col("members") >= least)


def gathered(runs_found: DataFrame, key: str, way: str) -> DataFrame:
    """Runs of members in the form ``key, way, run, members``."""
    ordered = F.array_sort(F.collect_list(F.struct("at", F.lower("symbol").alias("id"))))
    return runs_found.groupBy(key, "run").agg(ordered.alias("m")).select(key, F.lit(way).alias("way"), "run", F.col("m.id").alias("members"))


def resolve_first(names: DataFrame, name: str, listed: DataFrame) -> DataFrame:
    """Each distinct name with the first company it names, or null. Null names mean none."""
    find = _finder(listed)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pdf.assign(company_id=[next(iter(find(n)), None) if n else None for n in pdf[name]])

    return names.select(name).distinct().mapInPandas(run, f"`{name}` string, company_id string")


def named_group(kind: Column, year: Column) -> Column:
    """The display name of a group: its year and its type in words."""
    return F.concat_ws(" ", year.cast("string"), F.initcap(F.translate(kind, "_", " ")))
