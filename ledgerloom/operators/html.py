"""Markup as tables: block nodes, sections below a heading, cells of tables, and compensation tables read from cells.

The standard parser gives events; a small tree is built per document, in Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

# Tags without content, tags that make a block, and tags that may hold a heading, best first.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = ["h1", "h2", "h3", "h4", "h5", "h6", "p", "div", "li", "ul", "ol", "table", "tr", "td", "th", "section", "article", "body", "html", "blockquote", "pre", "center"]
HEADINGS = ["h1", "h2", "h3", "h4", "p", "div", "b", "span", "td"]
#: Longest text that counts as a heading.
HEADING_CHARS = 160
SPACES = re.compile(r"\s+")


@dataclass
class Node:
    tag: str
    attrs: dict[str, str | None] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def text(self) -> str:
        out = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            elif x.tag not in ("script", "style"):
                if x.tag == "br":
                    out.append("\n")
                if x is not self and x.tag in BLOCKS:
                    out.append(" ")
                stack.extend(reversed(x.children))
        return "".join(out)

    def clean(self) -> str:
        return SPACES.sub(" ", self.text()).strip()

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            x = stack.pop()
            yield x
            stack.extend(c for c in reversed(x.children) if isinstance(c, Node))

    def above(self) -> Iterator[Node]:
        x = self.parent
        while x is not None:
            yield x
            x = x.parent


class _Tree(HTMLParser):
    """Builds nodes; a block closes an open paragraph, a cell or row an open one, and a stray end tag is ignored."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root")
        self.open = [self.root]

    def _close(self, tags: set[str], stop: set[str]) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in stop:
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._close({"p"}, {"table", "td", "th", "div"})
        if tag in ("td", "th"):
            self._close({"td", "th"}, {"table"})
        elif tag == "tr":
            self._close({"tr"}, {"table"})
        elif tag == "li":
            self._close({"li"}, {"ul", "ol"})
        node = Node(tag, dict(attrs), self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        node = Node(tag, dict(attrs), self.open[-1])
        self.open[-1].children.append(node)

    def handle_endtag(self, tag: str) -> None:
        self._close({tag}, {"table"} if tag not in ("table", "html", "body") else set())

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(html: str | None) -> Node:
    tree = _Tree()
    tree.feed(html or "")
    tree.close()
    return tree.root


def find_heading(root: Node, pattern: str) -> tuple[Node, str] | None:
    """The node that holds the heading: tags in order of rank, then the shortest, then the first; never in a link or table.

    Failing that, the target of the first link whose text matches. The second value names the way.
    """
    rule = re.compile(pattern, re.I)
    found, targets, link = [], {}, None
    for i, n in enumerate(root.walk()):
        if ident := n.attrs.get("id") or n.attrs.get("name"):
            targets.setdefault(ident, n)
        if n.tag == "a" and (n.attrs.get("href") or "").startswith("#") and link is None and rule.search(n.clean()):
            link = n.attrs["href"][1:]
        if n.tag not in HEADINGS:
            continue
        text = n.clean()
        if not text or len(text) > HEADING_CHARS or not rule.search(text):
            continue
        if any(a.tag in ("a", "table") for a in n.above()) or any(x.tag == "a" for x in n.walk()):
            continue
        found.append((HEADINGS.index(n.tag), len(text), i, n))
    if found:
        return min(found, key=lambda x: x[:3])[3], "exact-heading"
    if link is not None and link in targets:
        return targets[link], "toc-anchor"
    return None


def _collected(texts: Iterator[str], stop: re.Pattern, after: int, blocks: int, chars: int) -> str:
    """Texts of blocks up to one that looks like the next heading, once ``after`` characters are there; equal blocks count once."""
    kept: dict[str, None] = {}
    size = 0
    for text in texts:
        if not text or text in kept:
            continue
        if (size >= after and len(text) <= HEADING_CHARS and stop.search(text)) or len(kept) >= blocks or size >= chars:
            break
        kept[text] = None
        size += len(text)
    return "\n\n".join(kept)[:chars]


def _siblings(block: Node) -> Iterator[str]:
    siblings = block.parent.children if block.parent else []
    start = next((i for i, c in enumerate(siblings) if c is block), len(siblings))
    for c in siblings[start + 1 :]:
        yield SPACES.sub(" ", c).strip() if isinstance(c, str) else c.clean()


def _flow(root: Node, block: Node) -> Iterator[str]:
    """Texts of the innermost blocks after ``block`` in the order of the document, wherever they stand."""
    inside = {id(n) for n in block.walk()}
    passed = False
    for n in root.walk():
        passed = passed or n is block
        if passed and id(n) not in inside and n.tag in BLOCKS and not any(isinstance(c, Node) and c.tag in BLOCKS for c in n.children):
            yield n.clean()


def section_below(html: str | None, pattern: str, ends: str, *, after: int = 0, blocks: int = 800, chars: int = 200_000, least: int = 0) -> dict | None:
    """Heading, text, confidence and method of the section that a heading opens; null if there is no such heading.

    Siblings after the heading's block are collected until one that looks like the next heading, once ``after``
    characters are there; equal blocks count once. If that gives fewer than ``least`` characters, as where the heading has a wrapper of
    its own, the blocks that follow in the document are collected instead, if they give more. A heading without text gives less confidence.
    """
    root = parse(html)
    at = find_heading(root, pattern)
    if at is None:
        return None
    node, way = at
    block = node if node.tag in BLOCKS or node.parent is None else node.parent
    stop = re.compile(ends, re.I)
    body, method = _collected(_siblings(block), stop, after, blocks, chars), "sibling-blocks"
    if len(body) < least:
        flow = _collected(_flow(root, block), stop, after, blocks, chars)
        if len(flow) > len(body):
            body, method = flow, "document-flow"
    return {"heading": node.clean(), "text": body, "confidence": 0.9 if body else 0.55, "method": f"{way}-and-{method}" if body else "heading-only"}


def table_cells(root: Node) -> list[list[list[str]]]:
    """Tables as rows of cell texts; line breaks within a cell are kept."""
    out = []
    for t in root.walk():
        if t.tag == "table":
            rows = []
            for r in t.walk():
                if r.tag == "tr" and next((a for a in r.above() if a.tag == "table"), None) is t:
                    cells = [c for c in r.children if isinstance(c, Node) and c.tag in ("td", "th")]
                    rows.append(["\n".join(SPACES.sub(" ", x).strip() for x in c.text().split("\n")).strip() for c in cells])
            out.append(rows)
    return out


def nodes(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, node, tag, text``: block nodes in document order. Null and empty markup gives no row."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, i, n.tag, n.clean()) for k, h in zip(pdf[key], pdf[html]) for i, n in enumerate(parse(h).walk()) if n.tag in BLOCKS]
            yield pd.DataFrame(rows, columns=[key, "node", "tag", "text"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, node int, tag string, text string")


def sections(df: DataFrame, key: str, html: str, pattern: str, ends: str, **limits: int) -> DataFrame:
    """``section_below`` of every row, as ``key, heading, text, confidence, method``; rows without the heading are left out."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *s.values()) for k, h in zip(pdf[key], pdf[html]) if (s := section_below(h, pattern, ends, **limits))]
            yield pd.DataFrame(rows, columns=[key, "heading", "text", "confidence", "method"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, heading string, text string, confidence double, method string")


def cells(df: DataFrame, key: str, html: str) -> DataFrame:
    """``key, table_no, row_no, col_no, text``: every cell of every table."""
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, t, r, c, x) for k, h in zip(pdf[key], pdf[html]) for t, tab in enumerate(table_cells(parse(h))) for r, row in enumerate(tab) for c, x in enumerate(row)]
            yield pd.DataFrame(rows, columns=[key, "table_no", "row_no", "col_no", "text"])

    return df.select(key, html).mapInPandas(run, f"{key} {kind}, table_no int, row_no int, col_no int, text string")


@dataclass(frozen=True)
class SectionKind:
    """A kind of section: its heading, the headings that end it once ``after`` characters are there, and its bounds."""

    name: str
    heading: str
    ends: str
    after: int
    blocks: int
    chars: int
    heading_only: bool = False
    never: str = r"$^"


# Headings, ends and bounds of the kinds of section.
KINDS = [
    SectionKind("cd_and_a", r"compensation\s*discussion\s*(?:and|&)\s*analysis", r"^(?:(?:people and )?compensation committee report|summary compensation table|pay versus performance|grants of plan-based awards|option exercises and stock vested)$", 4_000, 800, 200_000, True),
    SectionKind("ceo_pay_ratio", r"\bpay\s+ratio\b|^ratio\s+of\s+.*compensation\s+.*median", r"^(?:pay (?:versus|for) performance|equity compensation plans?|director compensation|outstanding equity awards.*|summary compensation table|proposal\s+\w+.*|certain relationships and related transactions|security ownership.*)$", 600, 300, 60_000),
    SectionKind("say_on_pay", r"\bsay[\s-]?on[\s-]?pay\b|advisory\s+(?:vote|resolution)\s+(?:on|to\s+approve)\s+.*compensation|approval.*\sof\s+.*executive.*compensation", r"^(?:proposal\s+\d+.*|approval of.*|advisory vote on the frequency.*|report of the audit committee|audit matters|certain relationships and related transactions|director compensation|pay ratio|pay versus performance)$", 400, 120, 25_000, never=r"frequency\s+of"),
    SectionKind("compensation_committee_report", r"compensation(?:\s+[a-z&, ]+)?\s+committee\s+report$|^report\s+of\s+the\s+.*compensation.*\s+committee$", r"^(?:pay versus performance|summary compensation table|grants of plan-based awards|equity compensation plan.*|outstanding equity awards.*|director compensation|report of the audit committee|audit matters)$", 200, 40, 6_000),
]


def all_sections(df: DataFrame, key: str, html: str, kinds: list[SectionKind] = KINDS) -> DataFrame:
    """``key, section_type, heading, text, confidence, method`` of every kind that a document has; a bare heading counts only where the kind allows it."""
    key_kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, h in zip(pdf[key], pdf[html]):
                for kind in kinds:
                    rule = f"^(?!.*(?:{kind.never})).*(?:{kind.heading})"
                    found = section_below(h, rule, kind.ends, after=kind.after, blocks=kind.blocks, chars=kind.chars, least=kind.after)
                    if found and (found["text"] or kind.heading_only):
                        rows.append((k, kind.name, *found.values()))
            yield pd.DataFrame(rows, columns=[key, "section_type", "heading", "text", "confidence", "method"])

    return df.select(key, html).mapInPandas(run, f"{key} {key_kind}, section_type string, heading string, text string, confidence double, method string")


# Headers of the columns of a compensation table, and words that begin a position.
COLUMNS = [
    ("name", r"name"),
    ("year", r"year"),
    ("salary", r"salary"),
    ("bonus", r"^bonus"),
    ("stock_awards", r"stock\s*awards?"),
    ("option_awards", r"option\s*awards?"),
    ("non_equity", r"non-?\s*equity"),
    ("other", r"all\s*other"),
    ("total", r"^total(?!\s*(?:stock|compensation))"),
]
POSITION = r"(?:Chair(?:man|woman)?|Chief|President|Executive|Senior|Vice|Former|Founder|General|Officer|Co-CEO|CEO|CFO|EVP|SVP|Director|Interim)"
YEAR = re.compile(r"^(?:fy)?\s*((?:19|20)\d{2})(?:\s*[-–/]\s*(\d{2}))?$", re.I)
MONEY = re.compile(r"^\(?\$?\s*[\d,]+(?:\.\d+)?\)?$|^[—–-]$")
PERSON = re.compile(r"^[A-Z][\w.'’-]*(?:\s+[A-Z][\w.'’-]*)+")


def split_name(cell: str) -> tuple[str, str]:
    """Name and position of a cell: at a line break, at a comma before a position, or where the space between them was lost."""
    cell = cell.strip()
    lines = [x.strip() for x in cell.split("\n") if x.strip()]
    if len(lines) > 1:
        name, rest = lines[0], " ".join(lines[1:])
    elif m := re.match(rf"^(.*?[a-z.])\d*\s*,?\s*({POSITION}\b.*)$", cell):
        name, rest = m.group(1), m.group(2)
    else:
        name, rest = cell, ""
    name = re.sub(r"[\d*†]+$|\s*\(\d+\)$", "", name.strip(" ,")).strip(" ,")
    return name, rest.strip(" ,")


def _years(cell: str) -> list[int]:
    out = []
    for x in cell.split("\n"):
        if m := YEAR.match(x.strip()):
            first = int(m.group(1))
            out.append(first // 100 * 100 + int(m.group(2)) if m.group(2) else first)
    return out


def compensation_rows(html: str | None) -> list[dict]:
    """Rows ``name, position, year`` and money of the table after the words "summary compensation table".

    Names fill down; a row with one cell names the person of the rows below or adds to the position; years
    stacked in one cell give a row each; of a name and year the larger total is kept.
    """
    root, seen, chosen = parse(html), "", None
    for n in root.walk():
        for c in n.children:
            if isinstance(c, str):
                seen = (seen + c)[-400:]
        if n.tag == "table":
            heads = " ".join(x for row in (table_cells(n) or [[]])[0][:3] for x in row).lower()
            named = "summary" in (seen + heads).lower() and "compensation" in (seen + heads).lower()
            if "total" in heads and re.search("year", heads) and (named or "salary" in heads):
                chosen = table_cells(n)[0]
                break
    if not chosen:
        return []
    at: dict[str, int] = {}
    body = 0
    for i, row in enumerate(chosen[:4]):
        found = {}
        for name, rule in COLUMNS:
            for j, x in enumerate(row):
                if j not in found.values() and re.search(rule, x.replace("\n", " ").strip(), re.I):
                    found[name] = j
                    break
        if len(found) > len(at):
            at, body, width = found, i + 1, [x for x in row if x]
    best: dict[tuple[str, int], dict] = {}
    name = position = ""
    for row in chosen[body:]:
        full = [x for x in row if x.strip()]
        if not full:
            continue
        years = [(j, y) for j, x in enumerate(row) if (y := _years(x))]
        if not years:
            text = full[0]
            if len(full) <= 2 and not MONEY.match(text):
                n, p = split_name(text)
                if re.match(rf"^(?:and|&)\b|^{POSITION}\b", text):
                    position = f"{position} {text}".strip()
                elif PERSON.match(text):
                    name, position = n, p
            continue
        cells_ = full if len(full) == len(width) and len(row) != len(width) else row
        j, ys = next(((j, y) for j, x in enumerate(cells_) if (y := _years(x))), years[0])
        head = next((x for x in cells_[:j] if x.strip()), "")
        if head:
            n, p = split_name(head)
            if re.match(rf"^(?:and|&)\b|^{POSITION}\b", head):
                position = f"{position} {head}".strip()
            else:
                name, position = n, p
        money = [x for x in cells_[j + 1 :] if x.strip() and x.strip() != "$"]
        for k, year in enumerate(ys):
            pick = lambda x: (x.split("\n") + [""] * len(ys))[k].strip()  # noqa: E731, B023
            values = {c: pick(cells_[i]) for c, i in at.items() if c not in ("name", "year") and i < len(cells_) and len(cells_) >= len(width)}
            if not MONEY.match(values.get("total", "")) and money:
                values["total"] = pick(money[-1])
            number = float(re.sub(r"[^\d.]", "", values.get("total", "")) or 0)
            entry = {"name": name, "position": position, "year": year, **values}
            old = best.get((name, year))
            if name and (old is None or number > old["_n"]):
                best[name, year] = entry | {"_n": number}
    return [{k: v for k, v in r.items() if k != "_n"} for r in best.values()]


def compensation(df: DataFrame, key: str, html: str) -> DataFrame:
    """``compensation_rows`` of every document; documents without such a table give no row."""
    kind = df.schema[key].dataType.simpleString()
    money = [c for c, _ in COLUMNS if c not in ("name", "year")]
    columns = [key, "name", "position", "year", *money]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, *[r.get(c) for c in columns[1:]]) for k, h in zip(pdf[key], pdf[html]) for r in compensation_rows(h)]
            yield pd.DataFrame(rows, columns=columns)

    schema = f"{key} {kind}, name string, position string, year int, " + ", ".join(f"{c} string" for c in money)
    return df.select(key, html).mapInPandas(run, schema)
