"""Names of listed companies in texts: the forms a name is written in, and which company each place means."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.sequential import pack_intervals

# Trailing legal forms, and last words that a name of two words goes without.
LEGAL = frozenset("inc incorporated corp corporation co company plc ltd limited llc lp de holdings holding group sa ag nv the".split())
SHORT_LAST = frozenset("com systems platforms technologies communications pharmaceuticals therapeutics".split())
# Words of general use, which alone name no company.
COMMON = frozenset(
    """
    above acquisition acquisitions agricultural agriculture airline airlines alcohol aligned alignment alternative alternatives american americas analysis analytics asian atlantic
    auto automotive autos bancorp bancshares bank banks below benchmark benchmarking benchmarks better beverage beverages beyond bioscience biosciences biotech biotechnology brand
    brands business businesses capital castle cci center centers chemical chemicals co commercial communication communications companies company consolidated construction
    consultant consultants consulting consumer consumers consumption container containers copper corp corporation device devices diagnostic diagnostics digital direct discovery
    dynamics eastern ebay effective effectively electric electronic electronics energy engaged engagement engagements engineered engineering enterprise enterprises entertainment
    equipment equipments equitable equities equity estate estates european express farms finance financial fintech fintechs first focus focused food foods gap general global gold
    gps greater group growth hardware health healthcare holding holdings hospitality hotel hotels inc income incomes independent independently industrial industries industry
    information informational ingredient ingredients institution institutional institutions instruments international investment investments investor investors jones laboratories
    laboratory leader leaders leading lesser light lighting lights limited logistics ltd macro main manufactured manufacturing market marketplace markets match matches materials
    media medical micro mineral minerals mining mobile motors national natural network networking networks northern online operational operations opportunities opportunity pacific
    packaging paid partners partnership payment payments perfect performance performing petroleum pharmaceutical pharmaceuticals platform platforms plc pool pools power premier
    primary product production products properties property range ranges realty reg regional relevance relevant report reporting reports residential resource resources retail
    science sciences select selected service services short shorter shortest silver smith software solution solutions southern stability stable store stores strategic street
    streets studio studios supply system systems table tables tactical technologies technology times tobacco total totals tower towers trader traders trading transaction
    transactional transactions transport transportation transports trust trustco trusts twelve universal unpaid value variety various venture ventures versus wave waves wesson
    western wholesale works
    """.split()
)
#: Symbols in brackets, which stand beside names; dotted letters, as in N.V..
SYMBOLS, DOTTED = re.compile(r"\([A-Z]{1,5}(?:\s*,\s*[A-Z]{1,5})*\)"), re.compile(r"(?<![^\W_])(?:[A-Za-z]\.){1,3}[A-Za-z](?![^\W_])\.?")
#: Confidence of initials.
INITIALS = 0.88
OUT = "{} {}, company_id string, ticker string, alias string, place long, confidence double, sharing long"


def unmarked(text: str) -> str:
    """A text in plain letters: compatible forms resolved, accents and invisible characters dropped."""
    if text.isascii():
        return text
    return "".join(c for c in unicodedata.normalize("NFKD", text) if unicodedata.category(c) not in ("Mn", "Cf"))


def written(text: str) -> list[str]:
    """Words of letters and digits in their own case; & and + are words."""
    return re.findall("[A-Za-z0-9]+", unmarked(text).replace("&", " and ").replace("+", " plus "))


def normal(text: str) -> str:
    """A text as words in lower case with one space between them."""
    return " ".join(written(text)).lower()


def tokens(name: str) -> list[str]:
    """Words of a name in their own case, dotted letters as one word."""
    joined = DOTTED.sub(lambda m: m[0].replace(".", "") + " ", unmarked(name)).replace("&", " & ")
    return re.sub(r"[^A-Za-z0-9_&\- ]+", " ", joined).split()


def stripped(name: str) -> str:
    """A name without trailing legal forms and a conjunction left dangling by them."""
    ts = tokens(name)
    for last in (LEGAL, ("&", "and")):
        while ts and ts[-1].lower() in last:
            ts.pop()
    return " ".join(ts)


def aliases(name: str) -> list[tuple[str, float]]:
    """Forms of a company name with their confidence, longest first: full, stripped, short, initials, telling word."""
    out: dict[str, float] = {}

    def add(form: str, confidence: float) -> None:
        form = normal(form)
        short = len(form) < 3 and not (len(form) == 2 and any(c.isdigit() for c in form))
        if form and not short and not COMMON.issuperset(form.split()):
            out.setdefault(form, confidence)

    add(name, 0.99)
    core = stripped(name) or name
    add(core, 0.96)
    ts = tokens(core)
    if len(ts) == 2 and ts[1].lower() in SHORT_LAST:
        add(ts[0], 0.92)
    elif len(ts) >= 2 and ts[-1].lower() == "group":
        add(" ".join(ts[:-1]), 0.92)
    initials = [t[0] for t in ts if re.fullmatch("[A-Za-z]+", t) and t.lower() not in LEGAL]
    if 3 <= len(initials) <= 5:
        add("".join(initials), INITIALS)
    telling = [w for w in normal(core).split() if len(w) > 4 and w not in COMMON]
    if len(telling) == 1 and len(telling[0]) >= 6:
        add(telling[0], 0.90)
    elif len(telling) >= 2 and len(telling[0]) >= 7:
        add(telling[0], 0.87)
    return sorted(out.items(), key=lambda a: (-len(a[0]), -a[1]))


def index(companies: Iterable[tuple[str, str | None, str]]) -> tuple[dict, dict]:
    """Aliases of ``(id, ticker, name)`` by their first word, as ``words, rank within the company, confidence, id``; and tickers by id with the number of companies by alias."""
    by_word: dict[str, list] = {}
    known: dict[str, tuple[str, str | None]] = {}
    sharing: dict[tuple[str, ...], set] = {}
    for company, ticker, name in companies:
        known[company] = (company, ticker)
        for rank, (form, confidence) in enumerate(aliases(name)):
            words = tuple(form.split())
            by_word.setdefault(words[0], []).append((words, rank, confidence, company))
            sharing.setdefault(words, set()).add(company)
    return by_word, {"known": known, "sharing": {w: len(c) for w, c in sharing.items()}}


def find(text: str, by_word: dict) -> list[tuple[int, int, float, str, str]]:
    """Companies named in a text as ``(start, end, confidence, id, alias)``, places in words from 0.

    Each company counts by the first place of the longest of its aliases that occurs; of places that overlap, the
    earlier, longer, surer one is kept. Initials count in capitals only, as they may spell a common word ("its").
    """
    own = written(SYMBOLS.sub(" ", text))
    words = [w.lower() for w in own]
    best: dict[str, tuple] = {}
    for i, w in enumerate(words):
        for form, rank, confidence, company in by_word.get(w, ()):
            if (company not in best or rank < best[company][0]) and tuple(words[i : i + len(form)]) == form and (confidence != INITIALS or own[i].isupper()):
                best[company] = (rank, i, i + len(form), confidence)
    places = [(start, end, confidence, company) for company, (_, start, end, confidence) in best.items()]
    return [(*m, " ".join(words[m[0] : m[1]])) for m in pack_intervals(places)]


def mentions(texts: DataFrame, key: str, text: str, listed: DataFrame) -> DataFrame:
    """Companies of ``listed(ticker, cik, name)`` named in each text: the alias, its place from 1 in words, its confidence, and how many companies share it."""
    spark = texts.sparkSession
    company = F.coalesce(F.nullif(F.trim(F.lower("ticker")), F.lit("")), "cik", F.lower("name"))
    rows = listed.where("trim(name) <> ''").select(company.alias("id"), "ticker", "name").distinct().collect()  # the list of companies, a fixed size
    shared = spark.sparkContext.broadcast(index(sorted(map(tuple, rows), key=str)))
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_word, about = shared.value
        for batch in batches:
            out = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                out += [(k, *about["known"][c], form, start + 1, confidence, about["sharing"][tuple(form.split())]) for start, _, confidence, c, form in find(t or "", by_word)]
            columns = list(zip(*out)) or [()] * 7
            types = [batch.schema.field(0).type, pa.string(), pa.string(), pa.string(), pa.int64(), pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[key, "company_id", "ticker", "alias", "place", "confidence", "sharing"])

    return texts.select(key, text).mapInArrow(run, OUT.format(key, kind))
