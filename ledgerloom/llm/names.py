"""Company names: one way of taking a written name apart, as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.operators.skew import salted_lookup
from ledgerloom.session import cut

# Legal forms and the form they stand for.
LEGAL = {
    "inc": "inc",
    "incorporated": "inc",
    "corp": "corp",
    "corporation": "corp",
    "co": "co",
    "company": "co",
    "ltd": "ltd",
    "limited": "ltd",
    "plc": "plc",
    "nv": "nv",
    "llc": "llc",
    "lp": "lp",
    "gmbh": "gmbh",
    "ag": "ag",
    "sa": "sa",
    "group": "group",
    "holdings": "holdings",
    "holding": "holdings",
    "hldgs": "holdings",
    "grp": "group",
}
# Letters with built-in accents and the plain letters they are compared as.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinoooooouuuuyy"
#: A word names a line of business if it stands in this share of the entries of the reference list, and in so many at least.
SHARE, FEWEST = 1 / 300, 10
#: Letters of a short form.
SHORTEST, LONGEST_SHORT = 2, 6


def _map(pairs: dict[str, str]) -> str:
    return "map(" + ", ".join(f"'{k}', '{v}'" for k, v in pairs.items()) + ")"


def _cleaned(column: str) -> str:
    """Lower case without accents, marks, notes, exchange symbols, former names and punctuation."""
    x = f"lower({column})"
    x = f"translate(regexp_replace({x}, '\\\\pM', ''), '{ACCENTED}', '{PLAIN}')"
    x = f"regexp_replace({x}, '\\\\((formerly|fka|f/k/a) [^)]*\\\\)', ' ')"
    x = f"regexp_replace({x}, '\\\\((nyse|nasdaq|amex)\\\\s*:[^)]*\\\\)|\\\\[[^\\\\]]*\\\\]', ' ')"
    x = f"regexp_replace({x}, '\\\\([0-9a-z]\\\\)|[*†‡^]', ' ')"
    x = f"regexp_replace({x}, '[.\\u0027’-]', '')"
    return f"trim(regexp_replace({x}, '[^\\\\pL\\\\pN&]+', ' '))"


def _symbol(column: str) -> str:
    found = f"regexp_extract(lower({column}), '\\\\((?:nyse|nasdaq|amex)\\\\s*:\\\\s*([a-z.-]+)\\\\s*\\\\)|\\\\[([a-z.-]+)\\\\]', %d)"
    return f"coalesce(nullif({found % 1}, ''), nullif({found % 2}, ''))"


def lexicon(universe: DataFrame, name: str = "name") -> DataFrame:
    """``word``: the words that name a line of business, by their share of the entries; legal forms are none.

    An entry of w words holds w of them at most, so there are at most w / ``SHARE``, however long the list is.
    """
    return universe.sparkSession.sql(
        f"""
        WITH entries AS (SELECT DISTINCT {name} AS name FROM {{u}}),
        words AS (SELECT explode(array_distinct(split({_cleaned("name")}, ' '))) AS word FROM entries)
        SELECT word FROM words WHERE length(word) > 3 AND NOT map_contains_key({_map(LEGAL)}, word)
        GROUP BY word HAVING count(*) >= greatest({FEWEST}, {SHARE} * (SELECT count(*) FROM entries))
        """,
        u=universe,
    )


def _tokenised(names: DataFrame, column: str) -> DataFrame:
    """Distinct names with their ``symbol`` and words ``ws``."""
    return names.sparkSession.sql(
        f"""
        SELECT {column} AS raw, {_symbol(column)} AS symbol,
               filter(split(coalesce({_cleaned(column)}, ''), ' '), w -> w NOT IN ('', '&', 'and', 'the')) AS ws
        FROM (SELECT DISTINCT {column} FROM {{n}})
        """,
        n=names,
    )


def _plain_stem(word: str) -> str:
    """Letters that are mistaken for others when a page is read, as the likelier ones."""
    return f"translate(replace({word}, 'rn', 'm'), '01', 'ol')"


def short_forms(typed: DataFrame, listed: DataFrame, words: DataFrame) -> DataFrame:
    """``word, sector``: short forms that are no beginning of their word, learned from the names themselves.

    Where a typed name and a listed one begin with the same word, a further word of the typed name stands for a line of
    business of the listed one if it has its first letter and all its letters in order. The line that most such
    beginnings speak for is taken. Both frames come from ``_tokenised``.
    """
    return typed.sparkSession.sql(
        f"""
        WITH t AS (
          SELECT DISTINCT {_plain_stem("get(ws, 0)")} AS first, word FROM {{typed}} LATERAL VIEW explode(slice(ws, 2, greatest(size(ws), 1))) AS word
          WHERE length(word) BETWEEN {SHORTEST} AND {LONGEST_SHORT} AND NOT map_contains_key({_map(LEGAL)}, word)),
        e AS (SELECT DISTINCT {_plain_stem("get(ws, 0)")} AS first, word AS sector FROM {{listed}} LATERAL VIEW explode(slice(ws, 2, greatest(size(ws), 1))) AS word),
        l AS (SELECT e.first, e.sector FROM e JOIN {{words}} w ON w.word = e.sector),
        votes AS (
          SELECT t.word, l.sector, count(*) AS n FROM t JOIN l ON t.first = l.first
          WHERE t.word <> l.sector AND left(t.word, 1) = left(l.sector, 1) AND NOT startswith(l.sector, t.word)
            AND l.sector RLIKE array_join(split(t.word, ''), '.*')
          GROUP BY t.word, l.sector)
        SELECT word, max_by(sector, struct(n, sector)) AS sector FROM votes GROUP BY word
        """,
        typed=typed,
        listed=listed,
        words=words,
    )


def word_meanings(words: DataFrame, sectors: DataFrame, learned: DataFrame) -> DataFrame:
    """``word, sector, later``: of the distinct ``words`` those that stand for a line of business of ``sectors``.

    A word is such a line, or the beginning of one, or a learned short form, or one typed with up to two slips, found by the
    pigeonhole join. Where several lines fit equally well, ``sector`` holds all, parted by bars. Where a name begins with the word it means the line if
    ``later`` is 0, only beside a word that names no line if it is 1, and never if it is 2.
    """
    from ledgerloom.llm.canonical import stem_candidates

    slips = stem_candidates(words.selectExpr("word AS stem").where("length(word) > 5"), sectors.selectExpr("word AS stem"))
    return words.sparkSession.sql(
        f"""
        WITH ways AS (
          SELECT w.word, w.word AS sector, 0 AS way, 0 AS edits FROM {{w}} w JOIN {{s}} s ON s.word = w.word
          UNION ALL
          SELECT w.word, p.sector, CASE WHEN length(w.word) > 3 THEN 1 ELSE 2 END, 0
          FROM {{w}} w JOIN (SELECT word AS sector, explode(transform(sequence(3, least({LONGEST_SHORT}, length(word) - 1)), n -> left(word, n))) AS start FROM {{s}}) p ON p.start = w.word
          UNION ALL
          SELECT w.word, l.sector, 3, 0 FROM {{w}} w JOIN {{l}} l ON l.word = w.word
          UNION ALL
          SELECT typed, listed, 4, edits FROM {{slips}}),
        every AS (SELECT word, collect_set(struct(way, edits, sector)) AS ws FROM ways GROUP BY word),
        best AS (SELECT word, array_min(ws) AS b, ws FROM every)
        SELECT word, array_join(array_sort(transform(filter(ws, w -> w.way = b.way AND w.edits = b.edits), w -> w.sector)), '|') AS sector,
               CASE WHEN b.way < 2 THEN 0 WHEN b.way < 4 THEN 1 ELSE 2 END AS later
        FROM best
        """,
        w=words,
        s=sectors,
        l=learned,
        slips=slips,
    )


def parts(names: DataFrame, column: str, universe: DataFrame, sectors: DataFrame | None = None, name: str = "name", persist=cut) -> DataFrame:
    """``raw`` with ``stem``, ``sectors`` and ``legal`` (sorted arrays) and ``symbol`` of each distinct name.

    The stem is what neither a line of business nor a legal form claims, run together, so a stem that was
    torn apart or hyphenated is whole again; ``0`` and ``1`` inside it are read as letters. A word that may stand for several
    lines of business gives them parted by bars. Null and empty names have an empty stem. Each distinct word is looked up once.
    ``sectors`` is the stored lexicon of ``universe``, if it is at hand.
    """
    sectors = persist(lexicon(universe, name)) if sectors is None else sectors
    tokens = persist(_tokenised(names, column))
    learned = short_forms(tokens, _tokenised(universe, name), sectors)
    placed = tokens.selectExpr("raw", "posexplode(ws) AS (i, word)")
    legal = f"map_contains_key({_map(LEGAL)}, word)"
    meanings = word_meanings(placed.where(f"NOT {legal}").select("word").distinct(), sectors, learned)
    read = salted_lookup(placed, meanings, ["word"], "left")
    return names.sparkSession.sql(
        f"""
        WITH tagged AS (
          SELECT raw, i, word, CASE WHEN {legal} THEN 'l' WHEN sector IS NULL THEN 'n' WHEN i = 0 AND later = 2 THEN 'n' WHEN i = 0 AND later = 1 THEN '?' ELSE 's' END AS kind,
                 CASE WHEN {legal} THEN element_at({_map(LEGAL)}, word) ELSE sector END AS means FROM {{read}}),
        whole AS (SELECT raw, array_sort(collect_list(struct(i, word, kind, means))) AS ws FROM tagged GROUP BY raw),
        settled AS (
          SELECT raw, transform(ws, w -> CASE WHEN w.kind = 'n' OR (w.kind = '?' AND NOT exists(ws, v -> v.kind = 'n')) THEN struct('n' AS kind, w.word AS word)
            WHEN w.kind = 'l' THEN struct('l' AS kind, w.means AS word) ELSE struct('s' AS kind, w.means AS word) END) AS tagged FROM whole),
        every AS (SELECT t.raw, t.symbol, coalesce(w.tagged, array()) AS tagged FROM {{tokens}} t LEFT JOIN settled w ON w.raw <=> t.raw)
        SELECT raw, symbol, {_plain_stem("array_join(transform(filter(tagged, t -> t.kind = 'n'), t -> t.word), '')")} AS stem,
          array_sort(array_distinct(transform(filter(tagged, t -> t.kind = 's'), t -> t.word))) AS sectors,
          array_sort(array_distinct(transform(filter(tagged, t -> t.kind = 'l'), t -> t.word))) AS legal
        FROM every
        """,
        read=read,
        tokens=tokens,
    )


def covered(a: str, b: str) -> str:
    """Whether each line of business of ``a`` may be one of ``b``."""
    return f"forall({a}, x -> exists({b}, y -> arrays_overlap(split(x, '[|]'), split(y, '[|]'))))"
