"""Names as people typed them, mapped to the entries of a reference list.

If a typed stem lies within K edits of a listed one, then of the K + 1 segments that the listed
stem is cut into at least one stands unchanged in the typed stem, at most K places away. So candidates come
from an equality join on (length, segment, substring), every candidate is verified by the
built-in edit distance, and what no entry survives for is reported by an anti-join. SQL only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.llm import names
from ledgerloom.session import cut

#: Edits that a stem of usual length may contain; short stems allow fewer.
K = 2


def _allowed(length: str) -> str:
    return f"CASE WHEN {length} >= 6 THEN {K} WHEN {length} >= 4 THEN 1 ELSE 0 END"


def stem_candidates(typed: DataFrame, listed: DataFrame) -> DataFrame:
    """Pairs ``(typed, listed, edits)`` of distinct stems within the allowed edits, without comparing all pairs."""
    n = K + 1
    return typed.sparkSession.sql(
        f"""
        WITH segments AS (
          SELECT stem, length(stem) AS len, seg,
                 1 + length(stem) * seg div {n} AS at,
                 length(stem) * (seg + 1) div {n} - length(stem) * seg div {n} AS width
          FROM {{listed}} LATERAL VIEW explode(sequence(0, {K})) AS seg WHERE stem <> ''),
        pieces AS (SELECT stem AS listed, len, seg, substring(stem, at, width) AS piece FROM segments),
        lengths AS (
          SELECT stem, len, seg, 1 + len * seg div {n} AS at, len * (seg + 1) div {n} - len * seg div {n} AS width
          FROM {{typed}}
          LATERAL VIEW explode(sequence(greatest(1, length(stem) - {K}), length(stem) + {K})) AS len
          LATERAL VIEW explode(sequence(0, {K})) AS seg WHERE stem <> ''),
        windows AS (
          SELECT DISTINCT stem AS typed, len, seg, substring(stem, at + shift, width) AS piece
          FROM lengths LATERAL VIEW explode(sequence(-{K}, {K})) AS shift
          WHERE at + shift >= 1 AND at + shift + width - 1 <= length(stem)),
        pairs AS (SELECT DISTINCT typed, listed FROM windows JOIN pieces USING (len, seg, piece))
        SELECT typed, listed, levenshtein(typed, listed, {K}) AS edits FROM pairs
        WHERE levenshtein(typed, listed, {K}) BETWEEN 0 AND {_allowed('length(listed)')}
        """,
        typed=typed,
        listed=listed,
    )


def map_names(typed: DataFrame, column: str, universe: DataFrame, persist=cut) -> DataFrame:
    """Each distinct name of ``typed`` with the ``ticker`` it means; the empty string if it means none.

    A candidate must not contradict the lines of business the name gives. Among candidates the fewest
    edits win, then the symbol given in the name, then equal lines of business, then equal legal forms;
    a tie that remains means no entry. Null, empty and stemless names are unmatched. Repeated names
    and repeated entries count once; other columns of either input are not read.
    """
    spark = typed.sparkSession
    listed = universe.selectExpr("ticker", "name AS raw").distinct()
    wanted = typed.selectExpr(f"{column} AS raw").distinct()
    # both kinds of name are taken apart in one go
    read = persist(names.parts(wanted.union(listed.select("raw")), "raw", universe, persist=persist))
    entries = read.join(listed, "raw")
    asked = spark.sql("SELECT r.* FROM {read} r LEFT SEMI JOIN {wanted} w ON w.raw <=> r.raw", read=read, wanted=wanted)
    near = stem_candidates(asked.select("stem").distinct(), entries.select("stem").distinct())
    matched = persist(
        spark.sql(
            f"""
            WITH scored AS (
              SELECT a.raw, e.ticker, struct(
                       -n.edits AS edits, coalesce(a.symbol = lower(e.ticker), false) AS symbol,
                       size(a.sectors) = size(e.sectors) AND {names.covered("e.sectors", "a.sectors")} AS sectors, a.legal = e.legal AS legal) AS score
              FROM {{asked}} a JOIN {{near}} n ON n.typed = a.stem JOIN {{entries}} e ON e.stem = n.listed
              WHERE {names.covered("a.sectors", "e.sectors")}),
            best AS (SELECT raw, ticker, rank() OVER (PARTITION BY raw ORDER BY score DESC) AS place FROM scored)
            SELECT raw, min(ticker) AS ticker FROM best WHERE place = 1 GROUP BY raw HAVING count(DISTINCT ticker) = 1
            """,
            asked=asked,
            near=near,
            entries=entries,
        )
    )
    return spark.sql(
        """
        SELECT raw, ticker FROM {matched}
        UNION ALL
        SELECT a.raw, '' AS ticker FROM {asked} a LEFT ANTI JOIN {matched} m ON a.raw <=> m.raw
        """,
        matched=matched,
        asked=asked,
    )
