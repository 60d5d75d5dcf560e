"""Text that looks alike brought to one form, by SQL that DuckDB runs inside Arrow partitions."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Characters that show nothing, as code point ranges.
INVISIBLE = [(0x00, 0x08), (0x0E, 0x1F), (0x7F, 0x84), (0x86, 0x9F), (0xAD, 0xAD), (0x34F, 0x34F), (0x61C, 0x61C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180E), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF), (0xFFA0, 0xFFA0), (0xFFF9, 0xFFFB), (0xE0000, 0xE01EF)]
# Spaces other than the plain one.
SPACES = [(0xA0, 0xA0), (0x1680, 0x1680), (0x2000, 0x200A), (0x202F, 0x202F), (0x205F, 0x205F), (0x3000, 0x3000)]
# Hyphens that look like the plain one.
HYPHENS = [(0x2010, 0x2011), (0x2043, 0x2043), (0xFE63, 0xFE63), (0xFF0D, 0xFF0D)]
# Accents as marks of their own.
MARKS = [(0x300, 0x34E), (0x350, 0x36F), (0x1AB0, 0x1AFF), (0x1DC0, 0x1DFF), (0x20D0, 0x20FF)]
# Letters of other scripts and the Latin letters they look like.
ALIKE = {
    "АВЕЅІЈКМНОРСТУХԌԚԜаеѕіјкорстухһԁԛԝӏѵ": "ABESIJKMHOPCTYXGQWaesijkopctyxhdqwlv",
    "ΑΒΕΖΗΙΚΜΝΟΡΤΥΧαεικνορτυχϲ": "ABEZHIKMNOPTYXaeikvoptuxc",
    "ՍՕօոսցհ": "UOonugh",
}
SCRIPTS = "\\p{Greek}\\p{Cyrillic}\\p{Armenian}\\p{Coptic}\\p{Cherokee}\\p{Lisu}"


def _styled() -> tuple[dict[str, str], dict[str, str]]:
    """Latin letters and digits in another width or style, and joined ones, with their plain forms, by Unicode's decompositions."""
    single, joined = {"K": "K", "Å": "Å"}, {}
    for code in [*range(0x80, 0x10000), *range(0x1D400, 0x1D800)]:
        c = chr(code)
        tag = unicodedata.decomposition(c).partition(" ")[0]
        plain = unicodedata.normalize("NFKC", c)
        if not (plain.isascii() and plain.isalnum()):
            continue
        if len(plain) == 1 and tag in ("<wide>", "<narrow>", "<font>"):
            single[c] = plain
        elif tag == "<compat>" and unicodedata.category(c) in ("Lu", "Ll", "Lt"):
            (single if len(plain) == 1 else joined)[c] = plain
    for code in range(0x24B6, 0x24EA):  # letters in circles
        single[chr(code)] = unicodedata.normalize("NFKC", chr(code))
    return single, joined


SINGLE, JOINED = _styled()


def _class(ranges: list[tuple[int, int]]) -> str:
    return "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in ranges)


def _ranges(chars) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for code in sorted(map(ord, chars)):
        if out and out[-1][1] == code - 1:
            out[-1] = (out[-1][0], code)
        else:
            out.append((code, code))
    return out


def _all(ranges: list[tuple[int, int]]) -> str:
    return "".join(chr(c) for a, b in ranges for c in range(a, b + 1))


#: What makes a value a case: any of these characters, or a word of mixed scripts.
CASE = f"[{_class(_ranges([*SINGLE, *JOINED]) + INVISIBLE + SPACES + HYPHENS + MARKS)}]"
MIXED = f"\\p{{Latin}}[\\p{{L}}\\p{{M}}]*[{SCRIPTS}]|[{SCRIPTS}][\\p{{L}}\\p{{M}}]*\\p{{Latin}}"


def _form(value: str) -> str:
    """SQL for the one form of ``value``."""
    x = f"regexp_replace({value}, '[{_class(INVISIBLE)}]', '', 'g')"
    x = f"translate({x}, '{''.join(SINGLE)}{_all(SPACES)}{_all(HYPHENS)}', '{''.join(SINGLE.values())}{' ' * len(_all(SPACES))}{'-' * len(_all(HYPHENS))}')"
    for c, plain in JOINED.items():
        x = f"replace({x}, '{c}', '{plain}')"
    x = f"nfc_normalize({x})"
    words = f"regexp_extract_all({x}, '[\\p{{L}}\\p{{M}}]+|[^\\p{{L}}\\p{{M}}]+')"
    plain = f"translate(w, '{''.join(ALIKE)}', '{''.join(ALIKE.values())}')"
    return f"array_to_string(list_transform({words}, lambda w: CASE WHEN regexp_matches(w, '{MIXED}') THEN {plain} ELSE w END), '')"


def sql(keys: list[str], fields: list[str], relation: str = "t") -> str:
    """The embedded query: one row per key and field that is a case, with its one form."""
    parts = [
        f"SELECT {', '.join(keys)}, '{f}' AS field, {f} AS value, {_form(f)} AS form FROM {relation} WHERE regexp_matches({f}, '{CASE}') OR regexp_matches({f}, '{MIXED}')"
        for f in fields
    ]
    return " UNION ALL ".join(parts)


def uneven_text(df: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """``keys, field, value, form`` of every value with characters that look like plain ones but are not.

    ``form`` has compatibility forms, joined letters, look-alikes in Latin words, invisible characters, spaces and
    hyphens made plain and accents composed. Null, empty and plain values give no row; repeated rows give repeated
    rows. Columns other than ``keys`` and ``fields`` are not read. A value is handled whole, however long it is.
    """
    query = sql([f'"{k}"' for k in keys], fields)
    schema = df.select(*keys).schema
    names = [*keys, "field", "value", "form"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        with duckdb.connect(config={"threads": 1, "memory_limit": "512MB"}) as con:
            for batch in batches:
                if not batch.num_rows:
                    continue
                con.register("t", pa.Table.from_batches([batch]))
                found = con.sql(query).to_arrow_table()
                con.unregister("t")
                kinds = [batch.schema.field(k).type for k in keys] + [pa.string()] * 3
                yield from found.select(names).cast(pa.schema(list(zip(names, kinds)))).to_batches()

    # a value of plain characters only can't be a case, and stays on this side of the boundary
    odd = None
    for f in fields:
        test = F.coalesce(F.col(f).rlike("[^\\t\\n\\x0B\\f\\r -~]"), F.lit(False))
        odd = test if odd is None else odd | test
    out = ", ".join(f"`{x.name}` {x.dataType.simpleString()}" for x in schema) + ", field string, value string, form string"
    return df.select(*keys, *fields).where(odd).mapInArrow(run, out)
