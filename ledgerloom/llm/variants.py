"""Spellings that mean the same person or organisation, linked within a group such as a filer.

The token that carries a name (family name, stem of a company) is cut into q-grams. An edit touches
at most Q of them, so two spellings within E edits share one of their Q * E + 1 rarest grams: an
equality join on (group, gram) over these prefixes finds every candidate. Candidates are verified by a
soft token similarity in which each token weighs by its rarity, and by an exact check
for contradictions such as two given names of one family.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm import names
from ledgerloom.operators.skew import salted_lookup
from ledgerloom.session import cut

Q, E = 2, 3
#: Least soft similarity of two spellings of one name.
LEAST = 0.62

# Short and pet forms of given names.
SHORT_NAMES = {
    "abby": "abigail",
    "alex": "alexander",
    "andy": "andrew",
    "becky": "rebecca",
    "ben": "benjamin",
    "beth": "elizabeth",
    "bill": "william",
    "bob": "robert",
    "charlie": "charles",
    "chris": "christopher",
    "chuck": "charles",
    "dan": "daniel",
    "deb": "deborah",
    "debbie": "deborah",
    "dick": "richard",
    "drew": "andrew",
    "ed": "edward",
    "fred": "frederick",
    "greg": "gregory",
    "jen": "jennifer",
    "jenny": "jennifer",
    "jim": "james",
    "joe": "joseph",
    "judy": "judith",
    "kate": "katherine",
    "kathy": "katherine",
    "ken": "kenneth",
    "larry": "lawrence",
    "len": "leonard",
    "liz": "elizabeth",
    "maggie": "margaret",
    "matt": "matthew",
    "mike": "michael",
    "nate": "nathaniel",
    "pat": "patricia",
    "peggy": "margaret",
    "rick": "richard",
    "rob": "robert",
    "ron": "ronald",
    "sam": "samuel",
    "sandra": "alexandra",
    "sandy": "alexandra",
    "steve": "steven",
    "sue": "susan",
    "ted": "theodore",
    "teddy": "theodore",
    "tim": "timothy",
    "tom": "thomas",
    "tony": "anthony",
    "vicky": "victoria",
}
# Short forms that stand for a second given name as well.
SECOND_NAMES = {"alex": "alexandra", "pat": "patrick", "ted": "edward", "teddy": "edward", "chris": "christine", "sam": "samantha"}
# What surrounds a person's name without being part of it.
TITLES = "mr|mrs|ms|miss|dr|prof|sir"
DEGREES = "cpa|ph\\.? ?d|md|m\\.d|mba|esq|jd|cfa"
SUFFIXES = "jr|sr|ii|iii|iv"
PARTICLES = ["de", "del", "der", "di", "la", "le", "van", "von"]


def person_parts(df: DataFrame, column: str) -> DataFrame:
    """``df`` with ``stem`` (family name), ``given``, ``middle``, ``suffix`` and ``tokens`` of a person's name.

    Read as "Given M. Family, Suffix" or "Family, Given M."; titles, degrees and notes are dropped. A name
    of one word is a family name. Null and empty names have an empty stem.
    """
    x = F.lower(F.coalesce(F.col(column), F.lit("")))
    x = F.translate(F.regexp_replace(x, r"\p{M}", ""), names.ACCENTED, names.PLAIN)
    x = F.regexp_replace(x, r"\([^)]*\)|[*†‡^]", " ")
    x = F.regexp_replace(x, rf"(^|[ ,])({DEGREES})\.?(?=$|[ ,])", " ")
    x = F.regexp_replace(x, rf"(^|[ ,])({TITLES})\.?(?=[ ,])", " ")
    suffix = F.regexp_extract(x, rf"[ ,]({SUFFIXES})\.?(?=$|[ ,])", 1)
    x = F.regexp_replace(x, rf"[ ,]+({SUFFIXES})\.?(?=$|[ ,])", " ")
    x = F.trim(F.regexp_replace(F.regexp_replace(x, r"[ ,]+$", ""), r"\s+", " "))
    x = F.when(F.contains(x, F.lit(",")), F.concat_ws(" ", F.regexp_extract(x, r"^[^,]*,(.*)$", 1), F.regexp_extract(x, r"^([^,]*),", 1))).otherwise(x)
    x = F.translate(F.regexp_replace(F.regexp_replace(x, r"[.'’\-,]", ""), "rn", "m"), "01", "ol")
    words = F.filter(F.split(x, r"\s+"), lambda w: (w != "") & ~w.isin(PARTICLES))
    df = df.withColumn("_words", words).withColumn("suffix", suffix)
    n = F.size("_words")
    df = df.select(
        *[c for c in df.columns if c != "_words"],
        F.when(n > 0, F.element_at("_words", -1)).otherwise("").alias("stem"),
        F.when(n > 1, F.element_at("_words", 1)).otherwise("").alias("given"),
        F.when(n > 2, F.substring(F.element_at("_words", 2), 1, 1)).otherwise("").alias("middle"),
        F.array_distinct("_words").alias("tokens"),
    )
    # looked up once for each spelling, not for each pair
    forms = F.array_distinct(F.array("given", _known(F.col("given"), SHORT_NAMES), _known(F.col("given"), SECOND_NAMES)))
    tokens = F.array_distinct(F.transform("tokens", lambda t: _known(t, SHORT_NAMES)))
    return df.withColumns({"forms": forms, "tokens": tokens})


def _grams(stem: Column) -> Column:
    padded = F.concat(F.lit("_"), stem, F.lit("_"))
    # a gram that occurs twice counts as two
    cut = F.transform(F.sequence(F.lit(1), F.length(stem) + 3 - Q), lambda i: F.substr(padded, i, F.lit(Q)))
    return F.transform(cut, lambda g, i: F.concat(g, F.size(F.filter(F.slice(cut, F.lit(1), i + 1), lambda h: h == g)).cast("string")))


def candidates(spellings: DataFrame, group: list[str], name: str, persist=cut) -> DataFrame:
    """Pairs ``name_a < name_b`` of a group whose stems share one of their rarest grams."""
    grams = spellings.where(F.col("stem") != "").select(*group, name, F.explode(F.array_distinct(_grams(F.col("stem")))).alias("gram"))
    grams = persist(grams)
    counts = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("df"))
    ranked = salted_lookup(grams, counts, ["gram"], counts=counts, n="df").groupBy(*group, name).agg(F.array_sort(F.collect_list(F.struct("df", "gram"))).alias("all"))
    prefix = ranked.select(*group, name, F.explode(F.slice("all", 1, Q * E + 1)).alias("g")).select(*group, name, F.col("g.gram").alias("gram"))
    a, b = prefix.withColumnRenamed(name, "name_a"), prefix.withColumnRenamed(name, "name_b")
    return a.join(b, [*group, "gram"]).where("name_a < name_b").select(*group, "name_a", "name_b").distinct()


def _known(word: Column, table: dict[str, str]) -> Column:
    pairs = F.create_map(*[F.lit(x) for kv in table.items() for x in kv])
    return F.coalesce(F.try_element_at(pairs, word), word)


def close(a: Column, b: Column, most: int = 2) -> Column:
    """Equal up to typing slips: ``most`` edits in a long word, one edit or swapped letters in a short one."""
    d, n = F.levenshtein(a, b), F.least(F.length(a), F.length(b))
    swapped = (d == 2) & (F.array_sort(F.split(a, "")) == F.array_sort(F.split(b, "")))
    return (a == b) | (d <= F.when(n >= 9, most).when(n >= 6, 2).when(n >= 3, 1).otherwise(0)) | ((n >= 3) & swapped)


def same_given(a: Column, b: Column, slips: int = 1) -> Column:
    """Whether given names may be one, by the forms each may stand for: equal up to slips, a pet form, or an initial.

    An absent name contradicts nothing. ``slips`` is 2 where both are slips of a third.
    """

    def alike(x: Column, y: Column) -> Column:
        initial = ((F.length(x) == 1) | (F.length(y) == 1)) & (F.substring(x, 1, 1) == F.substring(y, 1, 1))
        near = close(x, y) if slips == 1 else (F.levenshtein(x, y) <= F.least(F.lit(4), F.length(x) - 1, F.length(y) - 1))
        return (x == "") | (y == "") | initial | ((F.length(x) > 1) & (F.length(y) > 1) & near)

    return F.exists(a, lambda x: F.exists(b, lambda y: alike(x, y)))


def token_similarity(a: Column, b: Column) -> Column:
    """Soft similarity in 0..1 of two arrays ``struct(token, weight)``: best matches, weighed by rarity.

    The greater of both directions counts, as a spelling may leave out tokens of another.
    """

    def alike(x: Column, y: Column) -> Column:
        u, v = x["token"], y["token"]
        initial = ((F.length(u) == 1) | (F.length(v) == 1)) & (F.substring(u, 1, 1) == F.substring(v, 1, 1))
        edit = 1 - F.levenshtein(u, v) / F.greatest(F.length(u), F.length(v), F.lit(1))
        return F.when(u == v, 1.0).when(initial, 0.9).when(edit >= 0.5, edit).otherwise(0.0)

    def one_way(p: Column, q: Column) -> Column:
        best = lambda x: F.coalesce(F.array_max(F.transform(q, lambda y: alike(x, y))), F.lit(0.0))
        return F.aggregate(p, F.lit(0.0), lambda s, x: s + x["weight"] * best(x))

    total = lambda p: F.aggregate(p, F.lit(0.0), lambda s, x: s + x["weight"])
    return F.coalesce(F.greatest(one_way(a, b) / total(a), one_way(b, a) / total(b)), F.lit(0.0))


def weigh(spellings: DataFrame, group: list[str], name: str) -> DataFrame:
    """``tokens`` as ``struct(token, weight)`` with the inverse frequency of the token among all spellings."""
    each = spellings.select(*group, name, F.explode("tokens").alias("token"))
    n = spellings.select(F.count(F.lit(1)).alias("n"))
    counts = each.groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    weight = F.log(F.lit(1.0) + F.col("n") / F.col("df"))
    weighed = salted_lookup(each, counts.crossJoin(F.broadcast(n)), ["token"], counts=counts, n="df").groupBy(*group, name).agg(
        F.array_sort(F.collect_list(F.struct("token", weight.alias("weight")))).alias("weighed")
    )
    return spellings.join(weighed, [*group, name])


def link(spellings: DataFrame, group: list[str], name: str, contradicts, weak, persist=cut) -> DataFrame:
    """Pairs ``name_a < name_b`` of spellings of one entity.

    ``spellings`` is distinct by group and name with ``stem``, ``tokens`` and the parts that
    ``contradicts(x, y, slips)`` compares. ``weak(x)`` tells a spelling that leaves open who is meant, such as initials only: if such a one fits
    two spellings that contradict each other it is linked to neither, but to other weak ones it stays linked. Two
    spellings linked to a third are linked unless they contradict each other.
    """
    parts = persist(weigh(persist(spellings), group, name))  # both are read several times
    side = lambda end: parts.select(*group, F.col(name).alias(f"name_{end}"), F.struct(*[c for c in parts.columns if c not in (*group, name)]).alias(end))

    def checked(pairs: DataFrame, slips: int = 1) -> DataFrame:
        both = pairs.join(side("a"), [*group, "name_a"]).join(side("b"), [*group, "name_b"])
        return both.where(~contradicts(F.col("a"), F.col("b"), slips))

    fits = checked(candidates(parts, group, name, persist)).where(
        close(F.col("a.stem"), F.col("b.stem"), E) & (token_similarity(F.col("a.weighed"), F.col("b.weighed")) >= LEAST)
    )
    direct = persist(fits.select(*group, "name_a", "name_b", weak(F.col("a")).alias("weak_a"), weak(F.col("b")).alias("weak_b")))
    ends = direct.select(*group, F.col("name_a").alias("x"), F.col("name_b").alias("y"), F.col("weak_a").alias("weak_x"), F.col("weak_b").alias("weak_y")).unionByName(
        direct.select(*group, F.col("name_b").alias("x"), F.col("name_a").alias("y"), F.col("weak_b").alias("weak_x"), F.col("weak_a").alias("weak_y"))
    )
    # spellings that are not weak themselves and meet in x
    full = ends.where("NOT weak_y").select(*group, "x", "weak_x", F.col("y").alias("name_a"))
    meet = full.join(full.drop("weak_x").withColumnRenamed("name_a", "name_b"), [*group, "x"]).where("name_a < name_b")
    known = checked(meet.select(*group, "name_a", "name_b").distinct(), 2).select(*group, "name_a", "name_b")
    open_ = persist(meet.where("weak_x").join(known, [*group, "name_a", "name_b"], "left_anti").select(*group, "x").distinct())

    def settled(pairs: DataFrame) -> DataFrame:
        """``pairs`` without those of an open spelling and one that is not weak."""
        for end in ("a", "b"):
            pairs = pairs.join(open_.withColumnRenamed("x", f"name_{end}").withColumn(f"open_{end}", F.lit(True)), [*group, f"name_{end}"], "left")
        barred = (F.col("open_a") & ~F.col("weak_b")) | (F.col("open_b") & ~F.col("weak_a"))
        return pairs.where(~F.coalesce(barred, F.lit(False))).select(*group, "name_a", "name_b")

    kept = persist(settled(direct))
    ends = kept.select(*group, F.col("name_a").alias("x"), F.col("name_b").alias("y")).unionByName(kept.select(*group, F.col("name_b").alias("x"), F.col("name_a").alias("y")))
    second = ends.select(*group, "x", F.col("y").alias("name_a")).join(ends.select(*group, "x", F.col("y").alias("name_b")), [*group, "x"]).where("name_a < name_b")
    second = second.select(*group, "name_a", "name_b").distinct().join(kept, [*group, "name_a", "name_b"], "left_anti")
    return kept.unionByName(settled(checked(second, 2).withColumns({f"weak_{end}": weak(F.col(end)) for end in ("a", "b")})))


def person_contradicts(a: Column, b: Column, slips: int) -> Column:
    middle = (a["middle"] != "") & (b["middle"] != "") & (a["middle"] != b["middle"])
    return (a["suffix"] != b["suffix"]) | middle | ~same_given(a["forms"], b["forms"], slips)


def company_contradicts(a: Column, b: Column, slips: int) -> Column:
    def covered(x: Column, y: Column) -> Column:
        lines = lambda s: F.split(s, "[|]")
        return F.forall(x["sectors"], lambda s: F.exists(y["sectors"], lambda t: F.arrays_overlap(lines(s), lines(t))))

    return ~(covered(a, b) | covered(b, a))


def _own_names(df: DataFrame, group: list[str], name: str) -> tuple[DataFrame, list[str]]:
    """Distinct groups and names under names of our own, which no column of the caller can clash with."""
    own = [f"_group{i}" for i in range(len(group))]
    columns = [F.col(g).alias(o) for g, o in zip(group, own)] + [F.col(name).alias("_name")]
    return df.where(F.col(name).isNotNull()).select(*columns).distinct(), own


def _named(pairs: DataFrame, group: list[str], own: list[str]) -> DataFrame:
    return pairs.select(*[F.col(o).alias(g) for g, o in zip(group, own)], "name_a", "name_b")


def link_persons(df: DataFrame, group: list[str], name: str, persist=cut) -> DataFrame:
    """Link the spellings of persons; null and empty names link to nothing, repeated rows count once."""
    distinct, own = _own_names(df, group, name)
    spellings = person_parts(distinct, "_name")
    return _named(link(spellings, own, "_name", person_contradicts, lambda x: F.length(x["given"]) <= 1, persist), group, own)


def link_companies(df: DataFrame, group: list[str], name: str, universe: DataFrame, persist=cut) -> DataFrame:
    """Link the spellings of organisations; null and empty names link to nothing, repeated rows count once."""
    distinct, own = _own_names(df, group, name)
    distinct = persist(distinct)
    read = names.parts(distinct, "_name", universe, persist=persist).withColumnRenamed("raw", "_name")
    clear = F.filter("sectors", lambda s: ~F.contains(s, F.lit("|")))
    # a name is there once a group, so none holds many of the rows
    spellings = distinct.join(read, "_name").withColumn("tokens", F.array_distinct(F.concat(F.array("stem"), clear, "legal")))
    return _named(link(spellings, own, "_name", company_contradicts, lambda x: F.size(x["sectors"]) == 0, persist), group, own)
