"""Near copies among texts, by prefixes of token combinations.

A text is the set of its word sequences (tokens). All tokens are put in one order, rare ones first, and
each falls in a class by its frequency: a token of class 1 is a signature by itself, of class k only in combination
with k - 1 others of its class and part. A pair of sets of sizes m >= n that is similar to the degree t shares at least
``t / (1 + t) * (m + n)`` tokens, so at most a known number of tokens of either lacks in the other. The prefix of a set is
long enough that, whatever that many of its tokens lack, k tokens of some part of class k remain; so
similar sets share a signature. Frequent tokens are thus indexed only in combinations that are rare, and no similar pair
is missed.

The longer set of a pair asks with the prefix that fits its own size, the shorter one answers with the prefix that fits a
partner of its size at least, which is shorter. Each signature carries its depth in the prefix; a pair meets only
if the depth on both sides is within the prefix that fits this very pair. Wording that many texts share stands
at the end of the order, and is reached only by a set of which it makes up most.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.skew import salted_lookup
from ledgerloom.session import cut

#: Least and most counters of token frequencies, a byte each where they are sent to workers; tokens that share a counter
#: share its count. In between there is one for every ``OCCURRENCES`` tokens of all sets.
COUNTERS, MOST_COUNTERS, OCCURRENCES = 1 << 20, 1 << 26, 16
#: Counters that are brought to the driver as one row.
BLOCK = 1 << 16
#: Sets that a signature should lead to at most, on average.
TARGET = 16.0
#: Texts of so many tokens or fewer are indexed by single tokens.
SHORT = 16
#: Lengths are banded by this factor.
BAND = 2
#: A signature that so many sets have is spread over several tasks; it is looked for in one of ``SAMPLED`` sets.
HOT, SAMPLED = 20_000, 64
#: Most signatures that are spread; the others are only slower.
SPREAD = 10_000
#: Parity bits of a set, in longs.
LONGS = 16
NAMES = [f"w{i}" for i in range(LONGS)]
#: Tokens and characters that are worked on at once.
TOKENS_AT_ONCE, CHARACTERS_AT_ONCE = 1 << 19, 1 << 21
_MIX, _MIX2, _BASE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0xD6E8FEB86659FD93)
_IS_WORD = np.zeros(256, bool)
_IS_WORD[[*range(48, 58), *range(97, 123)]] = True


def _mix(values: np.ndarray) -> np.ndarray:
    x = values.view(np.uint64) * _MIX
    x ^= x >> np.uint64(29)
    x *= _MIX2
    return x ^ (x >> np.uint64(32))


def _powers(n: int, inverse: bool = False) -> np.ndarray:
    base = pow(int(_BASE), -1, 1 << 64) if inverse else int(_BASE)
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(max(0, n - 1), base, np.uint64))))


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` of ``lengths[i]`` each, one after another."""
    ends = np.cumsum(lengths)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - lengths, lengths) + np.repeat(starts, lengths)


def shingles(texts: list[str], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct hashes of the sequences of ``words`` words of each text, one after another, and how many each has.

    Words are runs of a-z and 0-9 after lower-casing. A word's hash is the polynomial of its characters, taken from running
    sums over all texts at once, so nothing is done word by word.
    """
    raw = b"\0".join(t.lower().encode("ascii", "replace").replace(b"\0", b" ") for t in texts) + b"\0"
    code = np.frombuffer(raw, np.uint8)
    inside = _IS_WORD[code]
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8)))))
    first, last = edge[::2], edge[1::2]
    running = np.concatenate((np.zeros(1, np.uint64), np.cumsum(code.astype(np.uint64) * _powers(len(code)))))
    word = _mix((running[last] - running[first]) * _powers(len(code), inverse=True)[first])
    text_of = np.searchsorted(np.flatnonzero(code == 0), first)
    n = len(word) - words + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(len(texts), np.int64)
    token = np.zeros(n, np.uint64)
    for i in range(words):
        token = _mix(token * _MIX2 + word[i : i + n])
    whole = text_of[:n] == text_of[words - 1 :]
    token, text_of = token[whole].view(np.int64), text_of[:n][whole]
    order = np.lexsort((token, text_of))
    token, text_of = token[order], text_of[order]
    new = np.ones(len(token), bool)
    new[1:] = (token[1:] != token[:-1]) | (text_of[1:] != text_of[:-1])
    return token[new], np.bincount(text_of[new], minlength=len(texts))


def _bitmaps(tokens: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Parities of the tokens of each set that fall on each bit; two sets differ in at least as many tokens as bits."""
    bits = 64 * LONGS
    at = np.repeat(np.arange(len(lengths)), lengths) * bits + (_mix(tokens) >> np.uint64(54)).astype(np.int64) % bits
    odd = (np.bincount(at, minlength=len(lengths) * bits) & 1).astype(np.uint8)
    return np.packbits(odd).view(np.int64).reshape(len(lengths), LONGS)


def _counter(tokens: np.ndarray, counters: int) -> np.ndarray:
    return (tokens.view(np.uint64) >> np.uint64(64 - (counters.bit_length() - 1))).astype(np.int64)


def _grade(counts: np.ndarray | float) -> np.ndarray:
    """A count as a byte, in eighths of a doubling; 0 for counts up to 1."""
    return np.where(np.asarray(counts) > 1, np.minimum(255, 1 + np.floor(8 * np.log2(np.maximum(counts, 1)))), 0).astype(np.uint8)


def frequencies(sets: DataFrame, counters: int) -> np.ndarray:
    """Grades of the counts of all tokens of all sets, in ``counters`` counters.

    Counts are summed by Spark and packed into blocks of bytes there; the driver gets ``counters`` bytes at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            for start in range(0, len(flat), 8 * TOKENS_AT_ONCE):
                at, n = np.unique(_counter(flat[start : start + 8 * TOKENS_AT_ONCE], counters), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["at", "n"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, np.ndarray] = {}
        for batch in batches:
            at, grade = batch.column(0).to_numpy(), _grade(batch.column(1).to_numpy())
            for block in np.unique(at // BLOCK).tolist():
                own = at // BLOCK == block
                blocks.setdefault(block, np.zeros(BLOCK, np.uint8))[at[own] % BLOCK] = grade[own]
        yield pa.RecordBatch.from_arrays([pa.array(list(blocks), pa.int64()), pa.array([b.tobytes() for b in blocks.values()], pa.binary())], ["block", "grades"])

    counts = sets.select("tokens").mapInArrow(run, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).where("n > 1")
    blocks = counts.repartition(F.expr(f"at div {BLOCK}")).mapInArrow(pack, "block long, grades binary")
    out = np.zeros(counters, np.uint8)
    for row in blocks.toLocalIterator():
        out[row["block"] * BLOCK :][:BLOCK] = np.frombuffer(row["grades"], np.uint8)
    return out


class Scheme:
    """Classes, parts and prefixes for sets of tokens; one for all sets, so that signatures agree."""

    def __init__(self, counts: np.ndarray, sets: int, at_least: tuple[int, int]):
        """``counts`` are grades if they are bytes."""
        self.grades = counts if counts.dtype == np.uint8 else _grade(counts)
        self.num, self.den = at_least
        n = max(1, sets)
        # the greatest count at which k tokens of a class are expected together in TARGET sets
        bounds = [n * (TARGET / n) ** (1 / k) for k in (1, 2)] if n > TARGET else [n, n]
        self.bounds = np.array([int(_grade(b)) for b in bounds])
        # a set longer than this can afford the waste of one part of each class
        self.short = max(SHORT, -(-4 * self.den // self.num))
        self.edges = self.short * BAND ** np.arange(40)
        self.hot, self.salts = np.zeros(0, np.uint64), np.zeros(0, np.int64)

    def band(self, n: np.ndarray) -> np.ndarray:
        """The band of sets of ``n`` tokens, -1 for short ones."""
        return np.searchsorted(self.edges, n, side="left") - 1

    def parts(self, band: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Parts of classes 2 and 3.

        Each part of class k may waste k - 1 tokens of a prefix. All together waste no more than the similar share
        of the shortest set of the band, so every set of it reaches its prefix.
        """
        spare = self.edges[np.maximum(band, 0)] * self.num // self.den - 1
        return np.maximum(1, spare * 5 // 12), np.maximum(1, spare // 6)

    def signatures(self, tokens: np.ndarray) -> list[int]:
        """The signatures of one set."""
        return self.all_signatures(tokens, np.array([len(tokens)]))[1].tolist()

    def all_signatures(self, tokens: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, ...]:
        """``set, signature, depth, asks, alone`` of sets given one after another.

        ``asks`` tells those a longer set uses; ``alone`` those with a token that no other set has.
        """
        num, den = self.num, self.den
        set_of = np.repeat(np.arange(len(lengths)), lengths)
        grade = self.grades[_counter(tokens, len(self.grades))]
        # by set, grade and token; a set's tokens may come in any order
        order = np.lexsort((tokens, grade, set_of))
        mixed, grade = _mix(tokens[order]), grade[order]
        klass = 1 + np.searchsorted(self.bounds, grade, side="left")
        starts = np.concatenate(([0], np.cumsum(lengths)))[:-1]
        at = np.arange(len(mixed)) - np.repeat(starts, lengths)
        # one more token than may lack, beside an equal or shorter set and beside an equal or longer one
        asking = lengths + (-lengths * num // den) + 1
        answering = lengths + (-2 * lengths * num // (num + den)) + 1
        own, longest = self.band(lengths), self.band(lengths * den // num)
        out = []
        for step in range(int((longest - own).max(initial=-1)) + 1):
            band = own + step
            need = np.where(band <= longest, asking if step == 0 else answering, 0)
            two, three = self.parts(band)
            spare = np.where(band < 0, 0, two + 2 * three)
            t = np.flatnonzero(at < np.where(need > 0, need + spare, 0)[set_of])
            s, x, alone = set_of[t], mixed[t], grade[t] == 0
            k = np.where(band[s] < 0, 1, klass[t])
            salt = _mix((band + 2).astype(np.uint64))[s]
            # combining tokens by set, class and part, in their order
            many = np.flatnonzero(k > 1)
            sm, xm, km = s[many], x[many], k[many]
            part = np.where(km == 2, xm % two[sm].astype(np.uint64), two[sm].astype(np.uint64) + xm % three[sm].astype(np.uint64)).astype(np.int64)
            group = sm * (int((two + three).max(initial=0)) + 1) + part
            by_group = np.argsort(group, kind="stable")
            g = group[by_group]
            new = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1]))) if len(g) else np.zeros(0, np.int64)
            first = np.repeat(new, np.diff(np.concatenate((new, [len(g)]))))
            rank = np.arange(len(g)) - first
            covers = k == 1
            covers[many[by_group]] = rank >= km[by_group] - 1
            depth = np.cumsum(covers)
            if len(s):
                begin = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
                depth = depth - np.repeat(depth[begin] - covers[begin], np.diff(np.concatenate((begin, [len(s)]))))
            keep = covers & (depth <= need[s])

            def emit(rows: np.ndarray, sig: np.ndarray, asks: bool = step == 0) -> None:
                out.append((s[rows], sig, depth[rows], np.full(len(rows), asks), alone[rows]))

            one = np.flatnonzero(keep & (k == 1))
            emit(one, _mix(x[one] + salt[one]))
            sorted_rows = many[by_group]
            for combined in (2, 3):
                last = np.flatnonzero(keep[sorted_rows] & (k[sorted_rows] == combined))
                rows, r, begin = sorted_rows[last], rank[last], first[last]
                if not len(rows):
                    continue
                times = r if combined == 2 else r * (r - 1) // 2
                nth = _ranges(np.zeros(len(r), np.int64), times)
                if combined == 2:
                    before = x[sorted_rows[np.repeat(begin, times) + nth]] * _MIX
                else:
                    high, low = np.tril_indices(int(r.max()), -1)
                    base = np.repeat(begin, times)
                    before = _mix(x[sorted_rows[base + low[nth]]] * _MIX + x[sorted_rows[base + high[nth]]])
                rows = np.repeat(rows, times)
                emit(rows, _mix(before + x[rows] * _MIX2 + salt[rows] + np.uint64(combined)))
        if not out:
            return tuple(np.zeros(0, d) for d in (np.int64, np.uint64, np.int64, bool, bool))
        return tuple(np.concatenate(c) for c in zip(*out))

    def answers(self, lengths: np.ndarray) -> np.ndarray:
        """The greatest depth at which a set answers a longer one."""
        return lengths + (-2 * lengths * self.num // (self.num + self.den)) + 1


def _slices(lengths: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Consecutive sets of about ``most`` tokens."""
    ends = np.cumsum(lengths)
    start = 0
    while start < len(lengths):
        stop = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + most, side="right")))
        yield start, stop
        start = stop


def _postings(sets: DataFrame, scheme) -> DataFrame:
    """``sig, id, meta``: meta holds the size of the set, the depth, and whether it asks (1) and answers (2)."""

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = scheme.value
        for batch in batches:
            lengths = batch.column(1).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            flat, ids = batch.column(1).flatten().to_numpy(zero_copy_only=False), batch.column(0).to_numpy()
            ends = np.concatenate(([0], np.cumsum(lengths)))
            for start, stop in _slices(lengths, TOKENS_AT_ONCE):
                part = lengths[start:stop]
                of, sig, depth, asks, alone = own.all_signatures(flat[ends[start] : ends[stop]], part)
                # a token that one set has leads to no other
                of, sig, depth, asks = (c[~alone] for c in (of, sig, depth, asks))
                answers = depth <= own.answers(part)[of]
                if len(own.hot):
                    # a hot signature is dealt out: a set asks under one of its salts, and answers under all
                    at = np.minimum(np.searchsorted(own.hot, sig), len(own.hot) - 1)
                    salts = np.where(own.hot[at] == sig, own.salts[at], 1)
                    mine = (_mix(ids[start:stop])[of] % salts.astype(np.uint64)).astype(np.int64)
                    times = np.where(answers, salts, 1)
                    salt = np.where(np.repeat(answers, times), _ranges(np.zeros(len(of), np.int64), times), np.repeat(mine, times))
                    of, sig, depth, asks, answers, mine = (np.repeat(c, times) for c in (of, sig, depth, asks, answers, mine))
                    asks = asks & (salt == mine)
                    sig = np.where(salt > 0, _mix(sig + salt.astype(np.uint64)), sig)
                meta = (part[of] << 32) | (depth << 2) | asks | (answers.astype(np.int64) << 1)
                yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(ids[start:stop][of]), pa.array(meta)], ["sig", "id", "meta"])

    return sets.select("id", "tokens").mapInArrow(index, "sig long, id long, meta long")


def _hot(sets: DataFrame, scheme) -> tuple[np.ndarray, np.ndarray]:
    """The signatures that more than ``HOT`` sets have, by a sample of the sets, and over how many tasks to spread each."""
    some = sets.where(F.pmod(F.xxhash64("id"), F.lit(SAMPLED)) == 0)
    counts = _postings(some, scheme).groupBy("sig").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") * SAMPLED > HOT)
    rows = counts.orderBy(F.desc("n"), "sig").limit(SPREAD).collect()
    sig = np.array([r["sig"] for r in rows], np.int64).view(np.uint64)
    order = np.argsort(sig)
    return sig[order], np.array([-(-r["n"] * SAMPLED // HOT) for r in rows], np.int64)[order]


def similar_sets(sets: DataFrame, at_least: tuple[int, int] = (4, 5)) -> DataFrame:
    """``a, b, common, n_a, n_b`` of distinct sets ``a < b`` whose Jaccard similarity is ``at_least`` num/den.

    ``sets(id long, tokens array<long>, w0.. long)`` holds distinct tokens and their parity bits, no set twice and none
    empty, as a stored table. Pairs that share a signature pass a bound on their parity bits; what is left is verified exactly.
    """
    spark, (num, den) = sets.sparkSession, at_least
    size = sets.agg(F.count(F.lit(1)).alias("sets"), F.coalesce(F.sum(F.size("tokens")), F.lit(0)).alias("tokens")).first()
    counters = COUNTERS
    while counters < MOST_COUNTERS and counters * OCCURRENCES < size["tokens"]:
        counters *= 2
    scheme = Scheme(frequencies(sets, counters), size["sets"], at_least)
    shared = spark.sparkContext.broadcast(scheme)  # at most MOST_COUNTERS bytes
    if size["sets"] > HOT:
        scheme.hot, scheme.salts = _hot(sets, shared)
        if len(scheme.hot):
            shared = spark.sparkContext.broadcast(scheme)
    postings = _postings(sets, shared)
    n = lambda e: F.shiftright(F.col(f"{e}.meta"), 32)
    depth = lambda e: F.shiftright(F.col(f"{e}.meta").bitwiseAND(0xFFFFFFFF), 2)
    # tokens a pair must have in common at least: the depths on both sides leave room for them
    common = F.ceil((n("a") + n("b")) * num / (num + den))
    longer = (n("a") > n("b")) | ((n("a") == n("b")) & (F.col("a.id") > F.col("b.id")))
    # this reads both sides, so it isn't pushed into one, and the index is made and shuffled once
    sides = F.col("a.meta").bitwiseAND(F.shiftright(F.col("b.meta"), 1)).bitwiseAND(1) == 1
    fits = sides & longer & (n("b") * den >= n("a") * num) & (depth("a") <= n("a") - common + 1) & (depth("b") <= n("b") - common + 1)
    both = postings.alias("a").join(postings.alias("b"), (F.col("a.sig") == F.col("b.sig")) & fits)
    # dealt out by the first set, so that neither dropping repeats nor the first look-up moves the pairs again
    met = both.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).repartition("a").dropDuplicates(["a", "b"])
    bits = lambda e: sets.select(F.col("id").alias(e), F.size("tokens").alias(f"n_{e}"), *[F.col(w).alias(f"{w}_{e}") for w in NAMES])
    differing = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in NAMES), F.lit(0))
    # similarity s needs |a ^ b| <= (1 - s) / (1 + s) * (|a| + |b|)
    close = differing * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    pairs = met.join(bits("a"), "a").join(bits("b"), "b").where(close).select("a", "b")
    side = lambda e: sets.select(F.col("id").alias(e), F.col("tokens").alias(f"t{e}"))
    checked = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", F.size(F.array_intersect("ta", "tb")).alias("common"), F.size("ta").alias("n_a"), F.size("tb").alias("n_b"))
    good = checked.where(F.col("common") * den >= (F.col("n_a") + F.col("n_b") - F.col("common")) * num)
    swap = F.col("a") > F.col("b")
    pick = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return good.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "common", pick("n_a", "n_b").alias("n_a"), pick("n_b", "n_a").alias("n_b"))


def distinct_sets(df: DataFrame, key: str, text: str, words: int) -> DataFrame:
    """``key, n, h1, h2, tokens, w0..``: each text's set with two hashes and its parity bits; texts of too few words are left out.

    In Arrow batches: as array functions of Spark are not compiled, they take five times as long for the same hashes.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, texts = batch.column(0).to_numpy(zero_copy_only=False), [t or "" for t in batch.column(1).to_pylist()]
            for start, stop in _slices(np.array([len(t) + 1 for t in texts], np.int64), CHARACTERS_AT_ONCE):
                tokens, n = shingles(texts[start:stop], words)
                some = n > 0
                if not some.any():
                    continue
                n = n[some]
                ends = np.concatenate(([0], np.cumsum(n)))
                sums = [np.add.reduceat(_mix(tokens + c), ends[:-1]).view(np.int64) for c in (1, 2)]
                lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(tokens))
                bits = _bitmaps(tokens, n)
                arrays = [pa.array(keys[start:stop][some]), pa.array(n.astype(np.int32)), *map(pa.array, sums), lists, *(pa.array(np.ascontiguousarray(bits[:, j])) for j in range(LONGS))]
                yield pa.RecordBatch.from_arrays(arrays, ["key", "n", "h1", "h2", "tokens", *NAMES])

    schema = "key long, n int, h1 long, h2 long, tokens array<long>, " + ", ".join(f"{w} long" for w in NAMES)
    return df.select(F.col(key).cast("long").alias("key"), text).where(F.col("key").isNotNull()).mapInArrow(run, schema)


def near_copies(df: DataFrame, key: str, text: str, *, words: int = 5, at_least: tuple[int, int] = (4, 5), persist=cut) -> tuple[DataFrame, DataFrame]:
    """Membership ``key, id`` and pairs ``a, b`` of different sets with similarity ``at_least``.

    Texts with equal sets form one class, named by its smallest key; only classes are compared. Null and
    empty texts, texts of fewer than ``words`` words, and rows without key belong to no class. Repeated rows count once;
    ``key`` should not stand for several texts, as of two classes that it would name one is compared.
    """
    prints = persist(distinct_sets(df, key, text, words))
    same = ["n", "h1", "h2"]
    heads = prints.groupBy(*same).agg(F.min("key").alias("id"))
    # a text that a third of all rows repeat is one class: its rows are dealt out over many tasks
    members = salted_lookup(prints.select("key", *same).distinct(), heads, same).select("key", "id")
    once = prints.join(heads.select(F.col("id").alias("key")), "key", "left_semi").withColumnRenamed("key", "id").drop(*same)
    sets = persist(once.dropDuplicates(["id"]))
    pairs = similar_sets(sets, at_least).select("a", "b")
    return members, pairs
