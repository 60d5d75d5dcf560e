"""Reading level of texts by a familiar-word formula.

Words are ranked per language by the number of documents that contain them. A text is described by the share
of its words outside the most frequent K words, for lists of several lengths K, and by its average sentence
length. What level such figures mean is learned from raters' labels, as weights and as small regression trees.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ledgerloom.session import cut

#: Languages that get word lists of their own; every text is read in the likeliest of them.
LANGUAGES = ("en", "de", "fr", "es")
#: Lengths of the lists of frequent words. The longest bounds what is sent to the workers.
LISTS = (8, 12, 16, 20, 25, 30, 35, 40, 50, 60, 70, 80, 90, 100, 115, 130, 145, 160, 180, 200, 225, 250, 280, 320, 360, 400, 450, 500, 600, 700, 850, 1000, 1500, 2500)
#: Words of each language that tell it from the others.
TELLING = 500
#: A word belongs to another language if its share of documents there is so many times higher.
FOREIGN = 8
#: Most labelled documents that the trees are fitted to: those of the smallest hash of their id.
LABELLED = 20_000
#: Labelled documents that it takes to fit weights; a language with fewer is rated by those of all languages.
LEAST_LABELS = 50
#: Distinct words a worker counts before it passes them on.
COUNTED = 200_000

WORDS = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*")
MARKUP = re.compile(r"<[^>]*>|&[a-z]+;|\r")
STOPS = re.compile(r"[.!?]+(?:\s|$)|\n\s*\n|\n(?=[-*•])")


def _words(text: str) -> list[str]:
    return WORDS.findall(text.lower())


def _plain(text: str) -> str:
    return MARKUP.sub(" ", text) if "<" in text or "&" in text or "\r" in text else text


def likeliest(seen: set[str], telling: dict[str, dict[str, float]]) -> int:
    """The language, as an index, whose telling words a text holds most of."""
    return max(range(len(LANGUAGES)), key=lambda i: sum(telling[LANGUAGES[i]].get(w, 0.0) for w in seen))


def word_counts(df: DataFrame, text: str, language: str, telling=None) -> DataFrame:
    """``lang, word, n``: in how many documents of a language a word occurs; the empty word counts documents.

    Without ``telling`` those of the texts whose language is stated; with that broadcast, those of all others, each under its
    likeliest language.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = {x: Counter() for x in LANGUAGES}

        def out() -> pa.RecordBatch:
            rows = [(x, w, n) for x, c in counts.items() for w, n in c.items()]
            for c in counts.values():
                c.clear()
            langs, words, ns = zip(*rows) if rows else ((), (), ())
            return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(ns, pa.int64())], ["lang", "word", "n"])

        for batch in batches:
            for t, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen = set(_words(_plain(t)))
                counts[x if telling is None else LANGUAGES[likeliest(seen, telling.value)]].update({"", *seen})
                if sum(map(len, counts.values())) > COUNTED:
                    yield out()
        yield out()

    stated = F.coalesce(F.col(language).isin(*LANGUAGES), F.lit(False))
    some = df.where((stated if telling is None else ~stated) & F.col(text).isNotNull()).select(text, language)
    return some.mapInArrow(run, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


def word_lists(counts: DataFrame) -> tuple[dict[str, dict[str, int]], dict[str, dict[str, float]]]:
    """Rank by word and language, and the weight of the words that tell a language.

    Words of stated languages are taken in two steps, so that no task sorts a whole vocabulary; what reaches
    the driver is bounded by the length of the lists. A language without documents has empty lists.
    """
    order = [F.desc("n"), "word"]
    salted = counts.withColumn("_part", F.pmod(F.xxhash64("word"), F.lit(64)))
    some = salted.withColumn("_k", F.row_number().over(W.partitionBy("lang", "_part").orderBy(*order))).where(F.col("_k") <= 2 * LISTS[-1])
    top = some.withColumn("_k", F.row_number().over(W.partitionBy("lang").orderBy(*order))).where(F.col("_k") <= 2 * LISTS[-1])
    # the empty word, which counts documents, is the most frequent and so among them
    rows = top.select("lang", "word", "n").collect()
    totals = {r["lang"]: r["n"] for r in rows if not r["word"]}
    shares: dict[str, dict[str, float]] = {x: {} for x in LANGUAGES}
    for r in rows:
        if r["word"]:
            shares[r["lang"]][r["word"]] = r["n"] / totals[r["lang"]]
    ranks: dict[str, dict[str, int]] = {}
    telling: dict[str, dict[str, float]] = {}
    for x, own in shares.items():
        rest = {w: max((s.get(w, 0.0) for y, s in shares.items() if y != x), default=0.0) for w in own}
        mine = sorted((w for w in own if own[w] * FOREIGN >= rest[w]), key=lambda w: (-own[w], w))[: LISTS[-1]]
        ranks[x] = {w: i for i, w in enumerate(mine)}
        n = totals.get(x, 0)
        telling[x] = {w: math.log(2 * n * own[w]) for w in mine[:TELLING]}
    return ranks, telling


def figures(text: str, ranks: dict[str, dict[str, int]], telling: dict[str, dict[str, float]]) -> tuple[int, list[float]]:
    """The language of a text, as an index, and its figures; a text without words has zeros."""
    text = _plain(text)
    words = _words(text)
    if not words:
        return 0, [0.0] * (len(LISTS) + 1)
    seen = set(words)
    at = likeliest(seen, telling)
    rank = ranks[LANGUAGES[at]]
    known = np.fromiter((rank.get(w, LISTS[-1]) for w in words), np.int32, len(words))
    outside = 1 - np.searchsorted(np.sort(known), LISTS) / len(words)
    sentences = sum(1 for s in STOPS.split(text) if WORDS.search(s))
    return at, [*outside.tolist(), len(words) / max(1, sentences)]


class Trees:
    """Least-squares boosting of trees of one depth over binned figures."""

    def __init__(self, rounds: int = 300, depth: int = 3, rate: float = 0.08, bins: int = 32, least: int = 8):
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], 1)

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        quantiles = np.linspace(0, 1, self.bins + 1)[1:-1]
        self.edges = [np.unique(np.quantile(x[:, j], quantiles)) for j in range(x.shape[1])]
        binned, (n, m), self.base, self.trees = self._bin(x), x.shape, float(y.mean()), []
        fitted, rows, column = np.full(n, self.base), np.arange(n), np.arange(m) * self.bins
        for _ in range(self.rounds):
            rest, node, splits = y - fitted, np.zeros(n, int), []
            for level in range(self.depth):
                nodes = 2**level
                code = ((node * m * self.bins)[:, None] + column + binned).ravel()
                size = nodes * m * self.bins
                total = np.bincount(code, np.repeat(rest, m), size).reshape(nodes, m, self.bins).cumsum(2)
                count = np.bincount(code, minlength=size).reshape(nodes, m, self.bins).cumsum(2)
                all_total, all_count = total[:, :1, -1:], count[:, :1, -1:]
                fair = (count >= self.least) & (all_count - count >= self.least)
                gain = np.where(fair, total**2 / np.maximum(count, 1) + (all_total - total) ** 2 / np.maximum(all_count - count, 1), -1.0).reshape(nodes, -1)
                best = gain.argmax(1)
                feature, bound = best // self.bins, np.where(gain.max(1) > 0, best % self.bins, self.bins)
                splits.append((feature, bound))
                node = node * 2 + (binned[rows, feature[node]] > bound[node])
            leaves = 2**self.depth
            value = self.rate * np.bincount(node, rest, leaves) / (np.bincount(node, minlength=leaves) + 1.0)
            self.trees.append((splits, value))
            fitted = fitted + value[node]
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        binned, rows, out = self._bin(x), np.arange(len(x)), np.full(len(x), self.base)
        for splits, value in self.trees:
            node = np.zeros(len(x), int)
            for feature, bound in splits:
                node = node * 2 + (binned[rows, feature[node]] > bound[node])
            out += value[node]
        return out


class Weights:
    """The formula proper: a weighted sum of the shares and the sentence length, and its logarithm, by ridge regression."""

    def __init__(self, ridge: float = 1.0):
        self.ridge = ridge

    def _columns(self, x: np.ndarray) -> np.ndarray:
        x = np.c_[x, np.log1p(x[:, -1])]
        if not hasattr(self, "mean"):
            self.mean, self.spread = x.mean(0), x.std(0) + 1e-9
        return np.c_[np.ones(len(x)), np.clip((x - self.mean) / self.spread, -4, 4)]

    def fit(self, x: np.ndarray, y: np.ndarray) -> Weights:
        a = self._columns(x)
        self.weights = np.linalg.solve(a.T @ a + self.ridge * np.eye(a.shape[1]), a.T @ y)
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self._columns(x) @ self.weights


class Formula:
    """A score of 1 to 4 from figures: with labels the mean of fitted weights and fitted trees, else the published formula."""

    def __init__(self):
        self.fitted: dict[int, tuple[Weights, Trees]] = {}
        self.models: dict[int, str] = {}

    def fit(self, language: np.ndarray, x: np.ndarray, level: np.ndarray) -> Formula:
        for at in range(len(LANGUAGES)):
            own = language == at
            # too few of a language: learn from all
            use = own if own.sum() >= LEAST_LABELS else np.ones(len(level), bool)
            if use.sum() >= LEAST_LABELS:
                self.models[at] = "own language" if use is own else "all languages"
                self.fitted[at] = Weights().fit(x[use], level[use]), Trees().fit(x[use], level[use])
        return self

    @staticmethod
    def published(x: np.ndarray) -> np.ndarray:
        """Levels by the familiar-word formula: 15.79 x share of words outside the list + 0.0496 x sentence length, and its bounds."""
        score = 15.79 * x[:, len(LISTS) - 1] + 0.0496 * x[:, -1]
        return 1 + (score >= 1.0) + (score >= 2.0) + (score >= 3.0)

    def levels(self, language: np.ndarray, x: np.ndarray) -> np.ndarray:
        out = self.published(x)
        for at, (weights, trees) in self.fitted.items():
            own = language == at
            if own.any():
                out[own] = np.clip(np.floor((weights.predict(x[own]) + trees.predict(x[own])) / 2 + 0.5), 1, 4)
        return out


def reading_levels(df: DataFrame, key: str, text: str, language: str, labels: DataFrame) -> DataFrame:
    """``key, level, formula, model`` of every row; ``labels(key, level)`` may rate a row several times.

    Document frequencies are taken over all rows: first those of stated language, then the others under the language that
    these tell. At most ``LABELLED`` labelled rows are used for fitting. ``model`` tells what rated a row: weights of its own
    language, or of all languages where it has fewer than ``LEAST_LABELS`` labels, or the published formula where all have
    fewer. ``formula`` is the level by the published formula in any case. A text without words has the lowest figures.
    ``df`` has no null texts; an empty table gives an empty one.
    """
    spark = df.sparkSession
    counts = cut(word_counts(df, text, language))
    _, telling = word_lists(counts)
    others = word_counts(df, text, language, spark.sparkContext.broadcast(telling))
    ranks, telling = word_lists(cut(counts.unionByName(others).groupBy("lang", "word").agg(F.sum("n").alias("n"))))
    lists = spark.sparkContext.broadcast((ranks, telling))  # bounded by LISTS and LANGUAGES
    kind = df.schema[key].dataType.simpleString()

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, telling = lists.value
        for batch in batches:
            rows = [figures(t, ranks, telling) for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(key), pa.array([a for a, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.list_(pa.float64()))], [key, "at", "x"])

    rated = labels.where(F.col("level").isNotNull()).groupBy(key).agg(F.avg("level").alias("_level"))
    chosen = rated.join(df.select(key), key, "left_semi").orderBy(F.xxhash64(key), key).limit(LABELLED)
    some = df.select(key, text).join(F.broadcast(chosen), key, "left_semi")  # at most LABELLED keys
    described = some.mapInArrow(describe, f"`{key}` {kind}, at int, x array<double>")
    known = described.join(F.broadcast(chosen), key).select("at", "x", "_level").toPandas()
    formula = Formula()
    if len(known) >= LEAST_LABELS:
        formula.fit(known["at"].to_numpy(), np.stack(known["x"].to_list()), known["_level"].to_numpy(float))
    shared = spark.sparkContext.broadcast(formula)

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks, telling = lists.value
        for batch in batches:
            if not batch.num_rows:
                continue
            at, x = zip(*(figures(t, ranks, telling) for t in batch.column(text).to_pylist()))
            at, x, own = np.array(at), np.array(x), shared.value
            columns = [pa.array(own.levels(at, x).astype(np.int32)), pa.array(own.published(x).astype(np.int32)), pa.array([own.models.get(i, "formula") for i in at.tolist()])]
            yield pa.RecordBatch.from_arrays([batch.column(key), *columns], [key, "level", "formula", "model"])

    return df.select(key, text).mapInArrow(rate, f"`{key}` {kind}, level int, formula int, model string")
