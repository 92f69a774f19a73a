"""Toxicity by class-conditional Kneser-Ney models of how words are spelled.

Each class has an interpolated Kneser-Ney model of characters within words:
discounted counts of its own at full history, and below that one backoff
distribution that both classes share, made of continuation counts.  Where a
class has not seen an expression, only its backoff weight speaks.  A word's
evidence is the difference of its log-likelihoods under the two models.

A document is as toxic as its worst passage: the two log-likelihoods are
compared, normalised by length, over every window of words and over the whole
text, and a logistic curve, fitted on rows that the models did not count, turns
peak and mean into a probability.  A word that a window repeats counts once.
All grams count, also those seen once, and all words of a text are scored.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled rows of each class that the models are fitted on at most, by hash of the id.
MAX_ROWS_PER_CLASS = 12_000
ORDER = 5
WINDOW = 8
DISCOUNT = 0.75
_CACHE_WORDS = 100_000
_WORD = re.compile(r"[^\W_]+")
#: Longer runs of letters and digits are scored in pieces of about a word's length, each after the history before it.
LONGEST_WORD = 64
PIECE = 8


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def _units(text: str | None, order: int) -> list[str | tuple[str, int]]:
    """The words of a text; of a long run its pieces, as the history with the piece and the length of the history."""
    units: list[str | tuple[str, int]] = []
    for word in words_of(text):
        if len(word) <= LONGEST_WORD:
            units.append(word)
            continue
        marked = f"^{word}$"
        for at in range(1, len(word) + 1, PIECE):
            begin, end = max(0, at - order + 1), at + PIECE if at + PIECE <= len(word) else len(marked)
            units.append((marked[begin:end], at - begin))
    return units


def _grams(unit: str | tuple[str, int], order: int) -> Iterator[str]:
    """Each character of a word and its end, or of a piece, after the history that the models use."""
    marked, first = (f"^{unit}$", 1) if isinstance(unit, str) else unit
    return (marked[max(0, i - order + 1) : i + 1] for i in range(first, len(marked)))


@dataclass
class SpellingModels:
    """Evidence of grams, and of histories alone for grams that were not seen after them."""

    seen: dict[str, float]
    unseen: dict[str, float]
    order: int = ORDER
    window: int = WINDOW
    weights: tuple[float, float, float] = (0.0, 1.0, 0.0)  # of the constant, the peak and the mean
    prior: float = 0.5
    _words: dict[str | tuple[str, int], float] = field(default_factory=dict, repr=False)

    @classmethod
    def fit(cls, counts: dict[str, tuple[int, int]], order: int = ORDER, window: int = WINDOW, discount: float = DISCOUNT) -> SpellingModels:
        """From the counts of each gram in the ordinary and in the toxic class."""
        total: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
        kinds: tuple[dict, dict] = (defaultdict(int), defaultdict(int))
        for gram, pair in counts.items():
            for c in (0, 1):
                if pair[c]:
                    total[c][gram[:-1]] += pair[c]
                    kinds[c][gram[:-1]] += 1
        shared = _SharedBackoff(counts, order, discount)

        def backoff(c: int, history: str) -> float:
            return discount * kinds[c][history] / total[c][history] if history in total[c] else 1.0

        seen, unseen = {}, {}
        for gram, pair in counts.items():
            history = gram[:-1]
            lower = shared.probability(history[1:], gram[-1])
            p = [(max(pair[c] - discount, 0.0) / total[c][history] if history in total[c] else 0.0) + backoff(c, history) * lower for c in (0, 1)]
            seen[gram] = math.log(p[1]) - math.log(p[0])
            unseen[history] = math.log(backoff(1, history)) - math.log(backoff(0, history))
        return cls(seen, unseen, order, window)

    def evidence(self, word: str | tuple[str, int]) -> float:
        """Log-likelihood of the word, or piece of a long run, under the toxic model less that under the ordinary one."""
        known = self._words.get(word)
        if known is None:
            seen, unseen, known = self.seen, self.unseen, 0.0
            for gram in _grams(word, self.order):
                value = seen.get(gram)
                known += unseen.get(gram[:-1], 0.0) if value is None else value
            if len(self._words) >= _CACHE_WORDS:
                self._words.clear()
            self._words[word] = known
        return known

    def features(self, text: str | None) -> tuple[int, float, float]:
        """Words and pieces of long runs, the largest mean evidence of a window, and the mean evidence of the text."""
        words = _units(text, self.order)
        if not words:
            return 0, 0.0, 0.0
        known, evidence = self._words, self.evidence
        values = np.array([known[w] if w in known else evidence(w) for w in words])
        # A word that a window holds again adds nothing.
        numbers: dict[str | tuple[str, int], int] = {}
        same = np.array([numbers.setdefault(w, len(numbers)) for w in words])
        again = np.zeros(len(values), bool)
        for lag in range(1, min(self.window, len(values))):
            again[lag:] |= same[lag:] == same[:-lag]
        values[again] = 0.0
        sums = np.concatenate(([0.0], np.cumsum(values)))
        if len(words) <= self.window:
            peak = sums[-1]
        else:
            peak = (sums[self.window :] - sums[: -self.window]).max()
        return len(words), peak / self.window, sums[-1] / max(len(words), self.window)

    def probability(self, n: int, peak: float, mean: float) -> float:
        """Texts without words have the share of toxic rows."""
        if not n:
            return self.prior
        z = self.weights[0] + self.weights[1] * peak + self.weights[2] * mean
        return 1 / (1 + math.exp(-z)) if z > -700 else 0.0


class _SharedBackoff:
    """Kneser-Ney probabilities from continuation counts of all grams, whatever their class."""

    def __init__(self, counts: dict[str, tuple[int, int]], order: int, discount: float) -> None:
        self.discount = discount
        self.count: dict[str, int] = defaultdict(int)
        self.total: dict[str, int] = defaultdict(int)
        self.kinds: dict[str, int] = defaultdict(int)
        grams = set(counts)
        for size in range(order, 1, -1):
            # A gram is continued by each different character before it.
            for gram in (g for g in grams if len(g) == size):
                self.count[gram[1:]] += 1
            grams |= {g for g in self.count if len(g) == size - 1}
        for gram, n in self.count.items():
            self.total[gram[:-1]] += n
            self.kinds[gram[:-1]] += 1
        self.floor = 1.0 / (self.kinds.get("", 0) + 1)
        self._known: dict[str, float] = {}

    def probability(self, history: str, character: str) -> float:
        gram = history + character
        known = self._known.get(gram)
        if known is None:
            lower = self.probability(history[1:], character) if history else self.floor
            n = self.total.get(history, 0)
            known = lower
            if n:
                known = (max(self.count.get(gram, 0) - self.discount, 0.0) + self.discount * self.kinds[history] * lower) / n
            self._known[gram] = known
        return known


def fold(id_col: Column, folds: int = 5) -> Column:
    """crc32 of the id as text, modulo the folds; rows without an id are held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % folds, F.lit(0)).cast("int")


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_rows: int = MAX_ROWS_PER_CLASS) -> SpellingModels:
    """Models from labelled rows that are not held out.

    Of each class, the ``max_rows`` rows with the smallest id hashes are used:
    folds 1 to 3 are counted, fold 4 sets the curve.  Rows without a label or
    id are ignored; of contradicting labels the toxic one holds.  Without rows
    of both classes everything is ordinary.
    """
    spark = docs.sparkSession
    marked = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    marked = marked.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    marked = marked.withColumn("fold", fold(F.col("doc_id"))).where("fold <> 0")
    sizes = {r["label"]: r["n"] for r in marked.where("label in (0, 1)").groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    if not sizes.get(0) or not sizes.get(1):
        return SpellingModels({}, {}, weights=(math.log(1e-6), 0.0, 0.0), prior=1e-6)
    chosen = None
    for c in (0, 1):
        part = marked.where(F.col("label") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
        chosen = part if chosen is None else chosen.union(part)
    # Two times max_rows short rows at most.
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(F.broadcast(chosen), "doc_id").select("label", "fold", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def grams() -> pa.RecordBatch:
            found: dict[str, list[int]] = defaultdict(lambda: [0, 0])
            for c in (0, 1):
                for word, n in words[c].items():
                    for gram in _grams(word, ORDER):
                        found[gram][c] += n
                words[c].clear()
            columns = [pa.array(list(found), pa.string()), *(pa.array([v[c] for v in found.values()], pa.int64()) for c in (0, 1))]
            return pa.RecordBatch.from_arrays(columns, ["gram", "ordinary", "toxic"])

        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                words[label].update(words_of(text.as_py()))
            if len(words[0]) + len(words[1]) > 300_000:
                yield grams()
        yield grams()

    counted = rows.where("fold < 4").select("label", "text").mapInArrow(count, "gram string, ordinary long, toxic long")
    counted = counted.groupBy("gram").agg(F.sum("ordinary").alias("ordinary"), F.sum("toxic").alias("toxic"))
    # The grams of a bounded number of texts.
    counts = {g: (a, b) for g, a, b in counted.toLocalIterator(prefetchPartitions=True)}
    models = SpellingModels.fit(counts)
    models.prior = sizes[1] / (sizes[0] + sizes[1])
    sent = spark.sparkContext.broadcast(models)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.features(t.as_py()) for t in batch.column(1)]
            columns = [batch.column(0), *(pa.array([f[k] for f in found]) for k in range(3))]
            yield pa.RecordBatch.from_arrays(columns, ["label", "n", "peak", "mean"])

    measured = rows.where("fold = 4").select("label", "text").mapInArrow(measure, "label int, n long, peak double, mean double")
    points = np.array([tuple(r) for r in measured.where("n > 0").collect()], float).reshape(-1, 4)
    models.weights = _logistic(points, sizes)
    return models


def _logistic(points: np.ndarray, sizes: dict[int, int], rounds: int = 50, ridge: float = 1e-3) -> tuple[float, float, float]:
    """Weights of the constant, peak and mean by Newton steps; rows weigh as their class does among all labels."""
    y = points[:, 0]
    if len(np.unique(y)) < 2:
        return (math.log(sizes[1] / sizes[0]), 1.0, 0.0)
    x = np.column_stack([np.ones(len(y)), points[:, 2], points[:, 3]])
    weight = np.where(y == 1, sizes[1] / y.sum(), sizes[0] / (1 - y).sum())
    weight *= len(y) / weight.sum()
    w = np.zeros(3)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (weight * (p - y)) + ridge * w
        hessian = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(3)
        step = np.linalg.solve(hessian, gradient)
        w -= step * min(1.0, 5.0 / (np.abs(step).max() + 1e-12))
        if np.abs(step).max() < 1e-8:
            break
    return tuple(w.tolist())


def score(docs: DataFrame, models: SpellingModels, text_col: str = "text", out_col: str = "score") -> DataFrame:
    """``docs`` with the probability of the toxic label; it depends on the text alone, null being empty."""
    source = docs.drop(out_col).withColumn(text_col, F.col(text_col).cast("string"))
    at = source.columns.index(text_col)
    schema = source.withColumn(out_col, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sent.value.probability(*sent.value.features(t.as_py())) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out_col])

    return source.mapInArrow(run, schema)
