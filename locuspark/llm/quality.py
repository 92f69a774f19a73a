"""Quality by importance resampling over hashed n-grams.

Two bag-of-n-grams models over the same hash buckets are counted: one of the
target rows, one of all raw rows.  A text's log importance weight is the
log-likelihood ratio of all its n-grams under the two models.  Adding Gumbel
noise and taking the k largest samples k documents without replacement in
proportion to their weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.llm.common import materialise, unused

#: Hash buckets of the models; each task counts into two arrays of this size.
BUCKETS = 1 << 16
#: Rows of the target model, those with the smallest id hashes; the raw model counts all rows.
MAX_TARGET_ROWS = 50_000
#: Weight of the raw model in the target model, as a number of n-grams.
PRIOR = 1000.0
_BIGRAM = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(40)


def _buckets(text: str | None, buckets: int) -> np.ndarray:
    """Buckets of a text's lower-cased words and pairs of neighbouring words."""
    words = text.lower().encode().split() if text else []
    one = np.fromiter(map(crc32, words), np.uint64, len(words))
    mixed = one * _BIGRAM
    two = (mixed[:-1] ^ (mixed[:-1] >> np.uint64(29))) * _BIGRAM + mixed[1:]
    both = np.concatenate([mixed >> _SHIFT, (two * _BIGRAM) >> _SHIFT])
    return (both % np.uint64(buckets)).astype(np.int64)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", buckets: int = BUCKETS, max_rows: int = MAX_TARGET_ROWS) -> np.ndarray:
    """Log ratio of each bucket's probability: rows labelled 1 over all rows.

    All rows count as raw, labelled or not; null and empty texts add nothing.
    The target model starts from the raw one, so little evidence says little.
    Of contradicting labels of an id the larger holds.  The target model counts
    ``max_rows`` rows at most.
    """
    good = labels.where(F.col(label_col) == 1).select(F.col(id_col).cast("long").alias("doc_id")).where("doc_id is not null").distinct()
    chosen = good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows).withColumn("target", F.lit(True))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # At most max_rows ids go to all tasks; texts stay where they are.
    marked = rows.join(F.broadcast(chosen), "doc_id", "left").select(F.coalesce("target", F.lit(False)).alias("target"), "text")
    raw, target = _counts(marked, buckets)
    q = (raw + 0.5) / (raw.sum() + 0.5 * buckets)
    p = (target + PRIOR * q) / (target.sum() + PRIOR)
    return np.log(p) - np.log(q)


def _counts(rows: DataFrame, buckets: int) -> np.ndarray:
    """N-grams by bucket of all rows, and of those marked as target."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((2, buckets), np.int64)
        for batch in batches:
            found = [_buckets(text.as_py(), buckets) for text in batch.column(1)]
            good = [f for f, t in zip(found, batch.column(0).to_pylist()) if t]
            for k, part in enumerate((found, good)):
                if part:
                    counts[k] += np.bincount(np.concatenate(part), minlength=buckets)
        at = np.nonzero(counts[0])[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(counts[0, at]), pa.array(counts[1, at])], ["bucket", "raw", "target"])

    out = np.zeros((2, buckets))
    # At most one row a bucket.
    for bucket, raw, target in rows.mapInArrow(run, "bucket int, raw long, target long").groupBy("bucket").agg(F.sum("raw"), F.sum("target")).collect():
        out[:, bucket] = raw, target
    return out


def log_weights(docs: DataFrame, ratio: np.ndarray, text_col: str = "text", out_col: str = "log_weight") -> DataFrame:
    """``docs`` with the log importance weight of each text; texts without words weigh as raw text does, 0."""
    source = docs.drop(out_col).withColumn(text_col, F.col(text_col).cast("string"))
    at = source.columns.index(text_col)
    schema = source.withColumn(out_col, F.lit(0.0)).schema
    sent = docs.sparkSession.sparkContext.broadcast(ratio)

    def weight(text: str | None) -> float:
        found = _buckets(text, len(sent.value))
        return float(sent.value[found].sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [weight(t.as_py()) for t in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], [*batch.schema.names, out_col])

    return source.mapInArrow(run, schema)


def gumbel(id_col: Column, seed: int = 0) -> Column:
    """Standard Gumbel noise that follows from the id and the seed alone."""
    uniform = (F.shiftrightunsigned(F.xxhash64(id_col, F.lit(seed)), 11) + F.lit(0.5)) / F.lit(float(1 << 53))
    return -F.log(-F.log(uniform))


def _kth_largest(rows: DataFrame, column: str, k: int, parts: int = 1024) -> tuple[object, int]:
    """The k-th largest value of a column without nulls, and the number of rows above it.

    Rows are counted by which of ``parts`` equal pieces of the interval they
    fall in, then the piece with the k-th is cut again: a bounded number of
    counts a pass, whatever the ties.
    """
    value = F.col(column)
    whole = dict(rows.dtypes)[column] == "bigint"
    low, high = rows.agg(F.min(value), F.max(value)).first()
    above = 0
    while low < high:
        if whole:
            width = -(-(high - low + 1) // parts)
            part = F.floor((value.cast("decimal(38,0)") - F.lit(low).cast("decimal(38,0)")) / F.lit(width).cast("decimal(38,0)"))
        else:
            width = (high - low) / parts
            if low + width == low or high - width == high:  # so few doubles are left that each is counted
                part = value
            else:
                part = F.least(F.floor((value - F.lit(low)) / F.lit(width)), F.lit(parts - 1))
        counts = rows.where((value >= F.lit(low)) & (value <= F.lit(high))).groupBy(part.alias("part"))
        counts = counts.agg(F.count(F.lit(1)).alias("n"), F.min(value).alias("a"), F.max(value).alias("b")).collect()
        for row in sorted(counts, key=lambda r: r["a"], reverse=True):
            if above + row["n"] >= k:
                break
            above += row["n"]
        low, high = row["a"], row["b"]
    return low, above


def gumbel_top_k(weighted: DataFrame, fraction: float, id_col: str = "doc_id", weight_col: str = "log_weight", seed: int = 0) -> DataFrame:
    """``weighted`` with ``gumbel_key`` and ``selected``: true for the k rows with the largest keys.

    k is ``fraction`` of the rows, rounded up, and exactly k rows are selected.
    Of rows with the very key of the k-th, those with the smallest ids are
    taken, null ids last; rows that share the id as well are taken in an order
    that the stored table fixes.  Columns named as the two results are replaced.
    """
    key = "gumbel_key"
    weighted = weighted.drop(key, "selected")
    place, order = unused(weighted, "_place", "_order")
    keyed = weighted.withColumn(key, F.col(weight_col) + gumbel(F.col(id_col), seed))
    keyed = materialise(keyed.withColumn(order, F.bitwise_not(F.col(id_col).cast("long"))).withColumn(place, F.negative(F.monotonically_increasing_id())), "gumbel")
    columns = [c for c in keyed.columns if c not in (place, order)]
    total = keyed.count()
    k = min(total, -int(-total * fraction // 1))
    if k <= 0:
        return keyed.select(*columns, F.lit(False).alias("selected"))
    edge, above = _kth_largest(keyed, key, k)
    selected, tied = F.col(key) > F.lit(edge), F.col(key) == F.lit(edge)
    needed = k - above
    named = keyed.where(tied & F.col(order).isNotNull())
    n_named = named.count()
    if needed <= n_named:
        first, above = _kth_largest(named, order, needed)
        selected, tied = selected | (tied & F.coalesce(F.col(order) > F.lit(first), F.lit(False))), tied & F.coalesce(F.col(order) == F.lit(first), F.lit(False))
        needed -= above
    else:
        selected, tied = selected | (tied & F.col(order).isNotNull()), tied & F.col(order).isNull()
        needed -= n_named
    last, _ = _kth_largest(keyed.where(tied), place, needed)
    return keyed.select(*columns, (selected | (tied & (F.col(place) >= F.lit(last)))).alias("selected"))
