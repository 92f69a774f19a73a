"""Exact top-k inner-product search by the three-phase uniform threshold.

A vector's dimensions are dealt to groups; a group's part of the inner product
is its local score.  Phase one gathers, for each query, the heads of the local
score lists and resolves those entries; the k-th best total is a safe cutoff,
as k candidates reach it.  Phase two gives the cutoffs to all tasks, which
collect every entry whose local score in some group is at least a group's
uniform share of it: a total that reaches the cutoff must have one.  Phase
three resolves the collected entries exactly and keeps the best.

Queries are dealt to files of a bounded size in the shared folder, and so are
the cutoffs.  A task holds one block of candidates and one file of queries at a
time, so each phase is one pass over the candidates, which are never moved.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuspark.llm import files
from locuspark.llm.common import materialise, scratch_path

#: Values of the queries of one file, and of the candidates that a task holds, 8 bytes each.
WAVE_VALUES = 1 << 20
BLOCK_VALUES = 1 << 20
#: Scores of queries by candidates that a task computes at once, for each group.
SCORES = 1 << 20
_EXACT = 1 << 53
_LIMIT = 1 << 60
_NONE = np.iinfo(np.int64).min


def quantised(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", scale: float = 256.0) -> DataFrame:
    """``row``, ``vec_id`` and ``q``, floor(scale * x) of each component, for every usable row.

    Null vectors, null ids, and vectors with a null or non-finite component
    take no part.  Rows that repeat an id are rows of their own.
    """
    v = F.col(vec_col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = vectors.where(F.col(id_col).isNotNull() & v.isNotNull() & finite)
    q = F.transform(v, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))
    return usable.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("vec_id"), q.alias("q"))


def _matrix(column: pa.ListArray, width: int) -> np.ndarray:
    """Vectors as rows; short ones end in zeros, which add nothing to a product."""
    sizes = np.asarray(column.value_lengths())
    flat = np.asarray(column.flatten())
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width), np.int64)
    ends = np.cumsum(sizes)
    for i, (n, end) in enumerate(zip(sizes, ends)):
        n = min(int(n), width)  # no query reaches further
        out[i, :n] = flat[end - sizes[i] : end - sizes[i] + n]
    return out


def _blocks(batches: Iterator[pa.RecordBatch], width: int, values: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Row, id and vector of a bounded number of candidates at a time."""
    held, n = [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, max(1, values // width)):
            part = batch.slice(at, max(1, values // width))
            held.append((np.asarray(part.column(0)), np.asarray(part.column(1)), _matrix(part.column(2), width)))
            n += part.num_rows * width
            if n >= values:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held, n = [], 0
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


class _Queries:
    """Queries of one file, and their scores against candidates."""

    def __init__(self, uri: str, groups: int, width: int) -> None:
        table = files.read_block(uri)
        self.rows = np.asarray(table.column("row"))
        self.q = np.frombuffer(b"".join(table.column("q").to_pylist()), np.int64).reshape(len(self.rows), width)
        self.cuts = np.array_split(np.arange(width), min(groups, width))

    def local(self, at: slice, v: np.ndarray) -> list[np.ndarray]:
        """A matrix of local scores for each group: queries by candidates."""
        q = self.q[at]
        size = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * v.shape[1]
        if size >= _LIMIT:
            raise OverflowError("scores of 2^60 or more are not supported")
        # Products and sums of doubles are exact as long as no sum passes 2^53.
        kind = np.float64 if size < _EXACT else np.int64
        return [(q[:, c].astype(kind) @ v[:, c].T.astype(kind)).astype(np.int64) for c in self.cuts]

    def slices(self, candidates: int) -> Iterator[slice]:
        step = max(1, SCORES // max(1, candidates))
        return (slice(a, min(a + step, len(self.rows))) for a in range(0, len(self.rows), step))

    def heads(self, rows: np.ndarray, v: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows of queries, and the totals among the heads of their local lists, k of them or fewer."""
        for at in self.slices(len(rows)):
            parts = self.local(at, v)
            own = self.rows[at][:, None] == rows
            total = np.where(own, _NONE, sum(parts))
            if len(rows) > k:
                seen = np.zeros(total.shape, bool)
                for part in parts:
                    np.put_along_axis(seen, np.argpartition(np.where(own, _NONE, part), len(rows) - k, axis=1)[:, -k:], True, axis=1)
                total = np.partition(np.where(seen, total, _NONE), len(rows) - k, axis=1)[:, -k:]
            yield self.rows[at], total

    def sufficient(self, rows: np.ndarray, v: np.ndarray, cutoffs: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Positions of queries and candidates, and totals, of the entries that reach the cutoff."""
        for at in self.slices(len(rows)):
            parts = self.local(at, v)
            cutoff = cutoffs[at]
            share = -(-cutoff // len(parts))  # whole numbers reach a share if they reach the next whole number
            share[cutoff == _NONE] = _NONE
            enough = np.zeros(parts[0].shape, bool)
            for part in parts:
                enough |= part >= share[:, None]
            qi, vi = np.nonzero(enough & (self.rows[at][:, None] != rows))
            total = sum(p[qi, vi] for p in parts)
            best = total >= cutoff[qi]
            yield at.start + qi[best], vi[best], total[best]


def _trim(qi: np.ndarray, ids: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """The k best of each query, ties to smaller ids."""
    order = np.lexsort((ids, -score, qi))
    qi, ids, score = qi[order], ids[order], score[order]
    keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
    return qi[keep], ids[keep], score[keep]


def search(candidates: DataFrame, queries: DataFrame, k: int = 5, groups: int = 4, wave_values: int = WAVE_VALUES, block_values: int = BLOCK_VALUES) -> DataFrame:
    """``query_id``, ``rank`` from 1, ``vec_id``, ``score``: each query's k best candidates but its own row.

    Both tables hold ``row``, which says that a candidate is the query itself,
    ``vec_id`` and an array ``q`` of whole numbers.  Ids may repeat: each row
    is a candidate, and each query row is answered.  Ties go to smaller ids;
    with fewer candidates all are listed.  Vectors of unequal length are
    compared as if zeros followed.  Scores that may reach 2^60 are an error.
    """
    spark = candidates.sparkSession
    shape = queries.agg(F.count(F.lit(1)), F.max(F.size("q"))).first()
    n, width = shape[0], max(1, shape[1] or 0)
    schema = "query_id long, rank int, vec_id long, score long"
    if not n:
        return spark.createDataFrame([], schema)
    waves = max(1, -(-n * width // wave_values))
    folder = scratch_path(spark, "topk-queries")
    dealt = queries.select("row", "vec_id", "q", F.pmod(F.xxhash64("row"), F.lit(waves)).cast("int").alias("wave"))

    def write_queries(rows: pd.DataFrame) -> pd.DataFrame:
        wave = int(rows["wave"].iloc[0])
        rows = rows.sort_values("row")
        q = [np.pad(np.asarray(x, np.int64), (0, width - len(x))).tobytes() for x in rows["q"]]
        files.write_block(f"{folder}/queries-{wave:07d}.arrow", pa.table({"row": rows["row"].to_numpy(), "vec_id": rows["vec_id"].to_numpy(), "q": pa.array(q, pa.binary())}))
        return pd.DataFrame({"wave": [wave]})

    written = sorted(r[0] for r in materialise(dealt.groupBy("wave").applyInPandas(write_queries, "wave int"), "topk-waves").collect())  # a number a file
    vectors = candidates.select("row", "vec_id", "q")

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, v in _blocks(batches, width, block_values):
            for wave in written:
                for mine, best in _Queries(f"{folder}/queries-{wave:07d}.arrow", groups, width).heads(rows, v, k):
                    at, rank = np.nonzero(best != _NONE)
                    sizes = np.bincount(at, minlength=len(mine))
                    scores = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))), pa.int32()), pa.array(best[at, rank]))
                    yield pa.RecordBatch.from_arrays([pa.array([wave] * len(mine), pa.int32()), pa.array(mine), scores], ["wave", "row", "scores"])

    found = vectors.mapInArrow(heads, "wave int, row long, scores array<long>").groupBy("wave", "row")
    # With fewer than k heads nothing is cut.
    top = found.agg(F.sort_array(F.flatten(F.collect_list("scores")), asc=False).alias("top"))
    cutoffs = top.select("wave", "row", F.when(F.size("top") >= k, F.element_at("top", k)).otherwise(F.lit(_NONE)).alias("cutoff"))

    def write_cutoffs(rows: pd.DataFrame) -> pd.DataFrame:
        wave = int(rows["wave"].iloc[0])
        files.write_block(f"{folder}/cutoffs-{wave:07d}.arrow", pa.table({"cutoff": rows.sort_values("row")["cutoff"].to_numpy(np.int64)}))
        return pd.DataFrame({"wave": [wave]})

    materialise(cutoffs.groupBy("wave").applyInPandas(write_cutoffs, "wave int"), "topk-cutoffs").count()

    def resolve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, v in _blocks(batches, width, block_values):
            for wave in written:
                queries = _Queries(f"{folder}/queries-{wave:07d}.arrow", groups, width)
                cutoff = np.asarray(files.read_block(f"{folder}/cutoffs-{wave:07d}.arrow").column(0))
                for qi, vi, score in queries.sufficient(rows, v, cutoff):
                    qi, vec, score = _trim(qi, ids[vi], score, k)
                    yield pa.RecordBatch.from_arrays([pa.array(queries.rows[qi]), pa.array(vec), pa.array(score)], ["row", "vec_id", "score"])

    best = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    ranked = vectors.mapInArrow(resolve, "row long, vec_id long, score long").withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    named = queries.select(F.col("row"), F.col("vec_id").alias("query_id"))
    return ranked.join(named, "row").select("query_id", "rank", "vec_id", "score")


def search_ids(vectors: DataFrame, every: int = 50, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """The search with the rows whose id ``every`` divides as queries, against all rows."""
    points = materialise(quantised(vectors, id_col, vec_col, scale), "topk")
    return search(points, points.where(F.pmod("vec_id", F.lit(every)) == 0), k)
