"""The packed genotype: one row per marker, dosages in sample order.

Marker axis = partitions, sample axis = array.  All operators take and give
this shape; text files and long tables are brought into it once.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PACKED = "marker_idx int, snp string, chromosome string, position double, dosages array<double>"


@dataclass(frozen=True)
class Genotype:
    """Packed markers and the samples that their arrays follow."""

    packed: DataFrame
    taxa: tuple[str, ...]

    @property
    def n(self) -> int:
        return len(self.taxa)

    def count(self) -> int:
        return self.packed.count()

    def with_packed(self, packed: DataFrame) -> Genotype:
        return replace(self, packed=packed)

    def persist(self) -> Genotype:
        return self.with_packed(self.packed.persist())

    def markers(self, indexes: Sequence[int]) -> np.ndarray:
        """Samples x markers of a bounded selection, in the order asked for; repeats are allowed."""
        wanted = [int(i) for i in indexes]
        if not wanted:
            return np.zeros((self.n, 0))
        rows = self.packed.where(F.col("marker_idx").isin(sorted(set(wanted)))).select("marker_idx", "dosages").toArrow()
        by = {i: row for b in rows.to_batches() for i, row in zip(b.column(0).to_pylist(), matrix(b.column(1), self.n))}
        missing = [i for i in wanted if i not in by]
        if missing:
            raise IndexError(f"no markers {missing[:5]}")
        return np.column_stack([by[i] for i in wanted])

    def view(self, samples: Sequence[int] | None = None, markers: Sequence[int] | None = None) -> Genotype:
        """Lazy selection: both axes keep the given order, may repeat, and negative places count from the end.

        Markers are told by their place, 0 to count - 1, which is their index
        in whole genotypes; the view's markers are numbered by their order in
        it.  The wanted indexes reach the Parquet scan as a filter.
        """
        packed, taxa = self.packed, self.taxa
        if markers is not None:
            wanted = list(markers)
            at = _indexes(wanted, self.count())
            order = pa.table({"marker_idx": pa.array(at, pa.int32()), "_place": pa.array(range(len(at)), pa.int32())})
            chosen = packed.where(F.col("marker_idx").isin(sorted(set(at))))
            rows = chosen.join(F.broadcast(packed.sparkSession.createDataFrame(order)), "marker_idx")  # as many rows as were asked for
            packed = rows.withColumn("marker_idx", F.col("_place")).select(*packed.columns)
        if samples is not None:
            at = _indexes(samples, self.n)
            taxa, order = tuple(taxa[i] for i in at), np.array(at, int)
            n = self.n

            @F.arrow_udf("array<double>")
            def picked(column: pa.Array) -> pa.Array:
                part = matrix(column, n)[:, order]
                return pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * len(order), pa.int32()), pa.array(part.ravel()))

            packed = packed.withColumn("dosages", picked("dosages"))
        return Genotype(packed, taxa)

    def blocks(self, start: int, stop: int) -> Genotype:
        """Markers from start up to stop; a range that the scan's statistics can skip by."""
        return self.with_packed(self.packed.where((F.col("marker_idx") >= start) & (F.col("marker_idx") < stop)))


def _indexes(values: Iterable[int], size: int) -> list[int] | np.ndarray:
    if isinstance(values, np.ndarray) and values.dtype.kind == "i" and (not len(values) or -size <= values.min() and values.max() < size):
        return values % size
    out = []
    for v in values:
        if isinstance(v, (bool, np.bool_)) or int(v) != v:
            raise TypeError("indexes must be whole numbers")
        v = int(v)
        if not -size <= v < size:
            raise IndexError(f"index {v} is outside 0..{size - 1}")
        out.append(v % size)
    return out


def from_array(spark: SparkSession, gd: np.ndarray, taxa: Sequence[str] | None = None, snps: Sequence[str] | None = None, chromosomes: Sequence[str] | None = None, positions: Sequence[float] | None = None) -> Genotype:
    """Samples x markers in memory as a packed genotype; NaN is missing."""
    gd = np.asarray(gd, float)
    if gd.ndim != 2:
        raise ValueError("a genotype matrix has two dimensions")
    n, m = gd.shape
    taxa = tuple(map(str, taxa)) if taxa is not None else tuple(f"T{i + 1}" for i in range(n))
    check_taxa(taxa)
    if len(taxa) != n:
        raise ValueError(f"{n} samples but {len(taxa)} taxa")
    columns = {
        "marker_idx": pa.array(range(m), pa.int32()),
        "snp": pa.array([str(s) for s in snps] if snps is not None else [f"SNP{i + 1}" for i in range(m)]),
        "chromosome": pa.array([str(c) for c in chromosomes] if chromosomes is not None else ["1"] * m),
        "position": pa.array(np.asarray(positions, float) if positions is not None else np.arange(1.0, m + 1)),
        "dosages": pa.ListArray.from_arrays(pa.array(np.arange(0, n * m + 1, max(n, 1))[: m + 1] if n else np.zeros(m + 1), pa.int32()), pa.array(np.ascontiguousarray(gd.T).ravel(), from_pandas=True)),
    }
    return Genotype(spark.createDataFrame(pa.table(columns)).selectExpr(*_cast()), taxa)


def _cast() -> list[str]:
    return [f"cast({name} as {kind}) as {name}" for name, kind in (f.split(" ", 1) for f in PACKED.split(", "))]


def from_long(long: DataFrame, markers: DataFrame, taxa: Sequence[str], absent: float = float("nan")) -> Genotype:
    """(sample_idx, marker_idx, dosage) and (marker_idx, snp, chromosome, position); absent cells are missing, or as told.

    The one transpose of an analysis: a shuffle by marker.  Cells come in any order and are put in their places.
    """
    n = len(taxa)
    cells = long.where(F.col("dosage").isNotNull()).select("marker_idx", F.col("sample_idx").cast("int").alias("s"), F.col("dosage").cast("double").alias("d"))
    cells = cells.groupBy("marker_idx").agg(F.collect_list("s").alias("s"), F.collect_list("d").alias("d"))
    joined = markers.select("marker_idx", "snp", "chromosome", "position").join(cells, "marker_idx", "left").selectExpr(*_cast()[:-1], "s", "d")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, value = batch.column(4), batch.column(5)
            sizes = np.asarray(at.value_lengths().fill_null(0))
            out = np.full((batch.num_rows, n), absent)
            out[np.repeat(np.arange(batch.num_rows), sizes), np.asarray(at.flatten())] = np.asarray(value.flatten())
            ends = pa.array(np.arange(batch.num_rows + 1) * n, pa.int32())
            dosages = pa.ListArray.from_arrays(ends, pa.array(out.ravel(), from_pandas=True))
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], dosages], ["marker_idx", "snp", "chromosome", "position", "dosages"])

    return Genotype(joined.mapInArrow(place, PACKED), tuple(taxa))


def to_long(genotype: Genotype) -> DataFrame:
    """marker_idx, sample_idx, dosage; missing cells are null."""
    return genotype.packed.select("marker_idx", F.posexplode("dosages").alias("sample_idx", "dosage")).withColumn("dosage", F.when(~F.isnan("dosage"), F.col("dosage")))


def dosage_sum(dosages: Column) -> Column:
    """Sum over the dosages that are not missing."""
    return F.aggregate(dosages, F.lit(0.0), lambda s, x: s + F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))


def matrix(column: pa.ListArray, n: int) -> np.ndarray:
    """Markers x samples of an Arrow batch; missing is NaN."""
    sizes = np.asarray(column.value_lengths())
    if len(sizes) and not (sizes == n).all():
        raise ValueError(f"dosages must have {n} samples")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), n)


def check_taxa(taxa: Sequence[object]) -> None:
    bad = [t for t in taxa if t is None or not str(t).strip()]
    if bad:
        raise ValueError("taxa must not be null or blank")
    if len(taxa) == len(set(map(str, taxa))):
        return
    seen: set[str] = set()
    again = sorted({str(t) for t in taxa if str(t) in seen or seen.add(str(t))})
    if again:
        raise ValueError(f"taxa occur more than once: {', '.join(again[:5])}")
