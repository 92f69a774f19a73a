"""Linkage disequilibrium: squared correlations of marker pairs."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.operators.blocks import BlockKinship, SampleBlocks, correlations
from locuspark.session import MAX_SAMPLES
from locuspark.sources.genotype import Genotype, matrix


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def _with_moments(packed: DataFrame, n: int) -> DataFrame:
    clean = F.transform("dosages", lambda x: F.when(x.isNull() | F.isnan(x), F.lit(0.0)).otherwise(x))
    mean = F.aggregate("g", F.lit(0.0), lambda s, x: s + x) / n
    rows = packed.withColumn("g", clean).withColumn("mean", mean)
    return rows.withColumn("d", F.transform("g", lambda x: x - F.col("mean"))).withColumn("ss", _dot(F.col("d"), F.col("d"))).drop("g", "dosages", "mean")


def r_squared(a_d: Column, a_ss: Column, b_d: Column, b_ss: Column) -> Column:
    """Null where a marker does not vary."""
    return F.when((a_ss > 0) & (b_ss > 0), F.least(F.lit(1.0), F.pow(_dot(a_d, b_d), F.lit(2.0)) / (a_ss * b_ss)))


#: Markers whose products the driver holds; pairs of more come from tiles of markers. Bytes of a tile.
MAX_SQUARE, TILE_BYTES = 2000, 1 << 24


def ld_matrix(genotype: Genotype, max_snps: int | None = None) -> DataFrame:
    """``i``, ``j``, ``r2`` for i <= j; 1 on the diagonal, null for markers that do not vary.

    All markers, or the first ``max_snps`` if a caller asks for those.  Up to
    ``MAX_SQUARE`` of them, their products are summed over blocks of samples and
    reach the driver; the pairs of more are made on the executors.  Missing counts as 0.
    """
    spark, packed = genotype.packed.sparkSession, genotype.packed
    if max_snps is not None:
        first = [r[0] for r in packed.select("marker_idx").orderBy("marker_idx").limit(max_snps).collect()]
        packed = packed.where(F.col("marker_idx").isin(first))
    wanted = sorted(r[0] for r in packed.select("marker_idx").limit(MAX_SQUARE + 1).collect())
    if not wanted:
        return spark.createDataFrame([], "i int, j int, r2 double")
    if len(wanted) > MAX_SQUARE:
        return _tiled(genotype.with_packed(packed))
    return _pairs(spark, wanted, correlations(products(genotype, wanted)))


def _tiled(genotype: Genotype) -> DataFrame:
    """The pairs of any number of markers: each pair of tiles meets in one task, and nothing is collected."""
    n = genotype.n
    tiles = -(-genotype.count() // max(1, min(512, TILE_BYTES // (8 * max(1, n)))))

    def squared(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        index, tile = np.asarray(table.column("marker_idx")), np.asarray(table.column("tile"))
        g = np.nan_to_num(matrix(table.column("dosages").combine_chunks(), n), copy=False)
        g -= g.mean(axis=1, keepdims=True)
        spread = np.sqrt((g**2).sum(axis=1))
        here, there = (np.nonzero(tile == k.as_py())[0] for k in key)
        with np.errstate(divide="ignore", invalid="ignore"):
            scale = np.outer(spread[here], spread[there])
            r2 = np.where(scale > 0, np.minimum((g[here] @ g[there].T / scale) ** 2, 1.0), np.nan)
        i, j = np.repeat(index[here], len(there)), np.tile(index[there], len(here))
        r2 = np.where(i == j, 1.0, r2.ravel())
        keep = i <= j if key[0] == key[1] else np.ones(len(i), bool)
        return pa.table({"i": pa.array(np.minimum(i, j)[keep], pa.int32()), "j": pa.array(np.maximum(i, j)[keep], pa.int32()), "r2": pa.array(r2[keep], from_pandas=True)})

    rows = genotype.packed.select("marker_idx", "dosages", F.pmod(F.xxhash64("marker_idx"), F.lit(tiles)).cast("int").alias("tile"))
    met = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
    met = met.withColumn("a", F.least("tile", "other")).withColumn("b", F.greatest("tile", "other")).drop("other")
    return met.groupBy("a", "b").applyInArrow(squared, "i int, j int, r2 double")


def products(genotype: Genotype, markers: Sequence[int] | None = None) -> np.ndarray:
    """Products of centred markers, in the order of their index; missing counts as 0."""
    blocks = SampleBlocks.of(genotype, markers)
    try:
        return BlockKinship.over(blocks, 0.0).gram()
    finally:
        blocks.rows.unpersist()


def _pairs(spark: SparkSession, markers: Sequence[int], r: np.ndarray) -> DataFrame:
    """Squared correlations of i <= j: a row of the matrix is sent for each marker."""
    r2 = np.minimum(r**2, 1.0)
    np.fill_diagonal(r2, 1.0)
    values = [pa.array(row[i:], from_pandas=True) for i, row in enumerate(r2)]
    table = pa.table({"i": pa.array(markers, pa.int32()), "js": pa.array([markers[i:] for i in range(len(markers))], pa.list_(pa.int32())), "r2": pa.array([v.to_pylist() for v in values], pa.list_(pa.float64()))})
    cells = spark.createDataFrame(table).select("i", F.explode(F.arrays_zip("js", "r2")).alias("c"))
    return cells.select("i", F.col("c.js").alias("j"), F.col("c.r2").alias("r2"))


def ld_decay(genotype: Genotype, chromosome: str | None = None, max_dist: float = 1_000_000, every: bool = False) -> DataFrame:
    """``distance`` and ``r2`` of the pairs of a chromosome within ``max_dist``, the first chromosome by default, or of ``every`` one.

    A range join: positions are cut into cells of ``max_dist``, and a marker
    meets its own cell and both neighbours, as maps need not be sorted.  Of
    few markers, the correlations come from products over blocks of samples.
    """
    packed = genotype.packed
    if not every:
        if chromosome is None:
            row = packed.select("marker_idx", "chromosome").orderBy("marker_idx").limit(1).collect()
            chromosome = row[0]["chromosome"] if row else ""
        packed = packed.where(F.col("chromosome") == chromosome)
    few = [r[0] for r in packed.select("marker_idx").limit(min(genotype.n, MAX_SAMPLES + 1)).collect()]
    if 0 < len(few) < genotype.n and len(few) <= MAX_SAMPLES:
        return _near(genotype.with_packed(packed), max_dist)
    rows = _with_moments(packed.select("marker_idx", "chromosome", "position", "dosages"), genotype.n).withColumn("cell", F.floor(F.col("position") / F.lit(float(max(max_dist, 1)))))
    around = F.explode(F.array(*[F.col("cell") + F.lit(k) for k in (-1, 0, 1)]))
    a = rows.select("chromosome", F.col("marker_idx").alias("i"), F.col("position").alias("ap"), F.col("d").alias("ad"), F.col("ss").alias("ass"), around.alias("cell"))
    b = rows.select("chromosome", F.col("marker_idx").alias("j"), F.col("position").alias("bp"), F.col("d").alias("bd"), F.col("ss").alias("bss"), "cell")
    distance = F.abs(F.col("bp") - F.col("ap"))
    pairs = a.join(b, ["chromosome", "cell"]).where((F.col("j") > F.col("i")) & (distance <= max_dist))
    return pairs.select("i", "j", distance.alias("distance"), r_squared(F.col("ad"), F.col("ass"), F.col("bd"), F.col("bss")).alias("r2")).where("r2 is not null")


def _near(genotype: Genotype, max_dist: float) -> DataFrame:
    """The pairs of few markers, whose map the driver holds."""
    places = sorted(tuple(r) for r in genotype.packed.select("marker_idx", "chromosome", "position").collect())
    r2 = np.minimum(correlations(products(genotype)) ** 2, 1.0)
    at = np.array([np.nan if p[2] is None else p[2] for p in places], float)
    names = {c: k for k, c in enumerate({p[1] for p in places} - {None})}
    chromosome = np.array([names.get(p[1], -1) for p in places])
    rows: list[np.ndarray] = []
    for i in range(len(places) - 1):
        j = np.arange(i + 1, len(places))
        rows.append(j[(chromosome[j] == chromosome[i]) & (chromosome[i] >= 0) & (np.abs(at[j] - at[i]) <= max_dist) & np.isfinite(r2[i, j])])
    first = np.repeat(np.arange(len(rows)), [len(j) for j in rows]).astype(int)
    second = np.concatenate([*rows, np.zeros(0, int)]).astype(int)
    index = np.array([p[0] for p in places], np.int32)
    return genotype.packed.sparkSession.createDataFrame(pa.table({"i": index[first], "j": index[second], "distance": np.abs(at[second] - at[first]), "r2": r2[first, second]}))


def prune_markers(genotype: Genotype, threshold: float = 0.7) -> list[int]:
    """``ld_prune`` of all markers in the order of their index, whose products stand for the samples; few markers, any number of samples."""
    index = sorted(r[0] for r in genotype.packed.select("marker_idx").collect())
    gram = products(genotype)
    spread = np.sqrt(np.diag(gram) / genotype.n)
    r = np.abs(correlations(gram))
    kept, left = [], np.arange(len(index))
    while len(left):
        ref, left = left[0], left[1:]
        kept.append(index[ref])
        if spread[ref] >= 1e-8:
            left = left[(spread[left] >= 1e-8) & (r[ref, left] <= threshold)]
    return kept


def ld_prune(values: np.ndarray, threshold: float = 0.7) -> list[int]:
    """Positions of the columns kept: each, in order, drops later ones with a larger absolute correlation.

    Candidates are samples x markers in order of significance.  Later columns
    that do not vary are dropped; one that comes to be a reference drops none.
    """
    kept, left = [], list(range(values.shape[1]))
    centred = values - values.mean(axis=0)
    spread = values.std(axis=0)
    while left:
        ref, *rest = left
        kept.append(ref)
        if spread[ref] >= 1e-8 and rest:
            at = np.array(rest)
            varies = spread[at] >= 1e-8
            r = np.zeros(len(at))
            r[varies] = np.abs(centred[:, ref] @ centred[:, at[varies]] / len(values) / (spread[ref] * spread[at[varies]]))
            rest = at[varies & (r <= threshold)].tolist()
        left = rest
    return kept
