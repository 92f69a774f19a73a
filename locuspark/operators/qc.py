"""Numericalisation, imputation, allele frequencies, alignment: expressions over packed rows, by Arrow batches where they code every cell."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from locuspark.sources.genotype import Genotype, check_taxa, dosage_sum

# Call codes of one and of two characters.
HET_ONE = ("R", "Y", "S", "W", "K", "M")
HET_TWO = ("AT", "AG", "AC", "TA", "GA", "CA", "GT", "TG", "GC", "CG", "CT", "TC")
MISSING_ONE = ("N", "X", "-", "+", "/", "NA", "NAN")
MISSING_TWO = ("NN", "XX", "--", "++", "//", "00", "N", "NA", "NAN")
IMPUTE_METHODS = ("middle", "major", "minor", "mean", "none")


def _lists(column: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Ends of an array column's lists, from 0, and their elements; null lists are empty."""
    sizes = np.asarray(column.value_lengths().fill_null(0)).astype(np.int32)
    return np.concatenate(([0], np.cumsum(sizes))).astype(np.int32), column.flatten()


def _as_lists(column: pa.Array, ends: np.ndarray, values: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.float64()), mask=column.is_null() if column.null_count else None)


def numericalise(calls: Column, major_allele_zero: bool = False) -> Column:
    """Dosages of an array of allele calls; NaN is missing.

    Two states are 0 and 2, or 0 and 1 if one of them is heterozygous; three
    are 0, 1 and 2 with the heterozygote between; fewer or more give zeros.
    ``major_allele_zero`` puts the more frequent homozygote first.  A marker's
    calls are counted by state; its few states get a dosage each, and all
    calls are looked up at once.
    """

    @F.arrow_udf("array<double>")
    def coded(column: pa.Array) -> pa.Array:
        ends, flat = _lists(column)
        encoded = flat.fill_null("N").dictionary_encode()
        names = [v.upper() for v in encoded.dictionary.to_pylist()]
        codes = np.asarray(encoded.indices)
        out = np.empty(len(codes))
        for start, end in zip(ends[:-1].tolist(), ends[1:].tolist()):
            mine = codes[start:end]
            counts: Counter = Counter()
            for code, n in enumerate(np.bincount(mine, minlength=len(names)).tolist()):
                if n:
                    counts[names[code]] += n
            values = state_dosages(counts, major_allele_zero)
            out[start:end] = np.array([values.get(v, np.nan) for v in names])[mine]
        return _as_lists(column, ends, out)

    return coded(calls)


def state_dosages(counts: dict[str, int], major_allele_zero: bool = False) -> dict[str, float]:
    """Dosage of each upper-case call of a marker, from how often it occurs; missing ones are NaN."""
    width = max((len(v) for v in counts if v not in MISSING_ONE and v not in MISSING_TWO), default=2)
    one = width == 1
    hets, missing = (HET_ONE, MISSING_ONE) if one else (HET_TWO, MISSING_TWO)
    # Both spellings of a heterozygote are one state.  With one character, K sorts last, as heterozygotes do.
    spelt = sorted(v for v in counts if v in hets)
    state = {v: "Z" if one and v == "K" else spelt[0] if not one and v in spelt[:2] else v for v in counts if v not in missing}
    seen: Counter = Counter()
    for v, s in state.items():
        seen[s] += counts[v]
    levels = sorted(seen)
    between = [v for v in levels if v in hets or one and v == "Z"]

    def homozygotes(first: Sequence[str]) -> list[str]:
        """Those that are not in ``first``, by falling count and name if the major one is zero."""
        found = [v for v in levels if v not in first]
        return sorted(found, key=lambda v: (-seen[v], v)) if major_allele_zero else found

    if len(levels) == 2:
        het = [v for v in levels if v in hets]
        dosage = {v: float(v == het[0]) for v in levels} if het else dict(zip(homozygotes(()), (0.0, 2.0)))
    elif len(levels) == 3:
        if one and not (major_allele_zero and len(between) <= 1):
            order = (levels[0], levels[2], levels[1])
        elif one and between:
            order = (*homozygotes(between), between[0])
        elif one:
            order = tuple(homozygotes(())[i] for i in (0, 2, 1))
        elif len(between) == 1:
            order = (homozygotes(between)[0], between[0], homozygotes(between)[1])
        else:
            raise ValueError("three states of two characters need one heterozygote")
        dosage = dict(zip(order, (0.0, 1.0, 2.0)))
    else:
        return dict.fromkeys(counts, 0.0)
    return {v: dosage[state[v]] if v in state else float("nan") for v in counts}


def _missing(x: Column) -> Column:
    return x.isNull() | F.isnan(x)


def imputed(dosages: Column, method: str) -> Column:
    """Missing dosages as 1 (middle), 2 (major), 0 (minor), the marker's mean, or left as NaN."""
    if method not in IMPUTE_METHODS:
        raise ValueError(f"impute method must be one of {', '.join(IMPUTE_METHODS)}; got {method!r}")
    constant = {"middle": 1.0, "major": 2.0, "minor": 0.0, "none": float("nan")}.get(method)

    @F.arrow_udf("array<double>")
    def filled(column: pa.Array) -> pa.Array:
        ends, flat = _lists(column)
        values = flat.to_numpy(zero_copy_only=False).astype(float)
        gone = np.isnan(values)
        if gone.any() and constant is not None:
            values = np.where(gone, constant, values)
        elif gone.any():
            row = np.repeat(np.arange(len(column)), np.diff(ends))
            seen = np.bincount(row[~gone], minlength=len(column))
            mean = np.where(seen > 0, np.bincount(row[~gone], values[~gone], len(column)) / np.maximum(seen, 1), 1.0)
            values = np.where(gone, mean[row], values)
        return _as_lists(column, ends, values)

    return filled(dosages)


def impute(genotype: Genotype, method: str = "middle") -> Genotype:
    return genotype.with_packed(genotype.packed.withColumn("dosages", imputed(F.col("dosages"), method)))


def with_maf(genotype: Genotype) -> DataFrame:
    """Packed rows with ``freq`` and ``maf``; all samples count, missing ones too."""
    freq = dosage_sum(F.col("dosages")) / F.lit(2.0 * max(1, genotype.n))
    return genotype.packed.withColumn("freq", freq).withColumn("maf", F.least("freq", F.lit(1.0) - F.col("freq")))


def filter_maf(genotype: Genotype, threshold: float = 0.05) -> Genotype:
    """Markers whose minor allele frequency reaches the threshold; rows gain ``maf``."""
    if not 0 <= threshold <= 0.5:
        raise ValueError("maf_threshold must be between 0 and 0.5")
    return genotype.with_packed(with_maf(genotype).where(F.col("maf") >= threshold).drop("freq"))


def require_finite(genotype: Genotype) -> None:
    bad = genotype.packed.where(F.exists("dosages", _missing)).select("snp").limit(1).collect()
    if bad:
        raise ValueError(f"dosages must be imputed first; marker {bad[0][0]} has missing ones")


def duplicates(frame: DataFrame, column: str) -> DataFrame:
    """Values of a column that occur more than once, and how often."""
    return frame.groupBy(column).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@dataclass(frozen=True, eq=False)
class Trait(Mapping):
    """Values by taxon as an array, NaN where missing: for many samples, where a dictionary would take the driver's memory."""

    taxa: tuple[str, ...]
    values: np.ndarray

    def __len__(self) -> int:
        return len(self.taxa)

    def __iter__(self) -> Iterator[str]:
        return iter(self.taxa)

    @cached_property
    def _place(self) -> dict[str, int]:
        return {t: i for i, t in enumerate(self.taxa)}

    def __getitem__(self, taxon: str) -> float:
        return float(self.values[self._place[taxon]])


@dataclass(frozen=True)
class Aligned:
    """Inputs restricted to common taxa, in the phenotype's order."""

    taxa: tuple[str, ...]
    phenotype: dict[str, np.ndarray]
    genotype: Genotype
    covariates: np.ndarray | None = None
    kinship: np.ndarray | None = None
    dropped: int = 0


def sample_index(phenotype: DataFrame, others: Sequence[DataFrame], taxon: str = "taxon", order: str = "row") -> DataFrame:
    """Taxa of the phenotype that are in all others, and their index in its order."""
    from pyspark.sql import Window

    kept = phenotype.select(taxon, order)
    for other in others:
        kept = kept.join(other.select(taxon), taxon, "left_semi")
    # The sample axis is small by design: at most the samples of one analysis.
    return kept.withColumn("sample_idx", F.row_number().over(Window.orderBy(order)) - 1).select(taxon, "sample_idx")


def align(
    traits: dict[str, Mapping[str, float | None]],
    genotype: Genotype,
    covariates: dict[str, Sequence[float]] | None = None,
    kinship: tuple[Sequence[str], np.ndarray] | None = None,
) -> Aligned:
    """Inner join of the sample-side tables on taxon, in phenotype order; the genotype stays distributed.

    ``traits`` maps each trait to values by taxon, all over the same taxa.
    Duplicate taxa are rejected on every side; no common taxon is an error.
    """
    first = next(iter(traits.values()))
    if covariates is None and kinship is None and all(isinstance(v, Trait) and v.taxa == genotype.taxa for v in traits.values()):
        check_taxa(genotype.taxa)
        return Aligned(genotype.taxa, {name: np.asarray(v.values, float) for name, v in traits.items()}, genotype)
    taxa = list(first)
    check_taxa(taxa)
    check_taxa(genotype.taxa)
    position = {t: i for i, t in enumerate(genotype.taxa)}
    common = [t for t in taxa if t in position]
    if covariates is not None:
        common = [t for t in common if t in covariates]
    if kinship is not None:
        check_taxa(kinship[0])
        names = {t: i for i, t in enumerate(kinship[0])}
        common = [t for t in common if t in names]
    if not common:
        raise ValueError("the inputs have no taxa in common")
    at = [position[t] for t in common]
    part = genotype if at == list(range(genotype.n)) else genotype.view(samples=at)
    k = None
    if kinship is not None:
        rows = [names[t] for t in common]
        k = np.asarray(kinship[1], float)[np.ix_(rows, rows)]
    values = {name: np.array([np.nan if v[t] is None else v[t] for t in common], float) for name, v in traits.items()}
    cv = None if covariates is None else np.array([covariates[t] for t in common], float).reshape(len(common), -1)
    return Aligned(tuple(common), values, part, cv, k, len(taxa) - len(common))


def incidence_kinship(z_taxa: Sequence[str], z_labels: Sequence[str], z: np.ndarray, k_labels: Sequence[str], k: np.ndarray, taxa: Sequence[str]) -> np.ndarray:
    """Z K Z' for labelled incidence and kinship; rows follow ``taxa``, both label sets must match exactly."""
    z, k = np.asarray(z, float), np.asarray(k, float)
    for names in (z_taxa, z_labels, k_labels):
        check_taxa(names)
    if set(map(str, z_taxa)) != set(map(str, taxa)):
        raise ValueError("incidence rows must be the phenotype's taxa")
    if set(map(str, z_labels)) != set(map(str, k_labels)):
        raise ValueError("incidence columns must be the kinship's labels")
    if not np.isfinite(z).all() or not np.isfinite(k).all():
        raise ValueError("incidence and kinship must be finite")
    if (np.abs(z).sum(axis=1) == 0).any():
        raise ValueError("incidence has a row of zeros")
    row = {str(t): i for i, t in enumerate(z_taxa)}
    col = {str(t): i for i, t in enumerate(z_labels)}
    z = z[[row[str(t)] for t in taxa]][:, [col[str(t)] for t in k_labels]]
    return z @ k @ z.T


def incidence_kinship_long(z: DataFrame, k: DataFrame) -> DataFrame:
    """Z K Z' of long tables z(i, a, z) and k(a, b, k): two joins and a sum."""
    left = z.select(F.col("i"), F.col("a"), F.col("z").alias("za"))
    right = z.select(F.col("i").alias("j"), F.col("a").alias("b"), F.col("z").alias("zb"))
    return left.join(k, "a").join(right, "b").groupBy("i", "j").agg(F.sum(F.col("za") * F.col("k") * F.col("zb")).alias("k"))
