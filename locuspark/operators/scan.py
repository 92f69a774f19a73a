"""One pass over packed markers with broadcast sample-space state: every model's scan.

A kernel takes markers x samples and gives columns by marker.  The state is a
few n-vectors, or an n x n whitening matrix of bounded n.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from locuspark.functions import mixed, special
from locuspark.functions.columns import rounded, t_pvalue
from locuspark.operators.qc import with_maf
from locuspark.operators.testing import benjamini_hochberg
from locuspark.sources.genotype import Genotype, matrix

SCAN = "marker_idx int, p_value double, effect double, se double, stat double"
Kernel = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def scan(genotype: Genotype, kernel: Kernel) -> DataFrame:
    """``SCAN`` rows: p-value, effect, standard error and statistic of each marker."""
    n = genotype.n
    sent = genotype.packed.sparkSession.sparkContext.broadcast(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = sent.value(np.asarray(batch.column(0)), matrix(batch.column(1), n))
                columns = [pa.array(np.asarray(c, float), from_pandas=True) for c in found]
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["marker_idx", "p_value", "effect", "se", "stat"])

    return genotype.packed.select("marker_idx", "dosages").mapInArrow(run, SCAN)


@dataclass(frozen=True)
class Projection:
    """Residuals from a design: an orthonormal basis of its columns."""

    basis: np.ndarray
    columns: int

    @classmethod
    def of(cls, x: np.ndarray) -> Projection:
        u, s, _ = np.linalg.svd(x, full_matrices=False)
        keep = s > (s[0] if len(s) else 0.0) * max(x.shape) * np.finfo(float).eps
        return cls(u[:, keep], x.shape[1])

    def residual(self, rows: np.ndarray) -> np.ndarray:
        """Of vectors in rows."""
        return rows - (rows @ self.basis) @ self.basis.T


@dataclass(frozen=True)
class LeastSquares:
    """Each marker after the design: the general linear model."""

    y: np.ndarray
    space: Projection

    @classmethod
    def of(cls, y: np.ndarray, x: np.ndarray) -> LeastSquares:
        if len(y) <= x.shape[1] + 1:
            raise ValueError("the scan needs more observations than fixed effects")
        space = Projection.of(x)
        return cls(space.residual(y[None])[0], space)

    def __call__(self, index: np.ndarray, g: np.ndarray):
        r = self.space.residual(g)
        ss = np.einsum("ij,ij->i", r, r)
        ok = ss > 1e-10
        safe = np.where(ok, ss, 1.0)
        dot = r @ self.y
        df = len(self.y) - self.space.columns - 1
        sse = np.maximum(self.y @ self.y - dot**2 / safe, 0.0)
        effect = np.where(ok, dot / safe, 0.0)
        se = np.where(ok, np.maximum(np.sqrt(sse / df / safe), 1e-12), 1.0)
        stat = effect / se
        return np.where(ok, special.t_two_sided(stat, df), 1.0), effect, se, stat


def whitened(white: np.ndarray | mixed.LowRankWhitener, rows: np.ndarray) -> np.ndarray:
    """Vectors in rows, whitened."""
    return white.rows(rows) if isinstance(white, mixed.LowRankWhitener) else rows @ white.T


@dataclass(frozen=True)
class Whitened:
    """Each marker after whitening with fixed variance components; the null model's vg gives standard errors.

    The kinship is sent along only where markers may have missing dosages.
    """

    white: np.ndarray | mixed.LowRankWhitener
    y: np.ndarray
    space: Projection
    vg: float
    raw_y: np.ndarray
    x: np.ndarray
    k: np.ndarray | mixed.Factor | None
    delta: float
    samples: int | None = None  # where the vectors are rotated ones

    @classmethod
    def of(cls, y: np.ndarray, x: np.ndarray, k: np.ndarray | mixed.Factor | None, white: np.ndarray | mixed.LowRankWhitener, vg: float, delta: float, samples: int | None = None) -> Whitened:
        space = Projection.of(whitened(white, x.T).T)
        return cls(white, space.residual(whitened(white, y[None]))[0], space, vg, y, x, k, delta, samples)

    def __call__(self, index: np.ndarray, g: np.ndarray):
        df = (self.samples or len(self.y)) - self.space.columns - 1
        p, effect, se, stat = (np.full(len(g), v) for v in (1.0, np.nan, np.nan, np.nan))
        whole = np.isfinite(g).all(axis=1)
        use = np.nonzero(whole & (np.where(whole[:, None], g, 0.0).std(axis=1) >= 1e-8))[0]
        if len(use):
            r = self.space.residual(whitened(self.white, g[use]))
            ss = np.einsum("ij,ij->i", r, r)
            with np.errstate(divide="ignore", invalid="ignore"):
                error = np.sqrt(self.vg / ss)
            ok = (ss > 1e-12) & (error >= 1e-12)
            at = use[ok]
            effect[at], se[at] = (r @ self.y)[ok] / ss[ok], error[ok]
            stat[at] = effect[at] / se[at]
            p[at] = special.t_two_sided(stat[at], df)
        for i in np.nonzero(~whole)[0]:
            self._incomplete(g[i], i, p, effect, se, stat)
        return p, effect, se, stat

    def _incomplete(self, g: np.ndarray, i: int, p, effect, se, stat) -> None:
        """A marker with missing dosages: generalised least squares on the samples that have them."""
        seen = np.isfinite(g)
        x = np.column_stack([self.x[seen], g[seen]])
        if seen.sum() <= x.shape[1] or g[seen].std() < 1e-8:
            return
        if self.k is None:
            raise ValueError("markers with missing dosages need the kinship")
        at = np.nonzero(seen)[0]
        k = self.k.block(at, at) if isinstance(self.k, mixed.Factor) else self.k[np.ix_(at, at)]
        precision = np.linalg.pinv(k + self.delta * np.eye(int(seen.sum())))
        inverse = np.linalg.pinv(x.T @ precision @ x)
        error = float(np.sqrt(inverse[-1, -1] * self.vg))
        if error < 1e-12:
            return
        effect[i] = (inverse @ x.T @ precision @ self.raw_y[seen])[-1]
        se[i], stat[i] = error, effect[i] / error
        p[i] = special.t_two_sided(np.array([stat[i]]), seen.sum() - x.shape[1])[0]


@dataclass(frozen=True)
class Conditioned:
    """Each marker given cofactors, by the drop in whitened residual sum of squares."""

    white: np.ndarray
    y: np.ndarray
    space: Projection
    cofactors: np.ndarray
    samples: int | None = None

    @classmethod
    def of(cls, y: np.ndarray, x: np.ndarray, white: np.ndarray, cofactors: Sequence[int], samples: int | None = None) -> Conditioned:
        space = Projection.of(white @ x)
        return cls(white, space.residual((white @ y)[None])[0], space, np.array(cofactors, int), samples)

    def __call__(self, index: np.ndarray, g: np.ndarray):
        r = self.space.residual(g @ self.white.T)
        ss = np.einsum("ij,ij->i", r, r)
        ok = (ss >= 1e-12) & ~np.isin(index, self.cofactors)
        safe = np.where(ok, ss, 1.0)
        dot, null = r @ self.y, self.y @ self.y
        df = (self.samples or len(self.y)) - self.space.columns - 1
        rss = np.maximum(null - dot**2 / safe, 0.0)
        with np.errstate(divide="ignore"):
            f = np.maximum((null / rss - 1.0) * df, 0.0)
        effect = np.where(ok, dot / safe, np.nan)
        stat = np.where(ok, np.sign(dot) * np.sqrt(f), np.nan)
        with np.errstate(divide="ignore", invalid="ignore"):
            se = np.where(f > 0, np.abs(effect) / np.sqrt(f), np.nan)
        p = np.where(ok, special.t_two_sided(np.where(ok, np.sqrt(f), 0.0), df), 1.0)
        return p, effect, se, stat


def glm(genotype: Genotype, y: np.ndarray, x: np.ndarray, cofactors: Sequence[int] = ()) -> DataFrame:
    """General linear model scan, with the markers ``cofactors`` added to the design."""
    values = genotype.markers(cofactors) if len(cofactors) else np.zeros((len(y), 0))
    return scan(genotype, LeastSquares.of(np.asarray(y, float), np.column_stack([x, values])))


def null_r2(y: np.ndarray, x: np.ndarray) -> float:
    """Share of variance that the design alone explains."""
    r = Projection.of(x).residual(y[None])[0]
    total = ((y - y.mean()) ** 2).sum()
    return float(1 - r @ r / total) if total > 0 else 0.0


def glm_intercept(long: DataFrame, samples: DataFrame) -> DataFrame:
    """The intercept-only scan as plain aggregates: sums by marker, then algebra and a JVM p-value.

    ``long`` is (marker, sample, dosage) with every cell, ``samples`` (sample, y).
    """
    joined = long.join(samples, "sample")
    sums = joined.groupBy("marker").agg(
        F.count(F.lit(1)).alias("n"), F.regr_sxx("y", "dosage").alias("sxx"), F.regr_sxy("y", "dosage").alias("sxy"), F.regr_syy("y", "dosage").alias("syy")
    )
    ok = F.col("sxx") > 1e-10
    df = F.col("n") - 2
    effect = F.when(ok, F.col("sxy") / F.col("sxx")).otherwise(F.lit(0.0))
    sse = F.greatest(F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"), F.lit(0.0))
    se = F.when(ok, F.greatest(F.sqrt(sse / df / F.col("sxx")), F.lit(1e-12))).otherwise(F.lit(1.0))
    fitted = sums.select("marker", "n", effect.alias("effect"), se.alias("se")).withColumn("stat", F.col("effect") / F.col("se"))
    return fitted.withColumn("p_value", t_pvalue(F.col("stat"), (F.col("n") - 2).cast("double")))


#: A base design whose condition passes this is fitted marker by marker.
_STABLE_CONDITION = np.finfo(float).eps ** -0.25


@dataclass(frozen=True)
class Substitutes:
    """Largest statistics of each cofactor when a further marker joins the design."""

    x: np.ndarray
    y: np.ndarray
    pinv: np.ndarray
    first: int
    stable: bool

    def __call__(self, g: np.ndarray) -> np.ndarray:
        """For a block of markers: the largest |t| of each cofactor, -1 where there is none."""
        q = self.x.shape[1] - self.first
        weights = g @ self.pinv.T
        r = g - weights @ self.x.T
        ss = np.einsum("ij,ij->i", r, r)
        ok = ss >= 1e-8
        best = np.full(q, -1.0)
        if not ok.any():
            return best
        df = len(self.y) - self.x.shape[1] - 1
        if not self.stable:
            for row in g[ok]:
                full = np.column_stack([self.x, row])
                inverse = np.linalg.pinv(full)
                beta = inverse @ self.y
                left = self.y - full @ beta
                with np.errstate(divide="ignore", invalid="ignore"):
                    t = np.abs(beta / np.sqrt(np.maximum(np.diag(inverse @ inverse.T) * (left @ left) / df, 0.0)))
                best = np.fmax(best, t[self.first : -1])
            return best
        beta = self.pinv @ self.y
        left = self.y - self.x @ beta
        dot, ss, weights = (r @ left)[ok], ss[ok], weights[ok][:, self.first :]
        mse = np.maximum(left @ left - dot**2 / ss, 0.0) / df
        spread = np.diag(self.pinv @ self.pinv.T)[self.first :]
        shifted = beta[self.first :] - weights * (dot / ss)[:, None]
        variance = (spread + weights**2 / ss[:, None]) * mse[:, None]
        with np.errstate(divide="ignore", invalid="ignore"):
            t = np.abs(shifted / np.sqrt(np.maximum(variance, 0.0)))
        return np.fmax(best, np.nanmax(np.where(np.isfinite(t), t, -1.0), axis=0))


def reward(genotype: Genotype, scanned: DataFrame, y: np.ndarray, x: np.ndarray, cofactors: Sequence[int]) -> DataFrame:
    """``scanned`` with each cofactor's row replaced: its best p-value over all substitute markers, and its joint fit."""
    if not len(cofactors):
        return scanned
    values = genotype.markers(cofactors)
    base = np.column_stack([x, values])
    pinv = np.linalg.pinv(base)
    condition = np.linalg.cond(base)
    kernel = Substitutes(base, y, pinv, x.shape[1], bool(np.isfinite(condition) and condition <= _STABLE_CONDITION))
    n, q = genotype.n, len(cofactors)
    spark = genotype.packed.sparkSession
    sent = spark.sparkContext.broadcast(kernel)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full(q, -1.0)
        for batch in batches:
            if batch.num_rows:
                best = np.fmax(best, sent.value(matrix(batch.column(0), n)))
        yield pa.RecordBatch.from_arrays([pa.array(range(q), pa.int32()), pa.array(best)], ["c", "t"])

    # The smallest p-value is that of the largest statistic, as all have one df.
    found = dict(genotype.packed.select("dosages").mapInArrow(run, "c int, t double").groupBy("c").agg(F.max("t")).collect())
    t = np.array([found.get(i, -1.0) for i in range(q)])
    df = n - base.shape[1]
    p = np.where(t >= 0, special.t_two_sided(np.maximum(t, 0.0), df - 1), 1.0)
    beta = pinv @ y
    left = y - base @ beta
    se = np.sqrt(np.maximum(np.diag(pinv @ pinv.T) * (left @ left) / df, 0.0))
    rows = [(int(m), float(p[i]), float(beta[x.shape[1] + i]), float(se[x.shape[1] + i]), float(beta[x.shape[1] + i] / se[x.shape[1] + i])) for i, m in enumerate(cofactors)]
    return replace_rows(scanned, rows)


def replace_rows(scanned: DataFrame, rows: list[tuple]) -> DataFrame:
    """``scanned`` with the rows of a few markers replaced; as many as there are cofactors."""
    new = scanned.sparkSession.createDataFrame(rows, SCAN).withColumnsRenamed({c: f"new_{c}" for c in ("p_value", "effect", "se", "stat")})
    joined = scanned.join(F.broadcast(new), "marker_idx", "left")
    hit = F.col("new_p_value").isNotNull()
    return joined.select("marker_idx", *[F.when(hit, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in ("p_value", "effect", "se", "stat")])


def gwas_table(genotype: Genotype, scanned: DataFrame, adjusted: bool = True) -> DataFrame:
    """Results with names, frequencies and rounded estimates, ordered by chromosome, position and marker."""
    info = with_maf(genotype).select("marker_idx", "snp", "chromosome", "position", "maf")
    if adjusted:
        scanned = benjamini_hochberg(scanned, "p_value", "fdr", "marker_idx")
    rows = scanned.join(info, "marker_idx")
    return rows.select(
        F.col("snp").alias("SNP"),
        F.col("chromosome").alias("Chr"),
        F.col("position").cast("long").alias("Pos"),
        F.col("p_value").alias("P.value"),
        rounded(F.col("maf"), 4).alias("maf"),
        F.lit(genotype.n).alias("nobs"),
        rounded(F.col("effect"), 6).alias("effect"),
        rounded(F.col("se"), 6).alias("se"),
        *([rounded(F.col("fdr"), 6).alias("FDR.Adjusted.P.values")] if adjusted else []),
        "marker_idx",
    ).orderBy("Chr", "Pos", "marker_idx")

