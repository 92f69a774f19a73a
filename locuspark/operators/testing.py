"""Multiple testing over p-values of any number of markers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions.columns import chi2_of_pvalue, minus_log10

#: Rows up to which one sorted partition ranks p-values; beyond it ranks are built from ranges.
SINGLE_SORT = 2_000_000
_MEDIAN_CHI2 = 0.4549


def bonferroni_threshold(tests: int, alpha: float = 0.05) -> float:
    return alpha / tests


def benjamini_hochberg(rows: DataFrame, p: str, out: str, tie: str, single_sort: int = SINGLE_SORT) -> DataFrame:
    """``rows`` with adjusted p-values: p n / rank, the smallest from the right, at most 1.

    Small tables are sorted in one partition.  Larger ones are sorted by range:
    ranks and suffix minima within ranges, corrected by one row a range.
    Null p-values have none and do not count.
    """
    rows = rows.persist()  # p-values may come from an expression that must not run twice
    valid = rows.where(F.col(p).isNotNull())
    n = valid.count()
    if n <= single_sort:
        rank = F.row_number().over(Window.orderBy(p, tie))
        ranked = valid.withColumn("_r", rank)
        right = Window.orderBy(F.desc("_r")).rowsBetween(Window.unboundedPreceding, 0)
        done = ranked.withColumn(out, F.least(F.lit(1.0), F.min(F.col(p) * n / F.col("_r")).over(right))).drop("_r")
    else:
        parts = -(-n // single_sort) * 4
        ranged = valid.repartitionByRange(parts, p, tie).withColumn("_g", F.spark_partition_id()).persist()
        sizes = sorted(ranged.groupBy("_g").agg(F.count(F.lit(1))).collect())
        before, total = [], 0
        for g, size in sizes:
            before.append((g, total))
            total += size
        spark = rows.sparkSession
        ranged = ranged.join(F.broadcast(spark.createDataFrame(before, "_g int, _before long")), "_g")
        ranged = ranged.withColumn("_q", F.col(p) * n / (F.col("_before") + F.row_number().over(Window.partitionBy("_g").orderBy(p, tie))))
        least = dict(ranged.groupBy("_g").agg(F.min("_q")).collect())
        after, low = [], 1.0
        for g, _ in reversed(sizes):
            after.append((g, low))
            low = min(low, least[g])
        ranged = ranged.join(F.broadcast(spark.createDataFrame(after, "_g int, _after double")), "_g")
        right = Window.partitionBy("_g").orderBy(F.desc(p), F.desc(tie)).rowsBetween(Window.unboundedPreceding, 0)
        done = ranged.withColumn(out, F.least(F.col("_after"), F.min("_q").over(right), F.lit(1.0))).drop("_g", "_before", "_q", "_after")
    return done.unionByName(rows.where(F.col(p).isNull()).withColumn(out, F.lit(None).cast("double")))


def inflation(rows: DataFrame, p: str) -> float:
    """Genomic inflation: the median chi-square of p-values strictly inside (0, 1) over its expectation; 1 without any."""
    chi = rows.where((F.col(p) > 0) & (F.col(p) < 1)).select(chi2_of_pvalue(F.col(p)).alias("c"))
    median = chi.agg(F.median("c")).first()[0]
    return 1.0 if median is None else median / _MEDIAN_CHI2


def significant(rows: DataFrame, p: str, tests: int | None = None, method: str = "bonferroni", alpha: float = 0.05, tie: str = "marker_idx") -> DataFrame:
    """``rows`` with ``adjusted`` and ``significant`` by Bonferroni or false discovery rate."""
    n = rows.count() if tests is None else tests
    if method == "bonferroni":
        adjusted = F.least(F.lit(1.0), F.col(p) * n)
        return rows.withColumn("adjusted", adjusted).withColumn("significant", F.coalesce(F.col(p) <= bonferroni_threshold(n, alpha), F.lit(False)))
    if method == "fdr_bh":
        return benjamini_hochberg(rows, p, "adjusted", tie).withColumn("significant", F.coalesce(F.col("adjusted") <= alpha, F.lit(False)))
    raise ValueError(f"method must be bonferroni or fdr_bh; got {method!r}")


def candidate_cutoff(rows: DataFrame, p: str, alpha: float, tests: int | None = None) -> float:
    """The false-discovery cutoff alpha i / m, at the i whose p m / alpha is nearest to alpha."""
    m = rows.count() if tests is None else tests
    finite = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    distance = F.abs(F.lit(alpha) - F.col(p) * m / alpha)
    best = finite.agg(F.min(F.struct(distance.alias("d"), F.col(p).alias("p"))).alias("b")).first()["b"]
    if best is None:
        return 0.0
    rank = finite.where((F.col(p) < best["p"])).count() + 1
    return alpha * rank / m


def candidates(rows: DataFrame, p: str, threshold: float, alpha: float | None = None) -> DataFrame:
    """Rows below the false-discovery cutoff, or without ``alpha`` up to the threshold."""
    if alpha is not None:
        return rows.where(F.col(p) < candidate_cutoff(rows, p, alpha))
    return rows.where(F.col(p) <= threshold)


def calibrate(rows: DataFrame, p: str) -> DataFrame:
    """p-values raised so that the 5 % quantile is as expected, where that can be done; at most 1."""
    c = rows.agg((-F.log10(F.percentile(p, F.lit(0.05))) / 1.3).alias("c")).first()["c"]
    if c is None or not c > 0 or c == float("inf"):
        return rows
    return rows.withColumn(p, F.least(F.lit(1.0), F.pow(F.col(p), F.lit(1.0 / c))))


def ranked(rows: DataFrame, p: str, tie: str, out: str, n: int, single_sort: int = 2_000_000) -> DataFrame:
    """``rows`` with the rank of each by p and tie, from 1; beyond ``single_sort`` rows by sorted ranges, of which one count each reaches the driver."""
    if n <= single_sort:
        return rows.withColumn(out, F.row_number().over(Window.orderBy(p, tie)))
    ranged = rows.repartitionByRange(max(2, n // single_sort * 4), p, tie).withColumn("_range", F.spark_partition_id()).persist()
    starts, total = {}, 0
    for g, size in sorted(ranged.groupBy("_range").count().collect()):
        starts[g], total = total, total + size
    start = F.create_map(*[F.lit(v) for pair in starts.items() for v in pair])
    within = F.row_number().over(Window.partitionBy("_range").orderBy(p, tie))
    return ranged.withColumn(out, within + start[F.col("_range")]).drop("_range")


def qq(rows: DataFrame, p: str, tie: str, midpoint: bool = False, single_sort: int = 2_000_000) -> DataFrame:
    """Expected and observed -log10 p, by rank: i / n, or (i - 1/2) / n."""
    valid = rows.where((F.col(p) > 0) & (F.col(p) <= 1))
    n = valid.count()
    expected = (F.col("_rank") - (0.5 if midpoint else 0.0)) / n
    return ranked(valid, p, tie, "_rank", n, single_sort).select(tie, p, (-F.log10(expected)).alias("expected"), minus_log10(F.col(p)).alias("observed"))


def bin_best(rows: DataFrame, p: str, bin_size: float, threshold: float | None = None) -> DataFrame:
    """The marker with the smallest p-value of each chromosome and bin of positions; ties to the smaller index."""
    kept = rows.where(F.col(p).isNotNull() & ~F.isnan(p))
    if threshold is not None:
        kept = kept.where(F.col(p) <= threshold)
    at = F.when(F.isnan("position"), F.lit(0.0)).otherwise(F.coalesce("position", F.lit(0.0)))
    binned = kept.withColumn("bin", F.floor(at / F.lit(float(bin_size))))
    best = F.min(F.struct(F.col(p).alias("p_value"), "marker_idx"))
    return binned.groupBy("chromosome", "bin").agg(best.alias("best")).select("chromosome", "bin", "best.marker_idx", "best.p_value")
