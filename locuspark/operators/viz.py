"""What plots are drawn from: coordinates, thresholds, histograms, rasters, orders."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from locuspark.functions import mixed
from locuspark.functions.columns import minus_log10

GAP = 5_000_000.0


@dataclass(frozen=True)
class Plot:
    """Named tables and figures of one plot; drawing is left to the caller's library."""

    kind: str
    tables: dict[str, DataFrame]
    values: dict[str, float | list]

    def save(self, path: str) -> None:
        for name, table in self.tables.items():
            table.write.option("header", True).csv(f"{path}/{name}")


def genomic_axis(rows: DataFrame, order: str = "marker_idx", gap: float = GAP) -> DataFrame:
    """``chromosome``, ``first``, ``low``, ``offset``, ``centre``: where chromosomes lie on one axis.

    They follow in the order of their first marker, a gap apart.  One row a
    chromosome: the window over them is small.
    """
    spans = rows.groupBy("chromosome").agg(F.min(order).alias("first"), F.min("position").alias("low"), F.max("position").alias("high"))
    before = Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1)
    width = F.col("high") - F.col("low")
    offset = F.coalesce(F.sum(width + F.lit(float(gap))).over(before), F.lit(0.0))
    return spans.withColumn("offset", offset).withColumn("centre", F.col("offset") + width / 2).drop("high")


def manhattan(rows: DataFrame, p: str = "p_value", tests: int | None = None, gap: float = GAP, significance: float | None = None, suggestive: float | None = None) -> Plot:
    """Points of a Manhattan plot with thresholds 0.05 / m and 1 / m."""
    m = rows.count() if tests is None else tests
    if m == 0:
        raise ValueError("a Manhattan plot needs a marker")
    lines = {"significance": 0.05 / m if significance is None else significance, "suggestive": 1.0 / m if suggestive is None else suggestive}
    for name, value in lines.items():
        if not 0 < value <= 1:
            raise ValueError(f"{name} must be between 0 and 1")
    axis = genomic_axis(rows, gap=gap)
    points = rows.join(F.broadcast(axis.select("chromosome", "low", "offset")), "chromosome")
    points = points.withColumn("x", F.col("offset") + F.col("position") - F.col("low")).withColumn("log_p", minus_log10(F.col(p))).drop("low", "offset")
    return Plot("manhattan", {"points": points, "axis": axis}, lines)


def raster(points: DataFrame, x_bins: int, y_bins: int, x_range: tuple[float, float], y_range: tuple[float, float], colour: str = "chromosome") -> DataFrame:
    """The largest -log10 p of each cell and colour, for plots of very many markers."""

    def cell(value: Column, low: float, high: float, bins: int) -> Column:
        return F.least(F.greatest(F.floor((value - low) / ((high - low) / bins)), F.lit(0)), F.lit(bins - 1))

    return points.groupBy(cell(F.col("x"), *x_range, x_bins).alias("x_bin"), cell(F.col("log_p"), *y_range, y_bins).alias("y_bin"), F.col(colour)).agg(F.max("log_p").alias("log_p"))


def histogram(rows: DataFrame, value: str, bins: int = 30, by: Sequence[str] = ()) -> DataFrame:
    """Counts in equal bins between the smallest and largest value; the last bin is closed."""
    low, high = rows.agg(F.min(value), F.max(value)).first()
    if low is None:
        return rows.limit(0).select(*by, F.lit(0).alias("bin"), F.lit(0).cast("long").alias("n"))
    if low == high:
        low, high = low - 0.5, high + 0.5
    at = F.least(F.floor((F.col(value) - low) / ((high - low) / bins)), F.lit(bins - 1)).cast("int")
    return rows.where(F.col(value).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def scatter_fit(rows: DataFrame, x: str, y: str) -> DataFrame:
    """Correlation and the least-squares line of a prediction plot."""
    return rows.agg(F.corr(x, y).alias("r"), F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_count(y, x).alias("n"))


def heatmap_order(kinship: np.ndarray) -> list[int]:
    """Samples in the order of average linkage on 1 - kinship rows."""
    return mixed.leaf_order(mixed.average_linkage(1.0 - kinship), len(kinship))


def multi_model(tables: dict[str, DataFrame]) -> DataFrame:
    """SNP, Chr, Pos of all models' markers and one p-value column a model, in the order of chromosomes' first mention.

    Every table must hold a marker once, and a marker must be in one place.
    """
    keys = ["SNP", "Chr", "Pos"]
    parts = []
    for at, (name, table) in enumerate(tables.items()):
        missing = {*keys, "P.value"} - set(table.columns)
        if missing:
            raise ValueError(f"{name} lacks columns {sorted(missing)}")
        order = F.col("marker_idx") if "marker_idx" in table.columns else F.monotonically_increasing_id()
        parts.append(table.select(F.col("SNP").cast("string"), F.col("Chr").cast("string"), F.col("Pos").cast("double"), F.col("`P.value`").alias("p"), F.lit(name).alias("model"), F.struct(F.lit(at).alias("t"), order.alias("o")).alias("seen")))
    union = parts[0]
    for part in parts[1:]:
        union = union.unionByName(part)
    union = union.persist()
    again = union.groupBy(*keys, "model").count().where("count > 1").limit(1).collect()
    if again:
        raise ValueError(f"{again[0]['model']} holds a marker more than once")
    conflict = union.groupBy("SNP").agg(F.countDistinct("Chr").alias("c"), F.countDistinct("Pos").alias("q")).where("c > 1 or q > 1").limit(5).collect()
    if conflict:
        raise ValueError("markers have conflicting coordinates: " + ", ".join(r["SNP"] for r in conflict))
    wide = union.groupBy(*keys).pivot("model", list(tables)).agg(F.first("p"))
    first = union.groupBy("Chr").agg(F.min("seen").alias("chr_seen"))
    return wide.join(F.broadcast(first), "Chr").orderBy("chr_seen", "Pos", "SNP").select(*keys, *[f"`{m}`" for m in tables])
