"""Drop-folder ingest: HapMap lines that arrive as files become packed rows as they come."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from locuspark.operators.qc import imputed, numericalise
from locuspark.sources.readers import HAPMAP_COLUMNS


def hapmap_stream(spark: SparkSession, folder: str, taxa: Sequence[str], impute_method: str = "middle", major_allele_zero: bool = False) -> DataFrame:
    """Packed rows without an index from files without a header; a marker row needs nothing but itself."""
    lines = spark.readStream.text(folder).withColumn("fields", F.split("value", "\t"))
    rows = lines.where((F.size("fields") == len(HAPMAP_COLUMNS) + len(taxa)) & (F.col("fields")[0] != HAPMAP_COLUMNS[0]))
    calls = F.slice("fields", len(HAPMAP_COLUMNS) + 1, len(taxa))
    return rows.select(
        F.col("fields")[0].alias("snp"),
        F.col("fields")[2].alias("chromosome"),
        F.col("fields")[3].cast("double").alias("position"),
        imputed(numericalise(calls, major_allele_zero), impute_method).alias("dosages"),
    )


def append_packed(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append what has arrived to a Parquet table, each file once."""
    return rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
