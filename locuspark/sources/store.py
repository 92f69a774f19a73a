"""The genotype store: packed rows as Parquet in marker ranges, with samples and settings beside them."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.sources.genotype import PACKED, Genotype, check_taxa, from_array

SCHEMA_VERSION = 1
#: Markers of a row group and of a file, so that index ranges skip both.
CHUNK = 1024


def write_store(genotype: Genotype, path: str, chunk: int = CHUNK, markers: int | None = None) -> None:
    """Write packed rows sorted by marker; refuses an existing path, and leaves no partial store.

    ``meta`` is written last and read first: a store without it is incomplete.
    """
    if chunk <= 0:
        raise ValueError("the chunk must be positive")
    check_taxa(genotype.taxa)
    spark = genotype.packed.sparkSession
    m = genotype.packed.count() if markers is None else markers
    packed = genotype.packed.selectExpr(*[f.split(" ")[0] for f in PACKED.split(", ")])
    ranged = packed.repartitionByRange(max(1, -(-m // (chunk * 16))), "marker_idx").sortWithinPartitions("marker_idx")
    ranged.write.mode("errorifexists").option("maxRecordsPerFile", chunk * 16).parquet(f"{path}/markers")
    spark.createDataFrame(list(enumerate(genotype.taxa)), "sample_idx int, taxon string").coalesce(1).write.parquet(f"{path}/samples")
    meta = [(SCHEMA_VERSION, m, genotype.n, chunk)]
    spark.createDataFrame(meta, "schema_version int, markers long, samples int, chunk int").coalesce(1).write.parquet(f"{path}/meta")


class GenotypeStore:
    """A store opened for reading; selections are filters that reach the scan."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        try:
            meta = spark.read.parquet(f"{path}/meta").collect()
        except Exception as error:
            raise ValueError(f"{path} is not a complete genotype store") from error
        if len(meta) != 1 or meta[0]["schema_version"] != SCHEMA_VERSION:
            raise ValueError(f"{path} has an unsupported schema version")
        self.path, self.chunk = path, meta[0]["chunk"]
        taxa = [r["taxon"] for r in spark.read.parquet(f"{path}/samples").orderBy("sample_idx").collect()]
        if len(taxa) != meta[0]["samples"]:
            raise ValueError(f"{path} holds {len(taxa)} samples, not {meta[0]['samples']}")
        check_taxa(taxa)
        self.shape = (len(taxa), meta[0]["markers"])
        self.genotype = Genotype(spark.read.schema(PACKED).parquet(f"{path}/markers"), tuple(taxa))

    @property
    def taxa(self) -> tuple[str, ...]:
        return self.genotype.taxa

    def marker_map(self) -> DataFrame:
        return self.genotype.packed.select("marker_idx", "snp", "chromosome", "position")

    def read_markers(self, start: int, stop: int, samples: Sequence[int] | None = None) -> np.ndarray:
        """Samples x markers of a bounded range."""
        block = self.genotype.blocks(start, stop)
        if samples is not None:
            block = block.view(samples=samples)
        rows = block.packed.select("dosages").orderBy("marker_idx").collect()
        return np.array([r[0] for r in rows], float).T.reshape(block.n, len(rows))


def open_store(spark: SparkSession, path: str) -> GenotypeStore:
    return GenotypeStore(spark, path)


def as_genotype(spark: SparkSession, source: Genotype | GenotypeStore | np.ndarray | DataFrame, taxa: Sequence[str] | None = None) -> Genotype:
    """Any accepted form: a packed table with taxa, a store, or a matrix."""
    if isinstance(source, Genotype):
        return source
    if isinstance(source, GenotypeStore):
        return source.genotype
    if isinstance(source, DataFrame):
        if taxa is None:
            raise ValueError("a packed table needs the samples' names")
        return Genotype(source.select(*[F.col(f.split(" ")[0]).cast(f.split(" ", 1)[1]) for f in PACKED.split(", ")]), tuple(taxa))
    return from_array(spark, source, taxa)


def import_numeric(spark: SparkSession, path: str, gd_path: str, gm_path: str, impute_method: str = "middle", chunk: int = CHUNK) -> GenotypeStore:
    """Numeric text straight into a store."""
    from locuspark.sources.readers import read_numeric

    write_store(read_numeric(spark, gd_path, gm_path, impute_method), path, chunk)
    return open_store(spark, path)


def import_hapmap(spark: SparkSession, path: str, hapmap_path: str, major_allele_zero: bool = False, impute_method: str = "middle", chunk: int = CHUNK) -> GenotypeStore:
    """HapMap text straight into a store; markers are rows already."""
    from locuspark.sources.readers import read_hapmap

    write_store(read_hapmap(spark, hapmap_path, major_allele_zero, impute_method), path, chunk)
    return open_store(spark, path)
