"""Readers of phenotype, numeric genotype, marker map and HapMap files."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.operators.qc import impute, numericalise
from locuspark.sources.genotype import Genotype, check_taxa, from_long

# What stands for a missing number in text.
PHENOTYPE_NA = ("NA", "NaN", "nan", "N/A")
NUMERIC_NA = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
HAPMAP_COLUMNS = ("rs", "alleles", "chrom", "pos", "strand", "assembly", "center", "protLSID", "assayLSID", "panelLSID", "QCcode")


@dataclass(frozen=True)
class Phenotype:
    """taxon, one double column a trait, and ``row``, the input's order."""

    frame: DataFrame
    traits: tuple[str, ...]


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def number(text: Column, missing: Sequence[str] = NUMERIC_NA) -> Column:
    """A number, or null where the text stands for a missing one."""
    trimmed = F.trim(text)
    return F.when(~trimmed.isin(*missing), trimmed.try_cast("double"))


def read_phenotype(spark: SparkSession, path: str) -> Phenotype:
    """Tab-separated, with a header: taxon and traits."""
    frame = spark.read.option("sep", "\t").option("header", True).option("quote", '"').option("multiLine", True).csv(path)
    return phenotype_from_frame(frame)


def phenotype_from_frame(frame: DataFrame) -> Phenotype:
    """First column is the taxon; the rest are numeric traits.  Checks as one aggregate over the input."""
    if len(frame.columns) < 2:
        raise ValueError("a phenotype needs a taxon column and a trait")
    taxon, *traits = frame.columns
    if len(set(traits)) < len(traits):
        raise ValueError("trait names must be unique")
    plain = frame.toDF("taxon", *[f"t{i}" for i in range(len(traits))])
    columns = [F.col("taxon").cast("string").alias("taxon")]
    bad = []
    for i, (name, kind) in enumerate(frame.dtypes[1:]):
        value = number(F.col(f"t{i}"), (*PHENOTYPE_NA, "")) if kind == "string" else F.col(f"t{i}").cast("double")
        clean = F.when(~F.isnan(value), value)
        text_lost = (F.col(f"t{i}").isNotNull() & value.isNull() & ~F.trim(F.col(f"t{i}")).isin(*PHENOTYPE_NA, "")) if kind == "string" else F.lit(False)
        bad.append(F.sum((text_lost | (F.abs(clean) == float("inf"))).cast("int")).alias(f"b{i}"))
        columns.append(clean.alias(f"t{i}"))
    taxon_col = F.col("taxon").cast("string")
    blank = F.sum((taxon_col.isNull() | (F.trim(taxon_col) == "")).cast("int"))
    checked = plain.agg(F.count(F.lit(1)).alias("n"), blank.alias("blank"), F.countDistinct("taxon").alias("distinct"), *bad).first()
    if checked["n"] == 0:
        raise ValueError("the phenotype is empty")
    if checked["blank"]:
        raise ValueError("taxa must not be null or blank")
    if checked["distinct"] != checked["n"]:
        again = [r[0] for r in plain.groupBy("taxon").count().where("count > 1").orderBy("taxon").limit(5).collect()]
        raise ValueError(f"taxa occur more than once: {', '.join(again)}")
    for i, name in enumerate(traits):
        if checked[f"b{i}"]:
            raise ValueError(f"trait {name} must be numeric and finite")
    out = plain.select(*columns).withColumn("row", F.monotonically_increasing_id()).toDF("taxon", *traits, "row")
    return Phenotype(out, tuple(traits))


def marker_map(frame: DataFrame) -> DataFrame:
    """snp, chromosome, position, marker_idx from the first three columns, in the input's order."""
    if len(frame.columns) < 3:
        raise ValueError("a marker map needs three columns")
    plain = frame.select(*[F.col(_quoted(c)) for c in frame.columns[:3]]).toDF("snp", "chromosome", "position")
    plain = plain.select(F.col("snp").cast("string").alias("snp"), F.col("chromosome").cast("string").alias("chromosome"), F.col("position").cast("string").try_cast("double").alias("position"))
    bad_position = F.col("position").isNull() | F.isnan("position") | (F.abs("position") == float("inf"))
    row = plain.agg(
        F.sum((F.col("snp").isNull() | (F.trim("snp") == "")).cast("int")).alias("blank"),
        F.sum((F.col("chromosome").isNull() | (F.trim("chromosome") == "")).cast("int")).alias("no_chr"),
        F.sum(bad_position.cast("int")).alias("bad"),
        F.count(F.lit(1)).alias("n"),
        F.countDistinct("snp").alias("distinct"),
    ).first()
    if row["blank"] or row["no_chr"]:
        raise ValueError("markers and chromosomes must not be null or blank")
    if row["bad"]:
        raise ValueError("positions must be finite numbers")
    if row["distinct"] != row["n"]:
        raise ValueError("marker names must be unique")
    return _in_order(plain, "marker_idx")


def _in_order(frame: DataFrame, name: str) -> DataFrame:
    """Number rows in the input's order: the partitions' sizes, then positions within."""
    tagged = frame.withColumn("_id", F.monotonically_increasing_id())
    part = F.shiftright("_id", 33)
    # One row for each partition.
    sizes = dict(tagged.groupBy(part.alias("p")).agg(F.count(F.lit(1))).collect())
    starts, total = {}, 0
    for p in sorted(sizes):
        starts[p], total = total, total + sizes[p]
    if not starts:
        return tagged.withColumn(name, F.lit(0)).drop("_id")
    base = F.create_map(*[F.lit(x) for kv in starts.items() for x in kv])
    within = F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    return tagged.withColumn(name, (base[part] + within).cast("int")).drop("_id")


#: Markers of a block of the transpose.
BLOCK_MARKERS = 1024


def read_numeric(spark: SparkSession, gd_path: str, gm_path: str, impute_method: str = "middle") -> Genotype:
    """Numeric genotype text (taxa rows) and its marker map, as a packed genotype.

    Each line is parsed where it is read and cut into blocks of markers; one
    shuffle brings the samples' parts of a block together, and they are
    turned there.  No cell is ever a row, no marker a column of a plan.
    """
    markers = marker_map(spark.read.option("sep", "\t").option("header", True).csv(gm_path))
    lines = spark.read.text(gd_path)
    header = lines.first()
    if header is None:
        raise ValueError("the genotype file is empty")
    names = _line_fields(header["value"])[1:]
    # Names are one line of the file; they must agree with the map in order.
    listed = [r[0] for r in markers.orderBy("marker_idx").select("snp").collect()]
    if names != listed:
        raise ValueError("the genotype's markers and the map differ in names or order")
    body = _in_order(lines, "line").where("line > 0 and trim(value) <> ''").select("line", "value")
    m = len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for line, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                taxon, *fields = _line_fields(text.as_py())
                if len(fields) != m:
                    raise ValueError("a genotype row has another number of fields than the header")
                values = _numbers(fields)
                starts = range(0, m, BLOCK_MARKERS)
                blocks = [values[s : s + BLOCK_MARKERS].tobytes() for s in starts]
                n = len(blocks)
                columns = [pa.array(range(n), pa.int32()), pa.array([line] * n, pa.int32()), pa.array([taxon] + [None] * (n - 1), pa.string()), pa.array(blocks, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["block", "line", "taxon", "cells"])

    parts = body.mapInArrow(cut, "block int, line int, taxon string, cells binary").persist()
    order = {r["line"]: (i, r["taxon"]) for i, r in enumerate(parts.where("block = 0").select("line", "taxon").orderBy("line").collect())}
    taxa = [t for _, t in order.values()]
    check_taxa(taxa)
    n = len(taxa)

    def turn(rows: pa.Table) -> pa.Table:
        at = np.argsort(np.asarray(rows.column("line")))
        cells = rows.column("cells").to_pylist()
        block = np.stack([np.frombuffer(cells[i]) for i in at]).T
        first = rows.column("block")[0].as_py() * BLOCK_MARKERS
        dosages = pa.ListArray.from_arrays(pa.array(np.arange(len(block) + 1) * n, pa.int32()), pa.array(np.ascontiguousarray(block).ravel(), from_pandas=True))
        return pa.table({"marker_idx": pa.array(np.arange(first, first + len(block)), pa.int32()), "dosages": dosages})

    turned = parts.select("block", "line", "cells").groupBy("block").applyInArrow(turn, "marker_idx int, dosages array<double>")
    packed = markers.join(turned.hint("merge"), "marker_idx").select("marker_idx", "snp", "chromosome", "position", "dosages")
    return impute(Genotype(packed, tuple(taxa)), impute_method)


def _line_fields(line: str) -> list[str]:
    """Tab-separated fields, quotes around a field removed and doubled quotes halved."""
    fields = line.split("\t")
    if '"' in line:
        fields = [f[1:-1].replace('""', '"') if len(f) > 1 and f[0] == f[-1] == '"' else f for f in fields]
    return fields


def _numbers(fields: list[str]) -> np.ndarray:
    """Numbers, NaN where a field stands for a missing one; other text is an error."""
    try:
        return np.array(fields, float)
    except ValueError:
        return np.array([np.nan if f.strip() in NUMERIC_NA else float(f) for f in fields])


def numeric_from_frame(frame: DataFrame, gm: DataFrame, impute_method: str = "middle") -> Genotype:
    """A labelled table (taxon, a column for each marker) as a packed genotype, by unpivot."""
    taxon, *names = frame.columns
    markers = marker_map(gm)
    if names != [r[0] for r in markers.orderBy("marker_idx").select("snp").collect()]:
        raise ValueError("the genotype's markers and the map differ in names or order")
    rows = _in_order(frame.toDF("taxon", *[f"m{i}" for i in range(len(names))]), "sample_idx")
    taxa = [r[0] for r in rows.orderBy("sample_idx").select("taxon").collect()]
    check_taxa(taxa)
    cells = rows.unpivot("sample_idx", [f"m{i}" for i in range(len(names))], "m", "dosage")
    cells = cells.select("sample_idx", F.substring("m", 2, 12).cast("int").alias("marker_idx"), F.col("dosage").cast("double").alias("dosage"))
    return impute(from_long(cells, markers, taxa), impute_method)


def read_hapmap(spark: SparkSession, path: str, major_allele_zero: bool = False, impute_method: str = "middle") -> Genotype:
    """HapMap text: 11 descriptive columns, then a column of calls for each taxon.  Marker rows: no shuffle."""
    lines = spark.read.text(path).withColumn("fields", F.split("value", "\t"))
    header = lines.select("fields").first()
    if header is None or len(header["fields"]) <= len(HAPMAP_COLUMNS):
        raise ValueError("a HapMap file has 11 columns and the taxa")
    taxa = header["fields"][len(HAPMAP_COLUMNS) :]
    check_taxa(taxa)
    return hapmap_calls(_in_order(lines.select("fields"), "line").where("line > 0 and size(fields) > 1"), taxa, major_allele_zero, impute_method)


def hapmap_calls(lines: DataFrame, taxa: Sequence[str], major_allele_zero: bool, impute_method: str) -> Genotype:
    """``line`` (from 1) and ``fields`` of marker rows, as a packed genotype."""
    calls = F.slice("fields", len(HAPMAP_COLUMNS) + 1, len(taxa))
    packed = lines.select(
        (F.col("line") - 1).cast("int").alias("marker_idx"),
        F.col("fields")[0].alias("snp"),
        F.col("fields")[2].alias("chromosome"),
        F.col("fields")[3].cast("double").alias("position"),
        numericalise(calls, major_allele_zero).alias("dosages"),
    )
    return impute(Genotype(packed, tuple(taxa)), impute_method)
