"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import files

_LOCAL_SCRATCH: dict[str, str] = {}

#: Bytes of an Arrow batch sent to a Python worker; long texts make record counts a poor bound.
ARROW_BATCH_BYTES = 8 << 20


def scratch_root(spark: SparkSession) -> str:
    """Folder that the driver and every executor can reach.

    The cluster names it in ``spark.checkpoint.dir``.  Where that is unset, a
    temporary folder serves a local master and the warehouse serves a cluster.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_SCRATCH:
        if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            _LOCAL_SCRATCH[app] = "file://" + tempfile.mkdtemp(prefix="locuspark-")
        else:
            _LOCAL_SCRATCH[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _LOCAL_SCRATCH[app]


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str, **options: object) -> DataFrame:
    """Write ``df`` to the shared folder and read it back, which cuts its lineage.

    A lost executor costs the tasks that ran on it, never the table.
    """
    path = scratch_path(df.sparkSession, name)
    writer = df.write
    for key, value in options.items():
        writer = writer.option(key.replace("__", "."), value)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_SCANS = {"FileScan", "Scan", "BatchScan", "ColumnarToRow", "Project", "Filter", "WholeStageCodegen", "InputAdapter", "AdaptiveSparkPlan"}


def stable(df: DataFrame, name: str) -> DataFrame:
    """``df`` itself where it only scans files, which gives the same rows in the same partitions each time; else a table with its rows."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    nodes = set(re.findall(r"^[\s:+*|-]*(?:\(\d+\) )?([A-Za-z]+)", plan, re.MULTILINE))
    return df if nodes <= _SCANS and nodes & {"FileScan", "BatchScan"} else materialise(df, name)


def write_by_partition(rows: DataFrame, path: str) -> None:
    """A file for each partition of the table that ``row``, a monotonically increasing id, was made on.

    It holds the partition's rows of ``rows`` in order, so a second scan of the
    table finds what was decided of its rows without a shuffle of the table.
    """
    listed = rows.groupBy(F.shiftright("row", 33).alias("block")).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, found in zip(batch.column(0).to_pylist(), batch.column(1)):
                files.write_block(f"{path}/{block:07d}.arrow", pa.Table.from_struct_array(found.values).sort_by("row"))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64())], ["block"])

    materialise(listed.mapInArrow(write, "block long"), "written").count()


def text_sum(text: Column) -> Column:
    """A checksum that tells whether a second scan gives the same text; null for null."""
    return F.crc32(text.cast("string").cast("binary"))


def keep_rows(docs: DataFrame, kept: DataFrame, text_col: str) -> DataFrame:
    """The rows of ``docs`` that ``kept`` lists: ``row``, their monotonically increasing id, and ``sum``, their ``text_sum``.

    ``docs`` must give the same rows in the same partitions again, as ``stable``
    tables do; a row that differs is an error.
    """
    path = scratch_path(docs.sparkSession, "kept")
    write_by_partition(kept.select("row", "sum"), path)
    row, check = unused(docs, "_row", "_sum")
    source = docs.select("*", F.monotonically_increasing_id().alias(row), text_sum(F.col(text_col)).alias(check))
    n = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sums = None
        for batch in batches:
            if not batch.num_rows:
                continue
            here = np.asarray(batch.column(n))
            if rows is None:
                name = f"{path}/{int(here[0]) >> 33:07d}.arrow"
                table = files.read_block(name) if files.size_of(name) is not None else None
                rows = np.zeros(0, np.int64) if table is None else np.asarray(table.column("row"))
                sums = np.zeros(0) if table is None else table.column("sum").to_pandas().to_numpy(float)
            at = np.searchsorted(rows, here)
            hit = at < len(rows)
            hit[hit] = rows[at[hit]] == here[hit]
            found = batch.column(n + 1).to_pandas().to_numpy(float)[hit]
            if not np.array_equal(found, sums[at[hit]], equal_nan=True):
                raise ValueError("the documents differ from those that were compared; write them to a table first")
            yield batch.filter(pa.array(hit)).select(list(range(n)))

    return source.mapInArrow(run, docs.schema)


def bound_arrow_batches(spark: SparkSession) -> None:
    """Bound the batches that Python workers get by bytes, as texts have no bounded length."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(ARROW_BATCH_BYTES))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores before it until no column of ``df`` has it, in any case."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``, within one expression."""
    return F.transform(F.array(value), body)[0]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
