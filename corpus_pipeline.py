"""The corpus pipeline: five stages, each written and read again, each on all that the last one kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from locuspark.llm import decontam, neardup, secrets, spm, toxicity
from locuspark.llm.common import bound_arrow_batches, materialise, scratch_path, stable, table, unused
from locuspark.llm.queries import PIECE_MODEL

#: Rows up to this many are named to all tasks (16 bytes each); beyond it the join shuffles.
BROADCAST_ROWS = 500_000


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the models, learned from the labels not held out, call toxic.

    Null and empty texts have the score of the labels' share, and stay where
    that is under a half; without labels of both kinds all documents stay.
    """
    bound_arrow_batches(spark)
    models = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "_toxicity")
    return toxicity.score(docs, models, out_col=score).where(F.col(score) < 0.5).select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of five-word-shingle similarity 0.8 or more; null and wordless texts are a group."""
    bound_arrow_batches(spark)
    return neardup.one_of_each_group(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that hold a benchmark item, whether they have an id or not; null and empty texts hold none."""
    (row,) = unused(docs, "_row")
    numbered = stable(docs, "pipeline-docs").withColumn(row, F.monotonically_increasing_id())
    found = decontam.contaminated(numbered, table(spark, sf_dir, "benchmark"), id_col=row)
    found = materialise(found.select(F.col("doc_id").alias(row)).distinct(), "pipeline-contaminated")
    named = F.broadcast(found) if found.count() <= BROADCAST_ROWS else found
    return numbered.join(named, row, "left_anti").select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, secrets in their texts replaced by marks and ``n_chars`` counted again; null and empty texts stay as they are."""
    bound_arrow_batches(spark)
    clean = secrets.redact(docs)
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every document, for training: none for an empty text, null and a count of 0 for a null one."""
    bound_arrow_batches(spark)
    rows = spm.encode(docs.select("doc_id", "text"), spm.read_model(PIECE_MODEL))
    return rows.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("near duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", redact_secrets),
    ("pieces", encode_pieces),
]

#: No SQL expresses the models, fingerprints and merges.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result a Parquet table in the shared folder."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch_path(spark, "pipeline-" + name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
