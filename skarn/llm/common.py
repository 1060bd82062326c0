"""Tables, shared staging and the fold rule used by every operator here."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; one of our own only in local mode (tests), where all tasks can read it."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="skarn-shared-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it back.

    This cuts the lineage with files that outlive any executor. Column names and types are kept.
    """
    path = f"{shared_dir(df.sparkSession)}/skarn-{label}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fold(id_col: str, k: int) -> Column:
    """crc32 of the id's text modulo k: the split rule of labelled rows."""
    return F.crc32(F.col(id_col).cast("string")) % F.lit(k)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are bounded by bytes, so two tasks' batches fit beside an executor's heap."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "16777216")


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns that an operator reads, under fixed names, so other columns can't clash."""
    small_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(text: str | Column = "text") -> Column:
    """Tells rows of one doc_id with other texts apart."""
    return F.xxhash64((F.col(text) if isinstance(text, str) else text).cast("string"))
