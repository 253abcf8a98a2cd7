"""Scratch tables in the folder that driver and executors share."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.shipping import ship

#: Texts and sets go to Python so many at a time where small_batches says so; the buffers of a batch are outside the JVM's heap.
BATCH_ROWS = 1_000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def use_small_batches(spark: SparkSession) -> None:
    """From now on the session sends at most BATCH_ROWS rows to Python at a time."""
    if not 0 < int(spark.conf.get(_BATCH)) <= BATCH_ROWS:
        spark.conf.set(_BATCH, BATCH_ROWS)


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Small batches for the queries that run inside; the session's setting comes back after."""
    before = spark.conf.get(_BATCH)
    use_small_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; a temporary folder only where one machine runs everything."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "contextloom-checkpoints")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and the files survive executors."""
    spark = df.sparkSession
    ship(spark)
    path = f"{shared_folder(spark)}/contextloom-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    # shuffle files of finished stages are dropped once the JVM finds their plans unused
    spark.sparkContext._jvm.System.gc()
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def drop(df: DataFrame) -> None:
    """Delete the files of a table made by materialize that nothing needs any more."""
    jvm, session = df.sparkSession.sparkContext._jvm, df.sparkSession._jsparkSession
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(session.sessionState().newHadoopConf()).delete(path, True)


def flat(text: Column) -> Column:
    """A text with single spaces between words and none around; only what differs from that is matched."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]{2,}|[\x09-\x0D]", " "))


def flat_words(flat_text: Column) -> Column:
    """Array of the words of a text made by flat."""
    return F.when(flat_text == "", F.array().cast("array<string>")).otherwise(F.split(flat_text, " "))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(taken: list[str], name: str) -> str:
    """name, with underscores until no column in taken has it (Spark compares names without case)."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name
