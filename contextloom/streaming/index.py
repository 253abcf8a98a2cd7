"""Keeping an index up to date with a stream of file versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def latest(versions: DataFrame, order: str) -> DataFrame:
    """The last version of each path."""
    w = Window.partitionBy("path").orderBy(F.desc(order))
    return versions.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def follow(versions: DataFrame, order: str, update: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each batch's last versions to update(files, epoch), which must give the same result if an epoch is repeated."""
    return versions.writeStream.foreachBatch(lambda batch, epoch: update(latest(batch, order), epoch)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
