"""Connected components of link tables by minimum labels and pointer jumping."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.shared import drop, materialize

#: Links and documents in links up to so many (16 bytes each) are joined on the driver in one step, more by rounds of queries.
HELD_LINKS = 500_000


def least_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(documents, in order, and the smallest document that links a-b lead to from each)."""
    docs, ends = np.unique(np.concatenate([a, b]), return_inverse=True)
    a, b = ends[: len(a)], ends[len(a) :]
    label = np.arange(len(docs))
    while True:
        low, high = np.minimum(label[a], label[b]), np.maximum(label[a], label[b])
        apart = low < high
        if not apart.any():
            return docs, docs[label]
        # labels are roots here: each takes the least that one of its links sees, then all labels go on to their roots
        np.minimum.at(label, high[apart], low[apart])
        while (label[label] != label).any():
            label = label[label]


def components(links: DataFrame) -> DataFrame:
    """(doc, comp) for every document in links (a, b), as a table: the smallest document that links lead to.

    A round takes the least label among a document's neighbours and then that label's own label, so labels move along
    paths of doubling length; it ends when no label changes. Only sums go to the driver.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct()
    both = materialize(both, "links")
    labels = materialize(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("doc"), F.least("a", "m").alias("comp")), "labels")
    while True:
        near = both.join(labels.withColumnsRenamed({"doc": "b", "comp": "near"}), "b").groupBy("a").agg(F.min("near").alias("near"))
        step = labels.join(near.withColumnRenamed("a", "doc"), "doc").select("doc", "comp", F.least("comp", "near").alias("to"))
        # a root that saw a smaller label hands it to its members
        hook = step.groupBy(F.col("comp").alias("root")).agg(F.min("to").alias("lower"))
        step = step.join(hook, F.col("comp") == F.col("root")).select("doc", F.least("to", "lower").alias("comp"), (F.least("to", "lower") < F.col("comp")).alias("moved"))
        new = materialize(step, "labels")
        drop(labels)
        if new.where("moved").isEmpty():
            drop(both)
            return new
        labels = new


class Labels:
    """Components of all links added so far; only links between different components are followed."""

    def __init__(self) -> None:
        self.table: DataFrame | None = None
        #: the table's (doc, comp) while there are at most HELD_LINKS of them and of new links together, else None
        self.held: tuple[np.ndarray, np.ndarray] | None = (np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64))

    def of(self, df: DataFrame, column: str, name: str) -> DataFrame:
        """df with the component of the documents in column: the documents themselves, where nothing links them."""
        if self.table is None:
            return df.withColumn(name, F.col(column))
        known = self.table.select(F.col("doc").alias(column), F.col("comp").alias(name))
        return df.join(known, column, "left").withColumn(name, F.coalesce(name, column))

    def add(self, links: DataFrame) -> None:
        """Take links (a, b) in; they are read twice."""
        n = links.count()
        if not n:
            return
        if self.held is None or n + len(self.held[0]) > HELD_LINKS:
            self.held = None
            self._add_by_queries(links)
            return
        new = links.select("a", "b").toPandas()
        sides = (np.concatenate([new[c].to_numpy(dtype=np.int64), old]) for c, old in zip("ab", self.held, strict=True))
        self.held = least_labels(*sides)
        table = pa.table(dict(zip(("doc", "comp"), map(pa.array, self.held), strict=True)))
        labels = materialize(links.sparkSession.createDataFrame(table), "components")
        if self.table is not None:
            drop(self.table)
        self.table = labels

    def _add_by_queries(self, links: DataFrame) -> None:
        new = materialize(self.of(self.of(links.select("a", "b"), "a", "x"), "b", "y").where("x <> y").distinct(), "new")
        if not new.isEmpty():
            joined = components(new.select(F.col("x").alias("a"), F.col("y").alias("b")))
            every = new.select(F.col("a").alias("doc"), F.col("x").alias("old")).unionByName(new.select(F.col("b").alias("doc"), F.col("y").alias("old")))
            if self.table is not None:
                every = every.unionByName(self.table.select("doc", F.col("comp").alias("old")))
            every = every.distinct().join(joined.select(F.col("doc").alias("old"), "comp"), "old", "left")
            labels = materialize(every.select("doc", F.coalesce("comp", "old").alias("comp")), "components")
            drop(joined)
            if self.table is not None:
                drop(self.table)
            self.table = labels
        drop(new)

    def take(self, links: DataFrame) -> None:
        """Take in links that materialize has made, and delete their table."""
        self.add(links)
        drop(links)
