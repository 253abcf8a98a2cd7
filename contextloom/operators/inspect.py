"""Checks of finished bundles: what kind they are, warnings, and an audit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def bundle_type(document: Column) -> Column:
    """context or diff by the keys of a JSON document; null for anything else."""
    keys = F.json_object_keys(document)
    return F.when(F.array_contains(keys, "task"), "context").when(F.array_contains(keys, "from_ref"), "diff")


def check_context(files: DataFrame, group: list[str], markers: DataFrame | None = None, budget: DataFrame | None = None) -> DataFrame:
    """(group, check, detail) warnings on files (rank, path, mode, score, tokens_used) of context bundles.

    Included files must come by falling score; each mention must be of a listed file; the tokens must fit the code budget.
    """
    w = Window.partitionBy(*group).orderBy("rank")
    shown = files.where("mode <> 'skipped'").withColumn("before", F.lag("score").over(w))
    found = shown.where("score > before").select(*group, F.lit("order").alias("check"), F.col("path").alias("detail"))
    twice = files.groupBy(*group, "path").count().where("count > 1").select(*group, F.lit("repeated").alias("check"), F.col("path").alias("detail"))
    found = found.unionByName(twice)
    if markers is not None:
        lost = markers.select(*group, F.col("file").alias("path")).distinct().join(files, [*group, "path"], "left_anti")
        found = found.unionByName(lost.select(*group, F.lit("mention").alias("check"), F.col("path").alias("detail")))
    if budget is not None:
        used = files.groupBy(*group).agg(F.sum("tokens_used").alias("used")).join(budget, group)
        over = used.where("used > code").select(*group, F.lit("budget").alias("check"), F.concat_ws("/", "used", "code").alias("detail"))
        found = found.unionByName(over)
    return found


def check_diff(changed: DataFrame, symbols: DataFrame, references: DataFrame) -> DataFrame:
    """(check, detail) warnings on a diff bundle: symbols of unlisted files, references to unknown symbols, odd kinds."""
    lost = symbols.join(changed.select(F.col("path").alias("file")), "file", "left_anti").select(F.lit("symbol").alias("check"), F.col("name").alias("detail"))
    known = symbols.where("change <> 'added'").select(F.col("name").alias("word")).distinct()
    loose = references.withColumn("word", F.element_at(F.split("symbol", "::"), -1)).join(known, "word", "left_anti").select(F.lit("reference").alias("check"), F.col("symbol").alias("detail"))
    odd = changed.where("type not in ('added', 'modified', 'deleted', 'renamed') or (type = 'renamed' and `from` is null)").select(F.lit("kind").alias("check"), F.col("path").alias("detail"))
    twice = changed.groupBy("path").count().where("count > 1").select(F.lit("repeated").alias("check"), F.col("path").alias("detail"))
    return lost.unionByName(loose).unionByName(odd).unionByName(twice)


def audit(files: DataFrame, group: list[str], top: int = 10) -> DataFrame:
    """(group, files by form, tokens, and the most relevant paths)."""
    count = lambda mode: F.count_if(F.col("mode") == mode).alias(mode)
    modes = [count(m) for m in ("full", "focused", "signature_only", "summary_only", "skipped")]
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "path")
    best = files.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= top).groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("_n", "path"))), lambda x: x["path"]).alias("top_paths"))
    return files.groupBy(*group).agg(*modes, F.sum("tokens_used").alias("tokens")).join(best, group)
