"""The lines of a file that matter to a task, and a rendering of only these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.functions.text import lines, symbol_tokens
from contextloom.lexicon import FOCUS_HEAD, FOCUS_PADDING


def relevant_ranges(files: DataFrame, symbols: DataFrame, tasks: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """(task_id, path, start, end), merged: the head of each file and the symbols that share a token with the task.

    files: (path, n_lines); symbols: (file, name, start_line, end_line); tasks: (task_id, token). Ranges are padded, and
    those with one line or less between them are one. pairs (task_id, path) are the candidates of each task: those whose file
    has symbols get its head at least, if the task has a token; without them only files with a matching symbol are listed.
    """
    named = symbols.select(F.col("file").alias("path"), "start_line", "end_line", F.explode(F.array_distinct(symbol_tokens(F.col("name")))).alias("token"))
    hit = named.join(tasks.select("task_id", "token"), "token").select("task_id", "path", "start_line", "end_line").distinct()
    hit = hit.join(files.select("path", "n_lines").where("n_lines > 0"), "path")
    body = hit.select(
        "task_id",
        "path",
        F.greatest(F.col("start_line") - FOCUS_PADDING, F.lit(1)).cast("int").alias("start"),
        F.least(F.col("end_line") + FOCUS_PADDING, F.col("n_lines")).cast("int").alias("end"),
    )
    headed = hit.select("task_id", "path", "n_lines")
    if pairs is not None:
        some = pairs.join(symbols.select(F.col("file").alias("path")), "path", "left_semi").join(tasks.select("task_id"), "task_id", "left_semi")
        headed = headed.unionByName(some.join(files.select("path", "n_lines").where("n_lines > 0"), "path").select("task_id", "path", "n_lines"))
    head = headed.select("task_id", "path", F.lit(1).alias("start"), F.least(F.lit(FOCUS_HEAD), F.col("n_lines")).cast("int").alias("end")).distinct()
    return merge_ranges(body.unionByName(head), ["task_id", "path"])


def merge_ranges(ranges: DataFrame, group: list[str], gap: int = 2) -> DataFrame:
    """Ranges (start, end) of each group, where one that starts at most `gap` after the end of those before joins them."""
    w = Window.partitionBy(*group).orderBy("start", "end")
    df = ranges.withColumn("_reach", F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    df = df.withColumn("_new", F.when(F.col("start") <= F.col("_reach") + gap, 0).otherwise(1))
    df = df.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return df.groupBy(*group, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def render_ranges(content: Column, ranges: Column) -> Column:
    """The lines of an array of (start, end) structs, each range under a header, with a mark between ranges."""
    every = lines(content)

    def one(r: Column) -> Column:
        length = F.greatest(F.least(r["end"], F.size(every)) - r["start"] + 1, F.lit(0))
        body = F.array_join(F.transform(F.slice(every, r["start"], length), lambda x: F.concat(x, F.lit("\n"))), "")
        return F.concat(F.lit("// Lines "), r["start"].cast("string"), F.lit("-"), r["end"].cast("string"), F.lit("\n"), body)

    return F.array_join(F.transform(ranges, one), "\n// ...\n\n")
