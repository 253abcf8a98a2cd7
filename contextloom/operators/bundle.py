"""Bundles: what goes into a document for a task, its checks and its audit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.lexicon import MANIFESTS, SYMBOL_SECTIONS

VISIBLE = ["full", "focused", "signature_only"]


def output_files(allocated: DataFrame) -> DataFrame:
    """Files of the document: skipped ones stay as a note, those of score 0 go."""
    return allocated.where("score <> 0")


def included(allocated: DataFrame) -> DataFrame:
    return allocated.where("mode <> 'skipped' and score > 0")


def mode_counts(allocated: DataFrame, group: list[str]) -> DataFrame:
    """Files and tokens of each form."""
    return allocated.groupBy(*group, "mode").agg(F.count("*").alias("files"), F.sum("tokens_used").alias("tokens"))


def symbol_graph(symbols: DataFrame, group: list[str] | None = None) -> DataFrame:
    """A row of sorted arrays (name, file), one for each kind with a section; other kinds are left out."""
    entry = F.struct("name", "file", "visibility", "signature", "start_line", "end_line")
    sections = [F.array_sort(F.collect_list(F.when(F.col("kind") == kind, entry))).alias(name) for kind, name in SYMBOL_SECTIONS.items()]
    return symbols.groupBy(*(group or [])).agg(*sections)


def graph_symbols(symbols: DataFrame, allocated: DataFrame) -> DataFrame:
    """Symbols of included files that no visible form of the file shows already."""
    inside = symbols.join(included(allocated).select(F.col("path").alias("file")), "file", "left_semi")
    seen = allocated.where(F.col("mode").isin(*VISIBLE)).select(F.col("path").alias("file"))
    return inside.join(seen, "file", "left_anti")


def used_dependencies(dependencies: DataFrame, contents: DataFrame) -> DataFrame:
    """Dependencies (name, ..) whose name stands in any included content; the names are few, contents are scanned once."""
    low = contents.select(F.lower("content").alias("content"))
    return dependencies.join(low, F.contains(F.col("content"), F.lower("name")), "left_semi")


def summary_lines(files: DataFrame) -> DataFrame:
    """(path, line): files (path, score, summary) near the root that are relevant or manifests."""
    parts = F.split("path", "/")
    df = files.where((F.size(parts) <= 2) & (F.element_at(parts, -1).isin(*MANIFESTS) | (F.col("score") > 0)) & F.col("summary").isNotNull())
    return df.select("path", F.concat(F.lit("- "), "path", F.lit(": "), "summary").alias("line"))


def skipped_warning(allocated: DataFrame, group: list[str]) -> DataFrame:
    """(group, skipped, warning) where files with a score were left out."""
    df = allocated.where("score > 0").groupBy(*group).agg(F.count_if(F.col("mode") == "skipped").alias("skipped")).where("skipped > 0")
    return df.withColumn("warning", F.concat(F.col("skipped").cast("string"), F.lit(" relevant file(s) were skipped for lack of budget")))


def to_json(document: DataFrame) -> DataFrame:
    """(json): each row as one pretty document, without null fields."""
    return document.select(F.to_json(F.struct(*document.columns), {"pretty": "true"}).alias("json"))
