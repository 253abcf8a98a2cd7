"""Whole documents of contexts and diffs: assembled rows of a fixed schema, their Markdown, files of them, and reading back."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.lexicon import SYMBOL_SECTIONS
from contextloom.operators import bundle as U
from contextloom.operators import render as R

SCHEMA_VERSION = "0.2"
DIFF_VERSION = "0.1"
_ENTRY = "array<struct<name: string, file: string, visibility: string, signature: string, start_line: int, end_line: int>>"
_GRAPH = "struct<" + ", ".join(f"{name}: {_ENTRY}" for name in SYMBOL_SECTIONS.values()) + ">"
_BUDGET = "struct<declared: bigint, effective: bigint, task: bigint, repo_summary: bigint, memory: bigint, safety: bigint, code: bigint, strict: boolean, overflow: boolean>"
_FILE = (
    "struct<path: string, inclusion_mode: string, content: string, signatures: array<string>, summary: string, relevance_score: double, "
    "estimated_tokens: bigint, line_ranges: array<struct<start: int, end: int>>>"
)
_MARK = "array<struct<turn_index: bigint, file: string, fingerprint: string>>"
_ITEM = "array<struct<turn_index: bigint, text: string, confidence: double, polarity: string, resolved_by: bigint, fingerprint: string>>"
_MEMORY = f"struct<constraints: {_ITEM}, decisions: {_ITEM}, open_questions: {_ITEM}, stage_markers: {_MARK}>"
#: Fields of a context document, in order.
CONTEXT = (
    f"schema_version string, task string, repo_summary string, file_tree string, relevant_files array<{_FILE}>, symbol_graph {_GRAPH}, "
    f"dependency_graph array<struct<name: string, version: string, features: array<string>>>, token_budget {_BUDGET}, conversation_memory {_MEMORY}, warnings array<string>"
)


def memory(items: DataFrame, markers: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, conversation_memory): items by class and file mentions of each conversation, in order of turns."""
    entry = F.struct("turn_index", "text", F.col("confidence").cast("double").alias("confidence"), "polarity", "resolved_by", "fingerprint")
    of = lambda kind: F.array_sort(F.collect_list(F.when(F.col("classification") == kind, entry)))
    said = items.groupBy(*keys).agg(of("constraint").alias("constraints"), of("decision").alias("decisions"), of("open_question").alias("open_questions"))
    marked = markers.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("turn_index", "file", "fingerprint"))).alias("stage_markers"))
    both = said.join(marked, list(keys), "full_outer")
    names = ["constraints", "decisions", "open_questions", "stage_markers"]
    filled = [F.coalesce(c, F.array().cast(_MARK if c == "stage_markers" else _ITEM)).alias(c) for c in names]
    return both.select(*keys, F.struct(*filled).alias("conversation_memory"))


def context_documents(
    tasks: DataFrame, built: DataFrame, symbols: DataFrame, shares: DataFrame, summary: Column, tree: Column, dependencies: DataFrame | None = None, memories: DataFrame | None = None
) -> DataFrame:
    """task_id and the fields of CONTEXT for each task.

    built: files of plans.commands.build; shares: (task_id, share) of budget.share_budget; summary and tree: columns of tasks;
    memories: (task_id, conversation_memory). Only dependencies that an included content names are listed.
    """
    entry = F.struct(
        "rank", "path", F.col("mode").alias("inclusion_mode"), "content", "signatures", "summary", F.col("score").alias("relevance_score"), F.col("tokens_used").alias("estimated_tokens"), F.col("ranges").alias("line_ranges")
    )
    names = ["path", "inclusion_mode", "content", "signatures", "summary", "relevance_score", "estimated_tokens", "line_ranges"]
    listed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(*(x[n].alias(n) for n in names)))
    files = built.groupBy("task_id").agg(listed.cast(f"array<{_FILE}>").alias("relevant_files"), F.count_if(F.col("mode") == "skipped").alias("_skipped"))
    shown = U.included(built).select("task_id", F.col("path").alias("file"), F.col("mode").isin(*U.VISIBLE).alias("seen"))
    graph = U.symbol_graph(symbols.join(shown.where("not seen"), "file"), ["task_id"]).select("task_id", F.struct(*SYMBOL_SECTIONS.values()).cast(_GRAPH).alias("symbol_graph"))
    df = tasks.select("task_id", "task", summary.alias("repo_summary"), tree.alias("file_tree"))
    df = df.join(files, "task_id", "left").join(graph, "task_id", "left").join(shares.select("task_id", F.col("share").cast(_BUDGET).alias("token_budget")), "task_id", "left")
    if dependencies is not None:
        contents = U.included(built).where("content is not null").select("task_id", F.lower("content").alias("content"))
        named = contents.join(dependencies, F.contains(F.col("content"), F.lower("name"))).groupBy("task_id")
        deps = named.agg(F.array_sort(F.collect_set(F.struct("name", "version", "features"))).alias("dependency_graph"))
        df = df.join(deps, "task_id", "left")
    else:
        df = df.withColumn("dependency_graph", F.lit(None))
    df = df.join(memories, "task_id", "left") if memories is not None else df.withColumn("conversation_memory", F.lit(None).cast(_MEMORY))
    over = F.when(F.col("token_budget.overflow"), F.lit("Token budget overflow: reserves exceed effective budget. Code budget is 0. Raise --token-budget to include file content."))
    left = F.when(F.col("_skipped") > 0, F.concat(F.col("_skipped").cast("string"), F.lit(" file(s) skipped due to budget constraints.")))
    warned = F.array_compact(F.array(over, left))
    empty = F.struct(*(F.array().cast(_ENTRY).alias(n) for n in SYMBOL_SECTIONS.values()))
    return df.select(
        "task_id",
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        "task",
        "repo_summary",
        "file_tree",
        F.coalesce("relevant_files", F.array().cast(f"array<{_FILE}>")).alias("relevant_files"),
        F.coalesce("symbol_graph", empty).alias("symbol_graph"),
        F.coalesce(F.col("dependency_graph"), F.array()).cast("array<struct<name: string, version: string, features: array<string>>>").alias("dependency_graph"),
        "token_budget",
        "conversation_memory",
        F.when(F.size(warned) > 0, warned).alias("warnings"),
    )


def context_json(documents: DataFrame) -> DataFrame:
    """(task_id, text): each document as pretty JSON without null fields."""
    names = [c for c in documents.columns if c != "task_id"]
    return documents.select("task_id", F.to_json(F.struct(*names), {"pretty": "true"}).alias("text"))


def _each(items: Column, line) -> Column:
    return F.array_join(F.transform(items, line), "")


def context_markdown(documents: DataFrame) -> DataFrame:
    """(task_id, text): each document as Markdown."""
    files = documents.select("task_id", F.posexplode("relevant_files").alias("rank", "f"))
    shown = files.select("task_id", "rank", "f.path", F.col("f.inclusion_mode").alias("mode"), F.col("f.relevance_score").alias("score"), F.col("f.estimated_tokens").alias("tokens_used"), "f.content", "f.signatures", "f.summary", F.col("f.line_ranges").alias("ranges"))
    listed = R.file_section(shown, ["task_id"]).withColumnRenamed("text", "_files")
    graph = R.symbol_section(documents.select("task_id", "symbol_graph.*"), ["task_id"]).withColumnRenamed("text", "_graph")
    df = documents.join(listed, "task_id", "left").join(graph, "task_id", "left")
    text = lambda x: x.cast("string")
    dep = lambda d: F.concat(F.lit("- "), d["name"], F.lit(" "), F.coalesce(d["version"], F.lit("unknown")), F.when(F.size(d["features"]) > 0, F.concat(F.lit(" (features: "), F.array_join(d["features"], ", "), F.lit(")"))).otherwise(F.lit("")), F.lit("\n"))
    part = lambda head, items, line: F.when(F.size(items) > 0, F.concat(F.lit(f"### {head}\n\n"), _each(items, line), F.lit("\n"))).otherwise(F.lit(""))
    turn = lambda i: F.concat(F.lit("- [turn "), text(i["turn_index"]), F.lit("] "))
    sure = lambda i: F.concat(turn(i), i["text"], F.lit(" (confidence: "), F.format_string("%.2f", i["confidence"]), F.lit(")\n"))
    asked = lambda i: F.concat(turn(i), i["text"], F.coalesce(F.concat(F.lit(" (resolved at turn "), text(i["resolved_by"]), F.lit(")")), F.lit("")), F.lit("\n"))
    m = F.col("conversation_memory")
    held = F.concat(
        F.lit("---\n\n## Conversation Memory\n\n"),
        part("Constraints", m["constraints"], sure),
        part("Decisions", m["decisions"], sure),
        part("Open Questions", m["open_questions"], asked),
        part("Stage Markers", m["stage_markers"], lambda i: F.concat(turn(i), i["file"], F.lit("\n"))),
    )
    warned = F.concat(F.lit("---\n\n## Warnings\n\n"), _each(F.col("warnings"), lambda w: F.concat(F.lit("- "), w, F.lit("\n"))), F.lit("\n"))
    return df.select(
        "task_id",
        F.concat(
            F.lit("# Context Bundle\n\n**Task:** "), "task", F.lit("\n\n---\n\n## Repository Summary\n\n"), "repo_summary", F.lit("\n\n---\n\n## File Tree\n\n```\n"), "file_tree", F.lit("```\n\n---\n\n## Relevant Files\n\n"),
            F.coalesce("_files", F.lit("")), F.lit("---\n\n"), F.coalesce("_graph", F.lit("")), F.lit("---\n\n## Dependencies\n\n"), _each(F.col("dependency_graph"), dep), F.lit("\n"),
            F.when(m.isNotNull(), held).otherwise(F.lit("")), F.when(F.col("warnings").isNotNull(), warned).otherwise(F.lit("")),
        ).alias("text"),
    )


def context_warnings(documents: DataFrame) -> DataFrame:
    """(task_id, warning): budgets whose parts exceed them, included files out of order, mentions of unlisted files, unknown schemas."""
    b = F.col("token_budget")
    parts = b["task"] + b["repo_summary"] + b["memory"] + b["safety"] + b["code"]
    summed = F.when((parts > b["effective"]) & ~b["overflow"], F.concat(F.lit("Token budget buckets sum to "), parts.cast("string"), F.lit(" but effective budget is "), b["effective"].cast("string"), F.lit(" and overflow is not set")))
    scores = F.transform(F.filter("relevant_files", lambda f: f["inclusion_mode"] != "skipped"), lambda f: f["relevance_score"])
    rising = F.exists(F.zip_with(F.slice(scores, 1, F.greatest(F.size(scores) - 1, F.lit(0))), F.slice(scores, 2, F.size(scores)), lambda x, y: x < y), lambda x: x)
    order = F.when(rising, F.lit("Included files are not in descending relevance score order"))
    listed = F.transform("relevant_files", lambda f: f["path"])
    lost = F.filter(F.coalesce(F.col("conversation_memory.stage_markers"), F.array().cast(_MARK)), lambda x: ~F.array_contains(listed, x["file"]))
    lost = F.transform(lost, lambda x: F.concat(F.lit("Conversation memory references '"), x["file"], F.lit("' which is not in relevant_files")))
    version = F.when(~F.col("schema_version").isin("0.1", "0.2"), F.concat(F.lit("Unknown schema version '"), "schema_version", F.lit("' — inspect output may be incomplete")))
    return documents.select("task_id", F.explode(F.array_compact(F.concat(F.array(summed, order), lost, F.array(version)))).alias("warning"))


def diff_markdown(changed: DataFrame, symbols: DataFrame, references: DataFrame, stats: DataFrame, from_ref: str, to_ref: str, budget: dict | None = None) -> DataFrame:
    """(text): a diff, of the tables that plans.commands.diff makes, as one Markdown document."""
    s = lambda c: F.col(c).cast("string")
    rows = {
        "Files added": "files_added", "Files modified": "files_modified", "Files deleted": "files_deleted", "Files renamed": "files_renamed", "Symbols added": "symbols_added",
        "Symbols removed": "symbols_removed", "Symbols signature changed": "symbols_changed", "Total lines added": "lines_added", "Total lines removed": "lines_removed",
    }
    table = F.concat(*(F.concat(F.lit(f"| {k} | "), s(c), F.lit(" |\n")) for k, c in rows.items()))
    head = stats.select(F.lit(0).alias("part"), F.lit("").alias("at"), F.concat(F.lit(f"# Diff: {from_ref} -> {to_ref}\n\n## Stats\n\n| Metric | Count |\n|--------|-------|\n"), table, F.lit("\n---\n\n## Changed Files\n\n| File | Change | +Lines | -Lines |\n|------|--------|--------|--------|\n")).alias("text"))
    kind = F.when(F.col("type") == "renamed", F.concat(F.lit("Renamed from "), "from")).otherwise(F.initcap("type"))
    files = changed.select(F.lit(1).alias("part"), F.col("path").alias("at"), F.concat(F.lit("| "), "path", F.lit(" | "), kind, F.lit(" | "), s("added_lines"), F.lit(" | "), s("removed_lines"), F.lit(" |\n")).alias("text"))
    what = F.concat(F.upper(F.replace("change", F.lit("_"), F.lit(" "))), F.lit(": `"), "name", F.lit("` ("), "kind", F.lit(")\n"))
    more = F.when(F.col("change") == "signature_changed", F.concat(F.lit("  - Before: `"), "from", F.lit("`\n  - After:  `"), "to", F.lit("`\n"))).otherwise(F.lit(""))
    per = symbols.withColumn("_line", F.concat(F.lit("- "), what, more)).groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("name", "kind", "_line"))), lambda x: x["_line"]), "").alias("lines"))
    marks = per.select(F.lit(3).alias("part"), F.col("file").alias("at"), F.concat(F.lit("### "), "file", F.lit("\n\n"), "lines", F.lit("\n")).alias("text"))
    once = lambda df, part, text: df.limit(1).select(F.lit(part).alias("part"), F.lit("").alias("at"), F.lit(text).alias("text"))
    used = references.select(F.lit(5).alias("part"), F.col("symbol").alias("at"), F.concat(F.lit("- `"), "symbol", F.lit("` referenced in:\n"), _each(F.col("files"), lambda f: F.concat(F.lit("  - "), f, F.lit("\n"))), F.lit("\n")).alias("text"))
    every = references.select(F.explode("files").alias("file")).distinct()
    whole = every.agg(F.array_sort(F.collect_list("file")).alias("files")).where(F.size("files") > 0)
    every = whole.select(F.lit(6).alias("part"), F.lit("").alias("at"), F.concat(F.lit("**All affected files ("), F.size("files").cast("string"), F.lit("):**\n"), _each(F.col("files"), lambda f: F.concat(F.lit("- "), f, F.lit("\n")))).alias("text"))
    parts = head.unionByName(files).unionByName(once(symbols, 2, "\n---\n\n## Symbol Changes\n\n")).unionByName(marks)
    parts = parts.unionByName(once(references, 4, "---\n\n## Impact Radius\n\nFiles affected by symbol removals or signature changes:\n\n")).unionByName(used).unionByName(every)
    if budget:
        said = f"---\n\n## Token Budget\n\n- Declared: {budget['declared']}\n- Effective: {budget['effective']}\n- Strict: {'yes' if budget['strict'] else 'no'}\n"
        parts = parts.unionByName(once(stats, 7, said))
    return R.joined(parts, [], ["part", "at"], F.col("text"))


def diff_warnings(changed: DataFrame, stats: DataFrame) -> DataFrame:
    """(warning): counters of a diff that differ from its files."""
    counts = changed.agg(*(F.count_if(F.col("type") == k).alias(f"n_{k}") for k in ("added", "modified", "deleted", "renamed"))).crossJoin(stats)  # one row each
    said = lambda k: F.when(F.col(f"n_{k}") != F.col(f"files_{k}"), F.concat(F.lit("Stats say "), F.col(f"files_{k}").cast("string"), F.lit(f" files {k} but found "), F.col(f"n_{k}").cast("string"), F.lit(f" {k.capitalize()} files")))
    return counts.select(F.explode(F.array_compact(F.array(*map(said, ("added", "modified", "deleted", "renamed"))))).alias("warning"))


def write_documents(texts: DataFrame, path: str) -> None:
    """A folder for each task_id under path with its text as one file."""
    texts.select("task_id", "text").write.partitionBy("task_id").option("lineSep", "\n").mode("overwrite").text(path)


def show_documents(texts: DataFrame) -> None:
    """Texts on standard output, one row at a time."""
    for row in texts.select("text").toLocalIterator():
        print(row["text"])


def read_contexts(spark: SparkSession, path: str) -> DataFrame:
    """(file, fields of CONTEXT) of JSON documents, one in each file; lines of symbols are 0 where they are missing."""
    df = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.from_json("value", CONTEXT).alias("d")).select("file", "d.*")
    default = lambda e: F.struct(e["name"].alias("name"), e["file"].alias("file"), e["visibility"].alias("visibility"), e["signature"].alias("signature"), F.coalesce(e["start_line"], F.lit(0)).alias("start_line"), F.coalesce(e["end_line"], F.lit(0)).alias("end_line"))
    return df.withColumn("symbol_graph", F.struct(*(F.transform(F.col(f"symbol_graph.{n}"), default).alias(n) for n in SYMBOL_SECTIONS.values())))
