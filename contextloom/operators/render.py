"""Documents: Markdown and JSON of bundles, memories and diffs. Each is one row of text per group."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.lexicon import FENCES, PRIMARY_SCORE, SYMBOL_SECTIONS


def fence(path: Column) -> Column:
    """Name of a file's language after the opening marks of a code block; empty if unknown."""
    names = F.create_map(*(F.lit(x) for pair in FENCES.items() for x in pair))
    return F.coalesce(F.try_element_at(names, F.element_at(F.split(path, r"\."), -1)), F.lit(""))


def joined(df: DataFrame, group: Sequence[str], order: list[str], text: Column, between: str = "") -> DataFrame:
    """(group, text): the texts of a group's rows in order."""
    parts = F.array_sort(F.collect_list(F.struct(*order, text.alias("_t"))))
    return df.groupBy(*group).agg(F.array_join(F.transform(parts, lambda x: x["_t"]), between).alias("text"))


def file_section(files: DataFrame, group: Sequence[str]) -> DataFrame:
    """The relevant files of each group as Markdown.

    files: rank, path, mode, score, tokens_used, content, signatures, summary, ranges (array of start, end). The first file
    below the primary score opens the supporting part.
    """
    ranges = F.array_join(F.transform("ranges", lambda r: F.concat(r["start"].cast("string"), F.lit("-"), r["end"].cast("string"))), ", ")
    head = F.concat(F.lit("### `"), "path", F.lit("` (score: "), F.format_string("%.4f", "score"), F.lit(")\n> Mode: "), "mode", F.lit(" | Tokens: "), F.col("tokens_used").cast("string"))
    head = F.concat(head, F.when(F.col("mode") == "focused", F.concat(F.lit(" | Lines: "), F.coalesce(ranges, F.lit("")))).otherwise(F.lit("")), F.lit("\n\n"))
    body = F.concat(F.lit("```"), fence(F.col("path")), F.lit("\n"), "content", F.when(F.endswith("content", F.lit("\n")), F.lit("")).otherwise(F.lit("\n")), F.lit("```\n\n"))
    marks = F.concat(F.array_join(F.transform("signatures", lambda s: F.concat(F.lit("- `"), s, F.lit("`\n"))), ""), F.lit("\n"))
    text = F.concat(head, *(F.coalesce(x, F.lit("")) for x in (body, marks, F.concat("summary", F.lit("\n\n")))))
    shown = files.where("mode <> 'skipped'")
    first = shown.where(F.col("score") < PRIMARY_SCORE).groupBy(*group).agg(F.min("rank").alias("_first"))
    shown = shown.join(first, list(group), "left").withColumn("_text", F.when(F.col("rank") == F.col("_first"), F.concat(F.lit("### Supporting Context\n\n"), text)).otherwise(text))
    return joined(shown, group, ["rank"], F.col("_text"))


def symbol_section(graph: DataFrame, group: Sequence[str]) -> DataFrame:
    """Markdown of a symbol graph as bundle.symbol_graph makes it."""

    def one(e: Column) -> Column:
        vis = F.coalesce(e["visibility"], F.lit("unknown"))
        return F.concat(F.lit("- `"), e["name"], F.lit("` — "), e["file"], F.lit(" — "), vis, F.lit(" (lines "), e["start_line"].cast("string"), F.lit("-"), e["end_line"].cast("string"), F.lit(")\n"))

    parts = []
    for name in SYMBOL_SECTIONS.values():
        text = F.concat(F.lit(f"### {name.capitalize()}\n\n"), F.array_join(F.transform(name, one), ""), F.lit("\n"))
        parts.append(F.when(F.size(name) > 0, text).otherwise(F.lit("")))
    return graph.select(*group, F.concat(F.lit("## Symbol Graph\n\n"), *parts).alias("text"))


def memory_items(items: DataFrame, group: Sequence[str], layout: str = "md") -> DataFrame:
    """A memory's items in order of turn and class, as Markdown lines or one JSON array."""
    if layout == "json":
        entry = F.struct("turn_index", "classification", "text", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), "polarity", "resolved_by", "fingerprint")
        return items.groupBy(*group).agg(F.to_json(F.array_sort(F.collect_list(entry)), {"pretty": "true"}).alias("text"))
    note = F.when(F.col("classification") == "open_question", F.coalesce(F.concat(F.lit(" (resolved at turn "), F.col("resolved_by").cast("string"), F.lit(")")), F.lit("")))
    note = note.otherwise(F.concat(F.lit(" (confidence: "), F.format_string("%.2f", "confidence"), F.lit(")")))
    label = F.initcap(F.replace(F.col("classification"), F.lit("_"), F.lit(" ")))
    line = F.concat(F.lit("- [turn "), F.col("turn_index").cast("string"), F.lit("] **"), label, F.lit("**: "), "text", note, F.lit("\n"))
    return joined(items, group, ["turn_index", "classification", "text"], line)


def staged_memory(items: DataFrame, group: Sequence[str]) -> DataFrame:
    """Markdown by stage of items as conversation.stage_items makes them."""
    line = F.concat(F.lit("- [turn "), F.col("turn_index").cast("string"), F.lit("] "), F.col("classification"), F.lit(": "), "text", F.lit("\n"))
    keys = [*group, "stage_index", "label", "start_turn", "end_turn"]
    per = joined(items, keys, ["turn_index", "classification", "text"], line)
    head = F.concat(F.lit("## Stage "), F.col("stage_index").cast("string"), F.lit(": "), "label", F.lit(" (turns "), F.col("start_turn").cast("string"), F.lit("-"), F.col("end_turn").cast("string"), F.lit(")\n\n"))
    return joined(per.withColumn("section", F.concat(head, "text", F.lit("\n"))), group, ["stage_index"], F.col("section"))


def decisions(items: DataFrame, markers: DataFrame, group: Sequence[str]) -> DataFrame:
    """(group, document): decisions with the files of their turns, turns of files, and counters, as JSON; questions only counted."""
    group = list(group)
    files = markers.groupBy(*group, "turn_index").agg(F.sort_array(F.collect_set("file")).alias("files"))
    made = items.where("classification = 'decision'").join(files, [*group, "turn_index"], "left")
    entry = F.struct("turn_index", "text", F.round(F.col("confidence").cast("double"), 4).alias("confidence"), F.coalesce("files", F.array().cast("array<string>")).alias("files"))
    listed = made.groupBy(*group).agg(F.array_sort(F.collect_list(entry)).alias("decisions"))
    turns = markers.groupBy(*group, "file").agg(F.sort_array(F.collect_set("turn_index")).alias("turns")).groupBy(*group).agg(F.array_sort(F.collect_list(F.struct("file", "turns"))).alias("files"))
    count = lambda kind: F.count_if(F.col("classification") == kind)
    stats = items.groupBy(*group).agg(count("constraint").alias("constraints"), count("decision").alias("decided"), count("open_question").alias("questions"), F.count_if(F.col("resolved_by").isNotNull()).alias("resolved"))
    df = stats.join(listed, group, "left").join(turns, group, "left")
    return df.select(*group, F.to_json(F.struct("decisions", "files", F.struct("constraints", "decided", "questions", "resolved").alias("stats")), {"pretty": "true"}).alias("document"))


def dependency_section(deps: DataFrame) -> DataFrame:
    version = F.coalesce("version", F.lit("unknown"))
    more = F.when(F.size("features") > 0, F.concat(F.lit(" (features: "), F.array_join("features", ", "), F.lit(")"))).otherwise(F.lit(""))
    return joined(deps, [], ["name"], F.concat(F.lit("- "), "name", F.lit(" "), version, more, F.lit("\n")))


def file_tree(paths: list[str], root: str) -> str:
    """A drawing of the paths of one document; chains of single folders share a line."""
    top: dict = {}
    for path in paths:
        at = top
        for part in path.split("/"):
            at = at.setdefault(part, {})

    def draw(node: dict, indent: str) -> list[str]:
        out = []
        for i, name in enumerate(sorted(node)):
            below = node[name]
            while len(below) == 1 and next(iter(below.values())):
                (child, inner), = below.items()
                name, below = f"{name}/{child}", inner
            last = i == len(node) - 1
            out.append(f"{indent}{'└── ' if last else '├── '}{name}{'/' if below else ''}")
            out += draw(below, indent + ("    " if last else "│   "))
        return out

    return "\n".join([f"{root}/", *draw(top, "")]) + "\n"
