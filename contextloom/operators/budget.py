"""Token budgets: how they are shared out, and which form of each file fits.

The choice of forms is a fold: what a rejected file would have cost stays available to the next, so a running sum cannot
express it. It runs over one small row per file (costs and a summary of at most some 300 bytes) within one task's list.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.functions.text import byte_tokens, cut_bytes
from contextloom.lexicon import FOCUS_WORTH, MEMORY_SHARE, SAFETY_SHARE, SUMMARY_BYTES, SUMMARY_LEAST, SUMMARY_SHARE

MODES = ["full", "focused", "signature_only", "summary_only", "skipped"]


def share_budget(declared: Column, task: Column, strict: Column | bool = False, buffer: Column | float = 0.10) -> Column:
    """Struct of a declared budget's parts; what is left after task, summary, memory and safety is for code."""
    as_column = lambda x: x if isinstance(x, Column) else F.lit(x)
    strict, buffer, declared = as_column(strict), as_column(buffer), declared.cast("long")
    part = lambda whole, share: F.floor(whole * share).cast("long")
    effective = F.when(strict, declared).otherwise(part(declared, 1.0 + buffer))
    own = byte_tokens(task)
    summary = F.greatest(F.lit(SUMMARY_LEAST).cast("long"), part(effective, SUMMARY_SHARE))
    left = F.greatest(effective - own - summary, F.lit(0))
    memory = F.least(part(effective, MEMORY_SHARE), left)
    safety = F.when(strict, F.lit(0).cast("long")).otherwise(part(effective, SAFETY_SHARE))
    reserved = own + summary + memory + safety
    return F.struct(
        declared.alias("declared"),
        effective.alias("effective"),
        own.alias("task"),
        summary.alias("repo_summary"),
        memory.alias("memory"),
        safety.alias("safety"),
        F.greatest(effective - reserved, F.lit(0)).alias("code"),
        strict.alias("strict"),
        (reserved >= effective).alias("overflow"),
    )


def raw_summary(content: Column, written: Column | None = None) -> Column:
    """A file's summary: the one that an analyzer wrote, else the first bytes of the content; null if there is none."""
    opening = F.when(content != "", cut_bytes(content, SUMMARY_BYTES))
    return opening if written is None else F.coalesce(written, opening)


def shorten(summary: str | None, most: int) -> str | None:
    """A summary that fits so many tokens, with an ellipsis if it was cut; None if nothing fits."""
    if not summary or most <= 0:
        return None
    raw = summary.encode()
    kept = raw[: 4 * most].decode("utf-8", "ignore")
    if not kept:
        return None
    return kept + "..." if len(kept.encode()) < len(raw) else kept


_CHOSEN = "path string, mode string, tokens_used long, summary string"


def allocate(candidates: DataFrame, group: str, budget: str) -> DataFrame:
    """(group, path, mode, tokens_used, summary): the first form of each file that fits what is left, best files first.

    candidates: group, budget (of the group), path, score, full, focused, signatures (costs; null where there is no such
    form) and summary. A file's full form takes any cost that fits; a focused form must save a fifth; a signature form must
    cost something; a summary is cut to fit.
    """
    df = candidates.select(F.col(group).alias("grp"), F.col(budget).cast("long").alias("budget"), "path", "score", *(F.col(c).cast("long").alias(c) for c in ("full", "focused", "signatures")), "summary")
    kind = candidates.schema[group].dataType.simpleString()

    never = np.iinfo("i8").max

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, left = (), 0
        for rows in batches:
            size = rows.num_rows
            modes, costs, texts = ["skipped"] * size, [0] * size, [None] * size
            # what a row costs at least: most rows do not fit what is left, and are passed over together
            form = lambda c, by=rows: pc.fill_null(by.column(c), never).to_numpy()
            least = form("full")
            for c in ("focused", "signatures"):
                least = np.minimum(least, np.where(form(c) > 0, form(c), never))
            least = np.where(rows.column("summary").is_valid().to_numpy(zero_copy_only=False), np.minimum(least, 1), least)
            at = pc.fill_null(rows.column("grp").dictionary_encode().indices, -1).to_numpy()
            for lo, hi in pairwise([0, *(np.flatnonzero(at[1:] != at[:-1]) + 1).tolist(), size] if size else []):
                grp = rows.column("grp")[lo].as_py()
                if now != (grp,):
                    now, left = (grp,), rows.column("budget")[lo].as_py()
                for i in (np.flatnonzero(least[lo:hi] <= left) + lo).tolist():
                    if least[i] > left:
                        continue
                    full, focused, signatures, summary = (rows.column(c)[i].as_py() for c in ("full", "focused", "signatures", "summary"))
                    mode, cost, text = "skipped", 0, None
                    if full is not None and full <= left:
                        mode, cost = "full", full
                    elif focused is not None and 0 < focused <= left and full is not None and (full == 0 or focused < full * FOCUS_WORTH):
                        mode, cost = "focused", focused
                    elif signatures is not None and 0 < signatures <= left:
                        mode, cost = "signature_only", signatures
                    else:
                        text = shorten(summary, left)
                        if text is not None:
                            mode, cost = "summary_only", len(text.encode()) // 4
                    left -= cost
                    modes[i], costs[i], texts[i] = mode, cost, text
            chosen = [rows.column("grp"), rows.column("path"), pa.array(modes, pa.string()), pa.array(costs, pa.int64()), pa.array(texts, pa.string())]
            yield pa.RecordBatch.from_arrays(chosen, ["grp", "path", "mode", "tokens_used", "summary"])

    # a group's rows follow one another within one partition, so only what is left is held, however long the list
    best = F.desc_nulls_last(F.nanvl(F.col("score").cast("double"), F.lit(None)))
    return df.repartition("grp").sortWithinPartitions("grp", best, "path").mapInArrow(fold, f"grp {kind}, {_CHOSEN}").withColumnRenamed("grp", group)


def keep_prefix(changes: DataFrame, group: list[str], cost: str, effective: Column) -> DataFrame:
    """Changes by score until the first that exceeds the budget; the first is kept in any case.

    What comes after the first overflow goes, too, so a running sum decides. Same scores are ordered by path.
    """
    w = Window.partitionBy(*group).orderBy(F.desc("score"), "path")
    df = changes.withColumn("_sum", F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_at", F.row_number().over(w))
    return df.where((F.col("_at") == 1) | (F.col("_sum") <= effective)).drop("_sum", "_at")


def truncate_memory(items: DataFrame, group: list[str], budget: Column, fixed_bytes: Column | None = None) -> DataFrame:
    """items (.., classification, text, confidence, resolved_by, turn_index) that a memory of so many tokens keeps.

    Resolved questions go first, all of them, then all other questions, then constraints and then decisions from the least
    confidence on, until the bytes of what is left make no more than budget tokens. fixed_bytes are counted, but stay.
    """
    step = F.when(F.col("classification") == "open_question", F.when(F.col("resolved_by").isNotNull(), 1).otherwise(2)).when(F.col("classification") == "constraint", 3).otherwise(4)
    df = items.withColumn("_step", step).withColumn("_bytes", F.octet_length("text"))
    lone = F.when(F.col("_step") > 2, F.col("confidence")).otherwise(F.lit(0.0))
    order = [F.col("_step"), lone, F.col("turn_index"), F.col("text")]
    w = Window.partitionBy(*group).orderBy(*order)
    # all questions of a step go together, so they share one remainder: what the later steps hold
    together = Window.partitionBy(*group).orderBy("_step").rangeBetween(Window.unboundedPreceding, -1)
    before = F.when(F.col("_step") <= 2, F.sum("_bytes").over(together)).otherwise(F.sum("_bytes").over(w.rowsBetween(Window.unboundedPreceding, -1)))
    total = F.sum("_bytes").over(Window.partitionBy(*group)) + (fixed_bytes if fixed_bytes is not None else F.lit(0))
    df = df.withColumn("_gone", F.floor((total - F.coalesce(before, F.lit(0))) / 4) > budget)
    return df.where(~F.col("_gone")).drop("_step", "_bytes", "_gone")
