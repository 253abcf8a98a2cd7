"""Relevance of files to tasks.

A task and a file meet only where they share a token, so scores come from an inverted index joined on tokens. Files' sets of
tokens are dealt out by path, so many files a task, before they meet: pairs, which are many more, are counted where they arise.
Texts never leave their scan. Pairs that share nothing have no keyword or symbol part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.functions.text import round4, symbol_tokens, tokens
from contextloom.lexicon import CHANGE, RECENCY, RELEVANCE, VECTOR_WEIGHT


def recency_score(position: Column) -> Column:
    """Bucket of the place (0 is the newest) of the last commit that touched a file; 0 if none did."""
    score = F.lit(0.0)
    for last, value in reversed(RECENCY):
        score = F.when(position <= last, value).otherwise(score)
    return F.when(position.isNull(), 0.0).otherwise(score)


def first_positions(commits: DataFrame, path: str = "path", position: str = "position") -> DataFrame:
    """(path, position, recency): the least place in the log at which a file occurs."""
    least = commits.groupBy(F.col(path).alias("path")).agg(F.min(position).alias("position"))
    return least.withColumn("recency", recency_score(F.col("position")))


def log_positions(log: DataFrame, order: list[Column], path: str) -> DataFrame:
    """(path, recency) over a log of single events, the newest first in `order`; only the newest 20 count.

    The cut is made by a distributed top-k, so no window orders the whole log.
    """
    newest = log.orderBy(*order).limit(RECENCY[-1][0] + 1)
    numbered = newest.withColumn("position", F.row_number().over(Window.orderBy(*order)) - 1)
    return first_positions(numbered, path)


def task_tokens(tasks: DataFrame, task_id: str, text: str) -> DataFrame:
    """(task_id, token, task_size): distinct tokens of each task and how many it has."""
    df = tasks.select(F.col(task_id).alias("task_id"), F.array_distinct(tokens(F.col(text))).alias("tokens"))
    return df.select("task_id", F.size("tokens").alias("task_size"), F.explode("tokens").alias("token"))


DEALT = 4096  # files that a task scores


def file_tokens(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(path, token): distinct tokens of each file's content, dealt out by path to so many tasks that none has many files."""
    df = files.select(F.col(path).alias("path"), F.array_distinct(tokens(F.col(content))).alias("tokens"))
    parts = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-files.count() // DEALT))
    return df.repartition(parts, "path").select("path", F.explode("tokens").alias("token"))


def name_tokens(symbols: DataFrame, path: str = "file", name: str = "name") -> DataFrame:
    """(path, token): distinct tokens of the names of each file's symbols."""
    return symbols.select(F.col(path).alias("path"), F.explode(symbol_tokens(F.col(name))).alias("token")).distinct()


def overlap(tasks: DataFrame, index: DataFrame) -> DataFrame:
    """(task_id, path, overlap): the share of a task's tokens that a file has.

    tasks: (task_id, token, task_size); index: (path, token). Without tokens in common there is no row.
    """
    shared = index.join(tasks, "token").groupBy("task_id", "path").agg(F.count("*").alias("shared"), F.first("task_size").alias("task_size"))
    return shared.select("task_id", "path", (F.col("shared") / F.col("task_size")).alias("overlap"))


def dependency_overlap(tasks: DataFrame, dependencies: DataFrame, files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """(task_id, path, overlap): for dependencies that a task names and a file's content has, shares of tokens, at most 1.

    A name that no task has as a token is dropped first, so few names are looked for in contents.
    """
    sizes = tasks.groupBy("task_id").agg(F.first("task_size").alias("task_size"))
    names = dependencies.select(F.lower("name").alias("name"), tokens(F.col("name")).alias("own")).distinct()
    named = names.join(tasks.select("task_id", F.col("token").alias("name")), "name").select("task_id", "name", F.explode("own").alias("token"))
    worth = named.join(tasks.select("task_id", "token"), ["task_id", "token"]).groupBy("task_id", "name").agg(F.count("*").alias("matching"))
    wanted = worth.select("name").distinct()
    held = files.select(F.col(path).alias("path"), F.lower(F.col(content)).alias("content")).join(wanted, F.col("content").contains(F.col("name"))).select("path", "name")
    found = held.join(worth, "name").join(sizes, "task_id").groupBy("task_id", "path").agg(F.sum(F.col("matching") / F.col("task_size")).alias("overlap"))
    return found.select("task_id", "path", F.least(F.col("overlap"), F.lit(1.0)).alias("overlap"))


def score_files(
    tasks: DataFrame, files: DataFrame, symbols: DataFrame | None = None, recency: DataFrame | None = None, dependencies: DataFrame | None = None, task_id: str = "task_id", task: str = "task"
) -> DataFrame:
    """(task_id, path, score) of every file that a task touches, by token, symbol name, dependency or recency.

    files: (path, content); symbols: (file, name); recency: (path, recency); dependencies: (name). Other pairs score 0; a
    task without tokens scores 0 everywhere.
    """
    wanted = task_tokens(tasks, task_id, task)
    parts = overlap(wanted, file_tokens(files)).select("task_id", "path", F.col("overlap").alias("value"), F.lit("keywords").alias("part"))
    if symbols is not None:
        parts = parts.unionByName(overlap(wanted, name_tokens(symbols)).select("task_id", "path", F.col("overlap").alias("value"), F.lit("symbols").alias("part")))
    if dependencies is not None:
        parts = parts.unionByName(dependency_overlap(wanted, dependencies, files).select("task_id", "path", F.col("overlap").alias("value"), F.lit("dependencies").alias("part")))
    if recency is not None:
        recent = recency.where("recency > 0").join(files.select("path"), "path", "left_semi")
        # few files are recent (the log is cut), and each meets every task
        parts = parts.unionByName(recent.crossJoin(wanted.select("task_id").distinct()).select("task_id", "path", F.col("recency").alias("value"), F.lit("recency").alias("part")))
    weights = F.create_map(*(F.lit(x) for pair in RELEVANCE.items() for x in pair))
    # the parts are added in one order, so that equal inputs give equal doubles
    sums = parts.groupBy("task_id", "path").agg(*(F.max(F.when(F.col("part") == p, weights[p] * F.col("value"))).alias(p) for p in RELEVANCE))
    total = sum((F.coalesce(F.col(p), F.lit(0.0)) for p in list(RELEVANCE)[1:]), F.coalesce(F.col("keywords"), F.lit(0.0)))
    return sums.select("task_id", "path", round4(total).alias("score"))


def rank(scored: DataFrame, group: list[str] | None = None, top: int | None = None) -> DataFrame:
    """scored with rank: higher scores first, then by path; per group, and only the first `top` if given."""
    w = Window.partitionBy(*(group or ["task_id"])).orderBy(F.desc("score"), "path")
    ranked = scored.withColumn("rank", F.row_number().over(w))
    return ranked.where(F.col("rank") <= top) if top else ranked


def hybrid_score(score: Column, vector: Column, weight: float = VECTOR_WEIGHT) -> Column:
    """Blend of both; without a vector score the first alone."""
    w = min(1.0, max(0.0, weight))
    return F.when(vector.isNull(), score).otherwise(round4((1 - w) * score + w * vector))


def boost(score: Column, mentions: Column, confidence: Column) -> Column:
    """A score raised by mentions in a conversation, 1 at most; not rounded again."""
    return F.when(mentions == 0, score).otherwise(F.least(F.lit(1.0), score * (1 + 0.15 * F.log1p(mentions) * confidence)))


def change_score(churn: Column, most_churn: Column, added: Column, removed: Column, resigned: Column, affected: Column, most_affected: Column, deleted: Column) -> Column:
    """Relevance of a changed file from its lines, symbols, reach and kind."""
    share = lambda x, most: F.when(most > 0, x / most).otherwise(0.0)
    symbols = F.least(F.lit(1.0), 0.2 * added + 0.3 * removed + 0.5 * resigned)
    kind = F.when(deleted, 0.5).otherwise(1.0)
    total = CHANGE["churn"] * share(churn, most_churn) + CHANGE["symbols"] * symbols
    return round4(total + CHANGE["affected"] * share(affected, most_affected) + CHANGE["kind"] * kind)
