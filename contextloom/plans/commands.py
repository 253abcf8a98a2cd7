"""The engine's six commands as plans over DataFrames: build, summarize, diff, prune, inspect and index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.functions.text import byte_tokens, lines
from contextloom.operators import budget as B
from contextloom.operators import bundle as U
from contextloom.operators import conversation as C
from contextloom.operators import diff as D
from contextloom.operators import focus as O
from contextloom.operators import inspect as I
from contextloom.operators import render as R
from contextloom.operators import scoring as S
from contextloom.operators import vector as V


def signature_costs(symbols: DataFrame) -> DataFrame:
    """(path, signatures, signature_cost) of each file's symbols; each line is rounded down by itself."""
    line = F.concat("signature", F.lit(" (lines "), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
    listed = symbols.select(F.col("file").alias("path"), "start_line", line.alias("line"), byte_tokens(line).alias("cost"))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("start_line", "line"))), lambda x: x["line"])
    return listed.groupBy("path").agg(texts.alias("signatures"), F.sum("cost").alias("signature_cost"))


def build(
    tasks: DataFrame,
    files: DataFrame,
    symbols: DataFrame,
    dependencies: DataFrame | None = None,
    recency: DataFrame | None = None,
    vectors: DataFrame | None = None,
    markers: DataFrame | None = None,
    items: DataFrame | None = None,
    total: int = 8000,
    strict: bool = False,
    buffer: float = 0.10,
    weight: float = 0.30,
) -> DataFrame:
    """(task_id, rank, path, score, mode, tokens_used, content, signatures, summary, ranges) of the context of many tasks.

    tasks: (task_id, task); files: (path, content, and written, an analyzer's summary, if there is one); vectors: (task_id,
    path, combined). The blend with vectors comes before the boost by mentions, and both before the budget.
    """
    scored = S.score_files(tasks, files, symbols, recency, dependencies)
    if vectors is not None:
        # a file that only its vector finds is blended with a score of 0
        found = vectors.select("task_id", "path", "combined").join(files.select("path"), "path", "left_semi")
        blend = S.hybrid_score(F.coalesce("score", F.lit(0.0)), F.col("combined"), weight)
        scored = scored.join(found, ["task_id", "path"], "full_outer").withColumn("score", blend).drop("combined")
    if markers is not None and items is not None:
        strength = C.mention_strength(C.mentions(files, markers), items)
        scored = scored.join(strength, "path", "left").withColumn("score", S.boost(F.col("score"), F.coalesce("mentions", F.lit(0)), F.coalesce("confidence", F.lit(0.0)))).drop("mentions", "confidence")
    shares = tasks.select("task_id", B.share_budget(F.lit(total), F.col("task"), strict, buffer).alias("share"))
    sized = files.withColumn("n_lines", F.size(lines(F.col("content"))))
    wanted = S.task_tokens(tasks, "task_id", "task")
    ranges = O.relevant_ranges(sized, symbols, wanted, scored.select("task_id", "path")).groupBy("task_id", "path").agg(F.array_sort(F.collect_list(F.struct("start", "end"))).alias("ranges"))
    costs = sized.select("path", byte_tokens(F.col("content")).alias("full"), B.raw_summary(F.col("content"), F.col("written") if "written" in files.columns else None).alias("summary"))
    focused = ranges.join(files.select("path", "content"), "path").select("task_id", "path", "ranges", byte_tokens(O.render_ranges(F.col("content"), F.col("ranges"))).alias("focused"))
    listed = signature_costs(symbols)
    df = scored.join(costs, "path").join(focused, ["task_id", "path"], "left").join(listed, "path", "left").join(shares.select("task_id", F.col("share.code").alias("code")), "task_id")
    chosen = B.allocate(df.withColumn("signatures", F.col("signature_cost")), "task_id", "code")
    out = chosen.join(df.select("task_id", "path", "score", "ranges", "signatures"), ["task_id", "path"]).join(files.select("path", "content"), "path")
    mode = F.col("mode")
    out = out.select(
        "task_id",
        "path",
        "score",
        "mode",
        "tokens_used",
        F.when(mode == "full", F.col("content")).when(mode == "focused", O.render_ranges(F.col("content"), F.col("ranges"))).alias("content"),
        F.when(mode == "signature_only", F.col("signatures")).alias("signatures"),
        F.when(mode == "summary_only", F.col("summary")).alias("summary"),
        F.when(mode == "focused", F.col("ranges")).alias("ranges"),
    )
    return S.rank(U.output_files(out))


def summarize(transcripts: DataFrame, keys: list[str], triggers: C.Triggers | None = None, since: int | None = None, skip_comments: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(items, markers, turn counts) of whole transcripts (keys, content)."""
    turns = C.parse_turns(transcripts, "content", keys)
    items = C.resolve(C.extract_items(turns, keys, triggers, skip_comments), keys)
    markers = C.extract_markers(turns, keys, (triggers or C.Triggers()).extensions)
    counts = turns.groupBy(*keys).agg((F.max("turn_index") + 1).alias("turn_count"))
    return (C.since(items, since) if since is not None else items), markers, counts


def diff(before: DataFrame, after: DataFrame, symbols_before: DataFrame, symbols_after: DataFrame, effective: int | None = None) -> dict[str, DataFrame]:
    """files, symbols, references and stats of two trees (path, content); with a budget only the changes that fit."""
    kinds = D.diff_files(before, after)
    sides = kinds.join(before.select(F.col("path").alias("_old"), F.col("content").alias("old")), F.coalesce("from", "path") == F.col("_old"), "left").drop("_old")
    sides = sides.join(after.select("path", F.col("content").alias("new")), "path", "left")
    changed = kinds.join(D.line_changes(sides), "path").join(sides.select("path", F.when(F.col("type") == "deleted", 0).otherwise(byte_tokens(F.col("new"))).cast("long").alias("tokens")), "path")
    changed = changed.withColumn("churn", F.col("added_lines") + F.col("removed_lines"))
    modified = kinds.where("type = 'modified'").select(F.col("path").alias("file"))
    symbols = D.diff_symbols(symbols_before.join(modified, "file", "left_semi"), symbols_after.join(modified, "file", "left_semi"))
    reach = D.impact(symbols, after)
    if effective is not None:
        affected = reach.groupBy("path").agg(F.count("*").alias("affected"))
        scored = D.score_changes(changed, D.symbol_counts(symbols), affected).withColumn("all", F.lit(1))
        changed = B.keep_prefix(scored, ["all"], "tokens", F.lit(effective)).drop("all")
        symbols = symbols.join(changed.select(F.col("path").alias("file")), "file", "left_semi")
    return {"files": changed, "symbols": symbols, "references": D.references(reach), "stats": D.diff_stats(changed, symbols)}


def prune(files: DataFrame, total: int, keep: list[str], task: str = "", strict: bool = False, buffer: float = 0.10) -> DataFrame:
    """(path, score, mode, tokens_used, signatures, summary, and content if given) of a bundle's files under another budget.

    task is the bundle's own and takes its part of the budget. Kept paths stay as they are and are paid first. A file that is
    stored in full or in part takes its stored cost as its full form; nothing is focused anew.
    """
    spark = files.sparkSession
    share = spark.range(1).select(B.share_budget(F.lit(total), F.lit(task), strict, buffer)["code"].alias("code"))
    named = spark.createDataFrame([(p,) for p in sorted(set(keep))], "path string")
    held, rest = files.join(named, "path", "left_semi"), files.join(named, "path", "left_anti")
    paid = held.agg(F.coalesce(F.sum("tokens_used"), F.lit(0)).alias("paid"))
    lines_of = F.coalesce("signatures", F.array().cast("array<string>"))
    listed = F.aggregate(lines_of, F.lit(0).cast("long"), lambda a, s: a + byte_tokens(s))
    costs = rest.crossJoin(F.broadcast(share.crossJoin(paid))).select(  # one row
        F.lit(0).alias("all"),
        F.greatest(F.col("code") - F.col("paid"), F.lit(0)).alias("budget"),
        "path",
        "score",
        F.when(F.col("mode").isin("full", "focused"), F.col("tokens_used")).alias("full"),
        F.lit(None).cast("long").alias("focused"),
        F.when(F.size(lines_of) > 0, listed).alias("signatures"),
        "summary",
    )
    chosen = B.allocate(costs, "all", "budget").select("path", F.col("mode").alias("_mode"), F.col("tokens_used").alias("_used"), F.col("summary").alias("_cut"))
    pruned = rest.join(chosen, "path")
    content = [F.when(F.col("_mode") == "full", F.col("content")).alias("content")] if "content" in files.columns else []
    pruned = pruned.select(
        "path",
        "score",
        F.col("_mode").alias("mode"),
        F.col("_used").alias("tokens_used"),
        F.when(F.col("_mode") == "signature_only", F.col("signatures")).alias("signatures"),
        F.when(F.col("_mode") == "summary_only", F.col("_cut")).alias("summary"),
        *content,
    )
    return held.select(*pruned.columns).unionByName(pruned)


def inspect(documents: DataFrame, column: str = "json") -> DataFrame:
    """documents with the type of bundle that each holds."""
    return documents.withColumn("bundle_type", I.bundle_type(F.col(column)))


def render_files(built: DataFrame) -> DataFrame:
    return R.file_section(built, ["task_id"])


def index(spark: SparkSession, files: DataFrame, store: str, model, config: V.VectorConfig | None = None, full: bool = False) -> DataFrame:
    """Bring the chunk index at `store` (a shared folder) up to date; returns the status of each path.

    Only changed files are chunked and embedded. Each run writes new tables beside the old and then points to them, so a
    run that fails leaves the index as it was.
    """
    config = config or V.VectorConfig()
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(f"{store}/current")
    fs = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    version = int(spark.read.text(f"{store}/current").first()[0]) if fs.exists(path) and not full else 0
    now = files.select("path", "content", F.sha2("content", 256).alias("content_hash"), F.lit(0).alias("mtime"))
    state = spark.read.parquet(f"{store}/{version}/state") if version else now.limit(0).select("path", "content_hash", "mtime")
    status = V.detect_changes(now, state)
    changed = files.join(status.where("status = 'changed'"), "path", "left_semi")
    fresh = V.embed(V.chunk_files(changed, config.chunk_tokens, config.chunk_overlap), "text", model, config.batch)
    stored = spark.read.parquet(f"{store}/{version}/chunks") if version else fresh.limit(0)
    V.refresh(stored, fresh, status).write.mode("overwrite").parquet(f"{store}/{version + 1}/chunks")
    now.drop("content").write.mode("overwrite").parquet(f"{store}/{version + 1}/state")
    status.write.mode("overwrite").parquet(f"{store}/{version + 1}/status")
    spark.createDataFrame([(str(version + 1),)], "value string").coalesce(1).write.mode("overwrite").text(f"{store}/current")
    return spark.read.parquet(f"{store}/{version + 1}/status")
