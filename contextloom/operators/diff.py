"""Two snapshots of a tree of files: changed files, changed symbols, and how far changes reach."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from contextloom.functions.text import WORD_CHARS, content_hash, fingerprint, normalize, split_lines
from contextloom.operators.scoring import change_score


def diff_files(before: DataFrame, after: DataFrame, similar: float = 0.5, common: int = 100) -> DataFrame:
    """(path, type, from) of files (path, content): added, modified, deleted, or renamed with the path they had.

    A deleted and an added file of equal content are one renamed file; of the others, pairs that share most of their lines
    are, if each is the other's most similar. Texts stay in their scan: hashes of them and of their lines travel.
    """
    line_set = lambda c: F.array_sort(F.array_distinct(F.transform(F.split(c, "\n"), lambda x: F.md5(x))))
    side = lambda df, name: df.select("path", content_hash(F.col("content")).alias(f"{name}_hash"), line_set(F.col("content")).alias(name))
    both = side(before, "old").join(side(after, "new"), "path", "full_outer")
    kind = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    # what is read several times is kept on the executors' disks, so that plans stay short
    changed = both.withColumn("type", kind).where("type is not null").localCheckpoint(True, StorageLevel.DISK_ONLY)
    gone = changed.where("type = 'deleted'").select(F.col("path").alias("from"), F.col("old").alias("lines"), F.col("old_hash").alias("hash"))
    come = changed.where("type = 'added'").select("path", F.col("new").alias("lines"), F.col("new_hash").alias("hash"))
    number = lambda df, key: df.select(key, "hash").withColumn("n", F.row_number().over(Window.partitionBy("hash").orderBy(key)))
    exact = number(gone, "from").join(number(come, "path"), ["hash", "n"]).select("from", "path")
    close = closest(gone.join(exact, "from", "left_anti"), come.join(exact, "path", "left_anti"), similar, common)
    moved = exact.unionByName(close).localCheckpoint(True, StorageLevel.DISK_ONLY)
    kept = changed.select("path", "type").join(moved.select(F.col("from").alias("path")), "path", "left_anti")
    out = kept.join(moved.select("path", "from"), "path", "left")
    return out.select("path", F.when(F.col("from").isNotNull(), "renamed").otherwise(F.col("type")).alias("type"), "from")


def closest(gone: DataFrame, come: DataFrame, similar: float, common: int) -> DataFrame:
    """(from, path): pairs of gone (from, lines) and come (path, lines), each the other's most similar, by path among equals.

    Of files with equal lines only the first by path can be in a pair. Pairs meet by lines of at most common * common pairs.
    Files that share only lines of more pairs are as similar as their parts of common lines and their sizes say, so of
    those with equal parts and sizes again the first counts: such lines make no product of files, and no pair is lost.
    """
    every = gone.select(F.lit(0).alias("side"), F.col("from").alias("name"), "lines").unionByName(come.select(F.lit(1).alias("side"), F.col("path").alias("name"), "lines"))
    same = every.groupBy("side", F.md5(F.array_join("lines", "")).alias("set")).agg(F.min("name").alias("name"), F.first("lines").alias("lines"))
    same = same.select("side", "name", F.size("lines").alias("n"), "lines").localCheckpoint(True, StorageLevel.DISK_ONLY)
    spread = same.select("side", "name", "n", F.explode("lines").alias("line"))
    uses = spread.groupBy("line").agg(F.count_if(F.col("side") == 0).alias("g"), F.count_if(F.col("side") == 1).alias("c")).where("g > 0 and c > 0")
    marked = spread.join(uses.select("line", (F.col("g") * F.col("c") > common * common).alias("often")), "line").localCheckpoint(True, StorageLevel.DISK_ONLY)
    of = lambda df, side, key, n: df.where(F.col("side") == side).withColumnsRenamed({"name": key, "n": n}).drop("side")
    fits = (F.col("n1") >= similar * F.col("n2")) & (F.col("n2") >= similar * F.col("n1"))
    ratio = F.col("shared") / F.greatest("n1", "n2")

    part = marked.where("often").groupBy("side", "name", "n").agg(F.sort_array(F.collect_list("line")).alias("often")).localCheckpoint(True, StorageLevel.DISK_ONLY)
    seldom = marked.where("not often").select("side", "name", "n", "line")
    met = of(seldom, 0, "from", "n1").join(of(seldom, 1, "path", "n2").hint("merge"), "line").where(fits).groupBy("from", "path").agg(F.count("*").alias("few"), F.first("n1").alias("n1"), F.first("n2").alias("n2"))
    own = lambda side, key, name: of(part.drop("n").withColumnRenamed("often", name), side, key, "n")
    met = met.join(own(0, "from", "often1"), "from", "left").join(own(1, "path", "often2"), "path", "left")
    met = met.withColumn("shared", F.col("few") + F.coalesce(F.size(F.array_intersect("often1", "often2")), F.lit(0)))
    met = met.select("from", "path", ratio.alias("similarity")).where(F.col("similarity") >= similar).localCheckpoint(True, StorageLevel.DISK_ONLY)

    part = part.where(F.size("often") >= similar * F.col("n")).withColumn("kind", F.md5(F.concat_ws(":", F.col("n"), F.array_join("often", ""))))
    kinds = part.groupBy("side", "kind", "n").agg(F.min("name").alias("name"), F.first("often").alias("often")).select("side", "kind", "n", "name", F.explode("often").alias("line"))
    a, b = of(kinds, 0, "from", "n1").withColumnRenamed("kind", "k1"), of(kinds, 1, "path", "n2").withColumnRenamed("kind", "k2")
    alike = a.join(b.hint("merge"), "line").where(fits).groupBy("k1", "k2").agg(F.count("*").alias("shared"), *(F.first(c).alias(c) for c in ("n1", "n2", "from", "path")))
    alike = alike.withColumn("similarity", ratio).where(F.col("similarity") >= similar).localCheckpoint(True, StorageLevel.DISK_ONLY)
    first = lambda other: F.min(F.struct((-F.col("similarity")).alias("s"), F.col(other).alias("other"))).alias("best")
    by_kind = alike.groupBy(F.lit(0).alias("side"), F.col("k1").alias("kind")).agg(first("path")).unionByName(alike.groupBy(F.lit(1).alias("side"), F.col("k2").alias("kind")).agg(first("from")))
    said = part.join(by_kind, ["side", "kind"]).select("side", "name", "best")
    said = said.unionByName(met.groupBy(F.lit(0).alias("side"), F.col("from").alias("name")).agg(first("path")))
    said = said.unionByName(met.groupBy(F.lit(1).alias("side"), F.col("path").alias("name")).agg(first("from")))
    best = said.groupBy("side", "name").agg(F.min("best").alias("best")).select("side", "name", F.col("best.other").alias("other")).localCheckpoint(True, StorageLevel.DISK_ONLY)
    left, right = best.where("side = 0").select(F.col("name").alias("from"), F.col("other").alias("path")), best.where("side = 1").select(F.col("other").alias("from"), F.col("name").alias("path"))
    return left.join(right, ["from", "path"])


HUNKS = "path string, added_lines long, removed_lines long, hunks array<struct<old_start: int, old_count: int, new_start: int, new_count: int, fingerprint: string>>"


def line_changes(pairs: DataFrame) -> DataFrame:
    """Hunks (three lines of context) and line counts of pairs (path, old, new); a null side is an empty file."""
    import hashlib

    def one(path: str, old: str | None, new: str | None) -> tuple:
        a, b = split_lines(old), split_lines(new)
        added = removed = 0
        hunks = []
        for group in difflib.SequenceMatcher(None, a, b, autojunk=False).get_grouped_opcodes(3):
            said = []
            for tag, i1, i2, j1, j2 in group:
                if tag != "equal":
                    said += a[i1:i2] + b[j1:j2]
                    removed += i2 - i1
                    added += j2 - j1
            i1, i2, j1, j2 = group[0][1], group[-1][2], group[0][3], group[-1][4]
            mark = hashlib.sha256("".join(x + "\n" for x in said).encode()).hexdigest()[:16]
            hunks.append({"old_start": i1 + (i2 > i1), "old_count": i2 - i1, "new_start": j1 + (j2 > j1), "new_count": j2 - j1, "fingerprint": mark})
        return path, added, removed, hunks

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame([one(*r) for r in pdf[["path", "old", "new"]].itertuples(index=False)], columns=["path", "added_lines", "removed_lines", "hunks"])

    return pairs.select("path", "old", "new").mapInPandas(run, HUNKS)


def diff_symbols(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, name, kind, change, from, to, fingerprint): symbols (file, name, kind, signature, ordinal) that came, went or changed.

    Of several symbols of one name and kind in a file the last counts on either side.
    """
    key = ["file", "name", "kind"]
    last = lambda df, to: df.groupBy(*key).agg(F.max_by("signature", "ordinal").alias(to))
    both = last(before, "from").join(last(after, "to"), key, "full_outer")
    change = F.when(F.col("from").isNull(), "added").when(F.col("to").isNull(), "removed").when(F.col("from") != F.col("to"), "signature_changed")
    df = both.withColumn("change", change).where("change is not null")
    mark = fingerprint(normalize(F.col("file")), normalize(F.col("name")), F.col("change"))
    moved = F.col("change") == "signature_changed"
    return df.select(*key, "change", F.when(moved, F.col("from")).alias("from"), F.when(moved, F.col("to")).alias("to"), mark.alias("fingerprint"))


def impact(changes: DataFrame, files: DataFrame) -> DataFrame:
    """(symbol, path): files (path, content) that name a removed or changed symbol as a whole word, but for its own file.

    Names are single identifiers, so contents meet them by an equality of words.
    """
    names = changes.where("change in ('removed', 'signature_changed')").select(F.concat_ws("::", "kind", "name").alias("symbol"), F.col("name").alias("word"), F.col("file").alias("own")).distinct()
    words = files.select("path", F.explode(F.array_distinct(F.split("content", f"[^{WORD_CHARS}_]+"))).alias("word"))
    return words.join(names, "word").where(F.col("path") != F.col("own")).select("symbol", "path").distinct()


def references(found: DataFrame) -> DataFrame:
    """(symbol, files): sorted files that refer to each symbol."""
    return found.groupBy("symbol").agg(F.sort_array(F.collect_set("path")).alias("files"))


def symbol_counts(changes: DataFrame) -> DataFrame:
    count = lambda kind: F.count_if(F.col("change") == kind)
    return changes.groupBy("file").agg(count("added").alias("added"), count("removed").alias("removed"), count("signature_changed").alias("resigned"))


def score_changes(changed: DataFrame, counts: DataFrame, affected: DataFrame) -> DataFrame:
    """changed (path, type, churn) with a score; counts from symbol_counts, affected: (path, affected)."""
    df = changed.join(counts.withColumnRenamed("file", "path"), "path", "left").join(affected, "path", "left").na.fill(0, ["added", "removed", "resigned", "affected"])
    most = df.agg(F.max("churn").alias("most_churn"), F.max("affected").alias("most_affected"))
    df = df.join(F.broadcast(most))  # one row
    score = change_score(F.col("churn"), F.col("most_churn"), F.col("added"), F.col("removed"), F.col("resigned"), F.col("affected"), F.col("most_affected"), F.col("type") == "deleted")
    return df.withColumn("score", score).drop("most_churn", "most_affected")


def diff_stats(changed: DataFrame, symbols: DataFrame) -> DataFrame:
    """One row of counters over changed files (path, type, added_lines, removed_lines) and changed symbols."""
    count = lambda column, value, name: F.count_if(F.col(column) == value).alias(name)
    files = changed.agg(
        count("type", "added", "files_added"),
        count("type", "modified", "files_modified"),
        count("type", "deleted", "files_deleted"),
        count("type", "renamed", "files_renamed"),
        F.coalesce(F.sum("added_lines"), F.lit(0)).alias("lines_added"),
        F.coalesce(F.sum("removed_lines"), F.lit(0)).alias("lines_removed"),
    )
    marks = symbols.agg(count("change", "added", "symbols_added"), count("change", "removed", "symbols_removed"), count("change", "signature_changed", "symbols_changed"))
    return files.join(F.broadcast(marks))
