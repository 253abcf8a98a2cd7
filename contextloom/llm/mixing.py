"""Mixing sources to target weights by systematic sampling, in DataFrame functions only.

Every source has a weight; the mix shares a given multiple of all words by weight, but no source is repeated more
often than a limit, and what a source cannot take goes to the others by weight. Within a source each document is
expected target/size times; expected copies are summed in a fixed order, one random offset is added, and a document is
taken once for each integer that its part of the sum crosses. Documents are ordered by size, so the words taken come
near the target, too.

Prefix sums work in two levels, so no source, however large, is ordered in one task: documents are counted by source
and cell (a size class and some bits of a hash), the few cells are summed in order, and only the rows of one cell are
ordered together.

Defined results: a null or blank text has size 0 and takes 0 words; null is a source of its own, the last; repeated rows
are separate documents; further columns pass through, but a column with the name of a result is replaced; an empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom.llm.shared import flat, free_name, materialize, table

RESULTS = ["size", "source_size", "target", "copies", "taken"]
#: A size class (the bit length of the size) is dealt to so many cells by hash.
CELLS = 256
#: Offsets are odd multiples of 1/2048, so whole numbers of expected copies cross exactly as many integers.
OFFSETS = 1024


def text_size(text: Column) -> Column:
    """Number of words."""
    line = F.coalesce(flat(text), F.lit(""))
    spaces = F.octet_length(line) - F.octet_length(F.replace(line, F.lit(" "), F.lit("")))
    return F.when(line == "", 0).otherwise(spaces + 1).cast("long")


def source_targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """One row per source of (source, source_size): its target by water-filling.

    With the sources ordered by limit over weight, those that stop at their limits are a prefix; the first level of the
    rest that does not exceed the next source's ratio is the answer, so running sums replace the rounds of resharing.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.get(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights)).cast("int"))
    df = sizes.withColumn("weight", w).withColumn("limit", F.lit(most) * F.col("source_size"))
    df = df.withColumn("ratio", F.col("limit") / F.col("weight"))
    by_ratio = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    before, rest = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    every = Window.partitionBy()
    df = df.withColumn("total", F.lit(share) * F.sum("source_size").over(every))
    level = (F.col("total") - F.coalesce(F.sum("limit").over(before), F.lit(0.0))) / F.sum("weight").over(rest)
    df = df.withColumn("level", level).withColumn("at", F.row_number().over(by_ratio))
    df = df.withColumn("level", F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("at", "level"))).over(every)["level"])
    target = F.least(F.col("limit"), F.coalesce(F.col("level") * F.col("weight"), F.col("limit")))
    return df.select("source", "source_size", target.alias("target"))


def _place(key: Column) -> Column:
    """A pseudo-random 31-bit number that other SQL engines can compute too."""
    return F.conv(F.substring(F.md5(key.cast("string")), 1, 7), 16, 10).cast("long")


def mix_sources(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5,
    most: float = 2.0,
    seed: int = 0,
    carry: list[str] | None = None,
) -> DataFrame:
    """The columns in carry (all, if None) of every row of docs, with size, source_size, target, copies (times taken) and taken (words taken)."""
    rest = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_row")
    df = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias(inner),
        F.col(source).alias("source"),
        text_size(F.col(text)).alias("size"),
        F.col(doc_id).cast("string").alias("_id"),
    )
    place = _place(F.concat_ws("/", F.coalesce(F.col("_id"), F.lit("")), F.lit(str(seed))))
    df = df.withColumn("_place", place)
    # a hash takes the high bits of the place within a size class, so cells follow one another in the order of the rows
    df = df.withColumn("_class", F.char_length(F.bin("size"))).withColumn("_cell", (F.col("_place") * CELLS / (1 << 28)).cast("int"))
    df = materialize(df, "mix")
    cells = df.groupBy("source", "_class", "_cell").agg(F.count("*").alias("_n"), F.sum("size").alias("_size"))
    own = Window.partitionBy("source")
    cells = cells.withColumns(
        {
            "_before": F.coalesce(F.sum("_n").over(own.orderBy("_class", "_cell").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "source_size": F.sum("_size").over(own),
        }
    )
    cells = cells.select("source", "_class", "_cell", "_before", "source_size")
    sizes = df.groupBy("source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, list(weights), share, most).withColumn(
        "_offset", ((_place(F.concat_ws("/", F.lit("offset"), F.coalesce("source", F.lit("\0")), F.lit(str(seed)))) % OFFSETS) + 0.5) / OFFSETS
    )
    known = cells.drop("source_size").join(targets.withColumnRenamed("source", "_of"), F.col("source").eqNullSafe(F.col("_of"))).drop("_of")
    known = known.select(F.col("source").alias("_s"), F.col("_class").alias("_c"), F.col("_cell").alias("_k"), "_before", "source_size", "target", "_offset")
    in_cell = Window.partitionBy("source", "_class", "_cell").orderBy("_place", "_id", "size")
    df = df.withColumn("_rank", F.row_number().over(in_cell))
    df = df.join(known, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_cell") == F.col("_k")))
    expected = F.coalesce(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)), F.lit(0.0))
    upto = lambda k: F.floor(F.col("_offset") + k * expected)
    rank = F.col("_before") + F.col("_rank")
    df = df.withColumn("copies", (upto(rank) - upto(rank - 1)).cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return df.select(*(F.col(f"{inner}.`{c}`") for c in rest), *RESULTS)


def op4_mix(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mix_sources(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken", "copies")
