"""Quality rules, n-gram Jaccard join, substring dedup, decontamination and mixing, one after the other.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor kept; its result is written to Parquet in the
shared folder and read back. All but the last return the columns of documents.

Defined results: null and empty texts fail the quality rules; a document all of whose words are duplicates is dropped, and
one that loses some keeps the others joined by single spaces, with n_chars counted anew; other texts stay as they are.
Documents the mix takes no copy of are dropped from the last stage's rows.

Stages that send texts to Python let the session send few rows at a time. Their results are read later, so the setting stays
where a stage is called by itself; run puts it back.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm.decontam import find_items
from contextloom.llm.jaccard import keep_first
from contextloom.llm.mixing import mix_sources
from contextloom.llm.quality import quality_rules
from contextloom.llm.shared import free_name, materialize, small_batches, table, use_small_batches
from contextloom.llm.sql import OP1, OP3, OP4, OP6, OP7
from contextloom.llm.substrings import deduplicate_substrings


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    # verdicts are found from small columns and go back by id, label and a hash of the text, so no copy of the texts is kept
    key = free_name(docs.columns, "_text")
    own = ["doc_id", "lang", key]
    hashed = docs.withColumn(key, F.xxhash64("text"))
    bad = quality_rules(hashed, carry=own).where("not kept").select(*(F.col(c).alias(f"bad_{i}") for i, c in enumerate(own))).distinct()
    same = [F.col(c).eqNullSafe(F.col(f"bad_{i}")) for i, c in enumerate(own)]
    return hashed.join(bad, same[0] & same[1] & same[2], "left_anti").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_small_batches(spark)
    return keep_first(docs)


def substrings(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_small_batches(spark)
    cut = deduplicate_substrings(docs).where("n_removed < n_words or n_removed = 0")
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    new = {"text": text, "n_chars": F.when(F.col("n_removed") > 0, F.char_length("kept_text")).otherwise(F.col("n_chars")).cast("long")}
    return cut.withColumns({c: v for c, v in new.items() if c in docs.columns}).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    use_small_batches(spark)
    return find_items(docs, table(spark, sf_dir, "benchmark")).where("not contaminated").select(*docs.columns)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    mixed = mix_sources(docs, carry=["doc_id", "lang", "source"])
    return mixed.where("copies > 0").select("doc_id", "lang", "source", "size", "source_size", "target", "copies", "taken")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality),
    ("ngram_jaccard", near_duplicates),
    ("substring_dedup", substrings),
    ("decontamination", decontamination),
    ("mixing", mix),
]



def _over(query: str, name: str) -> str:
    return query.replace("documents", name)


def _oracle() -> str:
    kept = OP3.replace("sha256(array_to_string(", "(array_to_string(").replace("kept_sha256", "kept_text")
    return f"""with s1 as materialized (select d.* from documents d join ({OP1}) q using (doc_id) where q.kept),
s2 as materialized (select d.* from s1 d join ({_over(OP6, "s1")}) q using (doc_id) where q.component_id = doc_id),
s3 as materialized (select d.doc_id, case when q.n_removed > 0 then q.kept_text else d.text end as text, d.lang, d.source from s2 d join ({_over(kept, "s2")}) q using (doc_id) where q.n_removed < q.n_words or q.n_removed = 0),
s4 as materialized (select d.* from s3 d join ({_over(OP7, "s3")}) q using (doc_id) where not q.contaminated)
select d.doc_id, d.lang, d.source, q.size, q.source_size, q.target, q.copies, q.taken from s4 d join ({_over(OP4, "s4")}) q using (doc_id) where q.copies > 0"""


#: The same rows in DuckDB.
ORACLE_SQL: str | None = _oracle()


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    with small_batches(spark):
        for name, stage in STAGES:
            docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
