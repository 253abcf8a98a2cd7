import os

import duckdb
import pytest

import corpus_pipeline

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
def test_pipeline_equals_its_sql(spark):
    db = duckdb.connect()
    for name in ("documents", "benchmark"):
        db.sql(f"create view {name} as select * from '{SF}/{name}.parquet'")
    want = db.sql(corpus_pipeline.ORACLE_SQL)
    columns = want.columns
    got = [tuple(r[c] for c in columns) for r in corpus_pipeline.run(spark, SF).collect()]
    near = lambda row: tuple(round(x, 6) if isinstance(x, float) else x for x in row)
    assert sorted(map(near, got)) == sorted(map(near, want.fetchall()))
    assert got


DOCS = "doc_id long, text string, lang string, source string, n_chars long, extra string, kept string, _row int"


def rows():
    """Nulls, blanks, repeated rows, ties, one id with two texts, a long text, and columns with names that operators use."""
    import random

    r = random.Random(3)
    said = lambda n: " ".join(f"{r.choice(['the', 'of', 'and', 'to', 'in', 'is', 'that'])} w{r.randrange(5000)}" for _ in range(n))
    a, b = said(60), said(90)
    texts = [(1, a), (1, a), (2, a), (3, b), (3, said(70)), (4, None), (5, ""), (6, " \n\t"), (None, said(60)), (7, said(9000)), (8, "#$% " * 90)]
    return [(i, t, ["en", None][k % 2], ["s", None][k % 3 == 0], 0 if t is None else len(t), "e", "k", k) for k, (i, t) in enumerate(texts)]


def test_stages_over_odd_rows(spark):
    docs = spark.createDataFrame(rows(), DOCS)
    want = docs.dtypes
    for name, stage in corpus_pipeline.STAGES:
        if not os.path.isdir(SF) and name == "decontamination":
            continue
        for given in (docs, docs.limit(0)):
            out = stage(spark, given, SF)
            got = out.collect()
            if name != "mixing":
                assert out.dtypes == want, name
                assert {r["_row"] for r in got} <= {r[-1] for r in rows()}
            assert given is docs or not got
            if given is docs:
                kept = {r["_row"] for r in got} if name != "mixing" else None
                if name == "quality_rules":
                    assert kept == {0, 1, 2, 3, 4, 8, 9}
                if name == "ngram_jaccard":  # rows of id 1 stay together, those without an id or a text stay
                    assert kept == {0, 1, 3, 4, 5, 6, 7, 8, 9, 10}
                if name == "substring_dedup":
                    assert 2 not in kept and {0, 1, 5, 6, 7, 8, 9} <= kept


def test_near_duplicates_make_few_tables(spark, monkeypatch):
    """A group of near copies: the stage keeps one, without dozens of tables that fill the driver's memory with queries."""
    import random

    from contextloom.llm import components, jaccard
    from contextloom.llm.shared import materialize

    r, made = random.Random(7), []
    base = [f"w{r.randrange(5000)}" for _ in range(150)]
    near = lambda k: " ".join(f"own{k}" if i == 2 * k else w for i, w in enumerate(base))
    docs = materialize(spark.createDataFrame([(k, near(k), None, None, 0, None, None, k) for k in range(60)], DOCS), "test")
    for module in (components, jaccard):
        monkeypatch.setattr(module, "materialize", lambda df, name: made.append(name) or materialize(df, name))
    assert [x["doc_id"] for x in corpus_pipeline.near_duplicates(spark, docs, SF).collect()] == [0]
    assert len(made) <= 38, made  # 43 with rounds of queries for every few links


def test_run_over_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages_send_small_batches(spark, tmp_path, monkeypatch):
    """Texts wait outside the JVM's heap while they go to Python; run puts the session's setting back."""
    from contextloom.llm.shared import materialize

    key, seen = "spark.sql.execution.arrow.maxRecordsPerBatch", []
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    before = spark.conf.get(key)
    monkeypatch.setattr(corpus_pipeline, "materialize", lambda df, name: seen.append(int(spark.conf.get(key))) or materialize(df, name))
    corpus_pipeline.run(spark, str(tmp_path))
    assert seen == [1000] * 5 and spark.conf.get(key) == before
    try:  # the results of a stage by itself are read later
        corpus_pipeline.substrings(spark, spark.createDataFrame([], DOCS), str(tmp_path))
        assert int(spark.conf.get(key)) == 1000
    finally:
        spark.conf.set(key, before)
