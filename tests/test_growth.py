"""Cases that only larger tables show."""

import duckdb

from contextloom import queries as Q
from contextloom.operators import conversation as C
from contextloom.operators import diff as D
from contextloom.operators import vector as V


def test_resolve_sends_no_exploded_words_to_the_driver(spark):
    rows = [(1, "open_question", 0, "a", "which cache size is right?"), (1, "decision", 2, "b", "cache size stays"), (1, "decision", 1, "c", "other things")]
    items = spark.createDataFrame(rows, "conv_id long, classification string, turn_index long, fingerprint string, text string")
    out = C.resolve(items, least=0.1)
    assert [r.resolved_by for r in out.where("classification = 'open_question'").collect()] == [2]
    plan = out._jdf.queryExecution().sparkPlan().toString()
    on_words = [line for line in plan.splitlines() if "Join [" in line and "word#" in line]
    assert on_words and all("SortMergeJoin" in line for line in on_words)


def test_resolve_counts_each_word_set_once(spark):
    said = "keep the cache small"
    rows = [(1, "open_question", 0, "a", said + " or big enough today?")] * 2 + [(1, "decision", 3, m, "cache sizes vary widely among hosts, zones, racks") for m in ("b", "b", "c")]
    items = spark.createDataFrame(rows, "conv_id long, classification string, turn_index long, fingerprint string, text string")
    got = {r.resolved_by for r in C.resolve(items, least=0.1).where("classification = 'open_question'").collect()}
    assert got == {None}


def test_pruned_changes_rounds_halves_to_even(spark, tmp_path):
    # 996.5 is 996 in SQL, the highest score; rounded up it is 997, the lowest
    rows = [(50, 30000, 996.5), (100, 30000, 994.0), (150, 30000, 0.5)]
    spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double").write.parquet(str(tmp_path / "orders.parquet"))
    db = duckdb.connect()
    db.sql(f"create view orders as select * from '{tmp_path}/orders.parquet/*.parquet'")
    want = db.sql(Q.SQL["pruned_changes"]).fetchall()
    assert want == [(0, "50")]
    assert [tuple(r) for r in Q.QUERIES["pruned_changes"](spark, str(tmp_path)).collect()] == want


def test_nearest_of_each_compares_cells_without_a_nested_loop(spark):
    import numpy as np

    from contextloom.shipping import ship

    ship(spark)
    made = np.random.default_rng(3).normal(size=(60, 5)).astype("f4")
    rows = [(i, [float(x) for x in made[i % 60]]) for i in range(400)] + [(400, None)]
    items = spark.createDataFrame(rows, "id long, vector array<float>")
    asked = items.where("id % 20 = 0 and id < 400").withColumnRenamed("id", "query")
    out = V.nearest_of_each(items, asked, 9, block=7, group=90)
    assert "NestedLoop" not in out._jdf.queryExecution().sparkPlan().toString()
    got = sorted((r["query"], r["rank"], r["id"], round(r["distance"], 6)) for r in out.collect())
    want = []
    for q in range(0, 400, 20):
        d = made[[i % 60 for i in range(400)]] - made[q % 60]
        far = np.sqrt((d.astype("f8") ** 2).sum(1))
        want += [(q, n + 1, int(i), round(float(far[i]), 6)) for n, i in enumerate(sorted(range(400), key=lambda i: (far[i], i))[:9])]
    assert got == want


def test_diff_files_finds_the_same_renames_with_common_lines(spark):
    import random

    r = random.Random(5)
    text = lambda i: "\n".join(r.sample("LMNO", r.randint(0, 3)) + r.sample([f"x{k}" for k in range(40)], r.randint(0, 3)))
    before = [(f"b{i:03}", text(i)) for i in range(150)]
    after = [(f"a{i:03}", text(i)) for i in range(150)]
    # the first of equal contents pair off; then each must be the other's most similar
    gone, come, exact = dict(before), dict(after), []
    for f, t in sorted(before):
        p = next((p for p in sorted(come) if come[p] == t), None)
        if p:
            exact.append((f, p))
            del gone[f], come[p]
    sets = lambda t: set(t.split("\n"))
    near = {(f, p): len(sets(t) & sets(u)) / max(len(sets(t)), len(sets(u))) for f, t in gone.items() for p, u in come.items()}
    near = {k: s for k, s in near.items() if s >= 0.5}
    one = {f: min((-s, p) for (g, p), s in near.items() if g == f)[1] for f, _ in near}
    two = {p: min((-s, f) for (f, q), s in near.items() if q == p)[1] for _, p in near}
    want = sorted(exact + [(f, p) for f, p in one.items() if two[p] == f])
    make = lambda rows: spark.createDataFrame(rows, "path string, content string")
    for common in (1, 3, 100):
        out = D.diff_files(make(before), make(after), common=common)
        assert sorted((x["from"], x["path"]) for x in out.where("type = 'renamed'").collect()) == want


def test_chunk_files_sends_no_text_to_python(spark):
    from contextloom.functions.text import split_lines
    from contextloom.shipping import ship

    ship(spark)
    texts = [None, "", "\n", "a", "a\n", "a\r\nb\n\nc", "é" * 30 + "\n" + "x\n" * 40, "\r\n\r\n", "one two\n" * 9 + "end"]
    out = V.chunk_files(spark.createDataFrame(list(enumerate(texts)), "path long, content string"), 8, 2)
    assert "InPandas" not in out._jdf.queryExecution().sparkPlan().toString()
    got = sorted((r.path, r.chunk_index, r.text, r.start_line, r.end_line) for r in out.collect())
    want = [(str(i), k, "\n".join(split_lines(t)[a:b]), a + 1, b) for i, t in enumerate(texts) for k, (a, b) in enumerate(V.pack_lines(t or "", 32, 8))]
    assert [(str(p), *rest) for p, *rest in got] == want


def test_scores_shuffle_files_not_pairs(spark, tmp_path):
    from contextloom.operators import scoring as S

    rows = [("p1", "alpha beta gamma"), ("p2", "beta delta"), ("p2", "beta"), (None, "alpha"), (None, "gamma alpha")]
    files = spark.createDataFrame(rows, "path string, content string")
    tasks = spark.createDataFrame([(1, "alpha beta"), (2, "delta delta epsilon")], "task_id long, task string")
    tasks.write.parquet(str(tmp_path / "tasks"))
    tasks = spark.read.parquet(str(tmp_path / "tasks"))
    out = S.score_files(tasks, files)
    plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
    assert plan.count("Exchange hashpartitioning") == 1 and "Exchange hashpartitioning(path" in plan, plan
    got = sorted(((r.task_id, r.path, r.score) for r in out.collect()), key=repr)
    assert got == sorted([(1, "p1", 0.4), (1, "p2", 0.4), (1, None, 0.4), (2, "p2", 0.2)], key=repr)


def test_allocate_folds_like_one_row_after_another(spark):
    import random

    from contextloom.operators import budget as B
    from contextloom.shipping import ship

    ship(spark)
    r = random.Random(2)
    cost = lambda: r.choice([None, 0, *range(1, 60)])
    rows = [(g, 100, f"p{i:03}", r.random(), cost(), cost(), cost(), r.choice([None, "", "words of a summary"])) for g in (None, 1, 2) for i in range(60)]
    want, left = [], {}
    for g, b, p, _, full, focused, signatures, summary in sorted(rows, key=lambda x: -x[3]):
        have = left.setdefault(g, b)
        mode, used = "skipped", 0
        if full is not None and full <= have:
            mode, used = "full", full
        elif focused and focused <= have and full is not None and focused < full * 0.8:
            mode, used = "focused", focused
        elif signatures and signatures <= have:
            mode, used = "signature_only", signatures
        elif (text := B.shorten(summary, have)) is not None:
            mode, used = "summary_only", len(text.encode()) // 4
        left[g] = have - used
        want.append((g, p, mode, used))
    df = spark.createDataFrame(rows, "g long, b long, path string, score double, full long, focused long, signatures long, summary string")
    got = [(x.g, x.path, x["mode"], x.tokens_used) for x in B.allocate(df, "g", "b").collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
