import pytest
from pyspark.sql import functions as F

from contextloom.operators import budget as B
from contextloom.operators import conversation as C
from contextloom.operators import diff as D
from contextloom.operators import focus as O
from contextloom.operators import inspect as I
from contextloom.operators import render as R
from contextloom.operators import scoring as S
from contextloom.operators import vector as V
from contextloom.fixture_queries import mode_counts
from contextloom.queries import allocate_modes
from contextloom.shipping import ship


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship(spark)


def test_share_budget(spark):
    got = spark.range(1).select(B.share_budget(F.lit(8000), F.lit("x" * 400)).alias("b")).first()["b"]
    assert (got.effective, got.task, got.repo_summary, got.memory, got.safety) == (8800, 100, 440, 1760, 440)
    assert got.code == 8800 - 100 - 440 - 1760 - 440 and not got.overflow
    tiny = spark.range(1).select(B.share_budget(F.lit(100), F.lit(""), True).alias("b")).first()["b"]
    assert tiny.overflow and tiny.code == 0 and tiny.safety == 0


def test_allocate_goes_on_after_what_does_not_fit(spark):
    rows = [("t", 12, f"p{i}", 1 - i / 10, full, None, None, None) for i, full in enumerate([5, 9, 3, 4])]
    df = spark.createDataFrame(rows, "g string, b int, path string, score double, full long, focused long, signatures long, summary string")
    got = {r.path: r["mode"] for r in B.allocate(df, "g", "b").collect()}
    assert got == {"p0": "full", "p1": "skipped", "p2": "full", "p3": "full"}


def test_allocate_forms(spark):
    rows = [
        ("t", 20, "a", 0.9, 100, 15, 3, "s"),
        ("t", 20, "b", 0.8, 18, 15, 4, "s"),
        ("t", 20, "c", 0.7, 50, None, None, "ä" * 20),
        ("t", 20, "d", 0.6, 0, None, None, None),
    ]
    df = spark.createDataFrame(rows, "g string, b int, path string, score double, full long, focused long, signatures long, summary string")
    got = {r.path: r for r in B.allocate(df, "g", "b").collect()}
    assert got["a"]["mode"] == "focused" and got["b"]["mode"] == "signature_only"
    assert got["c"]["mode"] == "summary_only" and got["c"].summary == "ää..." and got["c"].tokens_used == 1
    assert got["d"]["mode"] == "full" and got["d"].tokens_used == 0


def test_allocate_modes_takes_all_files_of_a_task(spark, tmp_path):
    # lists longer than 60 and than an Arrow batch; most files are too large for what is left
    sizes = {i: 13_001 + 6 * (i % 5) if i % 9 else 700 + i for i in range(300)}
    texts = {i: (("alpha beta " if i % 2 else "alpha ") + "x" * n)[:n] for i, n in sizes.items()} | {300: "beta", 301: "gamma"}
    spark.createDataFrame([(i, x, "en", "s") for i, x in texts.items()], "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "alpha beta"), (2, "beta"), (3, "gamma")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {}
    for task, wanted in ((1, {"alpha", "beta"}), (2, {"beta"}), (3, {"gamma"})):
        scored = [(-len(wanted & set(x.split())) / len(wanted), f"s/{i}.en", len(x)) for i, x in texts.items() if wanted & set(x.split())]
        left = 3000
        for _, path, n in sorted(scored):
            forms = [("full", n // 4, True), ("focused", n // 10, n % 3 == 0 and n // 10 < n // 4 * 0.8), ("signature_only", n // 16, n % 2 == 0)]
            mode, cost = next(((m, c) for m, c, there in forms if there and c <= left and (c or m == "full")), ("skipped", 0))
            want[task, path] = mode, cost
            left -= cost
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    old = spark.conf.get(size)
    spark.conf.set(size, "7")
    try:
        got = allocate_modes(spark, str(tmp_path)).collect()
        counts = mode_counts(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set(size, old)
    assert len(got) == len(want) and {(r.task_id, r.path): (r["mode"], r.tokens_used) for r in got} == want
    late = [mode for (task, _), (mode, _) in want.items() if task == 1][60:]
    assert len(late) == 241 and set(late) >= {"full", "skipped"}
    assert sum(r.files for r in counts) == len(want)


def test_truncate_memory(spark):
    rows = [
        ("c", "open_question", "q" * 40, 0.6, 3, 1),
        ("c", "open_question", "q" * 40, 0.6, None, 2),
        ("c", "constraint", "c" * 40, 0.4, None, 3),
        ("c", "constraint", "k" * 40, 0.9, None, 4),
        ("c", "decision", "d" * 40, 0.5, None, 5),
    ]
    df = spark.createDataFrame(rows, "g string, classification string, text string, confidence double, resolved_by long, turn_index long")
    kept = lambda n: sorted(r.text[0] + str(r.turn_index) for r in B.truncate_memory(df, ["g"], F.lit(n)).collect())
    assert kept(50) == ["c3", "d5", "k4", "q1", "q2"]
    assert kept(49) == ["c3", "d5", "k4", "q2"]
    assert kept(39) == ["c3", "d5", "k4"]
    assert kept(20) == ["d5", "k4"]
    assert kept(0) == []


def test_merge_ranges(spark):
    df = spark.createDataFrame([("f", 1, 10), ("f", 12, 20), ("f", 23, 30), ("f", 5, 6)], "p string, start int, end int")
    assert sorted((r.start, r.end) for r in O.merge_ranges(df, ["p"]).collect()) == [(1, 20), (23, 30)]


def test_render_ranges(spark):
    text = "\n".join("abcdef")
    df = spark.createDataFrame([(text, [(1, 2), (5, 9)])], "c string, r array<struct<start: int, end: int>>")
    assert df.select(O.render_ranges(F.col("c"), F.col("r")).alias("x")).first().x == "// Lines 1-2\na\nb\n\n// ...\n\n// Lines 5-9\ne\nf\n"


def classified(spark, line):
    return spark.range(1).select(C.classify(F.lit(line)).alias("x")).first().x


def test_classify(spark):
    got = classified(spark, "We must not store passwords")
    assert (got.classification, got.polarity, got.trigger) == ("constraint", "negative", "must")
    assert round(got.confidence, 4) == 0.9
    assert classified(spark, "Should we cache this?").classification == "constraint"
    assert classified(spark, "Then, going with Redis").confidence == pytest.approx(0.5)
    assert classified(spark, "Which port is it?").classification == "open_question"
    assert classified(spark, "Nothing here") is None and classified(spark, "  ") is None


def test_turns_by_layout(spark):
    blank = "User: hello\nthere\n\nAssistant: hi\n\n> quoted\n"
    heads = "Preamble\n## User\nask\n\n## Assistant\nanswer\n"
    stamps = "lost\n[10:30] first\nmore\n[10:31] second\n"
    df = spark.createDataFrame([("b", blank), ("h", heads), ("s", stamps)], "conv_id string, content string")
    got = {}
    for r in C.parse_turns(df).orderBy("conv_id", "turn_index").collect():
        got.setdefault(r.conv_id, []).append((r.speaker, r.lines))
    assert got["b"] == [("user", ["hello", "there"]), ("assistant", ["hi"]), (None, ["quoted"])]
    assert got["h"] == [(None, ["Preamble"]), ("user", ["ask", ""]), ("assistant", ["answer"])]
    assert got["s"] == [(None, ["first", "more"]), (None, ["second"])]


def memory(spark):
    lines = [(1, 0, ["Which cache layer should hold sessions here"]), (1, 1, ["What cache do sessions use?", "see src/a.rs, and src/b.py"]), (1, 2, ["We decided sessions use redis cache", "never log tokens", "never log tokens"])]
    return spark.createDataFrame(lines, "conv_id int, turn_index long, lines array<string>")


def test_resolve_and_stages(spark):
    items = C.resolve(C.extract_items(memory(spark)))
    rows = {(r.classification, r.turn_index): r for r in items.collect()}
    assert rows[("open_question", 1)].resolved_by == 2
    assert sum(1 for r in items.collect() if r.text == "never log tokens") == 1
    markers = C.extract_markers(memory(spark))
    assert [r.file for r in markers.orderBy("word_no").collect()] == ["src/a.rs", "src/b.py"]
    staged = C.stages(markers, spark.createDataFrame([(1, 3)], "conv_id int, turn_count long"))
    assert [(r.label, r.start_turn, r.end_turn) for r in staged.orderBy("stage_index").collect()] == [("Initial", 0, 0), ("src/a.rs, src/b.py", 1, 2)]
    assert C.stage_items(items, staged).count() == items.count()
    assert "redis" in R.staged_memory(C.stage_items(items, staged), ["conv_id"]).first().text
    assert "resolved at turn 2" in R.memory_items(items, ["conv_id"]).first().text


def test_mentions(spark):
    files = spark.createDataFrame([("src/a.rs",), ("xa.rs",), ("b.py",)], "path string")
    marks = spark.createDataFrame([("a.rs", 1), ("deep/src/a.rs", 2)], "file string, turn_index int")
    got = {(r.path, r.marker) for r in C.mentions(files, marks).collect()}
    assert got == {("src/a.rs", "a.rs"), ("xa.rs", "a.rs"), ("src/a.rs", "deep/src/a.rs")}


def test_diff_files_with_renames(spark):
    body = "\n".join(f"line {i}" for i in range(20))
    before = spark.createDataFrame([("a", "x"), ("b", "y"), ("old", body), ("same", "s"), ("copy", "z")], "path string, content string")
    after = spark.createDataFrame([("a", "x2"), ("new", body + "\nmore"), ("same", "s"), ("moved", "z"), ("c", "w")], "path string, content string")
    got = {r.path: (r.type, r["from"]) for r in D.diff_files(before, after).collect()}
    assert got == {"a": ("modified", None), "b": ("deleted", None), "new": ("renamed", "old"), "moved": ("renamed", "copy"), "c": ("added", None)}


def test_line_changes(spark):
    df = spark.createDataFrame([("p", "a\nb\nc\n", "a\nx\nc\nd\n")], "path string, old string, new string")
    got = D.line_changes(df).first()
    assert (got.added_lines, got.removed_lines, len(got.hunks)) == (2, 1, 1)


def test_symbol_changes_and_impact(spark):
    kind = "file string, name string, kind string, signature string, ordinal int"
    before = spark.createDataFrame([("f", "go", "function", "go()", 1), ("f", "gone", "function", "gone()", 2)], kind)
    after = spark.createDataFrame([("f", "go", "function", "go(x)", 1), ("f", "come", "function", "come()", 2)], kind)
    changes = D.diff_symbols(before, after)
    assert {(r.name, r.change) for r in changes.collect()} == {("go", "signature_changed"), ("gone", "removed"), ("come", "added")}
    files = spark.createDataFrame([("f", "go gone"), ("g", "call go()"), ("h", "cargo")], "path string, content string")
    assert {(r.symbol, r.path) for r in D.impact(changes, files).collect()} == {("function::go", "g")}


def test_chunks():
    text = "\n".join("x" * 9 for _ in range(10))
    assert V.pack_lines(text, 40, 10) == [(0, 4), (3, 7), (6, 10)]
    assert V.pack_lines("", 40, 10) == [] and V.pack_lines("y" * 100, 40, 10) == [(0, 1)]


def test_embed_and_nearest(spark):
    df = spark.createDataFrame([(i, "a" * i) for i in range(5)], "id int, text string")
    out = V.embed(df, "text", lambda: lambda texts: [[float(len(t)), 0.0] for t in texts])
    got = [r.id for r in V.nearest(out, [2.1, 0.0], 2).collect()]
    assert got == [2, 3]


def test_detect_changes(spark):
    kind = "path string, content_hash string, mtime int"
    now = spark.createDataFrame([("a", "1", 1), ("b", "2", 1), ("c", "3", 1)], kind)
    then = spark.createDataFrame([("a", "1", 0), ("b", "0", 1), ("d", "4", 1)], kind)
    assert {r.path: r.status for r in V.detect_changes(now, then).collect()} == {"a": "unchanged", "b": "changed", "c": "changed", "d": "removed"}
    assert {r.path: r.status for r in V.detect_changes(now, then, True).collect()}["b"] == "unchanged"


def test_scores(spark):
    tasks = spark.createDataFrame([(1, "parse request headers"), (2, "")], "task_id int, task string")
    files = spark.createDataFrame([("a", "parse the headers"), ("b", "nothing"), ("c", "tokio runtime")], "path string, content string")
    symbols = spark.createDataFrame([("b", "parseRequest")], "file string, name string")
    got = {(r.task_id, r.path): r.score for r in S.score_files(tasks, files, symbols).collect()}
    assert got == {(1, "a"): 0.2667, (1, "b"): 0.2}
    deps = spark.createDataFrame([("tokio",)], "name string")
    more = S.score_files(spark.createDataFrame([(1, "tokio speed")], "task_id int, task string"), files, None, None, deps)
    assert {r.path: r.score for r in more.collect()} == {"c": 0.25}


def test_file_section(spark):
    rows = [(1, 1, "a.py", "full", 0.5, 3, "x = 1", None, None, None), (1, 2, "b.rs", "signature_only", 0.3, 2, None, ["fn b()"], None, None), (1, 3, "c", "skipped", 0.2, 0, None, None, None, None)]
    df = spark.createDataFrame(rows, "task_id int, rank int, path string, mode string, score double, tokens_used long, content string, signatures array<string>, summary string, ranges array<struct<start: int, end: int>>")
    text = R.file_section(df, ["task_id"]).first().text
    assert "### `a.py` (score: 0.5000)" in text and "```python\nx = 1\n```" in text and "### Supporting Context" in text and "- `fn b()`" in text and "`c`" not in text


def test_file_tree():
    assert R.file_tree(["src/x/a.py", "src/x/b.py", "c.md"], "root") == "root/\n├── c.md\n└── src/x/\n    ├── a.py\n    └── b.py\n"


def test_bundle_checks(spark):
    df = spark.createDataFrame([('{"task": 1}',), ('{"from_ref": 1}',), ('{"x": 1}',)], "j string")
    assert [r.t for r in df.select(I.bundle_type(F.col("j")).alias("t")).collect()] == ["context", "diff", None]
    files = spark.createDataFrame([(1, 1, "a", "full", 0.2, 5), (1, 2, "b", "full", 0.5, 5)], "task_id int, rank int, path string, mode string, score double, tokens_used long")
    found = I.check_context(files, ["task_id"], budget=spark.createDataFrame([(1, 8)], "task_id int, code long"))
    assert {r.check for r in found.collect()} == {"order", "budget"}
    assert I.audit(files, ["task_id"]).first().top_paths == ["b", "a"]
