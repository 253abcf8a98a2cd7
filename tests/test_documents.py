import json

import pytest

from contextloom.fixture_queries import small_documents
from contextloom.operators import documents as T
from contextloom.operators import vector as V
from contextloom.shipping import ship


def test_contexts_survive_their_json(spark, tmp_path):
    made = small_documents(spark).cache()
    texts = T.context_json(made)
    T.write_documents(texts, str(tmp_path / "out"))
    back = {r["task"]: r for r in T.read_contexts(spark, str(tmp_path / "out" / "*")).collect()}
    for r in made.collect():
        assert back[r["task"]].asDict(True) | {"file": ""} == {k: v for k, v in r.asDict(True).items() if k != "task_id"} | {"file": ""}
    assert "conversation_memory" not in json.loads(texts.first()["text"])


def test_missing_lines_of_symbols_are_zero(spark, tmp_path):
    (tmp_path / "c.json").write_text(json.dumps({"schema_version": "0.1", "task": "t", "symbol_graph": {"functions": [{"name": "f", "file": "a.rs", "visibility": None, "signature": "fn f()"}]}}))
    row = T.read_contexts(spark, str(tmp_path)).first()
    assert (row["symbol_graph"]["functions"][0]["start_line"], row["symbol_graph"]["functions"][0]["end_line"]) == (0, 0)


def test_warnings_of_contexts(spark):
    schema = f"task_id long, {T.CONTEXT}"
    entry = lambda path, score, mode="full": (path, mode, "x", None, None, score, 1, None)
    budget = (10, 10, 5, 5, 5, 5, 5, False, False)
    memory = ([], [], [], [(3, "lost.rs", "f")])
    rows = [(1, "9", "t", "", "", [entry("a", 0.1), entry("b", 0.5)], None, [], budget, memory, None), (2, "0.2", "t", "", "", [entry("a", 0.5), entry("b", 0.9, "skipped"), entry("c", 0.1)], None, [], (10, 10, 1, 1, 1, 1, 1, False, False), None, None)]
    found = [(r.task_id, r.warning[:20]) for r in T.context_warnings(spark.createDataFrame(rows, schema)).collect()]
    assert sorted(found) == [(1, "Conversation memory "), (1, "Included files are n"), (1, "Token budget buckets"), (1, "Unknown schema versi")]


def test_search_meets_chunks_and_symbols(spark):
    ship(spark)
    model = lambda: lambda texts: [[float(len(t)), 0.0] for t in texts]
    vectors = lambda rows: spark.createDataFrame(rows, "path string, vector array<float>")
    tasks = spark.createDataFrame([(1, "abc")], "task_id long, task string")
    got = {r.path: (round(r.chunk_sim, 4), round(r.symbol_sim, 4), round(r.combined, 4)) for r in V.search(tasks, vectors([("a", [3.0, 0.0]), ("a", [9.0, 0.0]), ("b", [4.0, 0.0])]), vectors([("c", [3.0, 1.0])]), model).collect()}
    assert got == {"a": (1.0, 0.0, 0.6), "b": (0.5, 0.0, 0.3), "c": (0.0, 0.5, 0.2)}
    assert V.dimension_of("BGEBaseENV15") == 768
    with pytest.raises(ValueError):
        V.dimension_of("none")
