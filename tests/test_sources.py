import subprocess

import pytest

from contextloom.plans import commands as P
from contextloom.shipping import ship
from contextloom.sources import analyzers as A
from contextloom.sources import repository as R


@pytest.fixture
def repo(tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "target").mkdir()
    (tmp_path / "src" / "a.py").write_text('"""Parses requests."""\n\ndef parse_request(x):\n    return x\n\nclass _Hidden:\n    pass\n')
    (tmp_path / "src" / "b.rs").write_text("//! Store.\npub struct Store;\nimpl Store {\n    pub fn open() {}\n}\nfn helper() {}\n")
    (tmp_path / "target" / "x.py").write_text("skip")
    (tmp_path / "secret.log").write_text("skip")
    (tmp_path / "raw.bin").write_bytes(b"a\0b")
    (tmp_path / ".gitignore").write_text("*.log\n")
    (tmp_path / "Cargo.toml").write_text('[dependencies]\nserde = { version = "1", features = ["derive"] }\nlog = "0.4"\n')
    (tmp_path / "requirements.txt").write_text("# x\nnumpy[all]>=1.2; python_version > '3'\n-r y\n")
    git = lambda *a: subprocess.run(["git", "-C", tmp_path, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("init", "-q")
    git("add", "-A")
    git("commit", "-qm", "one")
    (tmp_path / "src" / "a.py").write_text('"""Parses requests."""\n\ndef parse_request(x, y):\n    return x\n')
    git("commit", "-qam", "two")
    return tmp_path


def test_scan_log_and_tree(spark, repo):
    got = {r.path: r for r in R.scan(spark, str(repo)).collect()}
    assert set(got) == {"Cargo.toml", "requirements.txt", "src/a.py", "src/b.rs"}
    assert {r.path: r.position for r in R.commit_log(spark, str(repo)).where("path like 'src/%'").groupBy("path").min("position").withColumnRenamed("min(position)", "position").collect()} == {"src/a.py": 0, "src/b.rs": 1}
    assert R.tree(spark, str(repo), "HEAD~1").where("path = 'src/a.py'").first().content.endswith("pass\n")
    assert [(r.name, r.version, r.features) for r in R.dependencies(spark, str(repo)).collect()] == [("log", "0.4", []), ("numpy", ">=1.2", []), ("serde", "1", ["derive"])]


def test_build_from_a_repository(spark, repo):
    ship(spark)
    files = A.summarize_files(R.scan(spark, str(repo)))
    symbols = A.extract_symbols(files)
    names = {(r.file, r.name, r.kind, r.visibility) for r in symbols.collect()}
    assert ("src/a.py", "parse_request", "function", "public") in names and ("src/b.rs", "open", "method", "public") in names and ("src/b.rs", "helper", "function", "private") in names
    tasks = spark.createDataFrame([(1, "parse request")], "task_id int, task string")
    got = P.build(tasks, files, symbols).collect()
    assert [(r.path, r["mode"]) for r in got][0] == ("src/a.py", "full")
    assert "### `src/a.py`" in P.render_files(P.build(tasks, files, symbols)).first().text


def test_diff_of_two_commits(spark, repo):
    ship(spark)
    before, after = R.tree(spark, str(repo), "HEAD~1"), R.tree(spark, str(repo), "HEAD")
    out = P.diff(before, after, A.extract_symbols(before), A.extract_symbols(after), effective=100)
    assert [(r.path, r.type, r.added_lines, r.removed_lines) for r in out["files"].collect()] == [("src/a.py", "modified", 1, 4)]
    assert {(r.name, r.change) for r in out["symbols"].collect()} == {("parse_request", "signature_changed"), ("_Hidden", "removed")}
    assert out["stats"].first().files_modified == 1


def test_index_follows_files(spark, tmp_path):
    ship(spark)
    model = lambda: lambda texts: [[float(len(t))] for t in texts]
    store = f"file://{tmp_path}/index"
    one = spark.createDataFrame([("a", "x\ny"), ("b", "z")], "path string, content string")
    two = spark.createDataFrame([("a", "x\ny"), ("b", "zz"), ("c", "w")], "path string, content string")
    assert {r.status for r in P.index(spark, one, store, model).collect()} == {"changed"}
    assert {r.path: r.status for r in P.index(spark, two, store, model).collect()} == {"a": "unchanged", "b": "changed", "c": "changed"}
    assert sorted(r.text for r in spark.read.parquet(f"{store}/2/chunks").collect()) == ["w", "x\ny", "zz"]


def test_other_analyzers():
    go = A.Go().symbols("func (s *S) Run() {\n}\nfunc help() {\n}\ntype T struct {\n}\nconst X = 1\n")
    assert [(s.name, s.kind, s.visibility) for s in go] == [("Run", "method", "public"), ("help", "function", "private"), ("T", "struct", "public"), ("X", "constant", "public")]
    ts = A.Script().symbols("export const f = (x) => x;\ntype A = string;\nexport class B {\n}\n")
    assert [(s.name, s.kind, s.visibility) for s in ts] == [("A", "interface", "private"), ("B", "class", "public"), ("f", "function", "public")]
    ex = A.Elixir().symbols("defmodule M do\n  defstruct [:a]\n  def go(x) do\n    x\n  end\n  def go(y), do: y\n  defp no(x), do: x\nend\n")
    assert [(s.name, s.kind, s.visibility) for s in ex] == [("M", "module", "public"), ("M", "struct", "public"), ("go", "function", "public"), ("no", "function", "private")]
    cpp = A.Cpp().symbols("namespace n {\nclass C {\n};\nint add(int a) {\n  return a;\n}\n}\n")
    assert [(s.name, s.kind) for s in cpp] == [("n", "module"), ("C", "class"), ("add", "function")]
    assert A.analyzer_for("x/Y.AS").extensions == ("as",) and A.analyzer_for("none") is None


def test_symbols_by_brackets():
    rust = lambda text: [(s.name, s.kind, s.visibility, s.start_line) for s in A.Rust().symbols(text)]
    assert rust("trait T { fn no(&self) {} }\nimpl Drop for X {\n  fn drop(&mut self) {}\n}\n") == [("T", "trait", "private", 1), ("drop", "method", "private", 3)]
    assert rust('#[cfg(a = "}")]\npub const fn f<const N: usize>(a: [u8; N]) {}\nuse a::{b, c};\nextern "C" { fn no(); }\nstatic mut X: char = \'{\';\n') == [("f", "function", "public", 2), ("X", "constant", "private", 5)]
    assert rust("macro_rules! m { () => { fn no() {} } }\nm!(fn no2() {});\nfn yes() {}") == [("yes", "function", "private", 3)]
    assert rust("fn open( {") == rust("") == rust("/* fn a() {}") == []
    assert A.Rust().symbols("fn f(a: &'static str, b: fn(u8) -> u8) where u8: Copy {}")[0].signature == "fn f(a : & 'static str, b : fn (u8) -> u8)"
    go = lambda text: [(s.name, s.kind, s.start_line, s.end_line) for s in A.Go().symbols(text)]
    assert go("var a, b = 1,\n\t2\nfunc Map[T any](x T) T {\n\treturn x\n}\ntype G[T any] struct{ x T }\ntype N int\n") == [("a", "constant", 1, 2), ("b", "constant", 1, 2), ("Map", "function", 3, 5), ("G", "struct", 6, 6)]
    assert go("var s = `\nfunc no() {}\n`\nconst (") == [("s", "constant", 1, 1)] and go("func") == go("") == []
    assert [s.name for s in A.Script().symbols("const a = b;\nlet c = x => x\nvar d = `\nclass No {}\n`\n")] == ["c"]
    cpp = A.Cpp().symbols("void f() {\n  if (a) {\n    g(a,\n      b);\n  }\n}\n")
    assert [(s.name, s.kind, s.start_line, s.end_line) for s in cpp] == [("f", "function", 1, 6)]


def test_declared_symbols(spark):
    from contextloom.fixture_queries import DECLARED, declared_symbols

    assert sorted(map(tuple, declared_symbols(spark, "").collect())) == sorted(DECLARED)


def test_escaped_ignore_rules():
    rules = R.IgnoreRules()
    rules.add("", "#no\n\\#x\n\\!y\na\\*b\nend\\ \n*.log\n!keep.log\n")
    assert [p for p in ("no", "#x", "!y", "a*b", "acb", "end ", "end", "d/z.log", "keep.log") if rules.ignored(p, False)] == ["#x", "!y", "a*b", "end ", "d/z.log"]


def test_tree_of_odd_files(spark, repo):
    ship(spark)
    (repo / "empty").write_text("")
    (repo / "no end").write_bytes("ä\nb".encode())
    (repo / "latin").write_bytes(b"\xe4")
    git = lambda *a: subprocess.run(["git", "-C", repo, "-c", "user.name=n", "-c", "user.email=e", *a], check=True, capture_output=True)
    git("add", "-A")
    git("commit", "-qm", "three")
    got = {r.path: r.content for r in R.tree(spark, str(repo), "HEAD").collect()}
    assert got["no end"] == "ä\nb" and not got.keys() & {"empty", "latin", "raw.bin", "secret.log"}
