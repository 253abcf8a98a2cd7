"""Files, trees, logs and manifests of a repository as DataFrames.

Listing is the driver's work (ignore rules are a walk); contents are read by executors through Spark's binary source.
"""

from __future__ import annotations

import fnmatch
import json
import os
import re
import subprocess
import tomllib
from collections.abc import Iterator
from pathlib import Path

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.functions.text import split_lines
from contextloom.lexicon import LOGGED_COMMITS, MAX_FILE_BYTES, SKIPPED_EXTENSIONS, SKIPPED_FOLDERS

FILES = "path string, content string, estimated_tokens long"
#: Bytes of a commit's files that a task holds at a time; a larger file goes alone.
BLOB_BYTES = 16 << 20


class IgnoreRules:
    """The rules of ignore files, the later and deeper ones first in effect."""

    def __init__(self) -> None:
        self.rules: list[tuple[str, re.Pattern, bool, bool]] = []

    def add(self, folder: str, text: str) -> None:
        for line in split_lines(text):
            rule = line.rstrip()
            if rule.endswith("\\") and rule != line:  # an escaped space at the end
                rule += " "
            if not rule or rule.startswith("#"):
                continue
            keep, rule = rule.startswith("!"), rule.removeprefix("!")
            only_folder, rule = rule.endswith("/"), rule.rstrip("/")
            anchored, rule = "/" in rule, rule.lstrip("/")
            rule = re.sub(r"\\(.)", lambda m: f"[{m[1]}]" if m[1] in "*?[" else m[1], rule)
            parts = ["(?:.*/)?" if p == "**" else fnmatch.translate(p).removeprefix("(?s:").removesuffix(r")\Z").removesuffix(r")\z").replace(".*", "[^/]*") for p in rule.split("/")]
            body = "/".join(parts).replace("(?:.*/)?/", "(?:.*/)?")
            self.rules.append((folder, re.compile(body if anchored else f"(?:.*/)?{body}"), keep, only_folder))

    def ignored(self, path: str, is_folder: bool) -> bool:
        verdict = False
        for folder, pattern, keep, only_folder in self.rules:
            inside = path.removeprefix(folder + "/") if folder else path
            if (not folder or path.startswith(folder + "/")) and (is_folder or not only_folder) and pattern.fullmatch(inside):
                verdict = not keep
        return verdict


def list_paths(root: str, ignore_file: str = ".contextignore", most_bytes: int = MAX_FILE_BYTES) -> list[str]:
    """Relative paths in order of their parts: no hidden files, nothing that ignore files or the fixed lists rule out."""
    rules, found = IgnoreRules(), []
    for here, folders, names in os.walk(root):
        at = os.path.relpath(here, root).replace(os.sep, "/")
        at = "" if at == "." else at
        for name in [".gitignore", *([ignore_file] if not at else [])]:
            file = Path(here, name)
            if file.is_file():
                rules.add(at, file.read_text(errors="replace"))
        join = lambda x: f"{at}/{x}" if at else x  # noqa: B023, E731
        folders[:] = sorted(f for f in folders if not f.startswith(".") and f not in SKIPPED_FOLDERS and not rules.ignored(join(f), True))
        for name in names:
            path = join(name)
            fits = not name.startswith(".") and name.rpartition(".")[2] not in SKIPPED_EXTENSIONS and not rules.ignored(path, False)
            if fits and os.path.getsize(os.path.join(here, name)) <= most_bytes:
                found.append(path)
    return sorted(found, key=lambda p: p.split("/"))


def skipped(path: Column) -> Column:
    """Whether a path lies in a folder, or has an extension, that scans pass over."""
    kinds = F.lit(False)
    for ext in SKIPPED_EXTENSIONS:
        kinds = kinds | path.endswith(f".{ext}")
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, SKIPPED_FOLDERS))) | kinds


def decoded(raw: Column) -> Column:
    """Text of bytes; null if a zero byte is near the start or they are not UTF-8."""
    return F.when(F.instr(F.decode(F.substring(raw, 1, 1024), "ISO-8859-1"), "\0") == 0, F.try_validate_utf8(raw.cast("string")))


def scan(spark: SparkSession, root: str, **how) -> DataFrame:
    """FILES of a repository."""
    paths = list_paths(root, **how)
    if not paths:
        return spark.createDataFrame([], FILES)
    top = Path(root).resolve()
    raw = spark.read.format("binaryFile").load([str(top / p) for p in paths]).select("path", "content")
    text = raw.select(F.replace(F.regexp_replace("path", "^file:/*", "/"), F.lit(f"{top}/"), F.lit("")).alias("path"), decoded(F.col("content")).alias("content"))
    return text.where("content is not null").withColumn("estimated_tokens", F.floor(F.octet_length("content") / 4).cast("long"))


def git(root: str, *args: str) -> str:
    return subprocess.run(["git", "-C", root, *args], capture_output=True, text=True, check=True, errors="replace").stdout


def commit_log(spark: SparkSession, root: str, commits: int = LOGGED_COMMITS) -> DataFrame:
    """(path, position): files that each of the last commits changed against its first parent; 0 is the newest."""
    rows = []
    try:
        ids = git(root, "rev-list", f"--max-count={commits}", "HEAD").split()
    except subprocess.CalledProcessError:
        ids = []
    for position, commit in enumerate(ids):
        names = git(root, "diff-tree", "--root", "--no-commit-id", "--name-only", "-r", "-z", "-m", "--first-parent", commit)
        rows += [(n, position) for n in dict.fromkeys(names.split("\0")) if n]
    return spark.createDataFrame(rows, "path string, position int")


def tree(spark: SparkSession, root: str, ref: str) -> DataFrame:
    """(path, content) of the text files of a commit that are not empty.

    Only paths and ids pass the driver; executors ask one git process a task for the contents, so root must be a folder they
    share, as for scan.
    """
    listed = [x.split("\t", 1) for x in git(root, "ls-tree", "-r", "-z", ref).split("\0") if x]
    rows = [(name, head.split()[2]) for head, name in listed if head.split()[1] == "blob"]
    blobs = spark.createDataFrame(rows, "path string, id string")
    return blobs.mapInPandas(_read_blobs(root), "path string, content string")


def _read_blobs(root: str):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked = subprocess.Popen(["git", "-C", root, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        try:
            for pdf in batches:
                rows, held = [], 0
                for name, blob in pdf[["path", "id"]].itertuples(index=False):
                    asked.stdin.write(f"{blob}\n".encode())
                    asked.stdin.flush()
                    size = int(asked.stdout.readline().split()[2])
                    raw = asked.stdout.read(size + 1)[:-1]  # a newline follows each object
                    try:
                        text = raw.decode()
                    except UnicodeDecodeError:
                        continue
                    if text and "\0" not in text[:1024]:
                        rows.append((name, text))
                        held += size
                    if held > BLOB_BYTES:
                        yield pd.DataFrame(rows, columns=["path", "content"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["path", "content"])
        finally:
            asked.stdin.close()
            asked.wait()

    return run


Dependency = tuple[str, str | None, list[str]]


def from_cargo(text: str) -> list[Dependency]:
    table = tomllib.loads(text).get("dependencies", {})
    return [(n, v if isinstance(v, str) else v.get("version"), [] if isinstance(v, str) else list(v.get("features", []))) for n, v in table.items()]


def requirement(line: str) -> Dependency | None:
    line = line.split(";")[0].strip()
    if not line or line[0] in "#-":
        return None
    for mark in (">=", "<=", "!=", "==", "~=", ">", "<"):
        if mark in line:
            name, _, version = line.partition(mark)
            return re.sub(r"\[.*?\]", "", name).strip(), mark + version.strip(), []
    return re.sub(r"\[.*?\]", "", line).strip(), None, []


def from_pyproject(text: str) -> list[Dependency]:
    return [d for x in tomllib.loads(text).get("project", {}).get("dependencies", []) if (d := requirement(x))]


def from_requirements(text: str) -> list[Dependency]:
    return [d for x in split_lines(text) if (d := requirement(x))]


def from_go_mod(text: str) -> list[Dependency]:
    found = []
    for block in re.findall(r"^require \((.*?)^\)", text, re.S | re.M):
        found += [(m[1], m[2], []) for m in re.finditer(r"^\s+(\S+)\s+(\S+)", block, re.M) if not m[1].startswith("//")]
    return found


def from_package_json(text: str) -> list[Dependency]:
    data, found = json.loads(text), {}
    for part in ("dependencies", "devDependencies"):
        for name, version in (data.get(part) or {}).items():
            found.setdefault(name, (name, version, []))
    return list(found.values())


def from_mix(text: str) -> list[Dependency]:
    block = re.search(r"^\s*defp?\s+deps\b.*?do\b(.*?)^\s*end\b", text, re.S | re.M)
    return [(m[1], m[2], []) for m in re.finditer(r"\{\s*:(\w+)\s*,\s*\"([^\"]*)\"", block[1])] if block else []


READERS = {"Cargo.toml": from_cargo, "go.mod": from_go_mod, "package.json": from_package_json, "pyproject.toml": from_pyproject, "requirements.txt": from_requirements, "mix.exs": from_mix}


def dependencies(spark: SparkSession, root: str) -> DataFrame:
    """(name, version, features) of the manifests at the root; the first manifest that names a package counts."""
    found: dict[str, Dependency] = {}
    for name, reader in READERS.items():
        file = Path(root, name)
        if file.is_file():
            try:
                rows = reader(file.read_text())
            except (ValueError, tomllib.TOMLDecodeError):
                rows = []
            for row in rows:
                found.setdefault(row[0], row)
    return spark.createDataFrame(sorted(found.values()), "name string, version string, features array<string>")


def transcripts(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(file, ordinal, content) of whole conversation files, in the order given."""
    order = spark.createDataFrame([(Path(p).resolve().as_uri(), i) for i, p in enumerate(paths)], "file string, ordinal int")
    text = spark.read.text(paths, wholetext=True).select(F.regexp_replace(F.input_file_name(), "^file:/+", "file:///").alias("file"), F.col("value").alias("content"))
    return text.join(order, "file")
