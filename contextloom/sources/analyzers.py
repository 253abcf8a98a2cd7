"""Symbols and summaries of source files, by language.

An analyzer is a class with extensions, symbols(text) and summary(text); registry order decides between two that share an
extension. Texts are analysed where they lie, batch by batch, so any number of files needs no shuffle.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.functions.text import split_lines
from contextloom.lexicon import SUMMARY_BYTES
from contextloom.sources import outline

SYMBOLS = "file string, ordinal int, name string, kind string, visibility string, signature string, start_line int, end_line int"


@dataclass(frozen=True)
class Symbol:
    name: str
    kind: str
    visibility: str | None
    signature: str
    start_line: int
    end_line: int


def capped(text: str | None) -> str | None:
    text = (text or "").strip()
    raw = text.encode()
    return None if not text else text if len(raw) <= SUMMARY_BYTES else raw[:SUMMARY_BYTES].decode("utf-8", "ignore") + "..."


def leading(text: str, mark: str) -> str | None:
    """The first run of comment lines."""
    said = []
    for line in split_lines(text):
        line = line.strip()
        if line.startswith(mark) and not line.startswith("#!"):
            said.append(line[len(mark) :].lstrip("/!").strip())
        elif said or line:
            break
    return capped(" ".join(x for x in said if x))


def block_or_line(text: str) -> str | None:
    m = re.match(r"\s*/\*+(.*?)\*/", text, re.S)
    return capped(" ".join(x.strip().lstrip("*").strip() for x in split_lines(m[1])).strip()) if m else leading(text, "//")


def body_end(lines: list[str], at: int) -> int:
    """The line (from 1) on which the braces opened at or after line index `at` are closed."""
    depth, opened = 0, False
    for i in range(at, len(lines)):
        for c in re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])'|//.*", "", lines[i]):
            if c == "{":
                depth, opened = depth + 1, True
            elif c == "}":
                depth -= 1
            elif c == ";" and not opened:
                return i + 1
        if opened and depth <= 0:
            return i + 1
    return at + 1 if not opened else len(lines)


class Lines:
    """A language told line by line with patterns (kind, pattern with a group `name`)."""

    extensions: tuple[str, ...] = ()
    patterns: list[tuple[str, re.Pattern]] = []
    literals = outline.C

    def visibility(self, line: str, m: re.Match) -> str | None:
        return "public"

    def summary(self, text: str) -> str | None:
        return block_or_line(text)

    def symbols(self, text: str) -> list[Symbol]:
        lines, plain, found = split_lines(text), split_lines(outline.blanked(text, self.literals)), []
        for i, line in enumerate(plain):
            for kind, pattern in self.patterns:
                if m := pattern.match(line):
                    found.append(Symbol(m["name"], kind, self.visibility(line, m), lines[i].lstrip(), i + 1, body_end(plain, i)))
                    break
        return found


def _p(x: str) -> re.Pattern:
    return re.compile(x)


class Rust:
    extensions = ("rs",)

    def symbols(self, text: str) -> list[Symbol]:
        # a symbol is at its keyword's line
        return [Symbol(*said, line, line) for *said, line in outline.rust(text)]

    def summary(self, text: str) -> str | None:
        inner = [x.strip()[3:].strip() for x in split_lines(text) if x.strip().startswith("//!")]
        if inner:
            return capped(" ".join(inner))
        m = re.search(r"^\s*///(.*)$", text, re.M)
        return capped(m[1]) if m else None


class Python(Lines):
    extensions = ("py", "pyi")

    def symbols(self, text: str) -> list[Symbol]:
        try:
            nodes = ast.walk(ast.parse(text))
        except (SyntaxError, ValueError):
            return []
        lines, found = split_lines(text), []
        for n in nodes:
            if isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "class" if isinstance(n, ast.ClassDef) else "function"
                found.append(Symbol(n.name, kind, "private" if n.name.startswith("_") else "public", lines[n.lineno - 1].lstrip(), n.lineno, n.end_lineno or n.lineno))
        return sorted(found, key=lambda s: s.start_line)

    def summary(self, text: str) -> str | None:
        try:
            doc = ast.get_docstring(ast.parse(text))
        except (SyntaxError, ValueError):
            doc = None
        return capped(" ".join(doc.split())) if doc else leading(text, "#")


class Go:
    extensions = ("go",)

    def symbols(self, text: str) -> list[Symbol]:
        lines = split_lines(text)
        seen = lambda name: "public" if name[:1].isupper() else "private"
        return [Symbol(name, kind, seen(name), said or lines[first - 1].lstrip(), first, last) for name, kind, said, first, last in outline.go(text)]

    def summary(self, text: str) -> str | None:
        return leading(text, "//")


class Script(Lines):
    extensions = ("ts", "tsx", "js", "jsx")
    literals = outline.SCRIPT
    patterns = [
        (kind, _p(rf"\s*(?P<export>export\s+)?(?:default\s+)?(?:declare\s+)?{words}"))
        for kind, words in (
            ("function", r"(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)"),
            ("class", r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)"),
            ("interface", r"(?:interface|type)\s+(?P<name>[\w$]+)"),
            ("enum", r"(?:const\s+)?enum\s+(?P<name>[\w$]+)"),
        )
    ]

    def visibility(self, line: str, m: re.Match) -> str:
        return "public" if m["export"] else "private"

    def symbols(self, text: str) -> list[Symbol]:
        lines, plain = split_lines(text), split_lines(outline.blanked(text, self.literals))
        arrows = [Symbol(name, "function", "public" if out else "private", lines[i - 1].lstrip(), i, body_end(plain, i - 1)) for name, out, i in outline.script(text)]
        best: dict[str, Symbol] = {}
        for s in sorted([*super().symbols(text), *arrows], key=lambda s: s.start_line):
            if s.name not in best or (s.visibility == "public" and best[s.name].visibility != "public"):
                best[s.name] = s
        return [best[n] for n in sorted(best)]


class Cpp(Lines):
    extensions = ("cpp", "cc", "cxx", "h", "hpp", "hxx")
    patterns = [
        ("type_alias", _p(r"\s*typedef\s+[^(;]*?\b(?P<name>\w+)\s*;")),
        ("type_alias", _p(r"\s*(?:template\s*<[^>]*>\s*)?using\s+(?P<name>\w+)\s*=")),
        ("enum", _p(r"\s*enum\s+(?:class\s+|struct\s+)?(?P<name>\w+)[^;()]*(?:\{.*)?$")),
        ("class", _p(r"\s*(?:template\s*<[^>]*>\s*)?class\s+(?P<name>\w+)(?:[^;()]*|[^;()]*\{.*)$")),
        ("struct", _p(r"\s*(?:template\s*<[^>]*>\s*)?(?:typedef\s+)?struct\s+(?P<name>\w+)(?:[^;()]*|[^;()]*\{.*)$")),
        ("module", _p(r"\s*namespace\s+(?P<name>\w+)")),
        ("function", _p(r"\s*(?!(?:return|else|new|throw|case|delete|goto|do|using|typedef)\b)[\w:<>,*&~\s]*?(?:\s[*&]*|^|[*&])(?P<name>(?:\w+::)*~?\w+)\s*\((?:[^;]*|[^;{]*\{.*)$")),
    ]

    def symbols(self, text: str) -> list[Symbol]:
        found = [s for s in super().symbols(text) if s.kind != "function" or s.name not in ("if", "for", "while", "switch", "catch", "return", "sizeof", "defined")]
        boxes = [(s.start_line, s.end_line) for s in found if s.kind in ("class", "struct")]
        own = lambda s: s.kind == "function" and ("::" in s.name or any(a < s.start_line <= b for a, b in boxes))
        bodies = [(s.start_line, s.end_line) for s in found if s.kind == "function"]
        # what looks like a head within a body is a call
        outer = [s for s in found if s.kind != "function" or not any(a < s.start_line <= b for a, b in bodies)]
        return [replace(s, kind="method") if own(s) else s for s in outer]


class Elixir(Lines):
    extensions = ("ex", "exs")
    patterns = [
        ("module", _p(r"\s*defmodule\s+(?P<name>[\w.]+)")),
        ("interface", _p(r"\s*defprotocol\s+(?P<name>[\w.]+)")),
        ("class", _p(r"\s*defimpl\s+(?P<name>[\w.]+)")),
        ("function", _p(r"\s*def(?P<private>macrop|p|macro)?\s+(?P<name>\w+[?!]?)")),
    ]

    def visibility(self, line: str, m: re.Match) -> str:
        return "private" if (m.groupdict().get("private") or "").endswith("p") else "public"

    def symbols(self, text: str) -> list[Symbol]:
        lines, found, seen, module = split_lines(text), [], set(), ""
        for i, line in enumerate(lines):
            if re.match(r"\s*defstruct\b", line) and module:
                found.append(Symbol(module, "struct", "public", line.strip(), i + 1, i + 1))
                continue
            for kind, pattern in self.patterns:
                if m := pattern.match(line):
                    module = m["name"] if kind == "module" else module
                    if kind == "function" and m["name"] in seen:
                        break
                    seen.add(m["name"] if kind == "function" else None)
                    indent = len(line) - len(line.lstrip())
                    end = next((k + 1 for k in range(i + 1, len(lines)) if lines[k].strip() == "end" and len(lines[k]) - len(lines[k].lstrip()) == indent), i + 1)
                    found.append(Symbol(m["name"], kind, self.visibility(line, m), line.lstrip(), i + 1, end if line.rstrip().endswith("do") else i + 1))
                    break
        return found

    def summary(self, text: str) -> str | None:
        return leading(text, "#")


class AngelScript(Cpp):
    extensions = ("as",)
    patterns = [
        ("class", _p(r"\s*(?:shared\s+|abstract\s+|final\s+|mixin\s+)*class\s+(?P<name>\w+)")),
        ("interface", _p(r"\s*(?:shared\s+)?interface\s+(?P<name>\w+)")),
        ("enum", _p(r"\s*(?:shared\s+)?enum\s+(?P<name>\w+)")),
        ("module", _p(r"\s*namespace\s+(?P<name>\w+)")),
        ("type_alias", _p(r"\s*(?:typedef|funcdef)\b.*?(?P<name>\w+)\s*(?:\(.*)?;")),
        ("function", _p(r"[\w@&<>\[\]\s]+?\s[@&]*(?P<name>\w+)\s*\([^;]*$")),
    ]


REGISTRY = [AngelScript(), Cpp(), Elixir(), Rust(), Go(), Script(), Python()]


def analyzer_for(path: str, registry: list = REGISTRY):
    ext = path.rpartition("/")[2].rpartition(".")
    return next((a for a in registry if ext[1] and ext[2].lower() in a.extensions), None)


def extract_symbols(files: DataFrame, registry: list | None = None) -> DataFrame:
    """SYMBOLS rows of files (path, content)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for path, content in pdf[["path", "content"]].itertuples(index=False):
                own = analyzer_for(path or "", registry or REGISTRY)
                for i, s in enumerate(own.symbols(content or "") if own else []):
                    rows.append((path, i, s.name, s.kind, s.visibility, s.signature, s.start_line, s.end_line))
            yield pd.DataFrame(rows, columns=["file", "ordinal", "name", "kind", "visibility", "signature", "start_line", "end_line"])

    return files.select("path", "content").mapInPandas(run, SYMBOLS)


def summarize_files(files: DataFrame, registry: list | None = None) -> DataFrame:
    """files with `written`, the analyzer's summary or null."""

    def own(paths: pd.Series, contents: pd.Series) -> pd.Series:
        out = []
        for path, content in zip(paths, contents, strict=True):
            found = analyzer_for(path or "", registry or REGISTRY)
            out.append(found.summary(content or "") if found else None)
        return pd.Series(out, dtype=object)

    return files.withColumn("written", F.pandas_udf(own, "string")("path", "content"))
