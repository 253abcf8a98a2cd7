"""Outlines of sources by tokens and brackets: comments and literals are blanked, then declarations are read from their heads.

No expression is parsed, so only what a declaration's head says is known. Lines count from 1.
"""

from __future__ import annotations

import bisect
import re
from collections.abc import Iterator
from dataclasses import dataclass

_LINE = r"//[^\n]*|/\*"
_QUOTED = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
#: What is blanked, by family of languages; /* stands for a block comment.
RUST = re.compile(_LINE + r"|\b[bc]?r(?P<hashes>#*)\".*?\"(?P=hashes)|\b[bc]?\"(?:\\.|[^\"\\])*\"|\"(?:\\.|[^\"\\])*\"|'(?:\\(?:u\{[^}]*\}|.[0-9a-fA-F]{0,2})|[^'\\\n])'", re.S)
GO = re.compile(_LINE + r"|`[^`]*`|" + _QUOTED)
SCRIPT = re.compile(_LINE + r"|`(?:\\.|[^`\\])*`|" + _QUOTED, re.S)
C = re.compile(_LINE + r"|R\"(?P<mark>[^(\s]*)\(.*?\)(?P=mark)\"|" + _QUOTED, re.S)

_TOKEN = re.compile(r"'[^\W\d]\w*|[^\W\d]\w*|\d[\w.]*|::|->|=>|\.\.=?|\.\.\.|[^\s\w]")
_CLOSED = {"(": ")", "[": "]", "{": "}"}


def blanked(text: str, literals: re.Pattern, nested: bool = False, mark: str = " ") -> str:
    """text with spaces for comments and literals, but for mark as a literal's first character; all places and lines stay."""
    out, at = [], 0
    while m := literals.search(text, at):
        end = m.end()
        if m[0] == "/*":
            depth = 1
            while depth and (edge := re.compile(r"/\*|\*/").search(text, end)):
                depth, end = depth + (1 if nested and edge[0] == "/*" else -1 if edge[0] == "*/" else 0), edge.end()
            end = len(text) if depth else end
        out += [text[at : m.start()], " " if m[0].startswith("/") else mark, re.sub(r"[^\n]", " ", text[m.start() + 1 : end])]
        at = end
    return "".join([*out, text[at:]])


@dataclass
class Source:
    """Tokens of a blanked text, the bracket that closes each opening one, and lines by place."""

    text: str

    def __post_init__(self) -> None:
        found = list(_TOKEN.finditer(self.text))
        self.words, self.places = [m[0] for m in found], [m.start() for m in found]
        self.newlines = [m.start() for m in re.finditer("\n", self.text)]
        self.closing: dict[int, int] = {}
        open_at: list[int] = []
        for i, w in enumerate(self.words):
            if w in _CLOSED:
                open_at.append(i)
            elif w in (")", "]", "}"):
                if not open_at or _CLOSED[self.words[open_at[-1]]] != w:
                    break
                self.closing[open_at.pop()] = i
        self.whole = len(self.closing) * 2 == sum(w in "()[]{}" for w in self.words)

    def word(self, i: int) -> str:
        return self.words[i] if i < len(self.words) else ""

    def line(self, i: int) -> int:
        return bisect.bisect_left(self.newlines, self.places[i]) + 1

    def past(self, i: int) -> int:
        """The token after i, or after the bracket that i opens."""
        return self.closing.get(i, i) + 1

    def past_angles(self, i: int) -> int:
        """The token after the generics that begin at i, if they do."""
        if self.word(i) != "<":
            return i
        depth = 0
        while i < len(self.words):
            depth += {"<": 1, ">": -1}.get(self.words[i], 0)
            i = self.past(i)
            if not depth:
                break
        return i

    def until(self, i: int, stops: set[str]) -> int:
        """The first token from i on, outside brackets, that is in stops."""
        while i < len(self.words) and self.words[i] not in stops:
            i = self.past(i)
        return i

    def parts(self, i: int, end: int, at: str) -> Iterator[tuple[int, int]]:
        """Stretches of i..end between the marks outside brackets and generics; empty ones are left out."""
        first, depth = i, 0
        while i < end:
            depth += {"<": 1, ">": -1}.get(self.words[i], 0)
            if self.words[i] == at and depth <= 0:
                if first < i:
                    yield first, i
                first = i + 1
            i = self.past(i)
        if first < end:
            yield first, end

    def spaced(self, i: int, end: int) -> str:
        """Tokens with a space between, but for the inner sides of round and square brackets."""
        said = ""
        for k in range(i, end):
            tight = not said or said[-1] in "([" or self.words[k] in (")", "]")
            said += self.words[k] if tight else " " + self.words[k]
        return said


_BEFORE_FN = {"default", "const", "async", "unsafe", "safe", "extern", "auto"}
_NAMED = {"struct": "struct", "enum": "enum", "trait": "trait"}


def rust(text: str) -> list[tuple]:
    """(name, kind, visibility, signature, line) of items and of the functions of impl blocks; nothing if brackets do not match."""
    src = Source(blanked(text, RUST, nested=True))
    return list(_rust_items(src, 0, len(src.words), None)) if src.whole else []


def _rust_items(src: Source, i: int, end: int, owner: str | None) -> Iterator[tuple]:
    while i < end:
        if src.word(i) == "#":  # an attribute
            i = src.past(i + 1 + (src.word(i + 1) == "!"))
            continue
        seen, begin = "private", i
        if src.word(i) == "pub":
            seen, i = "public", i + 1
            if src.word(i) == "(":
                seen, i = "crate" if src.words[src.closing[i] - 1] == "crate" else "private", src.past(i)
        said = set()
        while src.word(i) in _BEFORE_FN and (src.word(i) != "const" or src.word(i + 1) in _BEFORE_FN | {"fn"}):
            said.add(src.word(i))
            i += 1
        word, name = src.word(i), src.word(i + 1)
        if word == "fn":
            inputs = src.past_angles(i + 2)
            if src.word(inputs) != "(":
                return
            body = src.until(inputs, {"{", ";"})
            given = ", ".join(src.spaced(*p) for p in src.parts(inputs + 1, src.closing[inputs], ","))
            after = src.past(inputs)
            gives = " -> " + src.spaced(after + 1, src.until(after, {"{", ";", "where"})) if src.word(after) == "->" else ""
            shown = {"public": "pub ", "crate": "pub(crate) "}.get(seen, "")
            shown += "".join(f"{w} " for w in ("unsafe", "async") if w in said) + f"fn {name}({given}){gives}"
            yield name, "method" if owner else "function", seen, f"impl {owner} :: {shown}" if owner else shown, src.line(i)
            i = src.past(body)
        elif word == "impl" and not owner:
            body = src.until(i, {"{", ";"})
            head = src.past_angles(i + 1)
            stop = min(src.until(head, {"where"}), body)
            marks = [k for k in range(head, stop) if src.words[k] == "for" and src.word(k + 1) != "<"]
            if body < end and src.word(body) == "{":
                yield from _rust_items(src, body + 1, src.closing[body], src.spaced(marks[-1] + 1 if marks else head, stop))
            i = src.past(body)
        elif word in ("const", "static"):
            at = i + 1 + (src.word(i + 1) == "mut")
            stop = src.until(at, {";"})
            if not owner:
                yield src.word(at), "constant", seen, f"{seen} {word} {src.word(at)}: {src.spaced(at + 2, min(src.until(at, {'='}), stop))}", src.line(i)
            i = stop + 1
        elif word in _NAMED and not owner:
            yield name, _NAMED[word], seen, f"{seen} {word} {name}", src.line(i)
            i = src.past(src.until(i, {"{", ";"}))
        elif word == "mod" and not owner:
            yield name, "module", seen, f"{seen} mod {name}", src.line(i)
            if src.word(i + 2) == "{":
                yield from _rust_items(src, i + 3, src.closing[i + 2], None)
            i = src.past(i + 2)
        else:  # uses and types end with a semicolon, macros and blocks with either
            i = src.past(src.until(i, {";"} if word in ("use", "type") else {"{", ";"}))
        i = max(i, begin + 1)


def go(text: str) -> list[tuple]:
    """(name, kind, signature or null, first line, last line) of functions, methods, types, constants and variables.

    All names of a group are at the lines of the whole group; null stands for the first line.
    """
    src, found = Source(blanked(text, GO, mark="0")), []
    for i, word in enumerate(src.words):
        fresh = not i or src.line(i) > src.line(i - 1) or src.words[i - 1] in (";", "{")
        if not fresh or word not in ("func", "type", "const", "var"):
            continue
        if word == "func":
            name = src.past(i + 1) if src.word(i + 1) == "(" else i + 1
            if re.match(r"[^\W\d]", src.word(name)):
                inputs = src.past(src.past(name) if src.word(name + 1) == "[" else name + 1)
                body = src.past(inputs) if src.word(inputs) in ("(", "[") else inputs
                while body < len(src.words) and src.words[body] != "{" and src.line(body) == src.line(body - 1):
                    body = src.past(body)
                last = src.closing.get(body, body - 1) if src.word(body) == "{" else body - 1
                found.append((src.word(name), "method" if name > i + 1 else "function", None, src.line(i), src.line(min(last, len(src.words) - 1))))
            continue
        group = src.word(i + 1) == "("
        if group and i + 1 not in src.closing:
            continue
        last = src.closing[i + 1] if group else None
        for at in _go_specs(src, i + 2, last) if group else [i + 1]:
            stop = _go_end(src, at, last)
            place = src.line(i), src.line(last if group else stop - 1)
            if word == "type":
                body = src.past(at + 1) if src.word(at + 1) == "[" and src.word(src.past(at + 1)) in ("struct", "interface") else at + 1
                if src.word(body) in ("struct", "interface"):
                    found.append((src.word(at), src.word(body), f"type {src.word(at)} {src.word(body)}", *place))
                continue
            while re.match(r"[^\W\d]", src.word(at)):
                found.append((src.word(at), "constant", f"{word} {src.word(at)}", *place))
                if src.word(at + 1) != ",":
                    break
                at += 2
    return found


def _go_end(src: Source, i: int, end: int | None) -> int:
    """The token after the declaration that begins at i: the first on a later line that does not continue it."""
    i, end = src.past(i), len(src.words) if end is None else end
    while i < end and src.words[i] != ";" and (src.line(i) == src.line(i - 1) or src.words[i - 1] in tuple(",=+-*/|&<>.")):
        i = src.past(i)
    return i


def _go_specs(src: Source, i: int, end: int) -> Iterator[int]:
    while i < end:
        if src.words[i] != ";":
            yield i
        i = _go_end(src, i, end) if src.words[i] != ";" else i + 1


def script(text: str) -> Iterator[tuple[str, bool, int]]:
    """(name, exported, line) of constants and variables that hold an arrow function, over as many lines as its head takes."""
    src = Source(blanked(text, SCRIPT))
    for i, word in enumerate(src.words):
        if word not in ("const", "let") or not re.match(r"[^\W\d]|\$", src.word(i + 1)):
            continue
        name = i + 2
        while src.word(name) == "$" or re.match(r"[^\W\d]", src.word(name)) and src.words[name - 1] == "$":
            name += 1
        at = src.until(i + 1, {"=", ";", "const", "let"})
        if src.word(at) != "=":
            continue
        at += 1 + (src.word(at + 1) == "async")
        at = src.past_angles(at)
        head = src.past(at)
        if src.word(at) == "(" and src.word(head) == ":":
            head = src.until(head, {"=>", ";", "="})
        if src.word(head) == "=>":
            yield "".join(src.words[i + 1 : name]), i > 0 and src.words[i - 1] == "export", src.line(i)
