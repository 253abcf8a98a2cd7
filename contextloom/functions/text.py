"""Text scalars as column expressions: they stay in the JVM and take part in pushdown and pruning."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from contextloom.lexicon import STOP_WORDS

WORD_CHARS = r"\p{IsAlphabetic}\p{N}"


def tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Lower-cased runs of letters and digits of two bytes or more that are no stop words; repeats stay."""
    parts = F.split(F.lower(text), f"[^{WORD_CHARS}]+")
    return F.filter(parts, lambda w: (F.octet_length(w) >= 2) & ~w.isin(*stop_words))


def symbol_tokens(name: Column) -> Column:
    """Parts of an identifier at underscores and changes of case, lower-cased; stop words stay."""
    parts = F.split(name, r"_+|(?<=\p{Ll})(?=\p{Lu})|(?<=\p{Lu})(?=\p{Lu}\p{Ll})")
    return F.filter(F.transform(parts, F.lower), lambda w: F.octet_length(w) >= 2)


def normalize(text: Column, keep_prefix: bool = False) -> Column:
    """Text in a form to compare: lower case, few signs, single spaces; without speaker, heading, quote and time marks."""
    s = F.lower(text)
    if not keep_prefix:
        for prefix in (r"^\s*user:", r"^\s*assistant:", r"^\s*##? ", r"^\s*> ", r"^\s*\[(?=[\d:]*:)[\d:]*\]\s*"):
            s = F.regexp_replace(s, prefix, "")
    s = F.replace(s, F.lit("'"), F.lit(""))
    s = F.regexp_replace(s, rf"[^{WORD_CHARS}_\-./]+", " ")
    return F.trim(s)


def fingerprint(*parts: Column) -> Column:
    """16 hex digits that are equal for equal parts."""
    return F.substring(F.sha2(F.concat_ws("::", *parts), 256), 1, 16)


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def whole_word(phrase: str) -> str:
    """Pattern of a phrase with neither a letter, digit nor underscore beside it; the empty phrase matches nothing."""
    side = f"[{WORD_CHARS}_]"
    return f"(?<!{side}){re.escape(phrase)}(?!{side})" if phrase else r"(?!)"


def word_position(text: Column, phrase: str) -> Column:
    """1-based place of the first whole-word occurrence, 0 if there is none."""
    return F.regexp_instr(text, F.lit(whole_word(phrase)))


def contains_word(text: Column, phrase: str) -> Column:
    return text.rlike(whole_word(phrase))


def overlap_tokens(text: Column, stop_words: Sequence[str] = STOP_WORDS) -> Column:
    """Set of words without outer signs and stop words."""
    trimmed = F.transform(F.split(F.lower(text), r"\s+"), lambda w: F.regexp_replace(w, rf"^[^{WORD_CHARS}]+|[^{WORD_CHARS}]+$", ""))
    return F.array_distinct(F.filter(trimmed, lambda w: (w != "") & ~w.isin(*stop_words)))


def token_overlap(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets from overlap_tokens; 0 if both are empty."""
    both, either = F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b))
    return F.when(either == 0, 0.0).otherwise(both / either)


def byte_tokens(text: Column) -> Column:
    """Estimated tokens: a quarter of the bytes."""
    return F.floor(F.octet_length(text) / 4).cast("long")


def lines(text: Column) -> Column:
    """Array of lines; one line end at the very end begins no further line, and no text has none."""
    body = F.regexp_replace(text, r"\r?\n\z", "")
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\r?\n"))


def split_lines(text: str | None) -> list[str]:
    """The same lines in Python: only a newline, with or without a return before it, ends a line."""
    return re.split(r"\r?\n", re.sub(r"\r?\n\Z", "", text)) if text else []


def cut_bytes(text: Column, most: Column | int) -> Column:
    """The longest prefix of at most so many bytes that ends with a whole character."""
    most = F.lit(most) if isinstance(most, int) else most
    raw = text.cast("binary")
    # a character has four bytes at most, so one of four cuts ends between two characters
    tries = [F.try_validate_utf8(F.substring(raw, F.lit(1), F.greatest(most - k, F.lit(0))).cast("string")) for k in range(4)]
    return F.when(F.octet_length(text) <= most, text).otherwise(F.coalesce(*tries, F.lit("")))


def round4(score: Column) -> Column:
    """Half away from zero in the fourth place, of the scaled double."""
    return F.round(score * 10000) / 10000
