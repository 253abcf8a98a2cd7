"""Quality rules by distribution divergence, in DataFrame functions only.

A document's histogram of character classes (Unicode categories of code points) and its histogram of common words are compared with those of each
reference language by the Jensen-Shannon distance (base 2, so 0 to 1). A document that is close to no language in
both is rejected; too short a text gets no verdict from a histogram, nor does one that is labelled with a language without
a reference, as no reference tells what its histograms should be. Plain base rules come before. References are fitted for
the languages of common_words; a document without a label is held against all of them.

Defined results: a null text counts as empty; an empty text has zero counts and fails the base rules; repeated rows
are judged one by one; a very long text is measured whole; other columns pass through, but a column with the name of a result is replaced by it; an empty
table gives an empty result, and with no reference language only the base rules hold.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.llm.shared import flat, flat_words, free_name, materialize, table

#: Frequent function words by language, the bins of the word histograms.
COMMON_WORDS = {
    "de": "der die und in den von zu das mit des für ist".split(),
    "en": "the of and to in is that it for as was on".split(),
    "es": "de la que el en y los del las por un con".split(),
    "fr": "de la le et les des en un du que est pour".split(),
}

#: Classes of code points by Unicode category, besides white space between words; what is in none is "other".
CLASSES = {"upper": r"\p{Lu}", "lower": r"\p{Ll}", "letter": r"\p{Lt}\p{Lm}\p{Lo}", "mark": r"\p{M}", "digit": r"\p{N}", "point": r"\p{P}", "symbol": r"\p{S}"}
CHAR_BINS = ["space", *CLASSES, "other"]

BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
RESULTS = [*BASE, "base_failed", "near_lang", "js_chars", "js_words", "kept"]


@dataclass(frozen=True)
class QualityRules:
    """Limits; a distance is judged only over at least so many characters or words."""

    min_words: int = 50
    max_repeat_percent: int = 50
    max_js_chars: float = 0.28
    max_js_words: float = 0.255
    guard_chars: int = 200
    guard_words: int = 80
    common_words: dict[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _long(c: Column) -> Column:
    return c.cast("long")


def measure(docs: DataFrame, text: str, rules: QualityRules) -> DataFrame:
    """docs with the columns of BASE, q_chars (counts of CHAR_BINS) and q_<lang> (of its common words, then of the others)."""
    every = sorted({w for ws in rules.common_words.values() for w in ws})
    df = docs.withColumn("q_text", F.coalesce(F.col(text), F.lit("")))
    df = df.withColumn("q_flat", flat(F.col("q_text")))
    df = df.withColumn("q_words", flat_words(F.col("q_flat"))).withColumn("q_n", F.size("q_words"))
    # in most texts what is neither a lower-case letter of ASCII nor white space is short, so the rest reads little
    df = df.withColumn("q_odd", F.regexp_replace("q_flat", r"[a-z\x20]+", ""))
    df = df.withColumn("word_chars", _long(F.char_length("q_flat") - F.greatest(F.col("q_n") - 1, F.lit(0))))
    of = {k: F.char_length(F.regexp_replace("q_odd", f"[^{c}]+", "")) for k, c in CLASSES.items()}
    df = df.withColumn("q_odds", F.array(*of.values()))
    known = [F.get("q_odds", F.lit(i)) for i in range(len(of))]
    known[list(of).index("lower")] += F.col("word_chars") - F.char_length("q_odd")
    spaces = F.char_length("q_text") - F.col("word_chars")
    other = F.char_length("q_odd") - F.aggregate("q_odds", F.lit(0), lambda a, x: a + x)
    df = df.withColumn("q_chars", F.array(*map(_long, [spaces, *known, other])))
    hits = F.array_join(F.filter("q_words", lambda w: w.isin(every)), "  ")
    df = df.withColumn("q_hits", F.concat(F.lit(" "), hits, F.lit(" ")))
    for lang, own in rules.common_words.items():
        # each hit stands between two spaces of its own, so what a replacement takes away counts it
        per = [(F.octet_length("q_hits") - F.octet_length(F.replace(F.col("q_hits"), F.lit(f" {w} "), F.lit("")))) / len(f" {w} ".encode()) for w in own]
        df = df.withColumn(f"q_{lang}", F.array(*map(_long, per)))
        total = F.aggregate(F.col(f"q_{lang}"), F.lit(0).cast("long"), lambda a, x: a + x)
        df = df.withColumn(f"q_{lang}", F.concat(F.col(f"q_{lang}"), F.array(_long(F.col("q_n")) - total)))
    df = df.withColumn("q_bits", F.char_length(F.bin("q_n")))
    df = df.withColumn("q_sorted", sorted_windows(F.col("q_words"), F.col("q_n"), F.col("q_bits")))
    up = lambda x: F.call_function("shiftright", x, F.col("q_bits"))
    low = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("q_bits")) - 1
    word = lambda x, k: F.get("q_words", x.bitwiseAND(low).cast("int") + k)
    # equal hashes are few, and their words decide
    same = lambda x, y: F.coalesce((up(x) == up(y)) & (word(x, 0) == word(y, 0)) & (word(x, 1) == word(y, 1)) & (word(x, 2) == word(y, 2)), F.lit(False))
    at = lambda i: F.get(F.col("q_sorted"), i)
    df = df.withColumn("q_twice", F.filter("q_sorted", lambda x, i: same(x, at(i - 1)) | same(x, at(i + 1))))
    covered = F.flatten(F.transform("q_twice", lambda x: F.sequence(x.bitwiseAND(low), x.bitwiseAND(low) + 2)))
    df = df.withColumn("q_lines", F.filter(F.split("q_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
    return df.withColumns(
        {
            "n_words": _long(F.col("q_n")),
            "n_symbols": _long(F.char_length(F.regexp_replace("q_odd", "[^#*$%&|<>]+", ""))),
            "n_dup_lines": _long(F.size("q_lines") - F.size(F.array_distinct("q_lines"))),
            "n_repeat_words": _long(F.size(F.array_distinct(covered))),
        }
    )


def fit_references(measured: DataFrame, lang: str, rules: QualityRules) -> dict:
    """{language: (class shares, common-word shares)} over all long enough documents labelled with it.

    One row for each language of rules.common_words comes to the driver, whatever the size of the table.
    """
    df = measured.where(F.col(lang).isin(list(rules.common_words)) & (F.col("n_words") >= rules.guard_words))
    own = F.lit(None).cast("array<long>")
    for code in rules.common_words:
        own = F.when(F.col(lang) == code, F.col(f"q_{code}")).otherwise(own)
    sizes = [len(CHAR_BINS), max(map(len, rules.common_words.values())) + 1]
    df = df.select(F.col(lang).alias("lang"), "q_chars", own.alias("q_own"))
    sums = [F.sum(F.get(F.col(c), F.lit(i))).alias(f"{c}{i}") for c, k in zip(("q_chars", "q_own"), sizes, strict=True) for i in range(k)]
    found = {}
    for row in df.groupBy("lang").agg(*sums).collect():
        hists = []
        for c, k in (("q_chars", sizes[0]), ("q_own", len(rules.common_words[row["lang"]]) + 1)):
            values = [row[f"{c}{i}"] or 0 for i in range(k)]
            hists.append([v / max(1, sum(values)) for v in values])
        found[row["lang"]] = tuple(hists)
    return dict(sorted(found.items()))


def js_distance(counts: Column, total: Column, reference: list[float]) -> Column:
    """Jensen-Shannon distance of counts/total from the reference shares; null if total is 0.

    With f(x) = x log2 x the divergence is the sum of (f(p) + f(q)) / 2 - f((p + q) / 2), of which f(q) is a constant.
    """
    f = lambda x: x * F.log2(F.greatest(x, F.lit(1e-300)))
    fixed = sum(q * math.log2(q) for q in reference if q > 0) / 2
    own = F.transform(counts, lambda c: c / total)
    terms = F.zip_with(own, F.array(*map(F.lit, reference)), lambda p, q: f(p) / 2 - f((p + q) / 2))
    divergence = F.aggregate(terms, F.lit(fixed), lambda a, x: a + x)
    return F.when(total > 0, F.round(F.sqrt(F.greatest(divergence, F.lit(0.0))), 6))


def sorted_windows(ws: Column, n: Column, bits: Column) -> Column:
    """The 3-word windows as sorted longs: a hash above, the place in the low bits (as many as places need).

    A sort of primitive longs brings equal windows together in n log n, however long or repetitive a text is.
    """
    window = lambda i: F.xxhash64(F.get(ws, i), F.get(ws, i + 1), F.get(ws, i + 2))
    packed = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.call_function("shiftleft", window(i), bits).bitwiseOR(i.cast("long")))
    return F.when(n >= 3, F.sort_array(packed)).otherwise(F.array().cast("array<bigint>"))


def judge(measured: DataFrame, references: dict, rules: QualityRules) -> DataFrame:
    """measured (with q_lang, the label) with base_failed, near_lang, js_chars, js_words and kept; a narrow transformation of small columns."""
    failed = (F.col("n_words") < rules.min_words) | (100 * F.col("n_repeat_words") > rules.max_repeat_percent * F.col("n_words"))
    df = measured.withColumn("base_failed", failed)
    n_chars = F.aggregate("q_chars", F.lit(0).cast("long"), lambda a, x: a + x)
    df = df.withColumn("q_size", n_chars)
    ranked = []
    for lang, (chars, common) in references.items():
        js = F.struct(js_distance(F.col("q_chars"), F.col("q_size"), chars).alias("chars"), js_distance(F.col(f"q_{lang}"), F.col("n_words"), common).alias("words"))
        df = df.withColumn(f"q_js_{lang}", js)
        far = lambda part, lang=lang: F.coalesce(F.col(f"q_js_{lang}.{part}"), F.lit(1.0))
        ranked.append(F.struct((far("chars") + far("words")).alias("sum"), F.lit(lang).alias("lang"), F.col(f"q_js_{lang}").alias("js")))
    none = F.struct(F.lit(None).cast("double").alias("sum"), F.lit(None).cast("string").alias("lang"), F.struct(F.lit(None).cast("double").alias("chars"), F.lit(None).cast("double").alias("words")).alias("js"))
    df = df.withColumn("q_best", F.array_min(F.array(*ranked)) if ranked else none)
    df = df.withColumns({"near_lang": F.col("q_best.lang"), "js_chars": F.col("q_best.js.chars"), "js_words": F.col("q_best.js.words")})
    fits = lambda js, limit, n, guard: (n < guard) | js.isNull() | (js <= limit)
    verdict = fits(F.col("js_chars"), rules.max_js_chars, F.col("q_size"), rules.guard_chars) & fits(F.col("js_words"), rules.max_js_words, F.col("n_words"), rules.guard_words)
    foreign = F.col("q_lang").isNotNull() & ~F.col("q_lang").isin(list(references))
    return df.withColumn("kept", ~F.col("base_failed") & (foreign | verdict))


def quality_rules(
    docs: DataFrame, text: str = "text", lang: str = "lang", rules: QualityRules | None = None, references: dict | None = None, carry: list[str] | None = None
) -> DataFrame:
    """The columns in carry (all, if None) of every row of docs with RESULTS: counts, nearest language, distances, verdict.

    Texts are read once: the small measurements go to a table, from which the references are summed and the verdicts made.
    """
    rules = rules or QualityRules()
    carried = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_row")
    row = F.struct(*(F.col(f"`{c}`") for c in carried)) if carried else F.lit(None).cast("string")
    df = docs.select(row.alias(inner), F.col(text).alias("q_in"), F.col(lang).alias("q_lang"))
    small = [inner, "q_lang", *BASE, "q_chars", *(f"q_{x}" for x in rules.common_words)]
    df = materialize(measure(df, "q_in", rules).select(*small), "measured")
    if references is None:
        references = fit_references(df, "q_lang", rules)
    out = judge(df, references, rules)
    return out.select(*(F.col(f"{inner}.`{c}`") for c in carried), *RESULTS)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return quality_rules(docs, carry=["doc_id"])
