"""Constraints, decisions and open questions from conversations.

A transcript is split into turns by its layout, lines are classified by trigger phrases, and questions are matched with
later decisions. Everything is expressions over arrays of lines within a row, one explode, and joins on
conversation and token; nothing orders or collects more than one conversation together.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from contextloom import lexicon as L
from contextloom.functions.text import contains_word, fingerprint, lines, normalize, overlap_tokens, word_position


@dataclass(frozen=True)
class Triggers:
    """Phrases that classify a line; all are whole words in lower case."""

    positive: Sequence[str] = field(default_factory=lambda: L.POSITIVE_TRIGGERS)
    negative: Sequence[str] = field(default_factory=lambda: L.NEGATIVE_TRIGGERS)
    decision: Sequence[str] = field(default_factory=lambda: L.DECISION_TRIGGERS)
    question_end: str = "?"
    extensions: Sequence[str] = field(default_factory=lambda: L.MARKER_EXTENSIONS)


HEADING = r"(?i)^\s*## (user|assistant)"
STAMP = r"^\s*\[[0-9]{1,2}:"


def layout(text: Column) -> Column:
    """markdown_heading, timestamped or blank_line, from the first 50 lines that say something."""
    first = F.slice(F.filter(lines(text), lambda x: F.trim(x) != ""), 1, 50)
    return (
        F.when(F.exists(first, lambda x: x.rlike(HEADING)), "markdown_heading")
        .when(F.exists(first, lambda x: x.rlike(STAMP)), "timestamped")
        .otherwise("blank_line")
    )


def parse_turns(files: DataFrame, text: str = "content", keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, turn_index, speaker, lines) of whole transcripts.

    Each line gets the running number of the last line that begins a turn in its layout; a turn is the lines of one number.
    """
    keys = list(keys)
    df = files.select(*keys, layout(F.col(text)).alias("layout"), F.posexplode(lines(F.col(text))).alias("at", "line"))
    w = Window.partitionBy(*keys).orderBy("at")
    df = df.withColumn("blank", F.trim(F.regexp_replace("line", r"\s", " ")) == "")
    begins = (
        F.when(F.col("layout") == "markdown_heading", F.col("line").rlike(HEADING))
        .when(F.col("layout") == "timestamped", F.col("line").rlike(STAMP))
        .otherwise(~F.col("blank") & F.coalesce(F.lag("blank").over(w), F.lit(True)))
    )
    df = df.withColumn("begins", begins)
    df = df.withColumn("block", F.sum(F.col("begins").cast("int")).over(w))
    said = F.rtrim(F.regexp_replace("line", r"\s+$", ""))
    opening = F.regexp_replace(said, r"(?i)^\s*(user:|assistant:|>)\s*", "")
    shown = (
        F.when((F.col("layout") == "markdown_heading"), said)
        .when((F.col("layout") == "timestamped") & F.col("begins"), F.regexp_replace(F.trim(said), r"^[^\]]*\]\s*", ""))
        .when(F.col("layout") == "timestamped", F.trim(said))
        .when(F.col("begins"), opening)
        .otherwise(said)
    )
    speaker = F.when(F.col("begins") & (F.col("layout") == "markdown_heading"), F.lower(F.regexp_extract("line", HEADING, 1)))
    speaker = F.when(F.col("begins") & (F.col("layout") == "blank_line"), F.lower(F.nullif(F.regexp_extract("line", r"(?i)^\s*(user|assistant):", 1), F.lit("")))).otherwise(speaker)
    df = df.withColumn("shown", shown).withColumn("speaker", speaker)
    heading = (F.col("layout") == "markdown_heading") & F.col("begins")
    lost = heading | (F.col("blank") & (F.col("layout") != "markdown_heading")) | ((F.col("layout") == "timestamped") & (F.col("block") == 0))
    kept = F.collect_list(F.when(~lost, F.struct("at", "shown")))
    turns = df.groupBy(*keys, "layout", "block").agg(F.max("speaker").alias("speaker"), F.transform(F.array_sort(kept), lambda x: x["shown"]).alias("lines"))
    full = F.when(F.col("layout") == "timestamped", F.size("lines") > 0).otherwise(F.exists("lines", lambda x: F.trim(F.regexp_replace(x, r"\s", " ")) != ""))
    turns = turns.where(full)
    return turns.select(*keys, (F.row_number().over(Window.partitionBy(*keys).orderBy("block")) - 1).cast("long").alias("turn_index"), "speaker", "lines")


def _first(positions: list[tuple[str, Column]]) -> Column:
    """Struct (trigger, position) of the first listed phrase that occurs."""
    found = F.lit(None).cast("struct<trigger: string, position: int>")
    for phrase, at in reversed(positions):
        found = F.when(at > 0, F.struct(F.lit(phrase).alias("trigger"), at.cast("int").alias("position"))).otherwise(found)
    return found


def classify(line: Column, triggers: Triggers | None = None, skip_comments: bool = False) -> Column:
    """Struct (classification, confidence, polarity, trigger) of a line, null if it says nothing of the kind."""
    t = triggers or Triggers()
    text = F.trim(F.regexp_replace(line, r"^\s+|\s+$", ""))
    low = F.lower(text)
    ends = text.endswith(t.question_end)
    words = F.size(F.split(text, r"\s+"))
    clause = F.regexp_instr(low, F.lit("[" + "".join(L.CLAUSE_MARKS) + "]"))

    def by(kind: str, phrases: Sequence[str]) -> tuple[Column, Column]:
        at = [(p, word_position(low, p)) for p in phrases]
        count = sum(((p > 0).cast("int") for _, p in at), F.lit(0))
        first = _first(at)
        place = first["position"]
        before, after = F.substring(low, F.lit(1), place - 1), F.substring(low, place + F.char_length(first["trigger"]), F.char_length(low))
        person = F.arrays_overlap(F.split(before, r"\s+"), F.array(*map(F.lit, L.FIRST_PERSON)))
        c = L.CONFIDENCE
        part = lambda test, name: F.when(test, F.lit(c[name]).cast("float")).otherwise(F.lit(0.0).cast("float"))
        score = F.lit(c["match"]).cast("float") + part(person, "first_person") + part((clause == 0) | (place < clause), "first_clause")
        score = score + F.lit(c["further"]).cast("float") * (count - 1).cast("float") + part((words < L.SHORT_WORDS) & ~ends, "short")
        polarity = F.lit(None).cast("string")
        if kind == "constraint":
            next_two = F.slice(F.filter(F.split(after, r"\s+"), lambda w: w != ""), 1, 2)
            denied = first["trigger"].isin(*t.negative) | F.arrays_overlap(next_two, F.array(*map(F.lit, L.NEGATIONS)))
            polarity = F.when(denied, "negative").otherwise("positive")
        return count > 0, F.struct(F.lit(kind).alias("classification"), F.least(score.cast("float"), F.lit(1.0).cast("float")).alias("confidence"), polarity.alias("polarity"), first["trigger"].alias("trigger"))

    is_constraint, constraint = by("constraint", [*t.positive, *t.negative])
    is_decision, decision = by("decision", list(t.decision))
    question = F.struct(F.lit("open_question").alias("classification"), F.lit(L.QUESTION_CONFIDENCE).cast("float").alias("confidence"), F.lit(None).cast("string").alias("polarity"), F.lit(t.question_end).alias("trigger"))
    found = F.when(is_constraint, constraint).when(is_decision, decision).when(ends, question)
    if skip_comments:
        comment = F.lit(False)
        for mark in L.COMMENT_MARKS:
            comment = comment | text.startswith(mark)
        found = F.when(~comment, found)
    return F.when(text != "", found)


def extract_items(turns: DataFrame, keys: Sequence[str] = ("conv_id",), triggers: Triggers | None = None, skip_comments: bool = False) -> DataFrame:
    """Classified lines (keys, turn_index, line_no, text, fingerprint, classification, confidence, polarity), each text once a class."""
    keys = list(keys)
    df = turns.select(*keys, "turn_index", F.posexplode("lines").alias("line_no", "line"))
    df = df.withColumn("text", F.trim(F.regexp_replace("line", r"^\s+|\s+$", ""))).withColumn("found", classify(F.col("line"), triggers, skip_comments)).where("found is not null")
    df = df.select(*keys, "turn_index", "line_no", "text", fingerprint(normalize(F.col("text"), keep_prefix=True)).alias("fingerprint"), "found.classification", "found.confidence", "found.polarity")
    return first_of(df, [*keys, "classification", "fingerprint"], ["turn_index", "line_no"])


def first_of(df: DataFrame, same: list[str], order: list[str]) -> DataFrame:
    """The first row of each group of equals."""
    w = Window.partitionBy(*same).orderBy(*order)
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def extract_markers(turns: DataFrame, keys: Sequence[str] = ("conv_id",), extensions: Sequence[str] | None = None) -> DataFrame:
    """(keys, turn_index, line_no, word_no, file, fingerprint): words that look like file paths; repeats stay."""
    keys = list(keys)
    kinds = "|".join(map(str, extensions or L.MARKER_EXTENSIONS))
    df = turns.select(*keys, "turn_index", F.posexplode("lines").alias("line_no", "line"))
    df = df.select(*keys, "turn_index", "line_no", F.posexplode(F.split("line", r"\s+")).alias("word_no", "word"))
    df = df.withColumn("file", F.regexp_replace("word", r"^[\"'`()\[\],;]+|[\"'`()\[\],;]+$", ""))
    df = df.where(F.col("file").rlike(rf"^[\p{{IsAlphabetic}}\p{{N}}_\-./]+\.({kinds})$"))
    return df.select(*keys, "turn_index", "line_no", "word_no", "file", fingerprint(normalize(F.col("file"), keep_prefix=True)).alias("fingerprint"))


def resolve(items: DataFrame, keys: Sequence[str] = ("conv_id",), least: float = L.RESOLVED_OVERLAP) -> DataFrame:
    """items with resolved_by: the earliest later decision whose words overlap enough with an open question.

    An overlap above 0 needs a word in common, so candidates come from an equi-join on words within a conversation. Only sizes
    of word sets travel with the words, and neither side is sent to the driver: AQE sees its size from before the explode.
    """
    keys = list(keys)
    if "resolved_by" not in items.columns:
        items = items.withColumn("resolved_by", F.lit(None).cast("long"))
    words = items.select(*keys, "classification", "turn_index", "fingerprint", "resolved_by", overlap_tokens(F.col("text")).alias("words"))
    # words have no white space, so their md5 stands for the set; equal rows count once
    one_each = lambda df, side: df.withColumn(f"{side}_set", F.md5(F.array_join("words", " "))).dropDuplicates([c for c in df.columns if c != "words"] + [f"{side}_set"])
    spread = lambda df, side: one_each(df, side).withColumn(f"{side}_size", F.size("words")).withColumn("word", F.explode("words")).drop("words")
    q = words.where("classification = 'open_question' and resolved_by is null").select(*keys, F.col("turn_index").alias("q_turn"), F.col("fingerprint").alias("q_mark"), "words")
    d = words.where("classification = 'decision'").select(*keys, F.col("turn_index").alias("d_turn"), "words")
    meet = spread(q, "q").join(spread(d, "d").hint("merge"), [*keys, "word"]).where("d_turn > q_turn")
    shared = meet.groupBy(*keys, "q_turn", "q_mark", "q_set", "d_turn", "d_set").agg(F.count("*").alias("both"), (F.first("q_size") + F.first("d_size")).alias("sizes"))
    close = shared.where((F.col("both") / (F.col("sizes") - F.col("both"))).cast("float") >= F.lit(least).cast("float"))
    found = close.groupBy(*keys, "q_turn", "q_mark").agg(F.min("d_turn").alias("_by"))
    found = found.withColumnsRenamed({"q_turn": "turn_index", "q_mark": "fingerprint"}).withColumn("classification", F.lit("open_question"))
    out = items.join(found, [*keys, "turn_index", "fingerprint", "classification"], "left")
    return out.withColumn("resolved_by", F.coalesce("resolved_by", F.col("_by").cast("long"))).drop("_by")


def merge(items: DataFrame, turn_counts: DataFrame, keys: Sequence[str], ordinal: str, per_file: str) -> DataFrame:
    """One memory from several transcripts: turns are numbered on, a text counts once a class, leftovers are resolved.

    items: (keys, per_file, .., turn_index, resolved_by); turn_counts: (keys, per_file, ordinal, turn_count).
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy(ordinal).rowsBetween(Window.unboundedPreceding, -1)
    shift = turn_counts.select(*keys, per_file, F.coalesce(F.sum("turn_count").over(w), F.lit(0)).alias("_shift"))
    df = items.join(shift, [*keys, per_file]).withColumns({"turn_index": F.col("turn_index") + F.col("_shift"), "resolved_by": F.col("resolved_by") + F.col("_shift")}).drop("_shift")
    return resolve(first_of(df, [*keys, "classification", "fingerprint"], ["turn_index", "line_no"]), keys)


def since(items: DataFrame, turn: int) -> DataFrame:
    """Items from a turn on; a resolution by an earlier turn is forgotten."""
    return items.where(F.col("turn_index") >= turn).withColumn("resolved_by", F.when(F.col("resolved_by") >= turn, F.col("resolved_by")))


def stages(markers: DataFrame, turn_counts: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """(keys, stage_index, label, start_turn, end_turn): a stage begins at each turn that mentions files."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("start_turn")
    files = F.transform(F.array_sort(F.collect_list(F.struct("line_no", "word_no", "file"))), lambda x: x["file"])
    label = F.aggregate(files, F.lit("").cast("string"), lambda acc, f: F.when(acc == "", f).when(F.contains(acc, f), acc).otherwise(F.concat(acc, F.lit(", "), f)))
    starts = markers.groupBy(*keys, F.col("turn_index").alias("start_turn")).agg(label.alias("label"))
    begun = starts.groupBy(*keys).agg(F.min("start_turn").alias("first"))
    initial = turn_counts.join(begun, keys, "left").where("first is null or first > 0").select(*keys, F.lit(0).cast("long").alias("start_turn"), F.lit("Initial").alias("label"))
    every = starts.unionByName(initial).join(turn_counts, keys)
    last = F.greatest(F.col("turn_count") - 1, F.lit(0))
    return every.select(*keys, (F.row_number().over(w) - 1).cast("long").alias("stage_index"), "label", "start_turn", F.coalesce(F.lead("start_turn").over(w) - 1, last).cast("long").alias("end_turn"))


def stage_items(items: DataFrame, staged: DataFrame, keys: Sequence[str] = ("conv_id",)) -> DataFrame:
    """items with the stage whose turns hold them: an equi-join on the conversation with a range."""
    keys = list(keys)
    return items.join(staged, keys).where("turn_index between start_turn and end_turn")


def mentions(files: DataFrame, markers: DataFrame, path: str = "path", loose: bool = True) -> DataFrame:
    """(path, marker, turn_index): markers of files; loose: either path ends with the other.

    An equality of last path parts finds nearly all pairs; names that are only the end of another's last part are met by
    the markers whose last part differs, a distinct and short list that is compared with its own length of ends.
    """
    base = lambda c: F.element_at(F.split(c, "/"), -1)
    f = files.select(F.col(path).alias("path")).distinct()
    m = markers.select(F.col("file").alias("marker"), "turn_index")
    if not loose:
        return f.join(m, F.col("path") == F.col("marker")).select("path", "marker", "turn_index")
    names = m.select("marker").distinct()
    # all ends of a file's last part, so that a marker that is one of them meets it by equality, and the other way round
    ends = lambda c: F.transform(F.sequence(F.lit(1), F.char_length(c)), lambda i: F.substring(c, i, F.char_length(c)))
    left = f.select("path", F.explode(F.array_distinct(ends(base(F.col("path"))))).alias("end")).join(names.select("marker", base(F.col("marker")).alias("end")), "end")
    right = names.select("marker", F.explode(F.array_distinct(ends(base(F.col("marker"))))).alias("end")).join(f.select("path", base(F.col("path")).alias("end")), "end")
    pairs = left.select("path", "marker").unionByName(right.select("path", "marker")).distinct()
    pairs = pairs.where(F.endswith("path", "marker") | F.endswith("marker", "path"))
    return pairs.join(m, "marker").select("path", "marker", "turn_index")


def mention_strength(found: DataFrame, items: DataFrame) -> DataFrame:
    """(path, mentions, confidence): how often a file is mentioned; confidences at those turns, summed, over mentions."""
    counts = found.groupBy("path").agg(F.count("*").alias("mentions"))
    at = found.select("path", "turn_index").distinct().join(items.select("turn_index", "confidence"), "turn_index").groupBy("path").agg(F.sum("confidence").alias("total"))
    return counts.join(at, "path", "left").select("path", "mentions", (F.coalesce("total", F.lit(0.0)) / F.col("mentions")).alias("confidence"))


def has_trigger(line: Column, phrases: Sequence[str]) -> Column:
    test = F.lit(False)
    for p in phrases:
        test = test | contains_word(F.lower(line), p)
    return test
