"""Substring deduplication by a relative Lempel-Ziv parse against all earlier documents.

A document is parsed from left to right into factors: stretches of words that stand at one place of an earlier document. A
factor goes on while its source goes on with the same words; then the next begins, from another place or source. A word is a
duplicate if it is in a run of WINDOW words that an earlier document has, so a factor is followed only where such runs stand:
a factor of its own has WINDOW words at least, and one that begins where another ends is checked at that boundary, where its
runs reach back into the one before. The source of a run is the first place of the least document that has it, so one source
is followed as long as it is the least; the words that go do not depend on which of several sources is named.

The reference is cut into blocks by content: a run of WINDOW words is assigned to the least hash among its GRAM-word
grams (its anchor), and consecutive runs with one anchor form a block. Equal runs of words have equal anchors, in
whatever documents they stand, so an index of blocks by anchor has every block that could continue a factor:

- where an anchor occurs in one document only, no factor begins;
- where the whole block equals one that an earlier document has, the factor takes the whole block at once;
- where blocks with one anchor differ, the factor ends somewhere within: those blocks (one for each different content) are
  checked at each word.

So long repeats cost one index entry in about 18 words, and single runs are compared only at the ends of factors. All
comparisons are of 128-bit hashes; a block's first document is a minimum, which Spark combines before it shuffles, and
the joins that look it up may be split by adaptive execution when one passage is very common.

Defined results: null and empty texts have no words; a text shorter than WINDOW is kept; rows with one id do not count
as earlier than each other, so repeated rows get equal results; rows with a null id are kept whole and are nobody's
reference; other columns pass through, but a column with the name of a result is replaced; an empty table gives an empty
result; a very long text is parsed whole, as others.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.hashing import BASES, Words, slices, stretches
from contextloom.llm.shared import drop, free_name, materialize, table

WINDOW = 50
GRAM = 16
RESULTS = ["n_words", "n_removed", "spans", "factors", "kept_text"]

_BLOCKS = "anchor long, h1 long, h2 long, doc long, row long, start int, runs int"
_RUNS = "h1 long, h2 long, doc long, row long, start int"


def least_of(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of values[i:i+width] for each i, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out, have = np.minimum(out[:-step], out[step:]), have + step
    return out


def _signed(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _blocks_of(window: int, gram: int):
    """mapInArrow function: the content-defined blocks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False)
            for at, _, data, offsets in slices(batch.column("text")):
                ws = Words(data, offsets)
                begin = ws.windows(window)
                if not len(begin):
                    continue
                h1, h2 = ws.hashes(BASES[0]), ws.hashes(BASES[1])
                places = np.arange(len(h1) - gram + 1)
                anchor = least_of(stretches(h1, places, places + gram, BASES[1]), window - gram + 1)[begin]
                new = np.ones(len(begin), dtype=bool)
                new[1:] = (np.diff(begin) != 1) | (anchor[1:] != anchor[:-1])
                first = np.flatnonzero(new)
                runs = np.diff(np.append(first, len(begin)))
                lo, hi = begin[first], begin[first] + runs - 1 + window
                owner = ws.owner[lo]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(anchor[first])),
                        pa.array(_signed(stretches(h1, lo, hi, BASES[0]))),
                        pa.array(_signed(stretches(h2, lo, hi, BASES[1]))),
                        pa.array(docs[at + owner]),
                        pa.array(rows[at + owner]),
                        pa.array((lo - ws.first[owner]).astype(np.int32)),
                        pa.array(runs.astype(np.int32)),
                    ],
                    names=["anchor", "h1", "h2", "doc", "row", "start", "runs"],
                )

    return run


def _runs_of(window: int):
    """mapInArrow function: the single runs of the listed blocks of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, rows = batch.column("doc").to_numpy(zero_copy_only=False), batch.column("row").to_numpy(zero_copy_only=False)
            blocks = batch.column("blocks")
            for at, to, data, offsets in slices(batch.column("text")):
                ws = Words(data, offsets)
                begin, owner = [], []
                for i in range(at, to):
                    for b in blocks[i].as_py():
                        lo = int(ws.first[i - at]) + b["start"]
                        begin.append(np.arange(lo, lo + b["runs"]))
                        owner.append(np.full(b["runs"], i - at))
                if not begin:
                    continue
                begin, owner = np.concatenate(begin), np.concatenate(owner)
                h1, h2 = ws.hashes(BASES[0]), ws.hashes(BASES[1])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_signed(stretches(h1, begin, begin + window, BASES[0]))),
                        pa.array(_signed(stretches(h2, begin, begin + window, BASES[1]))),
                        pa.array(docs[at + owner]),
                        pa.array(rows[at + owner]),
                        pa.array((begin - ws.first[owner]).astype(np.int32)),
                    ],
                    names=["h1", "h2", "doc", "row", "start"],
                )

    return run


_CUT = "struct<n_words: long, n_removed: long, spans: array<struct<start: int, words: int>>, factors: array<struct<start: int, words: int, source: long, source_start: int>>, kept_text: string>"


def factors_of(start: np.ndarray, runs: np.ndarray, source: np.ndarray, place: np.ndarray, window: int) -> list[dict]:
    """Factors from matches in order of start: `runs` runs of window words from start on stand in source from place on."""
    new = np.ones(len(start), dtype=bool)
    new[1:] = (start[1:] != start[:-1] + runs[:-1]) | (source[1:] != source[:-1]) | (np.diff(place - start) != 0)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(start)) - 1
    lo, hi = start[first], start[last] + runs[last] - 1 + window
    begin = lo.copy()
    begin[1:] = np.maximum(lo[1:], np.maximum.accumulate(hi)[:-1])
    at = place[first] + begin - lo
    return [{"start": a, "words": b - a, "source": d, "source_start": p} for a, b, d, p in zip(begin.tolist(), hi.tolist(), source[first].tolist(), at.tolist(), strict=True) if a < b]


def _cut(window: int):
    """Arrow UDF: what is left of each text without the words of its factors."""

    @F.arrow_udf(_CUT)
    def cut(text: pa.Array, matches: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(text, matches, strict=True):
            ws = (t.as_py() or "").encode().split()
            if not found.is_valid or not len(found):
                out.append((len(ws), 0, [], [], b" ".join(ws).decode()))
                continue
            s, r, source, place = (np.asarray(found.values.field(c), dtype=np.int64) for c in ("start", "runs", "source", "place"))
            order = np.argsort(s, kind="stable")
            factors = factors_of(s[order], r[order], source[order], place[order], window)
            edge = np.zeros(len(ws) + 1, dtype=np.int64)
            np.add.at(edge, s, 1)
            np.add.at(edge, s + r - 1 + window, -1)
            gone = np.cumsum(edge[:-1]) > 0
            turn = np.flatnonzero(np.diff(np.concatenate(([0], gone.view(np.int8), [0]))))
            spans = [{"start": int(a), "words": int(b - a)} for a, b in zip(turn[::2], turn[1::2], strict=True)]
            kept = b" ".join([w for w, g in zip(ws, gone.tolist(), strict=True) if not g])
            out.append((len(ws), int(gone.sum()), spans, factors, kept.decode()))
        names, stretch = RESULTS, [("start", pa.int32()), ("words", pa.int32())]
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.struct(stretch)), pa.list_(pa.struct([*stretch, ("source", pa.int64()), ("source_start", pa.int32())])), pa.string()]
        return pa.StructArray.from_arrays([pa.array([x[i] for x in out], type=k) for i, k in enumerate(kinds)], names=names)

    return cut


def duplicate_blocks(docs: DataFrame, window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """(doc, row, start, runs, source, place) for stretches of docs (doc, row, text) whose runs all begin in an earlier document."""
    known = docs.where("doc is not null")
    blocks = materialize(known.mapInArrow(_blocks_of(window, gram), _BLOCKS), "blocks")
    anchors = blocks.groupBy("anchor").agg(F.min("doc").alias("lo"), F.max("doc").alias("hi"), F.min("h1").alias("a"), F.max("h1").alias("b"))
    anchors = anchors.where("lo < hi").select("anchor", (F.col("a") == F.col("b")).alias("uniform"))
    shared = materialize(blocks.join(anchors, "anchor").drop("anchor"), "shared")
    drop(blocks)
    # what is looked up is a table, so both sides of the join are dealt out anew and a very common block's rows can be split
    own = F.min(F.struct("doc", "start")).alias("first")
    first = materialize(shared.groupBy("h1", "h2").agg(own).select("h1", "h2", F.col("first.doc").alias("source"), F.col("first.start").alias("place")), "first")
    marked = materialize(shared.join(first, ["h1", "h2"]).drop("h1", "h2"), "marked")
    drop(shared)
    drop(first)
    whole = marked.where("doc > source").select("doc", "row", "start", "runs", "source", "place")
    # a block that differs from others with its anchor is checked run by run, once for each content
    ends = marked.where("doc = source and not uniform").select("doc", "row", "start", "runs")
    ends = ends.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "runs")).alias("blocks"))
    runs = known.join(ends, ["doc", "row"]).select("doc", "row", "text", "blocks").mapInArrow(_runs_of(window), _RUNS)
    runs = materialize(runs, "runs")
    earliest = runs.groupBy("h1", "h2").agg(own, F.max("doc").alias("last")).where("first.doc < last").select("h1", "h2", F.col("first.doc").alias("source"), F.col("first.start").alias("place"))
    single = runs.join(materialize(earliest, "earliest"), ["h1", "h2"]).where("doc > source").select("doc", "row", "start", F.lit(1).alias("runs"), "source", "place")
    found = materialize(whole.unionByName(single), "found")
    drop(marked)
    drop(runs)
    return found


def deduplicate_substrings(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, gram: int = GRAM) -> DataFrame:
    """docs with n_words, n_removed, spans (start, words) of removed words, their factors with sources, and kept_text, the other words."""
    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_row")
    slim = docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"))
    found = duplicate_blocks(slim, window, gram)
    found = found.groupBy("doc", "row").agg(F.collect_list(F.struct("start", "runs", "source", "place")).alias("matches"))
    full = docs.select(
        F.struct(*(F.col(f"`{c}`") for c in rest)).alias(inner),
        F.col(doc_id).cast("long").alias("doc"),
        F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"),
        F.col(text).alias("text"),
    )
    out = full.join(found, ["doc", "row"], "left").withColumn("_cut", _cut(window)("text", "matches"))
    return out.select(*(F.col(f"{inner}.`{c}`") for c in rest), *(F.col(f"_cut.{c}") for c in RESULTS))


def op3_substrings(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = deduplicate_substrings(docs)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"), F.size("spans").cast("long").alias("n_spans"))
