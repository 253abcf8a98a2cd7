"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are short and documents may be long, so the Jaccard similarity of the two says little. Items are partitioned by
size: class c has items of up to 2**c distinct shingles. For each class a document is cut into segments of twice that
many shingles, each overlapping the next by half, so a passage of a class lies whole in one segment, with a Jaccard
similarity to its item of 0.19 at least. Segment and item get `hashes` MinHash values, and each value that a segment shares
with an item of the class makes a candidate: the chance to miss a passage is below 0.2 percent at worst and 0.0001 for a
whole copy of the median size. A candidate counts only if the document has the given share of the item's shingles, compared
as words.

Only items travel, in blocks of about BLOCK_BYTES of text, AT_ONCE blocks in one plan; documents are never shuffled. With
more blocks, documents and what is found so far are written to the shared folder after each AT_ONCE of them.

Defined results: A-Z are lower-cased; null or blank texts and items match nothing; fewer words than a shingle needs make
one shingle, which equals only another text's whole; repeated rows are judged one by one and repeated items all named; other
columns pass through, but a column with the name of a result is replaced; an empty table on either side gives no match.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.hashing import BASES, LOWER, Words, mix, slices, stretches
from contextloom.llm.shared import drop, free_name, materialize, table

SHINGLE = 5
CONTAINED = 0.8
HASHES = 32
BLOCK_BYTES = 4 << 20
AT_ONCE = 8
RESULTS = ["contaminated", "n_items", "item_ids", "containment"]


def word_shingles(text: str, size: int) -> set[tuple[bytes, ...]]:
    ws = LOWER[np.frombuffer(text.encode(), dtype=np.uint8)].tobytes().split()
    return {tuple(ws[i : i + size]) for i in range(max(1, len(ws) - size + 1))} if ws else set()


def shingle_hashes(ws: Words, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles of all texts, and bounds: text i has those from bounds[i] to bounds[i + 1]."""
    hashes, n = ws.hashes(), np.diff(ws.first)
    count = np.where(n >= size, n - size + 1, np.minimum(n, 1))
    bounds = np.concatenate(([0], np.cumsum(count)))
    start = np.repeat(ws.first[:-1] - bounds[:-1], count) + np.arange(bounds[-1])
    end = np.minimum(start + size, np.repeat(ws.first[1:], count))
    return stretches(hashes, start, end, BASES[1]), bounds


def multipliers(hashes: int) -> np.ndarray:
    """Odd factors; times one of them modulo 2**64, mixed hashes come in another order."""
    return mix(np.arange(1, hashes + 1, dtype=np.uint64) * np.uint64(BASES[0])) | np.uint64(1)


class ItemIndex:
    """MinHash values of a block of items by size class, with the items' shingles."""

    def __init__(self, items: list[tuple[int, str]], size: int, share: float, hashes: int):
        self.size, self.share, self.factors = size, share, multipliers(hashes)
        self.ids, self.shingles, by_class = [], [], {}
        for item, text in items:
            own = word_shingles(text or "", size)
            if own:
                column = pa.array([text], pa.string())
                _, _, data, offsets = next(slices(column))
                h, _ = shingle_hashes(Words(data, offsets, lower=True), size)
                by_class.setdefault((len(own) - 1).bit_length(), []).append((len(self.ids), [(h * f).min() for f in self.factors]))
                self.ids.append(item)
                self.shingles.append(own)
        #: class: for each hash the sorted values with their items, and which low 16 bits occur
        self.classes = {}
        for c, rows in sorted(by_class.items()):
            values = np.array([v for _, v in rows], dtype=np.uint64)
            owner = np.array([i for i, _ in rows])
            self.classes[c] = []
            for k in range(hashes):
                order = np.argsort(values[:, k], kind="stable")
                seen = np.zeros(1 << 16, dtype=bool)
                seen[values[:, k] & np.uint64(0xFFFF)] = True
                self.classes[c].append((values[order, k], owner[order], seen))

    def candidates(self, h: np.ndarray, bounds: np.ndarray) -> set[tuple[int, int]]:
        """(text, item) that share a MinHash value in a segment."""
        found: set[tuple[int, int]] = set()
        count = np.diff(bounds)
        if not len(h) or not self.classes:
            return found
        at = {}
        for c in self.classes:
            blocks = (count + (1 << c) - 1) >> c
            first = np.concatenate(([0], np.cumsum(blocks)))
            owner = np.repeat(np.arange(len(count)), blocks)
            begin = np.repeat(bounds[:-1] - (first[:-1] << c), blocks) + (np.arange(first[-1]) << c)
            joined = np.flatnonzero(owner[1:] == owner[:-1]) if len(owner) > 1 else np.zeros(0, dtype=np.int64)
            at[c] = (begin, owner, joined)
        for k, factor in enumerate(self.factors):
            values = h * factor
            for c, index in self.classes.items():
                begin, owner, joined = at[c]
                least = np.minimum.reduceat(values, begin)
                both = least.copy()
                both[joined] = np.minimum(least[joined], least[joined + 1])
                known, items, seen = index[k]
                for i in np.flatnonzero(seen[both & np.uint64(0xFFFF)]):
                    lo, hi = np.searchsorted(known, both[i]), np.searchsorted(known, both[i], side="right")
                    found.update((int(owner[i]), int(x)) for x in items[lo:hi])
        return found

    def matches(self, column: pa.Array) -> list[list[tuple[int, float]]]:
        """For each text the (item id, containment) that reach the share."""
        out: list[list[tuple[int, float]]] = [[] for _ in range(len(column))]
        for at, _, data, offsets in slices(column):
            h, bounds = shingle_hashes(Words(data, offsets, lower=True), self.size)
            last, own = -1, set()
            for text, item in sorted(self.candidates(h, bounds)):
                if text != last:
                    last, own = text, word_shingles(column[at + text].as_py() or "", self.size)
                inside = len(self.shingles[item] & own)
                if inside >= self.share * len(self.shingles[item]):
                    out[at + text].append((self.ids[item], inside / len(self.shingles[item])))
        return out


def _found_in(index):
    @F.arrow_udf("array<struct<item: long, share: double>>")
    def found(text: pa.Array) -> pa.Array:
        kind = pa.list_(pa.struct([("item", pa.int64()), ("share", pa.float64())]))
        return pa.array([[{"item": i, "share": s} for i, s in row] for row in index.value.matches(text)], type=kind)

    return found


def find_items(
    docs: DataFrame, items: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text", size: int = SHINGLE, share: float = CONTAINED, hashes: int = HASHES, block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """docs with contaminated, n_items, item_ids and the highest containment (0 if none)."""
    slim = items.select(F.col(item_id).cast("long").alias("item"), F.col(item_text).alias("text")).where("text is not null")
    total = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-2 * total // block_bytes))
    rest = [c for c in docs.columns if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_row")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in rest)).alias(inner), F.col(text).alias("_text"))
    parts, sent, before = [], [], None
    for k in range(blocks):
        if len(sent) == AT_ONCE:
            written = materialize(df.select(inner, "_text", F.concat(*parts).alias("_known")), "decontam")
            if before is not None:
                drop(before)
            for index in sent:
                index.destroy()
            df, before, parts, sent = written, written, [F.col("_known")], []
        block = slim.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == k).collect()
        sent.append(docs.sparkSession.sparkContext.broadcast(ItemIndex([(r.item, r.text) for r in block], size, share, hashes)))
        df = df.withColumn(f"_found{k}", _found_in(sent[-1])("_text"))
        parts.append(F.col(f"_found{k}"))
    df = df.withColumn("_found", F.array_sort(F.concat(*parts)))
    return df.select(
        *(F.col(f"{inner}.`{c}`") for c in rest),
        (F.size("_found") > 0).alias("contaminated"),
        F.size("_found").cast("long").alias("n_items"),
        F.col("_found.item").alias("item_ids"),
        F.coalesce(F.array_max("_found.share"), F.lit(0.0)).alias("containment"),
    )


def op7_decontaminate(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return find_items(docs, table(spark, sf_dir, "benchmark")).select("doc_id", *RESULTS)
