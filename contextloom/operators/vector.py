"""Chunks, their vectors, nearest neighbours and an index that follows its files."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from contextloom.functions.text import content_hash, lines, split_lines
from contextloom.lexicon import CHUNK_OVERLAP, CHUNK_TOKENS, CHUNK_WEIGHT, NEAREST, SYMBOL_WEIGHT

CHUNK = "path string, chunk_index int, text string, content_hash string, start_line int, end_line int"


@dataclass(frozen=True)
class VectorConfig:
    """Settings of an index; those of a file's [vector] section replace the defaults."""

    enabled: bool = True
    model: str = "all-MiniLM-L6-v2"
    dimension: int = 384
    chunk_tokens: int = CHUNK_TOKENS
    chunk_overlap: int = CHUNK_OVERLAP
    top_k: int = NEAREST
    weight: float = 0.30
    batch: int = 256

    @classmethod
    def load(cls, path: str) -> VectorConfig:
        import tomllib
        from pathlib import Path

        file = Path(path)
        own = tomllib.loads(file.read_text()).get("vector", {}) if file.exists() else {}
        return cls(**{k: v for k, v in own.items() if k in cls.__dataclass_fields__})


# Known embedding models and the sizes of their vectors.
MODELS = {"AllMiniLML6V2": 384, "AllMiniLML12V2": 384, "BGESmallENV15": 384, "BGEBaseENV15": 768, "BGELargeENV15": 1024}


def dimension_of(name: str) -> int:
    """Size of a known model's vectors."""
    if name not in MODELS:
        raise ValueError(f"unknown embedding model: '{name}'. Supported: {', '.join(MODELS)}")
    return MODELS[name]


def pack_lines(text: str, most: int, overlap: int) -> list[tuple[int, int]]:
    """(first, end) lines of chunks of at most `most` bytes; each begins with the lines of the last `overlap` bytes before."""
    return pack_sizes([len(x.encode()) + 1 for x in split_lines(text)], most, overlap)


def pack_sizes(sizes: list[int], most: int, overlap: int) -> list[tuple[int, int]]:
    """The same of the bytes of lines, line ends included."""
    out, first, held = [], 0, 0
    for i, size in enumerate(sizes):
        if i > first and held + size > most:
            out.append((first, i))
            back, j = 0, i
            while j > first and back + sizes[j - 1] <= overlap:
                j -= 1
                back += sizes[j]
            first, held = j, back
        held += size
    if sizes:
        out.append((first, len(sizes)))
    return out


def chunk_files(files: DataFrame, tokens: int = CHUNK_TOKENS, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """CHUNK rows of files (path, content); a line that is too long is a chunk of its own. Lines count from 1.

    Only the sizes of lines go to Python, which gives back first and end lines by turns.
    """

    @F.pandas_udf("array<int>")
    def bounds(sizes: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else [n for pair in pack_sizes(x.tolist(), 4 * tokens, 4 * overlap) for n in pair] for x in sizes], dtype=object)

    df = files.select("path", lines(F.col("content")).alias("lines"))
    df = df.select("path", "lines", bounds(F.transform("lines", lambda x: F.octet_length(x) + 1)).alias("cuts"))
    at = lambda i, k: F.get("cuts", 2 * i + k)
    own = lambda i: F.struct(at(i, 0).alias("a"), at(i, 1).alias("b"), F.array_join(F.slice("lines", at(i, 0) + 1, at(i, 1) - at(i, 0)), "\n").alias("text"))
    chunks = F.transform(F.sequence(F.lit(0), (F.size("cuts") / 2).cast("int") - 1), own)
    df = df.where(F.size("cuts") > 0).select("path", F.posexplode(chunks).alias("chunk_index", "c"))
    return df.select("path", "chunk_index", "c.text", content_hash(F.col("c.text")).alias("content_hash"), (F.col("c.a") + 1).alias("start_line"), F.col("c.b").alias("end_line"))


def symbol_records(symbols: DataFrame) -> DataFrame:
    """(id, embed_text, path, name, kind, signature, content_hash) of symbols (file, name, kind, signature)."""
    text = F.concat_ws(" ", "kind", "name", "signature")
    name = F.concat_ws("::", "file", "name", F.replace(F.col("kind"), F.lit("_"), F.lit("")))
    return symbols.select(name.alias("id"), text.alias("embed_text"), F.col("file").alias("path"), "name", "kind", "signature", content_hash(text).alias("content_hash"))


def embed(df: DataFrame, text: str, model: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256) -> DataFrame:
    """df with `vector`; model() makes the embedding function, once for each Python worker's stream of batches."""

    @F.pandas_udf("array<float>")
    def vectors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = model()
        for part in parts:
            texts = part.fillna("").tolist()
            yield pd.Series([v for k in range(0, len(texts), batch) for v in own(texts[k : k + batch])])

    return df.withColumn("vector", vectors(text))


def distance(a: Column, b: Column) -> Column:
    """Euclidean distance of two arrays."""
    squares = F.zip_with(a, b, lambda x, y: (x - y).cast("double") * (x - y).cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def similarity(d: Column) -> Column:
    return 1.0 / (1.0 + d)


def nearest(items: DataFrame, query: list[float], k: int = NEAREST, vector: str = "vector", tie: str = "id") -> DataFrame:
    """The k items nearest to one vector, with distance and similarity: a scan, and a top-k within each task before the last."""
    df = items.withColumn("distance", distance(F.col(vector), F.lit([float(x) for x in query])))
    return df.orderBy("distance", tie).limit(k).withColumn("similarity", similarity(F.col("distance")))


def _near_fold(k: int, part: int = 512):
    """Fold over rows (_b, _g, _kind, query, id, v) in that order, a cell of queries and items at a time: its k best pairs a query.

    A matrix product with a bound of its error finds candidates; the distances that decide add in the order of the
    dimensions. Items come in the order of their ids, so their places break ties.
    """
    import numpy as np

    def matrix(column: pa.Array) -> np.ndarray:
        """Rows of a list column; NaN for missing vectors."""
        sizes = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
        wide = int(sizes.max(initial=0))
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if len(flat) == wide * len(column):
            return flat.reshape(len(column), wide)
        out = np.full((len(column), wide), np.nan, flat.dtype)
        for i, x in enumerate(column):
            if sizes[i] == wide:
                out[i] = x.values.to_numpy(zero_copy_only=False)
        return out

    class Cell:
        def __init__(self):
            self.asked, self.queries, self.ids, self.seen = [], [], [], 0
            self.q = None

        def start(self):
            widths = {x.shape[1] for x in self.queries}
            self.q = np.concatenate([x if x.shape[1] == max(widths) else np.full((len(x), max(widths)), np.nan, x.dtype) for x in self.queries])
            self.norm = (self.q.astype("f8") ** 2).sum(1)
            self.at, self.place, self.far = np.empty(0, "i8"), np.empty(0, "i8"), np.empty(0)
            self.most = np.full(len(self.q), np.inf)  # the k-th distance so far

        def meet(self, x: np.ndarray):
            if x.shape[1] != self.q.shape[1]:
                x = np.full((len(x), self.q.shape[1]), np.nan, x.dtype)
            norm = (x.astype("f8") ** 2).sum(1)
            eps = 1e-5 if x.dtype == np.float32 else 1e-12
            slack = eps * (self.norm + np.nanmax(norm, initial=0.0)) + 1e-30
            for lo in range(0, len(self.q), part):
                rows = slice(lo, lo + part)
                rough = self.norm[rows, None].astype(x.dtype) + norm[None, :].astype(x.dtype) - 2 * (self.q[rows] @ x.T)
                bound = self.most[rows] ** 2 * (1 + 1e-6) + slack[rows]
                if x.shape[0] > k:
                    loose = np.flatnonzero((rough <= bound[:, None]).sum(1) > 4 * k)
                    if len(loose):
                        bound[loose] = np.fmin(bound[loose], np.partition(rough[loose], k - 1, axis=1)[:, k - 1] * (1 + 1e-6) + 2 * slack[rows][loose])
                i, j = np.nonzero(~(rough > bound[:, None]))
                for at in range(0, len(i), 500_000):
                    self.add(i[at : at + 500_000] + lo, j[at : at + 500_000], x)
            self.seen += len(x)

        def add(self, i, j, x):
            total = np.zeros(len(i))
            for c in range(x.shape[1]):
                d = (x[j, c] - self.q[i, c]).astype("f8")
                total += d * d
            at, place, far = np.concatenate([self.at, i]), np.concatenate([self.place, j + self.seen]), np.concatenate([self.far, np.sqrt(total)])
            order = np.lexsort((place, far, at))
            at, place, far = at[order], place[order], far[order]
            first = np.searchsorted(at, np.arange(len(self.q)))
            nth = np.arange(len(at)) - first[at]
            last = nth == k - 1
            self.most[at[last]] = np.where(np.isnan(far[last]), np.inf, far[last])
            kept = nth < k
            self.at, self.place, self.far = at[kept], place[kept], far[kept]

        def best(self) -> Iterator[pa.RecordBatch]:
            if self.q is None or not self.ids:
                return
            asked, ids = pa.concat_arrays(self.asked), pa.concat_arrays(self.ids)
            for lo in range(0, len(self.at), 50_000):
                s = slice(lo, lo + 50_000)
                far = pa.array(self.far[s], pa.float64(), mask=np.isnan(self.far[s]))
                yield pa.RecordBatch.from_arrays([asked.take(pa.array(self.at[s])), ids.take(pa.array(self.place[s])), far], ["query", "id", "distance"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for rows in batches:
            key = np.stack([rows.column(c).to_numpy(zero_copy_only=False) for c in ("_b", "_g", "_kind")], 1)
            cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist(), len(key)]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                if now != tuple(key[lo, :2]):
                    if cell:
                        yield from cell.best()
                    now, cell = tuple(key[lo, :2]), Cell()
                some = rows.slice(lo, hi - lo)
                v = matrix(some.column("v"))
                if key[lo, 2] == 0:
                    cell.asked.append(some.column("query"))
                    cell.queries.append(v)
                elif cell.queries:
                    if cell.q is None:
                        cell.start()
                    cell.ids.append(some.column("id"))
                    cell.meet(v)
        if cell:
            yield from cell.best()

    return run


def nearest_of_each(items: DataFrame, queries: DataFrame, k: int = NEAREST, vector: str = "vector", tie: str = "id", block: int = 2048, group: int = 65536) -> DataFrame:
    """(query, id, distance, rank): the k items nearest to each query (query, vector), exactly.

    Some `block` queries and some `group` items make a cell, which one task compares by matrix products; so a task's memory
    and time have a bound whatever their numbers, and only the k best of a query leave a cell. All pairs are compared: cells
    grow with the product of both numbers.
    """
    blocks, groups = max(1, -(-queries.count() // block)), max(1, -(-items.count() // group))
    single = all(df.schema[c].dataType.simpleString() == "array<float>" for df, c in ((items, vector), (queries, "vector")))
    kind = "array<float>" if single else "array<double>"
    own, asked = items.schema[tie].dataType, queries.schema["query"].dataType
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    some = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    q = queries.select(some("query", blocks).alias("_b"), spread(groups).alias("_g"), F.lit(0).alias("_kind"), "query", F.lit(None).cast(own).alias("id"), F.col("vector").cast(kind).alias("v"))
    x = items.select(F.col(tie).alias("id"), F.col(vector).cast(kind).alias("v"))
    x = x.select(spread(blocks).alias("_b"), some("id", groups).alias("_g"), F.lit(1).alias("_kind"), F.lit(None).cast(asked).alias("query"), "id", "v")
    cells = q.unionByName(x).repartition(2 * blocks * groups, "_b", "_g").sortWithinPartitions("_b", "_g", "_kind", "id")
    out = T.StructType([T.StructField("query", asked), T.StructField("id", own), T.StructField("distance", T.DoubleType())])
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.asc_nulls_last("distance"), "id"))
    return cells.mapInArrow(_near_fold(k), out).withColumn("rank", best).where(F.col("rank") <= k)


def file_scores(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """(path, chunk_sim, symbol_sim, combined): the best match of either kind for each file."""
    best = lambda df, name: df.groupBy("path").agg(F.max("similarity").alias(name))
    both = best(chunks, "chunk_sim").join(best(symbols, "symbol_sim"), "path", "full_outer").na.fill(0.0, ["chunk_sim", "symbol_sim"])
    return both.withColumn("combined", CHUNK_WEIGHT * F.col("chunk_sim") + SYMBOL_WEIGHT * F.col("symbol_sim"))


def detect_changes(current: DataFrame, stored: DataFrame, trust_times: bool = False) -> DataFrame:
    """(path, status): changed, unchanged or removed, of files (path, content_hash, mtime) against the stored state."""
    c = current.select("path", F.col("content_hash").alias("now"), F.col("mtime").alias("now_time"))
    s = stored.select("path", F.col("content_hash").alias("then"), F.col("mtime").alias("then_time"))
    same = F.col("now") == F.col("then")
    if trust_times:
        same = same | (F.col("now_time") == F.col("then_time"))
    status = F.when(F.col("now").isNull(), "removed").when(F.coalesce(same, F.lit(False)), "unchanged").otherwise("changed")
    return c.join(s, "path", "full_outer").select("path", status.alias("status"))


def refresh(stored: DataFrame, fresh: DataFrame, status: DataFrame) -> DataFrame:
    """Rows of an index table (path, ..) after changed and removed files' rows made way for the fresh ones."""
    stale = status.where("status <> 'unchanged'").select("path")
    return stored.join(stale, "path", "left_anti").unionByName(fresh.join(status.where("status = 'changed'"), "path", "left_semi"))


def index_stats(status: DataFrame, chunks: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """One row of counters of an index run: files by status, and the chunks and symbols of changed files that were embedded."""
    count = lambda kind, name: F.count_if(F.col("status") == kind).alias(name)
    out = status.agg(count("changed", "files_indexed"), count("removed", "files_removed"), count("unchanged", "files_unchanged"))
    fresh = status.where("status = 'changed'").select("path")
    embedded = lambda df, name: df.join(fresh, "path", "left_semi").agg(F.count("*").alias(name))
    out = out.crossJoin(embedded(chunks, "chunks_embedded"))  # one row each
    return out.crossJoin(embedded(symbols, "symbols_embedded")) if symbols is not None else out.withColumn("symbols_embedded", F.lit(0).cast("long"))


def search(tasks: DataFrame, chunks: DataFrame, symbols: DataFrame, model: Callable[[], Callable[[list[str]], list[list[float]]]], k: int = NEAREST) -> DataFrame:
    """(task_id, path, chunk_sim, symbol_sim, combined): tasks (task_id, task) against an index of chunks and symbols.

    chunks and symbols: (path, vector). Each task is embedded and meets its k nearest chunks and k nearest symbols.
    """
    asked = embed(tasks.select(F.col("task_id").alias("query"), "task"), "task", model).select("query", "vector")
    parts = []
    for df, name in ((chunks, "chunk_sim"), (symbols, "symbol_sim")):
        own = df.select("path", "vector").withColumn("id", F.struct("path", F.monotonically_increasing_id()))
        near = nearest_of_each(own, asked, k).select(F.col("query").alias("task_id"), F.col("id.path").alias("path"), similarity(F.col("distance")).alias("s"))
        parts.append(near.groupBy("task_id", "path").agg(F.max("s").alias(name)))
    both = parts[0].join(parts[1], ["task_id", "path"], "full_outer").na.fill(0.0, ["chunk_sim", "symbol_sim"])
    return both.withColumn("combined", CHUNK_WEIGHT * F.col("chunk_sim") + SYMBOL_WEIGHT * F.col("symbol_sim"))
