"""Language-model scores by subword lattice likelihood.

The vocabulary and the order of its scores come from a public tokenizer's file; the probability of a document is that of
all ways to cut its words into pieces, summed by a log-space forward recursion, and of one end. Since no piece reaches over
white space, it is a product over words, so each distinct word's lattice is summed once.

Probabilities of pieces start from the file's scores (which order pieces by merge, so the r-th has a weight of
1 / (r + 10)) and are re-estimated from the word counts of all training documents: each round sums the expected uses of
pieces over the lattices of all distinct words. The end is one more piece, used once a document.

Counts are exact and grow with the corpus: words are counted in each task, then in Spark. The most frequent words
(`frequent` at most) are sent to all executors with their values; other words of a document are joined by a 128-bit hash.

Defined results: null texts are empty and get the end's score; repeated rows are scored alike; without training documents
base counts are 0 and pieces keep their first probabilities; other columns pass through, but a column with the name of a
result is replaced; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from contextloom.llm.langid import fold
from contextloom.llm.lattice import Pieces
from contextloom.llm.shared import drop, free_name, materialize, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS = 2
SMOOTH = 0.1
FREQUENT = 60_000
#: A task hands on its counts when it has so many distinct words.
HELD_WORDS = 400_000
RESULTS = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
LOW = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def load_pieces(path: str = VOCABULARY) -> tuple[list[str], list[int], np.ndarray]:
    """(pieces, ids of byte pieces, log probabilities from the file's order) of a sentencepiece vocabulary."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces, bytes_of, rank = [], {}, []
    for i in range(sp.get_piece_size()):
        p = sp.id_to_piece(i)
        if sp.is_byte(i):
            bytes_of[int(p[1:-1], 16)] = i
        elif sp.is_control(i) or sp.is_unknown(i):
            p = ""
        pieces.append(p)
        rank.append(-sp.get_score(i))
    if len(bytes_of) < 256:
        for b in range(256):
            if b not in bytes_of:
                bytes_of[b] = len(pieces)
                pieces.append(f"<0x{b:02X}>")
                rank.append(float(len(pieces)))
    weight = np.array([1 / (r + 10) if p else 0.0 for p, r in zip(pieces, rank, strict=True)])
    weight[list(bytes_of.values())] = 1 / (len(pieces) + 10)
    with np.errstate(divide="ignore"):
        return pieces, [bytes_of[b] for b in range(256)], np.log(weight / weight.sum())


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(LOW).split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    learned, every = Counter(), Counter()

    def out() -> pa.RecordBatch:
        words = list(every)
        made = pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array([learned[w] for w in words], pa.int64()), pa.array(list(every.values()), pa.int64())], names=["word", "c", "every"])
        learned.clear()
        every.clear()
        return made

    for batch in batches:
        for text, held in zip(batch.column("text"), batch.column("held").to_pylist(), strict=True):
            ws = tokens(text.as_py())
            every.update(ws)
            if not held:
                learned.update(ws)
            if len(every) > HELD_WORDS:
                yield out()
    yield out()


def _expected(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            words = [w.decode() for w in batch.column("word").to_pylist()]
            part = sent.value.expected(words, batch.column("c").to_numpy().astype(np.float64))
            total = part if total is None else total + part
        if total is not None:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], names=["piece", "uses"])

    return run


def _key(word: bytes) -> tuple[int, int]:
    digest = xxhash.xxh3_128_digest(word)
    return int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)


def _values(sent):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column("word").to_pylist()
            lp = sent.value.likelihood([w.decode() for w in words]) / np.log(10)
            keys = np.array([_key(w) for w in words], dtype=np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch.column("word"), batch.column("c"), batch.column("every"), pa.array(keys[:, 0]), pa.array(keys[:, 1]), pa.array(lp)], names=["word", "c", "every", "h1", "h2", "lp"])

    return run


_PARTS = "doc string, row long, n_tokens long, n_known long, base double, lp double, h1 array<long>, h2 array<long>, often array<int>"


def _document_parts(sent, n: int, v: int):
    """mapInArrow function: sums over the frequent words of each document, and its other words as keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = sent.value
        scale = np.log10(n + (v + 1))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                rows = {k: [] for k in ("n_tokens", "n_known", "base", "lp", "h1", "h2", "often")}
                for text in part.column("text"):
                    ws = Counter(tokens(text.as_py()))
                    n_known, base, lp, h1, h2, often = 0, 0.0, 0.0, [], [], []
                    for w, k in ws.items():
                        value = known.get(w)
                        if value is None:
                            a, b = _key(w)
                            h1.append(a)
                            h2.append(b)
                            often.append(k)
                        else:
                            n_known += k * value[0]
                            base += k * value[1]
                            lp += k * value[2]
                    total = sum(ws.values())
                    for name, x in zip(rows, (total, n_known, base - total * scale, lp, h1, h2, often), strict=True):
                        rows[name].append(x)
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays([part.column("doc"), part.column("row"), *(pa.array(x, k) for x, k in zip(rows.values(), kinds, strict=True))], names=["doc", "row", *rows])

    return run


def score_documents(
    docs: DataFrame, held: str, doc_id: str = "doc_id", text: str = "text", vocabulary: str = VOCABULARY, rounds: int = ROUNDS, frequent: int = FREQUENT, carry: list[str] | None = None
) -> DataFrame:
    """The columns in carry (all, if None) of every row of docs with RESULTS; rows with true in `held` are not learned from."""
    spark: SparkSession = docs.sparkSession
    sc = spark.sparkContext
    slim = docs.select(
        F.col(doc_id).cast("string").alias("doc"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("row"), F.col(text).alias("text"), F.coalesce(F.col(held), F.lit(False)).alias("held")
    )
    counted = slim.select("text", "held").mapInArrow(_count, "word binary, c long, every long")
    words = materialize(counted.groupBy("word").agg(F.sum("c").alias("c"), F.sum("every").alias("every")), "words")
    sums = words.agg(F.sum("c").alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = slim.where("not held").count()
    n, v = (sums["n"] or 0) + ends, (sums["v"] or 0) + (ends > 0)
    names, byte_ids, logp = load_pieces(vocabulary)
    end = len(names)
    logp = np.append(logp, np.log(1e-3))
    model = Pieces([*names, ""], byte_ids, logp)
    for _ in range(rounds if ends else 0):
        sent = sc.broadcast(model)
        uses = words.where("c > 0").select("word", "c").mapInArrow(_expected(sent), "piece long, uses double").groupBy("piece").agg(F.sum("uses").alias("uses")).toPandas()
        total = np.where(np.isfinite(model.logp), SMOOTH, 0.0)
        total[uses.piece.to_numpy()] += np.round(uses.uses.to_numpy(), 6)
        total[end] += ends
        with np.errstate(divide="ignore"):
            model = Pieces(model.pieces, byte_ids, np.log(total / total.sum()))
    values = words.mapInArrow(_values(sc.broadcast(model)), "word binary, c long, every long, h1 long, h2 long, lp double")
    values = materialize(values, "values")
    drop(words)
    # words are cut by a class of their count, so no task and no driver gets a top list from every partition
    rank = F.floor(F.log2("every") * 8).cast("int")
    held, least = 0, None
    for r in sorted(values.groupBy(rank.alias("rank")).count().collect(), key=lambda r: -r["rank"]):
        held += r["count"]
        if held > frequent:
            break
        least = r["rank"]
    top = values.where(rank >= least).select("word", "c", "lp").collect() if least is not None else []
    lookup = {bytes(r["word"]): (int(r["c"] > 0), float(np.log10(r["c"] + 1)), r["lp"]) for r in top}
    parts = materialize(slim.select("doc", "row", "text").mapInArrow(_document_parts(sc.broadcast(lookup), n, v), _PARTS), "parts")
    rare = parts.dropDuplicates(["doc", "row"]).select("doc", "row", F.explode(F.arrays_zip("h1", "h2", "often")).alias("x")).select("doc", "row", "x.h1", "x.h2", "x.often")
    own = values.select("h1", "h2", "c", "lp")
    rare = rare.join(own, ["h1", "h2"]).groupBy("doc", "row").agg(
        F.sum(F.when(F.col("c") > 0, F.col("often")).otherwise(0)).alias("rare_known"),
        F.sum(F.col("often") * F.log10(F.col("c") + 1)).alias("rare_base"),
        F.sum(F.col("often") * F.col("lp")).alias("rare_lp"),
    )
    end_base, end_lp = float(np.log10(ends + 1) - np.log10(n + v + 1)), float(model.logp[end] / np.log(10))
    parts = parts.select("doc", "row", "n_tokens", "n_known", "base", "lp").dropDuplicates(["doc", "row"])
    found = parts.join(rare, ["doc", "row"], "left").select(
        F.col("doc").alias("_doc"),
        F.col("row").alias("_hash"),
        (F.col("n_tokens") + 1).alias("n_tokens"),
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0)) + int(ends > 0)).alias("n_known"),
        F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) + end_base).alias("base_score"),
        (F.col("lp") + F.coalesce("rare_lp", F.lit(0.0)) + end_lp).alias("score"),
    )
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_kept")
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(inner), F.col(doc_id).cast("string").alias("_id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_of"))
    out = rows.join(found, F.col("_id").eqNullSafe(F.col("_doc")) & (F.col("_of") == F.col("_hash")))
    return out.select(*(F.col(f"{inner}.`{c}`") for c in kept), *RESULTS)


def op10_lattice(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 7) == 2)
    return score_documents(docs, "held_out", carry=["doc_id", "held_out"])
