"""Language identification by multinomial logistic regression on TF-IDF character n-grams.

Texts are lower-cased, runs of other characters than letters become one space, and the n-grams of 1 to 3 characters are
hashed to BUCKETS features. Document frequencies are counted over all training documents. Weights are learned with
follow-the-regularised-leader (per-coordinate rates, elastic net, so most weights are exactly 0) on a sample of about
`per_language` documents of each language, the bound on what training reads; one in five of them is held back to choose
a temperature by which scores are divided, so that they read as probabilities.

Sampling, order and hashing depend on ids and texts only, so reruns agree. Only the document frequencies, the weights
that are not 0 and the number of documents of each language go to the driver. Every lang value is learned; a model takes
BUCKETS times 8 bytes a language on the driver and each executor, and training several times that in one task.

Defined results: a null text or one without a letter is `und` with score 0; without training rows every text is `und`;
ties go to the language that sorts first; rows with a null id are predicted, but not learned from; repeated rows are
predicted alike; other columns pass through, but a column with the name of a result is replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from contextloom.llm.shared import free_name, table

BUCKETS = 1 << 15
ORDERS = (1, 2, 3)
PER_LANGUAGE = 800
RESULTS = ["lang_pred", "score"]
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 0.02, 0.02, 3

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """Which code points are letters."""
    if not _letters:
        _letters.append(np.array([chr(i).isalpha() if not 0xD800 <= i < 0xE000 else False for i in range(0x110000)]))
    return _letters[0]


def features(text: str | None) -> np.ndarray:
    """Buckets of the n-grams of a text, in order; empty if it has no letter."""
    codes = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = letters()[codes]
    if not letter.any():
        return np.zeros(0, dtype=np.int64)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # of a run of others the first stays, as a space
    codes = np.where(letter, codes, 32)[keep].astype(np.uint64)
    codes = np.concatenate(([np.uint64(32)], codes, [np.uint64(32)]))
    out = []
    for n in ORDERS:
        h = np.full(len(codes) - n + 1, np.uint64(n))
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k]
        h = h * np.uint64(0x9E3779B97F4A7C15)
        out.append((h >> np.uint64(49)).astype(np.int64))
    return np.concatenate(out)


def counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, how often) of a text."""
    all_of = np.bincount(features(text), minlength=BUCKETS)
    found = np.flatnonzero(all_of)
    return found, all_of[found]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for x in batch.column("text"):
            total[counts(x.as_py())[0]] += 1
            docs += 1
    if docs:
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(found, -1)), pa.array(np.append(total[found], docs))], names=["bucket", "docs"])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def vector(found: np.ndarray, often: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = (1 + np.log(often)) * idf[found]
    return x / max(1e-12, float(np.sqrt((x * x).sum())))


def fit(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, idf: np.ndarray) -> tuple[np.ndarray, float]:
    """(weights, temperature) from (buckets, counts, class); every fifth row is for the temperature."""
    z, n = np.zeros((BUCKETS + 1, classes)), np.zeros((BUCKETS + 1, classes))

    def weights(at: np.ndarray) -> np.ndarray:
        zs = z[at]
        return np.where(np.abs(zs) <= L1, 0.0, -(zs - np.sign(zs) * L1) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    cases = [(np.append(f, BUCKETS), np.append(vector(f, o, idf), 0.1), y) for f, o, y in rows]
    train, held = [c for i, c in enumerate(cases) if i % 5], [c for i, c in enumerate(cases) if not i % 5]
    for epoch in range(EPOCHS):
        for k in np.random.default_rng(epoch).permutation(len(train)):
            at, x, y = train[k]
            w = weights(at)
            p = softmax(x @ w)
            p[y] -= 1
            g = x[:, None] * p[None, :]
            z[at] += g - (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / ALPHA * w
            n[at] += g * g
    every = weights(np.arange(BUCKETS + 1))
    if not held:
        return every, 1.0
    logits, truth = np.array([x @ every[at] for at, x, _ in held]), np.array([y for _, _, y in held])
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean()
    lo, hi = np.log(0.5), np.log(10.0)
    for _ in range(40):  # golden section over the logarithm
        a, b = hi - (hi - lo) * 0.618034, lo + (hi - lo) * 0.618034
        lo, hi = (lo, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, hi)
    return every, float(np.exp((lo + hi) / 2))


def _training(names: list[str], idf: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, place = [], {x: i for i, x in enumerate(names)}
        for batch in batches:
            for x in batch.to_pylist():
                rows.append((x["place"], np.array(x["found"], dtype=np.int64), np.array(x["often"], dtype=np.float64), place[x["lang"]]))
        rows.sort(key=lambda r: (r[0], r[3], len(r[1])))
        w, temperature = fit([r[1:] for r in rows], len(names), idf)
        used = np.flatnonzero(np.abs(w).sum(axis=1))
        at = [np.flatnonzero(w[i]) for i in used]
        out = [w[i, a].tolist() for i, a in zip(used, at, strict=True)] + [[temperature]]
        classes = pa.array([a.tolist() for a in at] + [[]], type=pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), classes, pa.array(out, type=pa.list_(pa.float64()))], names=["bucket", "classes", "weights"])

    return run


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, often = zip(*(counts(x.as_py()) for x in batch.column("text")), strict=True) if batch.num_rows else ((), ())
        yield pa.RecordBatch.from_arrays(
            [batch.column("place"), batch.column("lang"), pa.array([f.tolist() for f in found], pa.list_(pa.int32())), pa.array([o.tolist() for o in often], pa.list_(pa.int32()))],
            names=["place", "lang", "found", "often"],
        )


class Model:
    def __init__(self, names: list[str], idf: np.ndarray, w: np.ndarray, temperature: float):
        self.names, self.idf, self.w, self.temperature = names, idf, w, temperature

    def predict(self, text: str | None) -> tuple[str, float]:
        found, often = counts(text)
        if not len(found) or not self.names:
            return "und", 0.0
        logits = vector(found, often, self.idf) @ self.w[found] + 0.1 * self.w[BUCKETS]
        p = softmax(logits / self.temperature)
        best = int(p.argmax())
        return self.names[best], float(p[best])


def train(labelled: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE) -> Model:
    """A model from all labelled rows (document frequencies) and a sample of them (weights)."""
    df = labelled.select(F.col(doc_id).cast("string").alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang")).where("id is not null and text is not null and lang is not null")
    sizes = df.groupBy("lang").count().collect()
    sizes = {r["lang"]: r["count"] for r in sorted(sizes, key=lambda r: r["lang"])}
    names = list(sizes)
    if not names:
        return Model([], np.zeros(BUCKETS), np.zeros((BUCKETS + 1, 0)), 1.0)
    sums = df.select("text").mapInArrow(_frequencies, "bucket long, docs long").groupBy("bucket").agg(F.sum("docs").alias("docs")).toPandas()
    total = int(sums.docs[sums.bucket == -1].iloc[0])
    df_of = np.zeros(BUCKETS)
    inside = sums[sums.bucket >= 0]
    df_of[inside.bucket.to_numpy()] = inside.docs.to_numpy()
    idf = np.log((1 + total) / (1 + df_of)) + 1
    place = F.pmod(F.xxhash64("id", F.lit("langid")), F.lit(1 << 40))
    limit = F.create_map(*(F.lit(v) for k, n in sizes.items() for v in (k, int((1 << 40) * min(1.0, per_language / n)))))
    picked = df.withColumn("place", place).where(F.col("place") < limit[F.col("lang")])
    sparse = picked.select("place", "lang", "text").mapInArrow(_sparse, "place long, lang string, found array<int>, often array<int>")
    rows = sparse.repartition(1).mapInArrow(_training(names, idf), "bucket long, classes array<int>, weights array<double>").collect()
    w, temperature = np.zeros((BUCKETS + 1, len(names))), 1.0
    for r in rows:
        if r["bucket"] < 0:
            temperature = r["weights"][0]
        else:
            w[r["bucket"], r["classes"]] = r["weights"]
    return Model(names, idf, w, temperature)


def identify(docs: DataFrame, model: Model, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (all, if None) of every row of docs, with lang_pred and score."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang: string, score: double>")
    def guess(column: pa.Array) -> pa.Array:
        names, scores = zip(*(sent.value.predict(x.as_py()) for x in column), strict=True) if len(column) else ((), ())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=["lang", "score"])

    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_row")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(inner), F.col(text).alias("_text")).withColumn("_guess", guess("_text"))
    return df.select(*(F.col(f"{inner}.`{c}`") for c in kept), F.col("_guess.lang").alias("lang_pred"), F.col("_guess.score").alias("score"))


def fold(doc_id: Column, folds: int) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % folds


def op8_language(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", fold(F.col("doc_id"), 4) == 2)
    model = train(docs.where("not held_out"))
    return identify(docs.select("doc_id", "text", "held_out"), model, carry=["doc_id", "held_out"])
