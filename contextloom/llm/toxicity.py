"""Toxic spans by a linear-chain conditional random field.

Tokens are words without outer punctuation, in lower case. Their features are the word, its prefixes and its last letters,
hashed; two labels (other, toxic) form a chain. Labels of documents become labels of tokens first: a feature that is in at
least `least_docs` toxic training documents, and far oftener in toxic than in other ones, marks the tokens of toxic
documents that have it. The field is trained on these tokens by stochastic gradient on its likelihood, over whole texts of a
sample of about `sample` training documents, half of them toxic if there are as many. Forward-backward marginals give each
token's probability; the sum of what a document's marginals have above a floor, and their largest, put through a logistic curve fitted on the same
documents, is its score, and the tokens with a marginal of one half or more are its offending offsets.

Defined results: null, empty and wordless texts get the score of a document without a toxic token; without labelled rows of
both kinds every score is 0; rows with a null id or label are scored, but not learned from; repeated rows are scored
alike; an id that labels call both is toxic; very long texts are read whole, one at a time; empty tables give an empty result;
other columns pass through, but a column with the name of a result is replaced. Only the sample's model goes to the driver;
its size is fixed.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from contextloom.llm.langid import fold
from contextloom.llm.shared import drop, free_name, materialize, table

BUCKETS = 1 << 18
PREFIXES = (3, 4, 5, 6, 7, 8)
PER_TOKEN = len(PREFIXES) + 3
SAMPLE = 5000
LEAST_DOCS = 4
LEAST_SHARE = 0.8
EPOCHS, RATE, DECAY, TOGETHER = 4, 0.15, 1e-5, 64
FLOOR = 0.1
#: Steps of training at least; a small sample is gone through more often.
STEPS = 200
#: Characters of texts scored at a time; a longer text goes alone.
STEP_CHARS = 2_000_000
#: Distinct words whose features a worker remembers.
REMEMBERED = 400_000
EDGE = "".join(chr(i) for i in range(33, 127) if not chr(i).isalnum()) + " «»“”„‘’…–—¡¿"
RESULTS = ["score", "predicted", "spans"]


def normal(word: str) -> str:
    return word.lower().strip(EDGE)


def feature_row(word: str) -> list[int]:
    """Buckets of a token's features; 0 fills up."""
    h = lambda kind, x: 1 + crc32(f"{kind}:{x}".encode("utf-8", "surrogatepass")) % (BUCKETS - 1)
    row = [h("b", "")]
    if word:
        row += [h("w", word), h("s", word[-3:])] + [h("p", word[:k]) for k in PREFIXES if len(word) >= k]
    return row + [0] * (PER_TOKEN - len(row))


def runs(u: np.ndarray, lengths: np.ndarray, trans: np.ndarray, pairs: bool = True) -> tuple[np.ndarray, np.ndarray | None]:
    """Marginals of the label toxic for each token and, if pairs are wanted, of each pair of labels (n, 2, 2) with the token after it.

    u: score of toxic over other, texts one after the other. All texts advance one token a step, the longest first, so a
    step is a few operations on as many numbers as texts are left. Messages are normalised at every step.
    """
    starts = np.concatenate(([0], np.cumsum(lengths)[:-1])).astype(np.int64)
    order = np.argsort(-lengths, kind="stable")
    lens, begin = lengths[order], starts[order]
    t = np.exp(trans)
    e = np.exp(np.clip(u, -30, 30))
    fwd, bwd = np.zeros(len(u)), np.ones(len(u))  # ratios toxic : other of the messages
    most = int(lens[0]) if len(lens) else 0
    left = np.searchsorted(-lens, -np.arange(most), side="left")  # texts longer than k
    ratio = None
    for k in range(most):
        n = left[k]
        at = begin[:n] + k
        ratio = e[at] * t[0, 1] if ratio is None else e[at] * (ratio[:n] * t[1, 1] + t[0, 1]) / (ratio[:n] * t[1, 0] + t[0, 0])
        fwd[at] = ratio
    ratio = np.ones(0)
    for k in range(most - 1, -1, -1):
        n = left[k]
        at = begin[:n] + k
        later = np.ones(n)
        m = len(ratio)
        if m:
            x = ratio * e[at[:m] + 1]
            later[:m] = (t[1, 0] + t[1, 1] * x) / (t[0, 0] + t[0, 1] * x)
        bwd[at] = later
        ratio = later
    both = fwd * bwd
    p = both / (1 + both)
    if not pairs:
        return p, None
    pair = np.zeros((len(u), 2, 2))
    if len(u) > 1:
        a = np.stack([np.ones(len(u) - 1), fwd[:-1]], axis=1)
        b = np.stack([np.ones(len(u) - 1), e[1:] * bwd[1:]], axis=1)
        joint = a[:, :, None] * t[None] * b[:, None, :]
        pair[:-1] = joint / joint.sum(axis=(1, 2), keepdims=True)
    pair[np.cumsum(lengths)[lengths > 0] - 1] = 0
    return p, pair


def token_labels(texts: list[list[str]], toxic: list[bool], least_docs: int, least_share: float) -> tuple[dict[str, list[int]], list[np.ndarray]]:
    """Feature rows of all words, and labels of all tokens, from labels of documents."""
    rows = {w: feature_row(w) for ws in texts for w in set(ws)}
    bad, good = Counter(), Counter()
    for ws, label in zip(texts, toxic, strict=True):
        seen = {f for w in set(ws) for f in rows[w][1:] if f}
        (bad if label else good).update(seen)
    n_bad, n_good = max(1, sum(toxic)), max(1, len(toxic) - sum(toxic))
    telling = {f for f, k in bad.items() if k >= least_docs and k / n_bad >= least_share * (k / n_bad + (good[f] + 0.5) / n_good) and k >= 4 * good[f]}
    marks = {w: any(f in telling for f in rows[w][1:] if f) for w in rows}
    return rows, [np.array([label and marks[w] for w in ws], dtype=np.float64) for ws, label in zip(texts, toxic, strict=True)]


def mass(p: np.ndarray) -> float:
    """Sum of what marginals have above FLOOR, so that many hardly suspect tokens of a long text do not add up."""
    return float(np.maximum(p - FLOOR, 0.0).sum() / (1 - FLOOR))


class Field:
    def __init__(self, w: np.ndarray, trans: np.ndarray, curve: tuple[float, float, float]):
        self.w, self.trans, self.curve = w, trans, curve
        self.known: dict[str, float] = {}

    def __getstate__(self):
        return (self.w, self.trans, self.curve)

    def __setstate__(self, state):
        self.w, self.trans, self.curve = state
        self.known = {}

    def unary(self, word: str) -> float:
        u = self.known.get(word)
        if u is None:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            u = self.known[word] = float(self.w[feature_row(normal(word))].sum())
        return u

    def marginals(self, texts: list[list[str]]) -> list[np.ndarray]:
        lengths = np.array([len(ws) for ws in texts], dtype=np.int64)
        unary = self.unary
        u = np.array([unary(w) for ws in texts for w in ws])
        if not len(u):
            return [np.zeros(0) for _ in texts]
        p, _ = runs(u, lengths, self.trans, pairs=False)
        return np.split(p, np.cumsum(lengths)[:-1])

    def score(self, p: np.ndarray) -> float:
        a, b, c = self.curve
        return float(1 / (1 + np.exp(-np.clip(a + b * np.log1p(mass(p)) + c * (p.max() if len(p) else 0.0), -30, 30))))


def fit(texts: list[list[str]], toxic: list[bool], least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE) -> Field:
    texts = [[normal(w) for w in ws] for ws in texts]
    rows, labels = token_labels(texts, toxic, least_docs, least_share)
    at = {w: i for i, w in enumerate(rows)}
    feats = np.array(list(rows.values()), dtype=np.int64).reshape(-1, PER_TOKEN)
    ids = [np.array([at[w] for w in ws], dtype=np.int64) for ws in texts]
    w, trans = np.zeros(BUCKETS), np.zeros((2, 2))
    seen, seen_t = np.full(BUCKETS, 1e-6), np.full((2, 2), 1e-6)
    for epoch in range(max(EPOCHS, -(-STEPS * TOGETHER // max(1, len(texts))))):
        order = np.random.default_rng(epoch).permutation(len(texts))
        for k in range(0, len(order), TOGETHER):
            part = [i for i in order[k : k + TOGETHER] if len(ids[i])]
            if not part:
                continue
            tokens, y = np.concatenate([ids[i] for i in part]), np.concatenate([labels[i] for i in part])
            lengths = np.array([len(ids[i]) for i in part])
            words, back = np.unique(tokens, return_inverse=True)
            p, pair = runs(w[feats[words]].sum(axis=1)[back], lengths, trans)
            per_word = np.bincount(back, p - y, minlength=len(words))
            f = feats[words].ravel()
            used, inverse = np.unique(f, return_inverse=True)
            g = np.bincount(inverse, np.repeat(per_word, PER_TOKEN), minlength=len(used)) / len(part) + DECAY * w[used]
            g[used == 0] = 0
            seen[used] += g * g
            w[used] -= RATE * g / np.sqrt(seen[used])
            inside = np.ones(len(y), dtype=bool)
            inside[np.cumsum(lengths) - 1] = False
            now, then = y[:-1][inside[:-1]].astype(int), y[1:][inside[:-1]].astype(int)
            have = np.bincount(2 * now + then, minlength=4).reshape(2, 2)
            gt = (pair.sum(axis=0) - have) / len(part) + DECAY * trans
            seen_t += gt * gt
            trans -= RATE * gt / np.sqrt(seen_t)
    w[0] = 0.0
    field = Field(w, trans, (0.0, 0.0, 0.0))
    p = [x for k in range(0, len(texts), 512) for x in field.marginals(texts[k : k + 512])]
    x = np.array([[1.0, np.log1p(mass(q)), q.max() if len(q) else 0.0] for q in p])
    y, c = np.array(toxic, dtype=np.float64), np.zeros(3)
    for _ in range(50):  # Newton steps with a small ridge
        s = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        grad = x.T @ (s - y) + 1e-2 * c
        hess = (x * (s * (1 - s))[:, None]).T @ x + 1e-2 * np.eye(3)
        c = c - np.linalg.solve(hess, grad)
    field.curve = tuple(float(v) for v in c)
    return field


def _training(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted(((x["place"], x["text"], x["toxic"]) for batch in batches for x in batch.to_pylist()), key=lambda r: (r[0], r[1]))
    toxic = [r[2] == 1 for r in rows]
    if not any(toxic) or all(toxic):
        return
    field = fit([r[1].split() for r in rows], toxic)
    used = np.flatnonzero(field.w)
    out = np.concatenate((np.array([-1, -2, -3, -4, -5, -6, -7]), used))
    value = np.concatenate((field.trans.ravel(), field.curve, field.w[used]))
    yield pa.RecordBatch.from_arrays([pa.array(out), pa.array(value)], names=["at", "value"])


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE) -> Field | None:
    """A field from the labelled rows of docs; None without rows of both kinds."""
    known = labels.select(F.col(doc_id).alias("id"), F.col(toxic).alias("toxic")).where("id is not null and toxic in (0, 1)").groupBy("id").agg(F.max("toxic").alias("toxic"))
    n = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    n_bad, n_good = n.get(1, 0), n.get(0, 0)
    if not n_bad or not n_good:
        return None
    want_bad = min(n_bad, max(sample // 2, sample - n_good))
    want_good = min(n_good, sample - want_bad)
    size = 1 << 40
    place = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit("toxicity")), F.lit(size))
    limit = F.when(F.col("toxic") == 1, int(size * want_bad / n_bad)).otherwise(int(size * want_good / n_good))
    picked = materialize(known.withColumn("place", place).where(F.col("place") < limit), "picked")
    # a sample of ids is small, however many labels there are; so no text is shuffled to find its texts
    few = F.broadcast(picked) if picked.count() <= 4 * sample else picked
    texts = docs.select(F.col(doc_id).alias("id"), F.col(text).alias("text")).where("text is not null")
    rows = texts.join(few, "id").select("place", "text", "toxic").repartition(1).mapInArrow(_training, "at long, value double").collect()
    drop(picked)
    if not rows:
        return None
    fixed = {r["at"]: r["value"] for r in rows if r["at"] < 0}
    w = np.zeros(BUCKETS)
    w[[r["at"] for r in rows if r["at"] >= 0]] = [r["value"] for r in rows if r["at"] >= 0]
    return Field(w, np.array([fixed[-k] for k in (1, 2, 3, 4)]).reshape(2, 2), (fixed[-5], fixed[-6], fixed[-7]))


def _spans(text: str, p: np.ndarray) -> list[dict]:
    """Offsets (code points) of runs of tokens with a marginal of one half or more, and the largest marginal of each."""
    out, at, before = [], 0, False
    for word, q in zip(text.split(), p.tolist(), strict=True):
        at = text.index(word, at)
        if q >= 0.5 and before:
            out[-1] = {"begin": out[-1]["begin"], "end": at + len(word), "marginal": max(q, out[-1]["marginal"])}
        elif q >= 0.5:
            out.append({"begin": at, "end": at + len(word), "marginal": q})
        before = q >= 0.5
        at += len(word)
    return out


def _steps(column: pa.Array) -> Iterator[list[str]]:
    """The texts of column, up to 500 or about STEP_CHARS at a time."""
    part, size = [], 0
    for x in column:
        text = x.as_py() or ""
        if part and (len(part) == 500 or size + len(text) > STEP_CHARS):
            yield part
            part, size = [], 0
        part.append(text)
        size += len(text)
    if part:
        yield part


_KIND = "struct<score: double, spans: array<struct<begin: int, end: int, marginal: double>>>"
_SPAN = pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())]))


def tag(docs: DataFrame, field: Field | None, text: str = "text", limit: float = 0.7, carry: list[str] | None = None) -> DataFrame:
    """The columns in carry (all, if None) of every row of docs, with score, predicted (score >= limit) and spans."""
    sent = docs.sparkSession.sparkContext.broadcast(field)

    def tagged(column: pa.Array) -> pa.Array:
        model, scores, spans = sent.value, [], []
        for texts in _steps(column):
            marginals = model.marginals([t.split() for t in texts]) if model else [np.zeros(0)] * len(texts)
            scores += [model.score(p) if model else 0.0 for p in marginals]
            spans += [_spans(t, p) if len(p) and p.max() >= 0.5 else [] for t, p in zip(texts, marginals, strict=True)]
        return pa.StructArray.from_arrays([pa.array(scores, pa.float64()), pa.array(spans, _SPAN)], names=["score", "spans"])

    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() not in RESULTS]
    inner = free_name([*docs.columns, *RESULTS], "_row")
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias(inner), F.col(text).alias("_text")).withColumn("_tag", F.arrow_udf(tagged, _KIND)("_text"))
    score = F.col("_tag.score")
    return df.select(*(F.col(f"{inner}.`{c}`") for c in kept), score.alias("score"), (score >= limit).cast("int").alias("predicted"), F.col("_tag.spans").alias("spans"))


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").withColumn("held_out", fold(F.col("doc_id"), 3) == 1)
    field = train(docs.where("not held_out"), table(spark, sf_dir, "labels").where(fold(F.col("doc_id"), 3) != 1))
    out = tag(docs, field, carry=["doc_id", "held_out"])
    return out.select("doc_id", "held_out", "score", "predicted", F.size("spans").cast("long").alias("n_spans"))
