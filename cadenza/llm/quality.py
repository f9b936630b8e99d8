"""Quality classifier: naive Bayes support vectors (Wang and Manning 2012).

Features are indicators of hashed n-grams: words, word pairs, and words' shapes (letters as x or X, digits as 0) with their
pairs. Each is scaled by its class log-count ratio over all labelled training documents, and a linear hinge-loss model is
fitted by dual coordinate descent on a bounded sample of them, the same number of each class if there are as many. Margins
become probabilities by a logistic curve fitted on folds that neither the ratios nor the model for them have seen; its offset
is then moved from the sample's part of each class to that of all labelled documents.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import documents, table
from ._text import Words, mix

U = np.uint64
BITS = 18
SAMPLE = 3000
BLOCK_BITS = 6
FEW = 1_000_000


def _shapes(data: bytes) -> bytes:
    """Letters of a text as x or X, digits as 0, bytes beyond ASCII as x; all else unchanged."""
    return data.translate(_SHAPE)


_SHAPE = bytes(0x78 if 97 <= i <= 122 or i >= 128 else 0x58 if 65 <= i <= 90 else 0x30 if 48 <= i <= 57 else i for i in range(256))


def features(texts: list[bytes], bits: int = BITS) -> list[np.ndarray]:
    """Sorted distinct feature numbers of each text."""
    low, shape = Words(texts, lower=True), Words([_shapes(t) for t in texts])
    kinds = [(mix(w.grams(n) ^ U(k)) >> U(64 - bits), n) for k, (w, n) in enumerate(((low, 1), (low, 2), (shape, 1), (shape, 2)))]
    out = []
    for lo, c in zip(low.first.tolist(), low.counts.tolist(), strict=True):
        out.append(np.unique(np.concatenate([g[lo : lo + max(0, c - n + 1)] for g, n in kinds])).astype(np.int32))
    return out


def _raw(b: pa.RecordBatch) -> list[bytes]:
    return [x or b"" for x in b["text"].cast(pa.binary()).to_pylist()]


def counts(rows: DataFrame, bits: int = BITS) -> DataFrame:
    """How many rows (text, label) of each class hold each feature: per block of features (block) the numbers of the negative
    and of the positive rows (held: 64-bit, one class after the other); block -1: the rows of each class. Each task sums first
    and sends one row a block."""
    width = 1 << max(0, bits - BLOCK_BITS)
    schema = "block int, held binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, n = np.zeros((2, 1 << bits), np.int32), np.zeros(2, np.int32)
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                c = b.slice(i, 1000)
                for f, y in zip(features(_raw(c), bits), c["label"].to_pylist(), strict=True):
                    total[int(y), f] += 1
                    n[int(y)] += 1
        if n.any():
            blocks = range((1 << bits) // width)
            yield pa.RecordBatch.from_pydict({"block": pa.array([-1, *blocks], pa.int32()), "held": pa.array([n.tobytes(), *(total[:, i * width : (i + 1) * width].tobytes() for i in blocks)], pa.binary())})

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.int32).astype(np.int64) for x in t.column("held"))
        return pa.table({"block": t.column("block")[:1], "held": pa.array([total.tobytes()], pa.binary())})

    return rows.mapInArrow(run, schema).groupBy("block").applyInArrow(add, schema)


def gathered(count: DataFrame, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """The counts as two vectors of 2**bits numbers, whatever the corpus, and the rows of each class."""
    width = 1 << max(0, bits - BLOCK_BITS)
    held, n = np.zeros((2, 1 << bits), np.int64), np.zeros(2, np.int64)
    got = count.toArrow()
    for block, x in zip(got.column("block").to_pylist(), got.column("held").to_pylist(), strict=True):
        if block < 0:
            n += np.frombuffer(x, np.int64)
        else:
            held[:, block * width : (block + 1) * width] += np.frombuffer(x, np.int64).reshape(2, width)
    return held, n


def ratios(held: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Log-count ratio of each feature, smoothed by alpha."""
    share = np.log((held + alpha) / (held + alpha).sum(axis=1, keepdims=True))
    return (share[1] - share[0]).astype(np.float32)


def descend(rows: list[np.ndarray], y: np.ndarray, r: np.ndarray, c: float = 0.1, epochs: int = 12, seed: int = 1) -> tuple[np.ndarray, float]:
    """Weights (over r-scaled indicators, brought to unit length a row) and bias of the L2-regularised hinge loss by dual
    coordinate descent (Hsieh et al. 2008). Classes weigh alike in total."""
    rng, w, bias = np.random.default_rng(seed), np.zeros(len(r)), 0.0
    x = [r[f] / max(1e-9, float(np.sqrt((r[f] ** 2).sum()))) for f in rows]
    most = c * np.where(y > 0, len(y) / (2 * max(1, (y > 0).sum())), len(y) / (2 * max(1, (y < 0).sum())))
    a = np.zeros(len(y))
    for _ in range(epochs):
        for i in rng.permutation(len(y)):
            f, v = rows[i], x[i]
            g = y[i] * (float(w[f] @ v) + bias) - 1
            new = min(max(a[i] - g / 2.0, 0.0), most[i])
            if new != a[i]:
                d = (new - a[i]) * y[i]
                w[f] += d * v
                bias += d
                a[i] = new
    return w, bias


def margins(rows: list[np.ndarray], r: np.ndarray, w: np.ndarray, bias: float) -> np.ndarray:
    return np.array([float(w[f] @ r[f]) / max(1e-9, float(np.sqrt((r[f] ** 2).sum()))) + bias for f in rows])


def logistic(m: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset that fit the labels (0, 1) to margins by Newton steps, with a little ridge for separable ones."""
    a, b = 1.0, 0.0
    goal = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(a * m + b, -30, 30)))
        g = np.array([((p - goal) * m).sum() + 1e-3 * a, (p - goal).sum()])
        s = np.maximum(p * (1 - p), 1e-9)
        h = np.array([[(s * m * m).sum() + 1e-3, (s * m).sum()], [(s * m).sum(), s.sum() + 1e-6]])
        d = np.linalg.solve(h, g)
        a, b = a - np.clip(d[0], -5, 5), b - np.clip(d[1], -5, 5)
    return float(a), float(b)


class Model:
    """A vector of 2**bits weights and the curve: of one size whatever the corpus."""

    def __init__(self, weights: np.ndarray, bias: float, ratio: np.ndarray, slope: float, offset: float, bits: int):
        self.weights, self.bias, self.ratio, self.slope, self.offset, self.bits = weights, bias, ratio, slope, offset, bits

    def score(self, texts: list[bytes]) -> np.ndarray:
        m = margins(features(texts, self.bits), self.ratio, self.weights, self.bias)
        return 1 / (1 + np.exp(-np.clip(self.slope * m + self.offset, -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, bits: int = BITS, sample: int = SAMPLE, folds: int = 4, seed: int = 1) -> Model:
    """A model of docs (doc_id, text) by labels (doc_id, label). Rows with a null or a label other than 0 and 1 are left out; an id
    with several labels has the least. Log-count ratios are over all labelled rows; the hinge model is fitted on at most
    `sample` ids of each class, those of least hash, each with its row of least checksum, so runs agree. Rows with one id are
    each counted, null and empty texts too. With rows of one class or none, the score is that class's part of all, one half
    without rows.

    Up to FEW labels are broadcast to the documents; beyond, both are shuffled by doc_id, once."""
    docs = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("label").cast("double").alias("label")).where("doc_id is not null and label in (0, 1)")
    labels = labels.groupBy("doc_id").agg(F.min("label").cast("int").alias("label"))
    few = labels.limit(FEW + 1).count() <= FEW
    rows = docs.join(F.broadcast(labels) if few else labels, "doc_id")
    held, n = gathered(counts(rows.select("text", "label"), bits), bits)
    order = F.xxhash64("doc_id", F.lit(seed))
    least = [labels.where(F.col("label") == y).withColumn("h", order).orderBy("h", "doc_id").limit(sample) for y in (0, 1)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_pydict({"doc_id": b["doc_id"], "h": b["h"], "label": b["label"], "key": b["key"], "f": pa.array([f.tobytes() for f in features(_raw(b), bits)], pa.binary())})

    # 2 * sample labels at most are broadcast, and one row for each comes to the driver
    some = docs.join(F.broadcast(least[0].unionAll(least[1])), "doc_id").select("doc_id", "h", "label", F.md5("text").alias("key"), "text")
    some = some.mapInArrow(run, "doc_id long, h long, label int, key string, f binary")
    got = some.groupBy("doc_id").agg(F.min(F.struct("key", "h", "label", "f")).alias("r")).select("r.h", "doc_id", "r.label", "r.f").toArrow()
    picked = sorted(zip(*(got.column(c).to_pylist() for c in ("h", "doc_id", "label", "f")), strict=True))
    x, y = [np.frombuffer(f, np.int32) for *_, f in picked], np.array([2 * v - 1 for _, _, v, _ in picked])
    r = ratios(held)
    if len(set(y.tolist())) < 2:
        p = 0.5 if not len(y) else float(y[0] > 0)
        return Model(np.zeros(1 << bits), 0.0, r, 0.0, float(np.log((p + 1e-6) / (1 - p + 1e-6))), bits)
    fold = np.arange(len(y)) % folds
    m = np.zeros(len(y))
    for k in range(folds):
        i, o = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        if not len(o) or len(set(y[i].tolist())) < 2:
            continue
        seen = held.copy()
        for j in o:
            seen[int(y[j] > 0), x[j]] -= 1
        apart = ratios(seen)
        m[o] = margins([x[j] for j in o], apart, *descend([x[j] for j in i], y[i], apart, seed=seed))
    up = (y > 0).sum()
    slope, offset = logistic(m, (y > 0).astype(float))
    offset += float(np.log(n[1] / n[0]) - np.log(up / (len(y) - up)))
    w, bias = descend(x, y, r, seed=seed)
    return Model(w, bias, r, slope, offset, bits)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id and score of each row of docs; null and empty texts are scored too, by the bias alone. One pass; the model is
    broadcast (4 MB by default, set by bits alone)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1000):
                c = b.slice(i, 1000)
                yield pa.RecordBatch.from_pydict({"doc_id": c["doc_id"], "score": pa.array(held.value.score(_raw(c)), pa.float64())})

    return documents(docs).mapInArrow(run, "doc_id long, score double")


def fold_of(doc_id) -> int:
    return zlib.crc32(str(doc_id).encode()) % 5


def op6_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """The score of every document. Rows whose crc32(doc_id as text) modulo 5 is 0 are held out."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    known = labels.where(~held).select("doc_id", F.col("quality").alias("label"))
    out = scored(docs, trained(docs, known))
    return out.select("doc_id", F.coalesce(held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
