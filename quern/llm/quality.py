"""Quality classifier: ordinal cumulative-link regression on graded ratings.

P(grade >= k) = sigmoid(w . x - threshold_k), with ordered thresholds and one vector w of
weights on hashed text features for all of them. Features of a text are its words (A-Z in lower
case), their first bytes (PREFIXES) and shapes, hashed; values are 1 + log(count), over the square root of
the sum of squares to the power NORM. Fitted on a bounded sample of rated texts (SAMPLE, by hash
of the id); applied to whole texts, to all rows.

Cases. Rows without a rating or with a null text train nothing; of several ratings of a text the
lowest counts. Without ratings of two grades all weights are 0. Null, empty and white-space texts
have no features: the thresholds alone give their probabilities, and they are not kept. Repeated
rows score alike. A null doc_id is kept. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, Prefix, lean, mix, raw, slices, words
from .common import chosen

BITS = 18
SAMPLE = 12_000
NORM = 0.5
PREFIXES = (4, 6)
LEAST_TEXTS = 3
BATCH = 256
ROUNDS = 30
RATE = 1.2
RIDGE = 1e-6
#: A text is kept if the probability of the highest grade is at least this.
KEEP = 0.5


def features(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value) of the features of each row, by row."""
    low = LOWER[data]
    start, end, at = words(low, off)
    n = len(off) - 1
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    word = mix(Prefix(low).span(start, end) + (end - start).astype(U)) >> U(64 - BITS)
    upper = (data[start] != low[start]).astype(U) + U(2) * (data[end - 1] != low[end - 1]).astype(U)
    tail = np.where(end - start > 1, low[end - 2], 0).astype(U)
    alpha = lambda x: ((x >= 97) & (x <= 122)) | (x >= 128)
    last = low[end - 1].astype(U)
    shape = np.where(alpha(last), U(300), last) * U(1000) + np.where(alpha(tail), U(300), tail) + U(1_000_000) * upper
    shape = mix(shape + U(0x5EED5EED5EED)) >> U(64 - BITS)
    row = np.repeat(np.arange(n), np.diff(at)).astype(U)
    kinds = [word, shape]
    prefix, size = Prefix(low), end - start
    for k in PREFIXES:
        n_bytes = np.minimum(size, k)
        kinds.append(mix(prefix.span(start, start + n_bytes) + n_bytes.astype(U) + U(k << 40)) >> U(64 - BITS))
    key, count = np.unique(np.concatenate([row << U(BITS) | x for x in kinds]), return_counts=True)
    r, bucket, value = (key >> U(BITS)).astype(np.int64), (key & U((1 << BITS) - 1)).astype(np.int64), 1 + np.log(count)
    norm = np.bincount(r, value * value, n) ** NORM
    return r, bucket, value / norm[r]


def fit(row: np.ndarray, bucket: np.ndarray, value: np.ndarray, grade: np.ndarray, grades: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) by AdaGrad over batches in the order given: row is sorted."""
    n = len(grade)
    share = np.array([max(1, (grade >= k).sum()) / max(1, n) for k in range(1, grades)])
    logit = np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    # thresholds: the first, and the logs of the steps to the next ones
    order = np.append(-logit[0], np.log(np.maximum(0.05, -np.diff(logit))))
    w, seen, order_seen = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8), np.full(grades - 1, 1e-8)
    cuts = lambda: order[0] + np.append(0, np.cumsum(np.exp(order[1:])))
    if len(np.unique(grade)) < 2:
        return w, cuts()
    # features of fewer than LEAST_TEXTS sample texts stay out
    keep = (np.bincount(bucket, minlength=1 << BITS) >= LEAST_TEXTS)[bucket]
    row, bucket, value = row[keep], bucket[keep], value[keep]
    sig = lambda x: 1 / (1 + np.exp(-np.clip(x, -40, 40)))
    at = np.searchsorted(row, np.arange(0, n + BATCH, BATCH))
    for _ in range(ROUNDS):
        for k in range(len(at) - 1):
            s, e = at[k], at[k + 1]
            y, r = grade[k * BATCH : (k + 1) * BATCH], row[s:e] - k * BATCH
            m = np.arange(len(y))
            z = np.bincount(r, value[s:e] * w[bucket[s:e]], len(y)).astype(float)
            p = np.column_stack([np.ones(len(y)), sig(z[:, None] - cuts()[None, :]), np.zeros(len(y))])
            own = np.maximum(1e-9, p[m, y] - p[m, y + 1])
            slope = p * (1 - p)
            up, down = slope[m, y] / own / len(y), slope[m, y + 1] / own / len(y)
            used, col = np.unique(bucket[s:e], return_inverse=True)
            g = np.bincount(col, value[s:e] * (down - up)[r], len(used)) + RIDGE * w[used]
            seen[used] += g * g
            w[used] -= RATE * g / np.sqrt(seen[used])
            dcut = np.bincount(y[y > 0] - 1, up[y > 0], grades - 1) - np.bincount(y[y < grades - 1], down[y < grades - 1], grades - 1)
            g = np.append(dcut.sum(), np.cumsum(dcut[::-1])[::-1][1:] * np.exp(order[1:]))
            order_seen += g * g
            order = order - RATE * g / np.sqrt(order_seen)
    return w, cuts()


def train(docs: DataFrame, ratings: DataFrame, grades: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """(weights, thresholds) from docs (doc_id, text) and ratings (doc_id, grade from 0)."""
    ratings = chosen(ratings, doc_id="long", grade="int").where(F.col("doc_id").isNotNull() & F.col("grade").between(0, grades - 1)).groupBy("doc_id").agg(F.min("grade").alias("grade"))
    some = ratings.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = chosen(docs, doc_id="long", text="string").where(F.col("text").isNotNull()).join(F.broadcast(some), "doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in slices(b.column(1)):
                row, bucket, value = features(data, off)
                at = np.searchsorted(row, np.arange(j - i + 1)).tolist()
                idx = [bucket[s:e].astype(np.int32).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                val = [value[s:e].astype(np.float32).tobytes() for s, e in zip(at[:-1], at[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pa.array(idx, pa.binary()), pa.array(val, pa.binary())], ["doc_id", "grade", "idx", "val"])

    # one row for each rated id, so no more than sample
    got = texts.select("doc_id", "text", "grade").mapInArrow(lean(run), "doc_id long, grade int, idx binary, val binary").groupBy("doc_id").agg(F.min(F.struct("grade", "idx", "val")).alias("x")).select("doc_id", "x.*").orderBy("doc_id").toArrow()
    idx, off = raw(got.column("idx"))
    val, _ = raw(got.column("val"))
    idx = np.frombuffer(idx[off[0] : off[-1]].tobytes(), np.int32)
    val = np.frombuffer(val[off[0] : off[-1]].tobytes(), np.float32)
    row = np.repeat(np.arange(len(off) - 1, dtype=np.int32), np.diff(off) // 4)
    grades_of = got.column("grade").to_numpy().astype(np.int64)
    del got
    return fit(row, idx, val, grades_of, grades)


def grade(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], keep: float = KEEP) -> DataFrame:
    """doc_id, score, expected_grade, p_ge_1 .. p_ge_K, kept of every text of docs."""
    weights, cuts = model
    names = [f"p_ge_{k}" for k in range(1, len(cuts) + 1)]
    weights = weights.astype(np.float32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in slices(b.column(1)):
                row, bucket, value = features(data, off)
                z = np.bincount(row, value * weights[bucket], j - i).astype(float)  # int if there are none
                p = 1 / (1 + np.exp(-np.clip(z[:, None] - cuts[None, :], -40, 40)))
                full = np.bincount(row, minlength=j - i) > 0
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(z), pa.array(p.sum(1)), *(pa.array(np.ascontiguousarray(p[:, k])) for k in range(len(cuts))), pa.array((p[:, -1] >= keep) & full)], ["doc_id", "score", "expected_grade", *names, "kept"])

    return chosen(docs, doc_id="long", text="string").mapInArrow(lean(run), "doc_id long, score double, expected_grade double, " + ", ".join(f"{n} double" for n in names) + ", kept boolean")


def graded(labels: DataFrame) -> DataFrame:
    """doc_id, grade of labels (doc_id, quality, toxic): 0 toxic, 1 poor, 2 good."""
    rows = chosen(labels, doc_id="long", quality="int", toxic="int")
    return rows.select("doc_id", F.when(F.col("toxic") == 1, 0).when((F.col("toxic") == 0) & (F.col("quality") == 0), 1).when((F.col("toxic") == 0) & (F.col("quality") == 1), 2).alias("grade"))
