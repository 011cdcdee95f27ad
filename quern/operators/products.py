"""The exact nearest points of every query, by matrix products.

Queries and points that are equal in the keys meet in cells: a key's points are cut into parts of about
PART rows and its queries into blocks of about BLOCK, so that no key, however full, is one task's work.
A cell goes through its points CHUNK at a time and holds the best k of each query; what leaves it is
these alone, so that pairs are never rows. The products choose; the cosines of what they choose are
worked out again, and rounded, as SQL does. A null vector has a null score, which comes last; one that is
zero or not finite has the score NaN, which comes first.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.sources.shared import on_workers

PART, BLOCK, CHUNK = 8192, 4096, 1024
#: Keys up to which their sizes are broadcast, and pairs whose cosines are worked out at once.
KEYS, PAIRS = 20_000, 1 << 16
#: Half a unit of the sixth digit, and a little for the sums of the products; the score of no vector.
NEAR, NONE = 0.6e-6, -3.0


def raw(column: pa.ChunkedArray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (double, filled up with zeros), and how long each is (-1: null or with a null)."""
    lists = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = lists.flatten()
    if not lists.null_count and not flat.null_count and len(flat) == len(lists) * width and set(np.unique(lists.value_lengths())) <= {width}:
        return flat.to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), width), np.full(len(lists), width)
    rows = [None if v is None or None in v else v for v in lists.to_pylist()]
    out = np.zeros((len(rows), width))
    for at, v in enumerate(rows):
        if v:
            out[at, : len(v)] = v
    return out, np.array([-1 if v is None else len(v) for v in rows])


def longest(*columns: pa.ChunkedArray) -> int:
    return max((n for c in columns for n in c.combine_chunks().value_lengths().to_pylist() if n is not None), default=0)


def rounded(x: np.ndarray) -> np.ndarray:
    """Six digits, halves away from zero."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


def first(at: np.ndarray, row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The best k of each query: high scores first, small ids first where they are equal."""
    order = np.lexsort((ids[row], -score, at))
    at, row, score = at[order], row[order], score[order]
    begin = np.flatnonzero(np.r_[True, at[1:] != at[:-1]]) if len(at) else np.zeros(0, int)
    keep = np.arange(len(at)) - np.repeat(begin, np.diff(np.r_[begin, len(at)])) < k
    return at[keep], row[keep], score[keep]


def search(asked: pa.Table, rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of queries (qvec; _top, if there is such a column: no higher label) and of rows
    (vec_id, embedding, label), and scores (inf: NaN)."""
    width = longest(asked.column("qvec"), rows.column("embedding"))
    (q, q_len), (p, p_len) = raw(asked.column("qvec"), width), raw(rows.column("embedding"), width)
    ids = rows.column("vec_id").to_numpy()
    top = asked.column("_top").to_numpy().astype(float) if "_top" in asked.column_names else None
    label = None if top is None else rows.column("label").to_numpy().astype(float)
    with np.errstate(all="ignore"):
        q_sq, p_sq = (q * q).sum(axis=1), (p * p).sum(axis=1)
        q_ok, p_ok = (np.isfinite(s) & (s > 0) for s in (q_sq, p_sq))
        q_unit, p_unit = (np.where(ok[:, None], v / np.sqrt(s)[:, None], 0.0) for v, s, ok in ((q, q_sq, q_ok), (p, p_sq, p_ok)))
    plain = q_ok.all() and p_ok.all() and len({*q_len, *p_len}) == 1
    floor = np.full(len(q), -np.inf)
    at, row, score = np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    for z in range(0, len(p), CHUNK):
        near = q_unit @ p_unit[z : z + CHUNK].T
        if not plain:
            near[~q_ok] = np.inf
            near[:, ~p_ok[z : z + CHUNK]] = np.inf
            near[(q_len[:, None] != p_len[None, z : z + CHUNK]) | (q_len < 0)[:, None]] = NONE
        if top is not None:
            near[~(label[None, z : z + CHUNK] <= top[:, None])] = -np.inf
        if z == 0 and near.shape[1] > k:
            floor = np.partition(near, -k, axis=1)[:, -k] - 2 * NEAR
        i, j = np.nonzero((near >= floor[:, None]) & (near > -np.inf))
        exact = near[i, j]
        for a in range(0, len(i), PAIRS):
            b = slice(a, a + PAIRS)
            x, y = i[b], j[b] + z
            with np.errstate(all="ignore"):
                cosine = rounded(np.clip(np.einsum("ij,ij->i", q[x], p[y]) / np.sqrt(q_sq[x] * p_sq[y]), -1, 1))
            exact[b] = np.where(np.isfinite(exact[b]) & (exact[b] > NONE), cosine, exact[b])
        at, row, score = first(np.r_[at, i], np.r_[row, j + z], np.r_[score, exact], ids, k)
        full = np.bincount(at, minlength=len(q)) >= k
        last = np.r_[at[1:] != at[:-1], True] if len(at) else np.zeros(0, bool)
        worst = np.full(len(q), -np.inf)
        worst[at[last]] = score[last]
        floor = np.where(full, worst - NEAR, floor)
    return at, row, score


def best(queries: DataFrame, points: DataFrame, k: int, keys: tuple[str, ...] = (), keep: tuple[str, ...] = (), upto: bool = False) -> DataFrame:
    """qid, keep, vec_id, score: for each query (qid, qvec, keys and other columns `keep`) the best k
    of each part of the points (vec_id, embedding, keys) with equal keys; the k nearest are among
    them. With upto, of points whose label is no higher than the query's grade."""
    on_workers(points.sparkSession)
    by = [f"_k{n}" for n in range(len(keys) or 1)]
    own = [F.col(c).alias(b) for b, c in zip(by, keys)] or [F.lit(0).alias(by[0])]
    left = queries.select(*own, "qid", "qvec", *keep, *([F.col("grade").cast("double").alias("_top")] if upto else []))
    right = points.select(*own, "vec_id", "embedding", *([F.col("label").cast("double").alias("label")] if upto else []))
    size = lambda df, of, name: df.groupBy(*by).agg(F.ceil(F.count("*") / of).cast("int").alias(name))
    shape = size(left, BLOCK, "_blocks").join(size(right, PART, "_parts"), by)
    if shape.limit(KEYS + 1).count() <= KEYS:
        shape = F.broadcast(shape)
    place = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    cell = [*by, "_block", "_part"]
    left = left.join(shape, by).withColumn("_block", place("qid", "_blocks")).withColumn("_part", every("_parts")).drop("_blocks", "_parts")
    right = right.join(shape, by).withColumn("_part", place("vec_id", "_parts")).withColumn("_block", every("_blocks")).drop("_blocks", "_parts")
    of_query = ["qid", *keep]
    schema = T.StructType([*(queries.schema[c] for c in of_query), points.schema["vec_id"], T.StructField("score", T.DoubleType())])

    def product(asked: pa.Table, rows: pa.Table) -> pa.Table:
        at, row, score = search(asked, rows, k) if asked.num_rows and rows.num_rows else (np.zeros(0, int), np.zeros(0, int), np.zeros(0))
        scores = pa.array(np.where(np.isposinf(score), np.nan, score), mask=score == NONE)
        found = {c: asked.column(c).take(pa.array(at)) for c in of_query}
        return pa.table(found | {"vec_id": rows.column("vec_id").take(pa.array(row)), "score": scores})

    return left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInArrow(product, schema)
