"""Nearest neighbours by an index: inverted lists around centroids, exact cosines inside them.

The centroids are fitted on a bounded sample (SAMPLE rows, the first by a hash of the id); every row
is then assigned to its nearest centroid. A search visits the lists whose centroids are nearest to
the query and takes the exact cosine, in double precision, of every row there. How many lists it
visits is measured: `tuned` looks at where the true neighbours of a bounded set of queries lie. A
query that finds fewer hits than it asks for visits all lists, which is the exact scan.

Rows and queries meet in cells: a list is cut into parts of about PART rows and its queries into
blocks of about BLOCK, so that no list, however full, is one task's work; a cell is a matrix product.
Vectors that are null, zero or not finite stand in the index (list -1) and are never found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.retrieval import few, ranked
from quern.sources.shared import on_workers, stored

#: Rows that centroids are fitted on, rounds of fitting, and lists at most.
SAMPLE, ROUNDS, MOST_LISTS = 20_000, 8, 4096
#: Rows and queries of a cell, about.
PART, BLOCK = 8192, 1024
#: Queries whose true neighbours set the number of lists that a search visits.
TUNING = 256


@dataclass(frozen=True)
class Index:
    """rows: list, part, vec_id, embedding, label. sizes: list, parts (a row for each list)."""

    centroids: np.ndarray
    rows: DataFrame
    sizes: DataFrame


def matrix(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors (double) of a list column, and which rows have one."""
    rows = column.to_pylist()
    width = max((len(r) for r in rows if r), default=0)
    out = np.array([[np.nan if x is None else x for x in r] if r and len(r) == width else [np.nan] * width for r in rows], float).reshape(len(rows), width)
    with np.errstate(all="ignore"):
        size = np.sqrt((out * out).sum(axis=1, keepdims=True))
        ok = np.isfinite(size[:, 0]) & (size[:, 0] > 0)
        return np.where(ok[:, None], out / size, 0.0), ok


def fitted(sample: np.ndarray, lists: int) -> np.ndarray:
    """Centroids on the unit sphere; empty ones go to the rows that fit worst."""
    at = sample[np.linspace(0, len(sample) - 1, lists).astype(int)].copy()
    for _ in range(ROUNDS):
        near = sample @ at.T
        own = near.argmax(axis=1)
        total = np.zeros_like(at)
        np.add.at(total, own, sample)
        empty = np.flatnonzero(np.bincount(own, minlength=lists) == 0)
        total[empty] = sample[np.argsort(near.max(axis=1))[: len(empty)]]
        at = total / np.maximum(np.linalg.norm(total, axis=1, keepdims=True), 1e-12)
    return at


def assigned(rows: DataFrame, centroids: np.ndarray, vector: str, probes: int = 1) -> DataFrame:
    """rows with list and near (0: the nearest list), once for each of the nearest `probes` lists."""
    at = rows.columns.index(vector)

    def run(batches):
        for b in batches:
            unit, ok = matrix(b.column(at))
            if unit.shape[1] != centroids.shape[1]:
                unit, ok = np.zeros((b.num_rows, centroids.shape[1])), np.zeros(b.num_rows, bool)
            score = unit @ centroids.T
            n = min(probes, score.shape[1])
            best = np.argsort(-score, axis=1, kind="stable")[:, :n]
            best[~ok] = -1
            take = pa.array(np.repeat(np.arange(b.num_rows), n))
            columns = [*(c.take(take) for c in b.columns), pa.array(best.ravel().astype(np.int32)), pa.array(np.tile(np.arange(n, dtype=np.int32), b.num_rows))]
            yield pa.RecordBatch.from_arrays(columns, [*b.schema.names, "list", "near"])

    return rows.mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType()), T.StructField("near", T.IntegerType())]))


def built(points: DataFrame, lists: int | None = None, path: str | None = None) -> Index:
    """The index of points (vec_id, embedding, label), as a table of the shared folder or at path.
    lists: the root of the number of rows unless it is given."""
    on_workers(points.sparkSession)
    points = points.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("int").alias("label"))
    first = points.where("embedding is not null").orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    sample, ok = matrix(first.column(0))
    sample = sample[ok]
    n = lists or round(points.count() ** 0.5)
    n = max(1, min(n, MOST_LISTS, len(sample)))
    centroids = fitted(sample, n) if len(sample) else np.zeros((1, 1))
    rows = assigned(points, centroids, "embedding").drop("near")
    rows = stored(rows.repartition("list", F.xxhash64("vec_id") % 16), "lists", path)
    sizes = rows.groupBy("list").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    placed = rows.join(F.broadcast(sizes), "list").withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("parts")).cast("int")).drop("parts")
    return Index(centroids, placed, sizes.where("list >= 0"))


def cells(asked: DataFrame, index: Index, k: int) -> DataFrame:
    """qid, vec_id, score, list, near: the best k of each query (qid, qvec, low, high, list, near) in
    each part of each list that it visits; low and high bound the label and may be null."""
    blocks = asked.groupBy("list").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    shape = F.broadcast(index.sizes.join(blocks, "list"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = asked.join(shape, "list").withColumn("block", F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int")).withColumn("part", every("parts"))
    left = left.select("list", "part", "block", "qid", "qvec", "low", "high", "near")
    right = index.rows.join(F.broadcast(blocks), "list").withColumn("block", every("blocks")).select("list", "part", "block", "vec_id", "embedding", "label")

    def product(queries: pa.Table, rows: pa.Table) -> pa.Table:
        out = {"qid": [], "vec_id": [], "score": [], "list": [], "near": []}
        if queries.num_rows and rows.num_rows:
            (q, q_ok), (p, p_ok) = matrix(queries.column("qvec")), matrix(rows.column("embedding"))
            ids, label = (rows.column(c).to_numpy() for c in ("vec_id", "label"))
            low, high = (queries.column(c).to_numpy().astype(float) for c in ("low", "high"))
            with np.errstate(invalid="ignore"):
                able = p_ok[None, :] & q_ok[:, None] & ~(label[None, :] < low[:, None]) & ~(label[None, :] > high[:, None])
                # without a label there is no band that a row is in
                able &= ~np.isnan(label.astype(float))[None, :] | (np.isnan(low) & np.isnan(high))[:, None]
            score = np.where(able, np.round(q @ p.T, 6), -np.inf) if q.shape[1] == p.shape[1] else np.full((len(q), len(p)), -np.inf)
            for i in range(len(q)):
                best = np.flatnonzero(score[i] >= np.partition(score[i], -k)[-k]) if len(p) > k else np.arange(len(p))
                best = best[np.isfinite(score[i, best])]
                best = best[np.lexsort((ids[best], -score[i, best]))][:k]
                out["vec_id"].append(ids[best])
                out["score"].append(score[i, best])
                out["qid"].append(np.full(len(best), queries.column("qid")[i].as_py()))
            n = [len(x) for x in out["qid"]]
            out["list"], out["near"] = ([np.repeat(queries.column(c).to_numpy(), n)] for c in ("list", "near"))
        kinds = {"qid": pa.int64(), "vec_id": pa.int64(), "score": pa.float64(), "list": pa.int32(), "near": pa.int32()}
        return pa.table({c: pa.array(np.concatenate(v) if v else [], t) for (c, t), v in zip(kinds.items(), out.values())})

    keys = ["list", "part", "block"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(product, "qid long, vec_id long, score double, list int, near int")


def visited(queries: DataFrame, index: Index, k: int, probes: int) -> DataFrame:
    """qid, vec_id, score, rank, near: the best k of each query among the nearest `probes` lists."""
    asked = few(assigned(queries.select("qid", F.col("qvec").cast("array<double>").alias("qvec"), "low", "high"), index.centroids, "qvec", probes))
    return ranked(cells(asked, index, k), ["qid"], [F.desc("score"), F.col("vec_id")], k)


def unbound(queries: DataFrame) -> DataFrame:
    """queries (qid, qvec) that ask for any label."""
    return queries.select("qid", "qvec", F.lit(None).cast("int").alias("low"), F.lit(None).cast("int").alias("high"))


def search(queries: DataFrame, index: Index, k: int, probes: int | None = None, target: float = 0.95) -> DataFrame:
    """qid, vec_id, score, rank for queries (qid, qvec, low, high): the k nearest of the lists that a
    query visits (as many as `tuned` finds unless probes is given). Queries with fewer hits than k
    are asked again over all lists."""
    n = len(index.centroids)
    probes = min(n, probes or tuned(queries, index, k, target))
    got = visited(queries, index, k, probes)
    if probes < n:
        got = stored(got, "hits")
        full = got.groupBy("qid").agg(F.count("*").alias("n")).where(F.col("n") >= k).select("qid")
        poor = queries.join(full, "qid", "left_anti")
        if not poor.isEmpty():
            got = got.join(full, "qid", "left_semi").unionByName(visited(poor, index, k, n))
    return got.select("qid", "vec_id", "score", "rank")


def tuned(queries: DataFrame, index: Index, k: int, target: float = 0.95) -> int:
    """How many of the nearest lists hold the share `target` of the k true neighbours of TUNING
    queries (the first by a hash of the id)."""
    some = queries.orderBy(F.xxhash64("qid"), "qid").limit(TUNING)
    near = [r["near"] for r in visited(some, index, k, len(index.centroids)).select("near").collect()]
    return int(np.quantile(near, target, method="higher")) + 1 if near else len(index.centroids)


def recall(found: DataFrame, true: DataFrame) -> DataFrame:
    """queries, wanted, found, recall: how many of the true (qid, vec_id) are found."""
    hit = true.select("qid", "vec_id").join(found.select("qid", "vec_id", F.lit(1).alias("hit")), ["qid", "vec_id"], "left")
    return hit.agg(F.countDistinct("qid").alias("queries"), F.count("*").alias("wanted"), F.count("hit").alias("found")).withColumn("recall", F.col("found") / F.col("wanted"))
