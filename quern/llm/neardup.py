"""Embedding near-dedup: PCA-ordered tiled comparison of vectors with equal labels.

Equal vectors are grouped first. The rest of a label is cut into blocks along its angle to the
first principal axis, and meets in pairs of blocks (tiles); blocks whose angles lie further apart
than the threshold's never meet. A tile turns its vectors to principal axes, adds up products over
the leading axes first, bounds what is left by the norms of the suffixes, and drops pairs whose
cosine cannot reach the threshold.
What remains is decided by the cosine of the vectors as they are, in double precision. Tiles
return link counts and the links that span their groups, never all pairs.

Cases. Null labels and vectors that are null, empty, all zero or hold null or non-finite
components link with nothing, nor do vectors of different lengths. Each row is a vector: rows
that repeat a vec_id link like others. A null vec_id gives no links to others and null ids. An
empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import groups, labels, lean, runs
from .common import chosen, components, small, written

THRESHOLD = 0.93
BLOCK = 2048
#: Vectors that the axes are fitted on; they decide the speed, never the result.
PCA_SAMPLE = 5_000
STEPS = (8, 16, 32)
#: What rounding, and what tells equal angles apart, may add to the difference of two angles.
SLACK = 1e-6
TIES = SLACK / 4


def axes(vectors: np.ndarray) -> np.ndarray:
    """Principal axes of unit vectors, those that carry most first."""
    x = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    _, v = np.linalg.eigh(x.T @ x)
    return v[:, ::-1]


def links(x: np.ndarray, y: np.ndarray | None, turn: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (i, j) of rows of x and y, or i < j of x alone, with cosine >= threshold."""
    unit = lambda m: m / np.linalg.norm(m, axis=1, keepdims=True)
    a = unit(x) @ turn
    b = a if y is None else unit(y) @ turn
    rest = lambda m: np.sqrt(np.maximum(0, np.cumsum((m * m)[:, ::-1], axis=1)[:, ::-1]))
    ra, rb, d, slack = rest(a), rest(b), a.shape[1], threshold - 1e-9
    steps = [s for s in STEPS if s < d]
    s = steps[0] if steps else d
    sums = a[:, :s] @ b[:, :s].T
    fit = sums + (ra[:, s][:, None] * rb[:, s][None, :] if s < d else 0) >= slack
    if y is None:
        fit &= np.tri(len(a), dtype=bool, k=-1).T
    i, j = np.nonzero(fit)
    sums = sums[i, j]
    for e in [*steps[1:], d] if s < d else []:
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 200_000):
            part = slice(k, k + 200_000)
            sums[part] += np.einsum("ij,ij->i", a[i[part], s:e], b[j[part], s:e])
            keep[part] = sums[part] + (ra[i[part], e] * rb[j[part], e] if e < d else 0) >= slack
        i, j, sums, s = i[keep], j[keep], sums[keep], e
    z = x if y is None else y
    nx, nz = np.sqrt((x * x).sum(1)), np.sqrt((z * z).sum(1))
    keep = np.zeros(len(i), bool)
    for k in range(0, len(i), 200_000):
        p, q = i[k : k + 200_000], j[k : k + 200_000]
        keep[k : k + 200_000] = (x[p] * z[q]).sum(1) / (nx[p] * nz[q]) >= threshold
    return i[keep], j[keep]


def angle(turns: dict[int, np.ndarray]):
    """The angle of v (of dim components) to the first axis of its dimension, 0 without one."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda a, b: a.cast("double") * b), F.lit(0.0), lambda s, p: s + p)
    norm = F.sqrt(dot(F.col("v"), F.transform("v", lambda x: x.cast("double"))))
    out = F.lit(0.0)
    for dim, turn in turns.items():
        cos = dot(F.col("v"), F.array(*(F.lit(float(x)) for x in turn[:, 0]))) / norm
        out = F.when(F.col("dim") == dim, F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cos)))).otherwise(out)
    return F.coalesce(out, F.lit(0.0))


def near_dedup(table: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK) -> DataFrame:
    """vec_id, n_links, component_id, kept of table (vec_id, embedding, label)."""
    spark = table.sparkSession
    single = table.schema["embedding"].dataType.elementType.typeName() == "float"
    rows = chosen(table, vec_id="long", label="string", embedding="array<float>" if single else "array<double>").withColumnRenamed("embedding", "v")
    fine = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf")))) & F.exists("v", lambda x: x != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    reps = written(rows.where("fine").groupBy("label", "v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies")).withColumn("dim", F.size("v")), "vectors")

    n = reps.count()
    every = max(1, n // PCA_SAMPLE)
    got = reps.where(F.pmod(F.xxhash64("rep"), F.lit(every)) == 0).select("dim", "v").limit(4 * PCA_SAMPLE).toArrow()  # the share holds about PCA_SAMPLE; the limit only bounds chance
    turns = {}
    for dim in set(got.column("dim").to_pylist()):
        mine = got.filter(pa.compute.equal(got.column("dim"), dim)).column("v")
        if len(mine) >= dim:
            turns[dim] = axes(np.array(mine.to_pylist(), np.float64))

    # Blocks are ranges of the angle; a pair's angle is no less than the difference of theirs. Equal
    # angles (all of a dimension without axes) are told apart, so that they fill blocks as well.
    apart = F.pmod(F.xxhash64("rep"), F.lit(1 << 20)) * (TIES / (1 << 20))
    ranged = written(reps.withColumn("t", angle(turns) + apart).repartitionByRange(max(1, -(-n // block)), "label", "dim", "t").withColumn("own", F.spark_partition_id()), "vectors-by-angle")
    bounds = written(ranged.groupBy("label", "dim", "own").agg(F.min("t").alias("first"), F.max("t").alias("last")), "blocks")
    other = bounds.select("label", "dim", F.col("own").alias("hi"), F.col("first").alias("next"))
    pairs = bounds.withColumnRenamed("own", "lo").join(small(other, other.count(), 100_000), ["label", "dim"]).where((F.col("lo") <= F.col("hi")) & (F.col("next") - F.col("last") <= math.acos(threshold) + SLACK)).select("label", "dim", "lo", "hi")
    sides = F.explode(F.when(F.col("lo") == F.col("hi"), F.array(F.struct(F.col("lo").alias("own"), F.lit(0).alias("side")))).otherwise(F.array(F.struct(F.col("lo").alias("own"), F.lit(0).alias("side")), F.struct(F.col("hi").alias("own"), F.lit(1).alias("side")))))
    met = written(pairs.select("label", "dim", "lo", "hi", sides.alias("x")).select("label", "dim", "lo", "hi", "x.own", "x.side"), "tiles")
    tiles = ranged.drop("t").join(small(met, met.count(), 200_000), ["label", "dim", "own"]).drop("own")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["label", "dim", "lo", "hi"]):
            at = runs(t, ["dim", "lo", "hi"]) if len(set(t.column("label").to_pylist())) == 1 else None
            if at is None:
                label = np.array(t.column("label").to_pylist())
                at = np.append(np.flatnonzero(np.append(True, (label[1:] != label[:-1])) | np.isin(np.arange(t.num_rows), runs(t, ["dim", "lo", "hi"]))), t.num_rows)
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s < 2:
                    continue
                g = t.slice(s, e - s).combine_chunks()
                dim = g.column("dim")[0].as_py()
                x = g.column("v").chunk(0).flatten().to_numpy(zero_copy_only=False).reshape(e - s, dim).astype(np.float64)
                side, rep, copies = (g.column(c).to_numpy() for c in ("side", "rep", "copies"))
                if g.column("lo")[0].as_py() == g.column("hi")[0].as_py():
                    i, j = links(x, None, turns.get(dim, np.eye(dim)), threshold)
                else:
                    one, two = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
                    if not len(one) or not len(two):
                        continue
                    i, j = links(x[one], x[two], turns.get(dim, np.eye(dim)), threshold)
                    i, j = one[i], two[j]
                if not len(i):
                    continue
                w = np.bincount(i, copies[j], e - s) + np.bincount(j, copies[i], e - s)
                low = labels(e - s, i, j)
                on = np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[low[on]]), pa.array(w[on].astype(np.int64))], ["a", "b", "w"])

    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = ["label", "dim", "lo", "hi"]
    found = written(tiles.repartition(parts, *keys).sortWithinPartitions(*keys, "side", "rep").mapInArrow(lean(run), "a long, b long, w long"), "links")
    comps = components(found.select("a", "b"), "vector-edges")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    nodes = reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left").select("label", "v", "rep", (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n"), F.coalesce("comp", "rep").alias("c"))
    whole = rows.where("fine").join(nodes, ["label", "v"]).select("vec_id", F.col("n").alias("n_links"), F.col("c").alias("component_id"))
    alone = rows.where("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return whole.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
