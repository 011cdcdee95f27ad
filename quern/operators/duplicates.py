"""Near-duplicate vectors by signed random projections, whatever their labels.

Equal vectors are one. A vector's code in a band is the signs of its products with fixed random
directions; vectors with equal codes are compared exactly. Two vectors at the angle t agree in a sign
with probability 1 - t/pi, so bits and bands follow from the number of vectors (about BUCKET in a
bucket of unlike ones), the threshold and `miss`: the probability that a pair at the threshold shares
no band (nearer pairs are missed less often). Buckets of more than BLOCK vectors are compared in
pairs of blocks. What is kept of the pairs is each vector's smallest partner, so that the output
grows with the vectors and not with the pairs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.nearest import matrix
from quern.operators.retrieval import few
from quern.sources.shared import on_workers, stored

BUCKET, BLOCK = 64, 2048


def shape(n: int, least: float, miss: float) -> tuple[int, int]:
    """(bits of a band, bands) for n vectors."""
    bits = min(30, max(4, round(math.log2(max(n, 2) / BUCKET))))
    agree = (1 - math.acos(least) / math.pi) ** bits
    return bits, max(1, math.ceil(math.log(miss) / math.log1p(-agree)))


def codes(points: DataFrame, bits: int, bands: int, seed: int = 17) -> DataFrame:
    """id, v, band, code: a row for each band; vectors without a direction are left out."""

    def run(batches):
        plane = None
        for b in batches:
            unit, ok = matrix(b.column(1))
            rows = np.flatnonzero(ok)
            if not len(rows):
                continue
            if plane is None or plane.shape[0] != unit.shape[1]:
                plane = np.random.default_rng([seed, unit.shape[1]]).standard_normal((unit.shape[1], bits * bands))
            sign = (unit[rows] @ plane > 0).reshape(len(rows), bands, bits)
            code = (sign * (1 << np.arange(bits))).sum(axis=2)
            take = pa.array(np.repeat(rows, bands))
            yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(np.tile(np.arange(bands, dtype=np.int32), len(rows))), pa.array(code.ravel().astype(np.int32))], ["id", "v", "band", "code"])

    return points.mapInArrow(run, "id long, v array<double>, band int, code int")


def partners(points: DataFrame, least: float, miss: float) -> DataFrame:
    """b, a: for each id the smallest id below it whose vector has a cosine above least; of
    different vectors (id, v)."""
    coded = codes(points, *shape(points.count(), least, miss))
    every = lambda n: F.sequence(F.lit(0), n - 1)
    big = coded.groupBy("band", "code").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK).select("band", "code", F.ceil(F.col("n") / BLOCK).cast("int").alias("_n"))
    cut = coded.join(few(big, 200_000), ["band", "code"], "left").withColumn("_n", F.coalesce("_n", F.lit(1))).withColumn("_i", F.pmod(F.xxhash64("id"), F.col("_n")).cast("int"))
    cut = cut.withColumn("_j", F.explode(every(F.col("_n")))).select("id", "v", "band", "code", "_i", F.least("_i", "_j").alias("lo"), F.greatest("_i", "_j").alias("hi"))

    def compare(t: pa.Table) -> pa.Table:
        unit, _ = matrix(t.column("v"))
        ids, block = t.column("id").to_numpy(), t.column("_i").to_numpy()
        order = np.argsort(ids)
        unit, ids, block = unit[order], ids[order], block[order]
        low = np.full(len(ids), -1)
        across = t.column("lo")[0] != t.column("hi")[0]
        for k in range(0, len(ids), 512):
            near = unit[k : k + 512] @ unit.T > least
            near &= np.arange(len(ids))[None, :] < np.arange(k, min(k + 512, len(ids)))[:, None]
            if across:
                near &= block[k : k + 512][:, None] != block[None, :]
            low[k : k + 512] = np.where(near.any(axis=1), near.argmax(axis=1), -1)
        hit = low >= 0
        return pa.table({"b": pa.array(ids[hit]), "a": pa.array(ids[low[hit]])})

    return cut.groupBy("band", "code", "lo", "hi").applyInArrow(compare, "b long, a long").groupBy("b").agg(F.min("a").alias("a"))


def duplicates(points: DataFrame, least: float = 0.9, miss: float = 1e-6) -> DataFrame:
    """vec_id, duplicate_of_id for points (vec_id, embedding): the smallest id below a vector's own
    with a cosine above least, null if there is none. Vectors that are null, zero or not finite are
    no duplicates."""
    on_workers(points.sparkSession)
    rows = points.select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    firsts = stored(rows.where("v is not null").groupBy("v").agg(F.min("vec_id").alias("id")).select("id", "v"), "vectors")
    found = stored(partners(firsts, least, miss), "partners")
    # copies are looked up by their vector's first id, and a vector that can't be compared has none
    able = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    ids = stored(rows.where("v is not null").join(firsts, "v").where(able).select("vec_id", "id"), "firsts")
    linked = ids.join(found.withColumnRenamed("b", "id"), "id", "left").select("vec_id", F.coalesce("a", F.when(F.col("id") < F.col("vec_id"), F.col("id"))).alias("duplicate_of_id")).where("duplicate_of_id is not null")
    return rows.select("vec_id").join(linked, "vec_id", "left")
