"""Mixing sources to target weights: a multivariate-hypergeometric splitting tree.

Each source's texts fall by a hash into blocks, and blocks stand in a permuted order. A source's
target in words gives whole passes over it and a quota of its blocks; the block at the quota's
end is drawn in part, by hash order, so that the words taken come nearest to the target. The exact
quotas of all sources are split between the two halves of the output shards by a multivariate
hypergeometric draw, and so on down to single shards: each shard gets exact quotas and takes the
next disjoint run of each source's permuted blocks. Inside a shard rows are ordered by a hash.
All draws come from the seed, so reruns agree.

What the driver holds is a row for each source and its shards' quotas. Blocks of a source are at
most MAX_BLOCKS, so that the order of blocks and the cut in one of them are small tasks however
large the source is.

Cases. Null text has size 0. A null source is a source, the last. Sources without words have
target 0. A text is taken 0, 1 or 2 times; rows alike in doc_id and text are taken alike. Ties
in the hash are taken together. An empty table gives no rows. Other columns are kept by
`mixture` and ignored by `plan`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import lean, slices, words
from .common import chosen, small, stowed, unstowed, written

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
SHARDS = 16
#: Words (and texts) of a shard that one task orders; larger shards are written by several.
TASK_WORDS = 2_000_000
SEED = 20240607
BLOCK_ROWS = 64
MAX_BLOCKS = 16_384
#: Texts on either side of the cut in a source's last block of which those are drawn that
#: come nearest to what is left of the target; words of that which are met exactly.
NEAR = 100
EXACT = 100_000


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """total shared by weight, none above cap times its size; the excess is shared again."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = float(total)
    while free:
        unit = left / sum(weights[i] for i in free)
        over = [i for i in sorted(free) if weights[i] * unit > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = weights[i] * unit
            break
        for i in over:
            out[i] = cap * sizes[i]
            left -= out[i]
            free.remove(i)
    return out


def tree(quotas: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """Exact quotas of each shard (rows) from each source (columns)."""
    out = np.zeros((shards, len(quotas)), np.int64)
    todo = [(quotas.astype(np.int64), 0, shards)]
    while todo:
        have, lo, hi = todo.pop()
        if hi - lo == 1:
            out[lo] = have
            continue
        mid, total = (lo + hi) // 2, int(have.sum())
        # seats are dealt to the halves first, so that shards differ by one block at most
        take = total * (mid - lo) // (hi - lo)
        draw = np.random.Generator(np.random.PCG64([seed, lo, hi])).multivariate_hypergeometric(have, take, method="marginals") if total else have
        todo += [(draw, lo, mid), (have - draw, mid, hi)]
    return out


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, src, size, h: words of each text, and the hash that orders it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n = [np.diff(words(data, off)[2]) for _, _, data, off in slices(b.column(3))]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(np.concatenate(n) if n else np.zeros(0, np.int64)), b.column(2)], ["doc_id", "src", "size", "h"])

    return keyed(docs).select("doc_id", "src", "h", "text").mapInArrow(lean(run), "doc_id long, src string, size long, h long")


def keyed(docs: DataFrame) -> DataFrame:
    src = F.coalesce(F.concat(F.lit("="), F.col("source")), F.lit(""))
    return docs.withColumn("src", src).withColumn("h", F.xxhash64(F.lit(SEED), "doc_id", "text"))


def block(n: str = "blocks"):
    return F.pmod(F.xxhash64(F.lit(1), "h"), F.col(n)).cast("int")


def fill(gap: float, near: list[tuple[int, int]]) -> list[int]:
    """Hashes of the texts (hash, words) whose sum comes nearest to the gap."""
    out, rest = [], sorted(x for x in near if x[1] > 0)
    while rest and gap > EXACT and rest[0][1] <= gap:
        h, n = rest.pop(0)
        out.append(h)
        gap -= n
    limit = 2 * EXACT
    sums = [1]  # bit s: some of the texts so far have s words together
    for _, n in rest:
        sums.append((sums[-1] | sums[-1] << n) & ((1 << limit) - 1))
    whole = min(max(0, round(gap)), limit - 1)
    below = (sums[-1] & ((1 << whole + 1) - 1)).bit_length() - 1
    above = sums[-1] >> whole
    s = whole + (above & -above).bit_length() - 1 if above else below
    s = below if gap - below <= s - gap else s
    for k in range(len(rest), 0, -1):
        if not sums[k - 1] >> s & 1:
            out.append(rest[k - 1][0])
            s -= rest[k - 1][1]
    return out


def plan(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP, shards: int = SHARDS, seed: int = SEED) -> tuple[DataFrame, DataFrame]:
    """(doc_id, src, size, h of all texts; src, block, whole, shards, cut, extra, target, source_size)."""
    spark = docs.sparkSession
    light = written(sizes(docs), "sizes")
    rows = light.groupBy("src").agg(F.count("*").alias("n"), F.sum("size").alias("words")).collect()  # one for each source
    rows.sort(key=lambda r: (r["src"] == "", r["src"]))
    goal = targets([r["words"] for r in rows], [float(weights[i % len(weights)]) for i in range(len(rows))], share * sum(r["words"] for r in rows), cap)
    blocks = [min(MAX_BLOCKS, max(1, -(-r["n"] // BLOCK_ROWS))) for r in rows]
    whole = [int(g // r["words"]) if r["words"] else 0 for g, r in zip(goal, rows, strict=True)]
    left = [float(g - w * r["words"]) if r["words"] else 0.0 for g, w, r in zip(goal, whole, rows, strict=True)]
    table = lambda data, kind: spark.createDataFrame(data, kind)
    src = small(table([(r["src"], b, x) for r, b, x in zip(rows, blocks, left, strict=True)], "src string, blocks int, left double"), len(rows), 100_000)

    # The order of each source's blocks, and which of them the quota ends in.
    sums = light.join(src, "src").withColumn("block", block()).groupBy("src", "block", "left").agg(F.sum("size").alias("words"))
    order = W.partitionBy("src").orderBy(F.xxhash64(F.lit(seed), "src", "block"), "block")
    placed = written(sums.withColumn("pos", F.row_number().over(order) - 1).withColumn("upto", F.sum("words").over(order.rowsBetween(W.unboundedPreceding, 0))), "blocks")
    last = placed.where((F.col("upto") > F.col("left")) & (F.col("upto") - F.col("words") <= F.col("left")) & (F.col("words") > 0)).select("src", "block", "pos", (F.col("left") - F.col("upto") + F.col("words")).alias("gap"))
    edge = light.join(src, "src").withColumn("block", block()).join(small(last, len(rows), 100_000), ["src", "block"])
    by_hash = W.partitionBy("src").orderBy("h")
    edge = edge.withColumn("sum", F.sum("size").over(by_hash.rangeBetween(W.unboundedPreceding, 0))).withColumn("k", F.dense_rank().over(by_hash))
    edge = edge.withColumn("at", F.coalesce(F.max(F.when(F.col("sum") <= F.col("gap"), F.col("k"))).over(W.partitionBy("src")), F.lit(0)))
    cuts = edge.where(F.col("k") <= F.col("at") - NEAR).groupBy("src").agg(F.max("h").alias("cut"), F.max("sum").alias("sum"))
    after = edge.where(F.abs(F.col("k") - F.col("at") - 0.5) < NEAR).groupBy("src", "h").agg(F.sum("size").alias("size")).groupBy("src").agg(F.collect_list(F.struct("h", "size")).alias("after"))
    ends = {r["src"]: r for r in last.join(cuts, "src", "left").join(after, "src", "left").collect()}  # one for each source
    quota, cut, extra, at = [], [], [], []
    for r, w, b in zip(rows, whole, blocks, strict=True):
        e = ends.get(r["src"])
        at.append(e["pos"] if e else -1)
        quota.append(w * b + (e["pos"] + 1 if e else 0))
        cut.append(e["cut"] if e else None)
        extra.append(fill(e["gap"] - (e["sum"] or 0), [(x["h"], x["size"]) for x in e["after"] or []]) if e else [])

    shares = tree(np.array(quota, np.int64), shards, seed) if rows else np.zeros((shards, 0), np.int64)
    upto = np.cumsum(shares, axis=0)
    of = table([(r["src"], b, w, p, c, x, upto[:, k].tolist(), float(g), r["words"]) for k, (r, b, w, p, c, x, g) in enumerate(zip(rows, blocks, whole, at, cut, extra, goal, strict=True))], "src string, blocks int, whole int, end int, cut long, extra array<long>, upto array<long>, target double, source_size long")
    seat = lambda v: F.size(F.filter("upto", lambda x: x <= v))
    passes = F.transform(F.when(F.col("whole") > 0, F.sequence(F.lit(0), F.col("whole") - 1)).otherwise(F.array().cast("array<int>")), lambda e: seat(e * F.col("blocks") + F.col("pos")))
    by_block = placed.select("src", "block", "pos").join(small(of, len(rows), 10_000), "src")
    by_block = by_block.select("src", "block", "target", "source_size", passes.alias("passes"), F.when(F.col("pos") <= F.col("end"), seat(F.col("whole") * F.col("blocks") + F.col("pos"))).alias("last"), (F.col("pos") == F.col("end")).alias("partly"), F.when(F.col("pos") == F.col("end"), F.col("cut")).alias("cut"), F.when(F.col("pos") == F.col("end"), F.col("extra")).alias("extra"), "blocks")
    return light, written(by_block, "plan")


def drawn(rows: DataFrame, by_block: DataFrame) -> DataFrame:
    """rows (with src, h) with target, source_size and shards, one for each time a row is taken."""
    n = by_block.count()
    of = by_block.groupBy("src").agg(F.first("blocks").alias("blocks"))
    rows = rows.join(small(of, of.count(), 100_000), "src").withColumn("block", block()).drop("blocks")
    rows = rows.join(small(by_block.drop("blocks"), n, 200_000), ["src", "block"])
    inside = F.col("last").isNotNull() & (~F.col("partly") | F.coalesce(F.col("h") <= F.col("cut"), F.lit(False)) | F.coalesce(F.array_contains("extra", F.col("h")), F.lit(False)))
    return rows.withColumn("shards", F.when(inside, F.concat("passes", F.array("last"))).otherwise(F.col("passes")))


def taken(docs: DataFrame, **options) -> DataFrame:
    """doc_id, size, source_size, target, taken, shards of every text of docs."""
    light, by_block = plan(chosen(docs, doc_id="long", source="string", text="string"), **options)
    return drawn(light, by_block).select("doc_id", "size", "source_size", "target", (F.col("size") * F.size("shards")).alias("taken"), "shards")


def mixture(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, **options) -> DataFrame:
    """The rows of docs as often as they are taken, by shard and in a hash's order inside it."""
    light, by_block = plan(chosen(docs, doc_id="long", source="string", text="string"), shards=shards, seed=seed, **options)
    n, size = light.agg(F.count("*"), F.sum("size")).first()
    # each row is taken CAP times at most
    salts = max(1, math.ceil(options.get("cap", CAP) * ((size or 0) + n) / (shards * TASK_WORDS)))
    rows = drawn(keyed(stowed(docs, doc_id="long", source="string", text="string")).drop("doc_id", "source", "text"), by_block)
    rows = rows.select("_row", "h", F.posexplode("shards").alias("pass", "shard"))
    # salted: a large shard is written by several tasks, each in a random order of its own
    rows = rows.withColumn("o", F.xxhash64(F.lit(seed), "h", "pass")).repartition("shard", F.pmod("o", F.lit(salts))).sortWithinPartitions("shard", "o")
    return unstowed(rows, docs.columns)
