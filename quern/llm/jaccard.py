"""N-gram Jaccard join: documents whose sets of five-word shingles have Jaccard >= 0.8.

Copies (equal word sequences) are grouped first and one of each group goes on. Bands of MinHash
values give candidates; a bucket's pairs are compared MinHash by MinHash and dropped as soon as
the posterior probability that their similarity reaches the threshold falls below a tolerance.
Survivors span candidate groups; within those, all pairs go through the same pruning and what
is left is verified exactly on the shingle sets. Large buckets and groups are split into blocks
that meet pairwise. Links are counted where they are found; only spanning links leave a task.

Words are runs without white space, A-Z in lower case. A text of one to four words has one
shingle, all its words. Cases: null, empty or white-space texts have no shingle and link with
nothing, not even with each other; repeated rows are documents of their own; null ids link to
nothing and get null ids back; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, Prefix, from_bytes, groups, labels, lean, mix, raw, runs, slices, words
from .common import chosen, components, small, written

WORDS = 5
THRESHOLD = 0.8
BANDS, ROWS = 32, 5
#: Posterior probability of reaching the threshold below which a pair is dropped, and the
#: number of MinHash values looked at between two such decisions.
TOLERANCE = 1e-6
STEP = 16
#: Rows of a block of a large bucket, and of a large candidate group.
BUCKET_BLOCK = 512
GROUP_BLOCK = 256
_SEEDS = mix(np.arange(1, 2 * BANDS * ROWS + 1, dtype=U) * U(0x9E3779B97F4A7C15))
_XOR, _MUL = _SEEDS[::2], _SEEDS[1::2] | U(1)
_PLACE = mix(np.arange(101, 101 + 64, dtype=U) * U(0x9E3779B97F4A7C15)) | U(1)


def least_matches(hashes: int, threshold: float, tolerance: float) -> int:
    """The fewest matches among so many MinHash values that keep a pair: with a flat prior the
    posterior P(J >= t | m of n match) is P(Binomial(n + 1, t) <= m)."""
    total = 0.0
    for m in range(hashes + 1):
        total += math.comb(hashes + 1, m) * threshold**m * (1 - threshold) ** (hashes + 1 - m)
        if total >= tolerance:
            return m
    return hashes


def word_hashes(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of the rows, and each row's place among them."""
    low = LOWER[data]
    start, end, at = words(low, off)
    if not len(start):
        return np.zeros(0, U), at
    return mix(Prefix(low).span(start, end) + (end - start).astype(U)), at


def shingles(w: np.ndarray, at: np.ndarray, n: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each row, and each row's place among them."""
    counts = np.diff(at)
    m = np.where(counts >= n, counts - n + 1, (counts > 0).astype(np.int64))
    place = np.zeros(len(at), np.int64)
    np.cumsum(m, out=place[1:])
    out = np.zeros(place[-1], U)
    long = counts >= n
    if long.any():
        total = len(w) - n + 1
        full = w[:total] * _PLACE[0]
        for k in range(1, n):
            full += w[k : k + total] * _PLACE[k]
        inside = np.zeros(len(w) + 1, np.int64)
        np.add.at(inside, at[:-1][long], 1)
        np.add.at(inside, at[1:][long] - n + 1, -1)
        keep = np.cumsum(inside)[:total] > 0
        out[np.repeat(long, m)] = mix(full[keep])
    for i in np.flatnonzero((counts > 0) & ~long):
        own = w[at[i] : at[i + 1]]
        out[place[i]] = mix(np.array([(own * _PLACE[: len(own)]).sum(dtype=U) + U(len(own))], U))[0]
    return out, place


def signatures(s: np.ndarray, place: np.ndarray, hashes: int) -> np.ndarray:
    """hashes MinHash values of 16 bits of each row that has shingles; the rows are not empty."""
    out = np.empty((len(place) - 1, hashes), np.uint16)
    for k in range(hashes):
        v = s ^ _XOR[k]
        v *= _MUL[k]
        out[:, k] = (np.minimum.reduceat(v, place[:-1]) >> U(16)).astype(np.uint16)
    return out


def fingerprints(w: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each row's sequence of words; the rows are not empty."""
    rank = (np.arange(len(w)) - np.repeat(at[:-1], np.diff(at))).astype(U)
    n = np.diff(at).astype(U)
    one = np.add.reduceat(mix(w + rank * U(0x9E3779B97F4A7C15)), at[:-1])
    two = np.add.reduceat(mix((w ^ U(0xD6E8FEB86659FD93)) + rank * U(0xC2B2AE3D27D4EB4F)), at[:-1])
    return mix(one + n), mix(two + n)


def sign(docs: DataFrame, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, t1 (hash of the text), f1, f2 (hashes of the word sequence, null without words), sig,
    keys (by band)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in slices(b.column(1)):
                w, at = word_hashes(data, off)
                full = np.diff(at) > 0
                n = int(full.sum())
                at = np.append(at[:-1][full], at[-1])
                mask = ~full
                place = np.zeros(j - i, np.int64)
                place[full] = np.arange(n)
                if n:
                    s, sat = shingles(w, at)
                    sig = signatures(s, sat, bands * rows)
                    f1, f2 = fingerprints(w, at)
                    key = np.full((n, bands), 0, U)
                    for k in range(rows):
                        key = mix(key * U(0x9E3779B97F4A7C15) + sig[:, k::rows][:, :bands].astype(U) + U(k + 1))
                else:
                    sig, f1, f2, key = np.zeros((1, bands * rows), np.uint16), np.zeros(1, U), np.zeros(1, U), np.zeros((1, bands), U)
                pick = lambda v: pa.array(v[place].astype(np.int64) if v.dtype != np.int64 else v[place], mask=mask)
                keys = pa.ListArray.from_arrays(pa.array(np.arange(0, (j - i + 1) * bands, bands, dtype=np.int32)), pa.array(key[place].view(np.int64).ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(2).slice(i, j - i), pick(f1.view(np.int64)), pick(f2.view(np.int64)), from_bytes(sig[place].view(np.uint8).ravel(), np.full(j - i, 2 * bands * rows), pa.binary()), keys], ["doc_id", "t1", "f1", "f2", "sig", "keys"])

    return chosen(docs, doc_id="long", text="string").withColumn("t1", F.xxhash64("text")).mapInArrow(lean(run), "doc_id long, t1 long, f1 long, f2 long, sig binary, keys array<long>")


def probable(a: np.ndarray, b: np.ndarray | None, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of signatures a and b (or i < j of a alone) that the incremental
    comparison keeps; least has (number of MinHash values, matches needed)."""
    z = a if b is None else b
    n = least[0][0]
    same = np.zeros((len(a), len(z)), np.uint16)
    for k in range(n):
        same += a[:, k][:, None] == z[:, k][None, :]
    fit = same >= least[0][1]
    if b is None:
        fit &= np.tri(len(a), dtype=bool, k=-1).T
    i, j = np.nonzero(fit)
    got = same[i, j].astype(np.int64)
    for upto, need in least[1:]:
        if not len(i):
            break
        keep = np.zeros(len(i), bool)
        for k in range(0, len(i), 100_000):
            p = slice(k, k + 100_000)
            got[p] += (a[i[p], n:upto] == z[j[p], n:upto]).sum(1)
            keep[p] = got[p] >= need
        i, j, got, n = i[keep], j[keep], got[keep], upto
    return i, j


def in_runs(at: np.ndarray, sig: np.ndarray, side: np.ndarray, diagonal: np.ndarray, least: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """The same over many small runs of rows at once: each row with the one d further on."""
    n = at[-1]
    run = np.repeat(np.arange(len(at) - 1), np.diff(at))
    left, right, d = [], [], 1
    size = np.diff(at)
    rows = np.flatnonzero(size[run] > 1)
    while len(rows):
        rows = rows[rows + d < n]
        rows = rows[run[rows] == run[np.minimum(rows + d, n - 1)]]
        i = rows[diagonal[run[rows]] | (side[rows] != side[rows + d])]
        got, upto = np.zeros(len(i), np.int64), 0
        for to, need in least:
            if not len(i):
                break
            got = got + (sig[i, upto:to] == sig[i + d, upto:to]).sum(1)
            i, got, upto = i[got >= need], got[got >= need], to
        left.append(i)
        right.append(i + d)
        d += 1
    return (np.concatenate(left), np.concatenate(right)) if left else (np.zeros(0, int), np.zeros(0, int))


def overlaps(sets: list[np.ndarray], i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The number of common values of sets i and j, for each pair."""
    if len(i) < 12:
        return np.array([len(np.intersect1d(sets[p], sets[q], assume_unique=True)) for p, q in zip(i, j, strict=True)], np.int64)
    used = np.unique(np.concatenate([i, j]))
    every = np.concatenate([sets[p] for p in used])
    owner = np.repeat(np.arange(len(used)), [len(sets[p]) for p in used])
    _, value, count = np.unique(every, return_inverse=True, return_counts=True)
    keep = count[value] > 1
    _, value = np.unique(value[keep], return_inverse=True)
    owner = owner[keep]
    order = np.argsort(value, kind="stable")
    value, owner = value[order], owner[order]
    common = np.zeros((len(used), len(used)), np.float32)
    for lo in range(0, int(value[-1]) + 1 if len(value) else 0, 4096):
        s, e = np.searchsorted(value, [lo, lo + 4096])
        x = np.zeros((len(used), 4096), np.float32)
        x[owner[s:e], value[s:e] - lo] = 1
        common += x @ x.T
    back = np.zeros(len(sets), np.int64)
    back[used] = np.arange(len(used))
    return common[back[i], back[j]].astype(np.int64)


def split(rows: DataFrame, keys: list[str], size: str, block: int) -> DataFrame:
    """rows of groups that meet in pairs of blocks: lo, hi (blocks) and side (0 in lo, 1 in hi)."""
    nb = F.ceil(F.col(size) / block).cast("int")
    rows = rows.withColumn("_nb", nb).withColumn("_own", F.pmod(F.xxhash64("rep"), F.col("_nb")).cast("int"))
    rows = rows.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_nb") - 1)))
    return rows.withColumn("lo", F.least("_own", "_other")).withColumn("hi", F.greatest("_own", "_other")).withColumn("side", (F.col("_own") > F.col("_other")).cast("int")).drop("_nb", "_own", "_other")


def jaccard_join(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """doc_id, class_id (smallest id reachable over links), copy_of (smallest id with the same
    words), n_links (other documents linked directly, copies included), kept (one of each class)."""
    return linked(docs, threshold, tolerance).drop("t1", "class_key")


def linked(docs: DataFrame, threshold: float = THRESHOLD, tolerance: float = TOLERANCE) -> DataFrame:
    """The rows of jaccard_join with t1, the hash of the row's text, and class_key, which tells
    classes apart also where ids repeat (null: no words or no id, so no class)."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    hashes = BANDS * ROWS
    least = [(n, least_matches(n, threshold, tolerance)) for n in range(STEP, hashes + 1, STEP)]
    signed = written(sign(docs), "signatures")
    valid = signed.where("f1 is not null and doc_id is not null")
    reps = written(valid.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "sig", "keys")).alias("x"), F.count("*").alias("copies")).select(F.monotonically_increasing_id().alias("rep"), "f1", "f2", F.col("x.doc_id").alias("doc_id"), "x.sig", "x.keys", "copies"), "classes")

    # Buckets of more than one class, in blocks; their pairs, pruned; spanning links of those.
    banded = reps.select("rep", F.posexplode("keys").alias("band", "key"))
    buckets = banded.groupBy("band", "key").agg(F.count("*").alias("n")).where("n > 1")
    near = split(banded.join(buckets, ["band", "key"]), ["band", "key"], "n", BUCKET_BLOCK)
    near = near.join(reps.select("rep", "sig"), "rep").select("band", "key", "lo", "hi", "side", "rep", "sig")

    def prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["band", "key", "lo", "hi"]
        for t in groups(batches, keys):
            at, rep = runs(t, keys), t.column("rep").to_numpy()
            data, off = raw(t.column("sig"))
            sig = data[off[0] : off[-1]].view(np.uint16).reshape(-1, hashes) if len(rep) else np.zeros((0, hashes), np.uint16)
            diagonal = t.column("lo").to_numpy()[at[:-1]] == t.column("hi").to_numpy()[at[:-1]]
            i, j = in_runs(at, sig, t.column("side").to_numpy(), diagonal, least)
            if len(i):
                low = labels(len(rep), i, j)
                on = np.flatnonzero(low != np.arange(len(rep)))
                yield pa.RecordBatch.from_arrays([pa.array(rep[on]), pa.array(rep[low[on]])], ["a", "b"])

    keys = ["band", "key", "lo", "hi"]
    loose = components(near.repartition(parts, *keys).sortWithinPartitions(*keys, "rep").mapInArrow(lean(prune), "a long, b long"), "near-edges")
    loose = written(loose, "near")

    # Exact verification within the groups that survivors span.
    sizes = loose.groupBy("comp").agg(F.count("*").alias("n"))
    members = loose.join(sizes, "comp").withColumnRenamed("node", "rep")
    n_members = loose.count()

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, j, data, off in slices(b.column(1)):
                w, at = word_hashes(data, off)
                s, place = shingles(w, at)
                own = [np.unique(s[place[k] : place[k + 1]]).tobytes() for k in range(j - i)]
                rows = np.flatnonzero(np.diff(at))  # of a repeated id a text may be empty
                f1, f2 = fingerprints(w, np.append(at[rows], at[-1])) if len(rows) else (np.zeros(0, U), np.zeros(0, U))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i).take(pa.array(rows)), pa.array(f1.view(np.int64)), pa.array(f2.view(np.int64)), pa.array([own[k] for k in rows], pa.binary())], ["doc_id", "f1", "f2", "shingles"])

    # Texts of the classes, found by id and told apart by their words where ids repeat.
    own = reps.select("rep", "doc_id", "f1", "f2", "sig", "copies").join(small(loose.select(F.col("node").alias("rep")), n_members), "rep", "left_semi")
    ids = small(own.select("doc_id").distinct(), n_members)
    texts = chosen(docs, doc_id="long", text="string").join(ids, "doc_id", "left_semi").mapInArrow(lean(sets), "doc_id long, f1 long, f2 long, shingles binary")
    payload = texts.groupBy("doc_id", "f1", "f2").agg(F.min("shingles").alias("shingles")).join(own, ["doc_id", "f1", "f2"]).select("rep", "sig", "copies", "shingles")
    meet = split(members.join(payload, "rep"), ["comp"], "n", GROUP_BLOCK).select("comp", "lo", "hi", "side", "rep", "copies", "sig", "shingles")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys = ["comp", "lo", "hi"]
        for t in groups(batches, keys):
            at = runs(t, keys)
            rep, side, copies, lo, hi = (t.column(c).to_numpy() for c in ("rep", "side", "copies", "lo", "hi"))
            data, off = raw(t.column("sig"))
            sig = data[off[0] : off[-1]].view(np.uint16).reshape(-1, hashes)
            data, off = raw(t.column("shingles"))
            for s, e in zip(at[:-1], at[1:], strict=True):
                if e - s < 2:
                    continue
                if lo[s] == hi[s]:
                    i, j = probable(sig[s:e], None, least)
                else:
                    one, two = s + np.flatnonzero(side[s:e] == 0), s + np.flatnonzero(side[s:e] == 1)
                    if not len(one) or not len(two):
                        continue
                    i, j = probable(sig[one], sig[two], least)
                    i, j = one[i] - s, two[j] - s
                if not len(i):
                    continue
                own = [data[off[k] : off[k + 1]].view(U) if (off[k] % 8 == 0) else np.frombuffer(data[off[k] : off[k + 1]].tobytes(), U) for k in range(s, e)]
                m = np.array([len(x) for x in own])
                both = overlaps(own, i, j)
                keep = both >= threshold * (m[i] + m[j] - both) - 1e-9
                i, j = i[keep], j[keep]
                if not len(i):
                    continue
                c = copies[s:e]
                w = np.bincount(i, c[j], e - s) + np.bincount(j, c[i], e - s)
                low, on = labels(e - s, i, j), np.flatnonzero(w)
                yield pa.RecordBatch.from_arrays([pa.array(rep[s:e][on]), pa.array(rep[s:e][low[on]]), pa.array(w[on].astype(np.int64))], ["a", "b", "w"])

    keys = ["comp", "lo", "hi"]
    found = written(meet.repartition(parts, *keys).sortWithinPartitions(*keys, "rep").mapInArrow(lean(verify), "a long, b long, w long"), "jaccard-links")
    tight = components(found.select("a", "b"), "jaccard-edges")
    counts = found.groupBy(F.col("a").alias("rep")).agg(F.sum("w").alias("w"))
    tight = written(tight, "jaccard-classes")
    first = reps.select(F.col("rep").alias("node"), "doc_id").join(tight, "node").groupBy("comp").agg(F.min("doc_id").alias("low"))
    nodes = reps.select("f1", "f2", "rep", "doc_id", "copies").join(tight.join(first, "comp").withColumnRenamed("node", "rep"), "rep", "left").join(counts, "rep", "left")
    nodes = nodes.select("f1", "f2", F.coalesce("low", "doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), (F.coalesce("w", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("comp", "rep").alias("class_key"))
    whole = valid.select("doc_id", "t1", "f1", "f2").join(nodes, ["f1", "f2"]).select("doc_id", "class_id", "copy_of", "n_links", "t1", "class_key")
    alone = signed.where("f1 is null or doc_id is null").select("doc_id", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("copy_of"), F.lit(0).cast("long").alias("n_links"), "t1", F.lit(None).cast("long").alias("class_key"))
    return whole.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(True)))
