"""Target-distribution importance resampling: documents drawn by how like a target they are.

Identical texts are collapsed by grouping the full text, so that features and weight are made once
for each text and counts are multiplied by its copies. Features are runs of words in hashed
buckets; a bucket's gain is the logarithm of its share in the target over that in the corpus, both
with one added. A text's weight is the floored mean of its features' gains. Weights are joined back
to the documents, each gets its own noise (Gumbel, from a hash of its id), and the highest sums are
drawn: a sample without replacement in proportion to the exponentials of the weights.

Cases. Null or empty text: no words, weight 0, never drawn where words are asked for. Repeated rows
are documents of their own; rows equal in id and text get ranks one after the other. A null doc_id
is the empty id in the hash and last among ties. An empty target or corpus has smoothed shares only.
Very long texts are read whole, in one row. Other columns are ignored.

Scale. Copies are counted before the shuffle. Texts that are a thousandth of all rows or more (a
thousand at most) are joined back by broadcast, all others by a shuffle. Ranks come from one range
sort: rows are written with their place in their range, ranges (one for each partition) are counted
and added up; ties are spread by a random number that is drawn before the sort.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import LOWER, from_bytes, lean, slices, words
from .common import chosen, written

#: Bytes outside words: all of ASCII but digits and small letters (after A-Z were lowered).
APART = np.ones(256, bool)
APART[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
#: Of 1000 rows, those from which a text is joined by broadcast.
HOT_SHARE = 1000


def hashed(data: np.ndarray, off: np.ndarray, order: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket) of each feature of the rows of off, and the words of each row."""
    data = LOWER[data]
    start, end, at = words(data, off, APART)
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    inside = ~APART[data]
    word = from_bytes(data[inside], end - start, pa.binary()).dictionary_encode()
    ids, names = word.indices.to_numpy().astype(np.int64), word.dictionary
    rows, found, code, text = [], [], ids, names
    for n in range(1, order + 1):
        if n > 1:
            same = row[n - 1 :] == row[: max(0, len(row) - n + 1)]
            pair = np.where(same, code[: len(same)] * len(names) + ids[n - 1 :], -1)
            key, code = np.unique(pair, return_inverse=True)
            text = pc.binary_join_element_wise(text.take(pa.array(np.maximum(key, 0) // max(1, len(names)))), names.take(pa.array(np.maximum(key, 0) % max(1, len(names)))), b" ")
        else:
            same = np.ones(len(row), bool)
        crc = np.fromiter((zlib.crc32(t) % buckets for t in text.to_pylist()), np.int64, len(text))
        rows.append(row[: len(same)][same])
        found.append(crc[code[same]] if len(crc) else np.zeros(0, np.int64))
    return np.concatenate(rows), np.concatenate(found), np.diff(at)


def features(texts: DataFrame, order: int, buckets: int) -> DataFrame:
    """key (sha256), copies, n_words, n_features, and buckets b with their counts c, of each
    different text."""
    alike = texts.groupBy(F.coalesce("text", F.lit("")).alias("text")).agg(F.count("*").alias("copies"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, data, off in slices(batch.column(2)):
                row, b, n_words = hashed(data, off, order, buckets)
                cell, c = np.unique(row * buckets + b, return_counts=True)
                total = np.bincount(row, minlength=j - i)
                held = np.append(0, np.cumsum(np.bincount(cell // buckets, minlength=j - i))).astype(np.int32)
                lists = [pa.ListArray.from_arrays(pa.array(held), pa.array(x.astype(np.int32))) for x in (cell % buckets, c)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n_words), pa.array(total), *lists], ["key", "copies", "n_words", "n_features", "b", "c"])

    rows = alike.select(F.unhex(F.sha2("text", 256)).alias("key"), "copies", "text")
    return rows.mapInArrow(lean(run), "key binary, copies long, n_words long, n_features long, b array<int>, c array<int>")


def bucket_counts(found: DataFrame) -> DataFrame:
    """b, n: how many features of the documents each bucket holds, copies counted."""
    return found.select("copies", F.explode(F.arrays_zip("b", "c")).alias("x")).groupBy(F.col("x.b").alias("b")).agg(F.sum(F.col("copies") * F.col("x.c")).alias("n"))


def gains(corpus: DataFrame, target: DataFrame, buckets: int) -> np.ndarray:
    """The gain of each bucket; `buckets` rows at most go to the driver."""
    s, t = bucket_counts(corpus), bucket_counts(target)
    both = s.withColumnRenamed("n", "s").join(t.withColumnRenamed("n", "t"), "b", "full").select("b", F.coalesce("s", F.lit(0)).alias("s"), F.coalesce("t", F.lit(0)).alias("t"))
    count, out = np.zeros((2, buckets), np.int64), np.zeros(buckets, np.int64)
    for r in both.collect():
        count[:, r["b"]] = r["s"], r["t"]
    (s, t), (all_s, all_t) = count, count.sum(axis=1)
    real = lambda x: x.astype(float)
    out[:] = np.floor(1000 * np.log(real(t + 1) * real(all_s + buckets) / (real(s + 1) * real(all_t + buckets))))
    return out


def weighed(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """key, copies, n_words, n_features, weight: the floored mean of a text's gains."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            b, c = batch.column(4), batch.column(5)
            n, total = b.value_lengths().to_numpy(), batch.column(3).to_numpy()
            got = np.append(0, np.cumsum(gain[b.flatten().to_numpy()] * c.flatten().to_numpy().astype(np.int64)))
            end = np.cumsum(n)
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(np.where(total > 0, (got[end] - got[end - n]) // np.maximum(total, 1), 0))], ["key", "copies", "n_words", "n_features", "weight"])

    return found.mapInArrow(run, "key binary, copies long, n_words long, n_features long, weight long")


def ranked_by(rows: DataFrame, *order) -> DataFrame:
    """rows, written, with place (1, 2, 3 ...) in the order of columns; rows equal in all of them
    in any order. Each task sorts a range."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = (*order, F.col("_tie"))
    ranges = rows.withColumn("_tie", F.rand(11)).repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_tie")
    placed = written(ranges.withColumn("_id", F.monotonically_increasing_id()), "ranges").withColumn("_p", F.shiftright("_id", 33)).withColumn("_i", F.col("_id") % (1 << 33))
    counts = placed.groupBy("_p").agg(F.count("*").alias("n"))
    before = counts.select("_p", F.coalesce(F.sum("n").over(W.orderBy("_p").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    return placed.join(F.broadcast(before), "_p").withColumn("place", F.col("_before") + F.col("_i") + 1).drop("_p", "_i", "_id", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int, order: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; rank of those drawn: percent of
    the documents with least_words or more."""
    docs, target = chosen(docs, doc_id="long", text="string"), chosen(target, text="string")
    found = written(features(docs, order, buckets), "features")
    weights = written(weighed(found, gains(found, features(target, order, buckets), buckets)), "weights")
    total, able = weights.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("n_words") >= least_words, F.col("copies"))), F.lit(0))).first()
    keyed = written(docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("key")), "keyed")
    hot = F.broadcast(weights.where(F.col("copies") * HOT_SHARE >= total))
    rows = keyed.join(hot, "key").unionByName(keyed.join(hot.select("key"), "key", "left_anti").join(weights.where(F.col("copies") * HOT_SHARE < total), "key"))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    rows = rows.select("doc_id", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") < least_words).alias("_short"))
    out = ranked_by(rows, F.col("_short"), F.desc("score"), F.asc_nulls_last("doc_id"))
    return out.select("doc_id", "n_features", "weight", "score", F.when(~F.col("_short") & (F.col("place") <= able * percent // 100), F.col("place")).alias("rank"))
