"""Search for all words of a question in a stored inverted index.

The index is a table of posting blocks: of a word and a bucket of texts, the ids that hold the word
with how often, and the highest of these counts. Buckets are dealt by a hash of the id, about BUCKET
texts each, so that a word that every text holds has many small blocks and no list of its own grows.

A question meets the heads of its words' blocks first (no ids are read): only buckets that have all
its words can hold a hit, and the highest counts bound the score of any text in them. The FIRST best
bounded buckets of each question are searched; where they give k hits, the buckets whose bound is
below the k-th score are never opened, all others are. Texts are not read at query time.

Very many questions (`many`) go through the index in one pass instead, without heads: questions meet
CELL buckets at a time, and what leaves a cell is the best k of each question there.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators.retrieval import few, ranked
from quern.sources.shared import on_workers, stored

#: Texts of a bucket, about, and buckets of each question that are searched before bounds count.
BUCKET, FIRST = 4096, 4
#: Rows of words that are broadcast.
WORDS = 200_000
#: Buckets and questions of a cell, about.
CELL, BLOCK = 8, 50_000


def built(texts: DataFrame, words: Callable[[str], Column], bucket: int = BUCKET, path: str | None = None) -> DataFrame:
    """w, bucket, ids, tfs, most: the index of texts (id, t), stored in the shared folder or at path.
    words gives the array of a text's words. Texts are shuffled once, to their buckets; words are
    counted and gathered there. Null words and ids are left out; rows with equal ids are one text."""
    texts = texts.where("id is not null").select("id", "t")
    total = texts.count()
    n = max(1, -(-total // bucket))
    placed = texts.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(n)).cast("int"))
    # a task's share is one bucket however many texts there are; left to itself Spark deals all texts to as many tasks as it has cores
    parts = max(-(-total // BUCKET), min(n, int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartitionById(n, "bucket") if bucket >= BUCKET else placed.repartition(parts, "bucket")
    counts = placed.select("bucket", "id", F.explode(words("t")).alias("w")).where("w is not null").groupBy("bucket", "id", "w").agg(F.count("*").alias("tf"))
    blocks = counts.groupBy("w", "bucket").agg(F.array_sort(F.collect_list(F.struct("id", "tf"))).alias("x"))
    blocks = blocks.select("w", "bucket", F.col("x.id").alias("ids"), F.col("x.tf").alias("tfs"), F.array_max("x.tf").alias("most"))
    return stored(blocks, "postings", path)


def gain(tf: str) -> F.Column:
    return 1 + F.log(tf)


def opened(asked: DataFrame, index: DataFrame, cells: DataFrame) -> DataFrame:
    """qid, id, score of the texts in cells (qid, bucket) that hold all asked words (qid, need, w)."""
    wide = few(asked.join(cells, "qid"), WORDS)
    found = index.select("w", "bucket", "ids", "tfs").join(wide, ["w", "bucket"]).select("qid", "need", F.explode(F.arrays_zip("ids", "tfs")).alias("x"))
    by = found.groupBy("qid", "need", F.col("x.ids").alias("id")).agg(F.count("*").alias("n"), F.round(F.sum(gain("x.tfs")), 6).alias("score"))
    return by.where("n = need").select("qid", "id", "score")


def all_words(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """qid, id, score, rank: of the texts with all the different words of each question (qid, w) the
    k with the highest sums of 1 + ln(count), small ids first where sums are equal."""
    asked = asked.where("w is not null").distinct()
    asked = stored(asked.join(asked.groupBy("qid").agg(F.count("*").alias("need")), "qid"), "asked")
    heads = index.select("w", "bucket", "most").join(few(asked, WORDS), "w").groupBy("qid", "bucket", "need").agg(F.count("*").alias("n"), F.sum(gain("most")).alias("bound")).where("n = need")
    heads = stored(ranked(heads.select("qid", "bucket", "bound"), ["qid"], [F.desc("bound"), F.col("bucket")]).withColumnRenamed("rank", "turn"), "heads")
    first = stored(opened(asked, index, heads.where(F.col("turn") <= FIRST).select("qid", "bucket")), "hits")
    best = ranked(first, ["qid"], [F.desc("score"), F.col("id")], k)
    floor = best.groupBy("qid").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
    # scores are rounded to six digits, so a bound may be short of a score by half of one
    rest = heads.where(F.col("turn") > FIRST).join(floor, "qid", "left").where(F.col("floor").isNull() | (F.col("bound") >= F.col("floor") - 1e-6))
    more = opened(asked, index, rest.select("qid", "bucket"))
    return ranked(best.drop("rank").unionByName(more), ["qid"], [F.desc("score"), F.col("id")], k).select("qid", "id", "score", "rank")


def intersected(words: list[list[str]], rows: pa.Table, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of questions (their words), places in all ids of rows (w, ids, tfs) one after another, and
    scores: the best k texts for each question."""
    ids, tfs, names = rows.column("ids").combine_chunks(), rows.column("tfs").combine_chunks(), rows.column("w").to_pylist()
    _, place, code = np.unique(ids.flatten().to_numpy(zero_copy_only=False), return_index=True, return_inverse=True)
    gains = 1 + np.log(tfs.flatten().to_numpy().astype(float))
    ends = np.cumsum(ids.value_lengths().to_numpy())
    spans: dict[str, list] = {}
    for w, begin, end in zip(names, np.r_[0, ends[:-1]], ends):
        spans.setdefault(w, []).append(np.arange(begin, end))
    lists: dict[str, tuple] = {}

    def posting(w: str) -> tuple[np.ndarray, np.ndarray]:
        if w not in lists:
            at = np.concatenate(spans[w])
            at = at[np.argsort(code[at])]
            lists[w] = code[at], gains[at]
        return lists[w]

    out = [], [], []
    for n, some in enumerate(words):
        if not all(w in spans for w in some):
            continue
        first, *others = sorted(map(posting, some), key=lambda x: len(x[0]))
        held, score = first
        for other, gain in others:
            at = np.minimum(np.searchsorted(other, held), len(other) - 1)
            both = other[at] == held
            held, score = held[both], score[both] + gain[at[both]]
        score = np.round(score, 6)
        if len(held) > k:
            top = score >= np.partition(score, -k)[-k]
            held, score = held[top], score[top]
        best = np.lexsort((held, -score))[:k]
        for column, values in zip(out, (np.full(len(best), n), place[held[best]], score[best])):
            column.append(values)
    return tuple(np.concatenate(c) if c else np.zeros(0, t) for c, t in zip(out, (int, int, float)))


def many(asked: DataFrame, index: DataFrame, k: int) -> DataFrame:
    """What `all_words` gives, for any number of questions: questions with the same words are one, and
    no pairs of questions and texts, or of questions and buckets, are shuffled or stored."""
    on_workers(index.sparkSession)
    by = stored(asked.where("w is not null").groupBy("qid").agg(F.array_sort(F.collect_set("w")).alias("words")), "asked")
    own = stored(by.select("words").distinct().withColumn("_n", F.monotonically_increasing_id()), "questions")
    cells, blocks = (index.agg(F.max("bucket")).first()[0] or 0) // CELL + 1, max(1, -(-own.count() // BLOCK))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = own.withColumn("_block", F.pmod(F.xxhash64("_n"), F.lit(blocks)).cast("int")).withColumn("_cell", every(cells))
    used = few(own.select(F.explode("words").alias("w")).distinct(), WORDS)
    right = index.join(used, "w", "left_semi").select("w", "ids", "tfs", F.floor(F.col("bucket") / CELL).cast("int").alias("_cell")).withColumn("_block", every(blocks))
    kind = index.schema["ids"].dataType.elementType
    schema = T.StructType([T.StructField("_n", T.LongType()), T.StructField("id", kind), T.StructField("score", T.DoubleType())])

    def hits(questions: pa.Table, rows: pa.Table) -> pa.Table:
        at, place, score = intersected(questions.column("words").to_pylist(), rows, k) if questions.num_rows and rows.num_rows else (np.zeros(0, int),) * 2 + (np.zeros(0),)
        ids = rows.column("ids").combine_chunks().flatten()
        return pa.table({"_n": questions.column("_n").take(pa.array(at)), "id": ids.take(pa.array(place)), "score": score})

    found = left.groupBy("_cell", "_block").cogroup(right.groupBy("_cell", "_block")).applyInArrow(hits, schema)
    best = ranked(found, ["_n"], [F.desc("score"), F.col("id")], k)
    return by.join(own, "words").join(best, "_n").select("qid", "id", "score", "rank")
