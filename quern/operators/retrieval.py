"""Retrieval over a frame of queries: filtered top-k, tiers, fusion, context."""

from __future__ import annotations

from collections.abc import Iterator
from importlib.util import find_spec

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.operators import products
from quern.sources.shared import stored

#: Queries up to which the query side is broadcast.
FEW = 20_000
#: Characters of names that go to all tasks as one automaton (some hundred bytes each).
NAME_CHARS = 500_000


def few(queries: DataFrame, limit: int = FEW) -> DataFrame:
    """queries, marked for broadcast if no more than limit of them are there."""
    return F.broadcast(queries) if queries.limit(limit + 1).count() <= limit else queries


def ranked(df: DataFrame, by: list[str], order: list[Column], k: int | None = None) -> DataFrame:
    """df with rank; with k only the first k of each group (Spark prunes before the shuffle)."""
    df = df.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(*order)))
    return df.where(F.col("rank") <= k) if k else df


def semantic(queries: DataFrame, points: DataFrame, k: int, low: int | None = None, also: tuple[str, ...] = ()) -> DataFrame:
    """qid, vec_id, score, rank: the k nearest points of each query (qid, qvec, grade), equal in
    the columns `also` of both.

    With low, points whose label is within one of the grade, and not under low: the band is
    spelled out, so that the join is on equal labels. Without, points with labels up to the grade.
    """
    if low is None:
        found = products.best(queries, points, k, also, upto=True)
    else:
        wide = queries.withColumn("label", F.explode(F.sequence(F.greatest(F.lit(low), F.col("grade") - 1), F.greatest(F.lit(low), F.col("grade") + 1)))).where(F.col("label") <= F.col("grade") + 1)
        found = products.best(wide, points, k, ("label", *also))
    return ranked(found, ["qid"], [F.desc("score"), F.col("vec_id")], k)


def theta(rows: DataFrame, asked: DataFrame, on: Column | None = None) -> DataFrame:
    """rows joined with a stated set of asked rows on any condition. Up to FEW asked rows are
    broadcast; more meet the rows in blocks, salted so that a block's rows spread over all tasks."""
    n, on = asked.count(), F.lit(True) if on is None else on
    if n <= FEW:
        return rows.join(F.broadcast(asked), on)
    n_blocks, salts = -(-n // FEW), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    place = lambda df, m: F.pmod(F.xxhash64(*df.columns), F.lit(m)).cast("int")
    asked = asked.withColumn("_b", place(asked, n_blocks)).withColumn("_s", every(salts))
    rows = rows.withColumn("_s2", place(rows, salts)).withColumn("_b2", every(n_blocks))
    return rows.join(asked, (F.col("_b") == F.col("_b2")) & (F.col("_s") == F.col("_s2")) & on).drop("_b", "_s", "_b2", "_s2")


def semantic_all(queries: DataFrame, points: DataFrame, k: int) -> DataFrame:
    """qid, vec_id, score, rank over all points: a stated set of queries against every row."""
    return ranked(products.best(queries, points, k), ["qid"], [F.desc("score"), F.col("vec_id")], k)


def relaxed(queries: DataFrame, strict: DataFrame, loose) -> DataFrame:
    """strict hits; for queries without any, those of loose(queries), computed for them only. The
    strict ones (a few rows for each query) are stored, since both parts read them."""
    strict = stored(strict, "strict")
    empty = queries.join(strict.select("qid").distinct(), "qid", "left_anti")
    return strict.withColumn("tier", F.lit(0)).unionByName(loose(empty).withColumn("tier", F.lit(1)))


def containing(texts: DataFrame, names: DataFrame) -> DataFrame:
    """Rows of texts (id, t and others) with the names (name_id, name) that t holds.

    Names of up to NAME_CHARS characters together go to all tasks as one automaton (Aho and
    Corasick's), and each text is read once whatever their number; more are looked up by words.
    """
    some = names.where("name is not null")
    size, n = some.agg(F.sum(F.length("name") + 1), F.count("*")).first()
    if not find_spec("ahocorasick") or (size or 0) > NAME_CHARS:
        return by_words(texts, names)
    ids: dict[str, list] = {}
    for r in some.collect() if n else []:
        ids.setdefault(r["name"], []).append(r["name_id"])
    every = ids.pop("", [])
    kinds = {f.name: f.dataType for f in names.schema.fields}
    schema = T.StructType([*texts.schema.fields, T.StructField("name_id", kinds["name_id"]), T.StructField("name", kinds["name"])])
    at, columns = texts.columns.index("t"), schema.names
    of = {"integer": pa.int32(), "long": pa.int64()}.get(kinds["name_id"].typeName(), pa.string())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        found = ahocorasick.Automaton()
        for name in ids:
            found.add_word(name, name)
        if ids:
            found.make_automaton()
        for b in batches:
            rows, name_ids, held = [], [], []
            for k, t in enumerate(b.column(at).to_pylist()):
                if t is None:
                    continue
                for name in sorted({x for _, x in found.iter(t)}) if ids else []:
                    for i in ids[name]:
                        rows.append(k)
                        name_ids.append(i)
                        held.append(name)
                for i in every:
                    rows.append(k)
                    name_ids.append(i)
                    held.append("")
            if rows:
                take = pa.array(rows, pa.int32())
                yield pa.RecordBatch.from_arrays([*(c.take(take) for c in b.columns), pa.array(name_ids, of), pa.array(held, pa.string())], columns)

    return texts.mapInArrow(run, schema)


def by_words(texts: DataFrame, names: DataFrame) -> DataFrame:
    """The same for more names: a name's inner words (between blanks) are whole words of each text
    that holds it, so texts are first looked up by the longest of them, by equal keys; only those
    found are searched. Names without an inner word are searched for in all texts.
    """
    inner = F.expr("array_max(transform(filter(slice(split(name, ' '), 2, greatest(size(split(name, ' ')) - 2, 0)), x -> x <> ''), x -> struct(length(x) AS n, x AS x)))")
    names = names.select("name_id", "name", inner.getField("x").alias("_k"))
    words = texts.select("id", F.explode(F.split("t", " ")).alias("_k"))
    found = words.join(few(names.where("_k is not null"), 200_000), "_k").select("id", "name_id", "name").distinct()
    held = F.contains("t", "name")
    hits = texts.join(few(found, 200_000), "id").where(held)
    bare = theta(texts, names.where("_k is null").drop("_k"), held)
    return hits.unionByName(bare)


def first_tier(df: DataFrame, by: str) -> DataFrame:
    """Rows of each group's lowest tier."""
    return df.withColumn("_t", F.min("tier").over(W.partitionBy(by))).where("tier = _t").drop("_t")


def fuse(lists: DataFrame, k: int = 60) -> DataFrame:
    """qid, id, rrf: reciprocal ranks (qid, id, rank from 1) added up."""
    return lists.groupBy("qid", "id").agg(F.round(F.sum(1.0 / (k + F.col("rank"))), 9).alias("rrf"))


def context(hits: DataFrame, line: Column) -> DataFrame:
    """qid, n, context: the lines of each query's hits in rank order."""
    got = hits.select("qid", "rank", line.alias("line")).groupBy("qid").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("rank", "line"))).alias("x"))
    return got.select("qid", "n", F.array_join("x.line", "\n").alias("context"))
