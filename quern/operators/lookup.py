"""Lookups of works by name: live wildcards, both ways of containing, tiers that fall back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import trigrams
from quern.operators.retrieval import few, first_tier, ranked, theta
from quern.sources.shared import stored

#: Substrings of questions that are broadcast, and the length by which questions are looked up.
PIECES, START = 2_000_000, 8


def fits(asked: str, own: str) -> Column:
    """An optional equality: nothing asked (null, 0 or an empty name) is no filter."""
    return F.coalesce(F.col(asked).cast("string"), F.lit("")).isin("", "0") | (F.col(asked) == F.col(own))


def named(works: DataFrame, asked: DataFrame) -> DataFrame:
    """works (with title) and the asked rows (qid, name and others) whose name stands in the title,
    case aside; % and _ in a name are wildcards. By trigrams, see there."""
    return trigrams.named(works, asked)


def exact(works: DataFrame, asked: DataFrame, k: int = 5) -> DataFrame:
    """qid, id, score, rank of works (id, title, grade, series) for asked (qid, name, g, s; g and s
    may be null): by name, grade and series, or where that finds none by name alone; whole titles
    first, then low grades."""
    hits = named(works, asked).withColumn("tier", F.when(fits("g", "grade") & fits("s", "series"), 0).otherwise(1))
    hits = first_tier(hits, "qid")
    best = ranked(hits, ["qid"], [F.when(F.ilike("title", F.col("name")), 0).otherwise(1), F.col("grade"), F.col("id")], k)
    return best.select("qid", "id", F.when(F.lower("title") == F.lower("name"), 1.0).otherwise(0.8).alias("score"), "rank")


def upto_grade(works: DataFrame, asked: DataFrame, k: int = 3) -> DataFrame:
    """qid, id, rank: works by name of no higher grade than g, low grades first."""
    hits = named(works, asked).where(F.col("g").isNull() | (F.col("g") == 0) | (F.col("grade") <= F.col("g")))
    return ranked(hits, ["qid"], [F.col("grade"), F.col("id")], k).select("qid", "id", "rank")


def of_own_grade(events: DataFrame, asked: DataFrame) -> DataFrame:
    """qid, id of what a name may mean: the only one, or those of grade g, or all of them."""
    hits = named(events, asked).withColumn("_n", F.count("*").over(W.partitionBy("qid")))
    return first_tier(hits.withColumn("tier", F.when((F.col("_n") == 1) | (F.col("grade") == F.col("g")), 0).otherwise(1)), "qid").select("qid", "id")


def pieces(text: Column, most: int) -> Column:
    """The different substrings of a text of up to `most` characters, the empty one among them."""
    n = F.length(text)
    sizes = F.sequence(F.lit(0), F.least(n, F.lit(most)))
    return F.array_distinct(F.flatten(F.transform(sizes, lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k)))))


def runs(text: Column, sizes: Column) -> Column:
    """The different substrings of a text that have one of the given lengths."""
    n = F.length(text)
    return F.array_distinct(F.flatten(F.transform(F.filter(sizes, lambda k: k <= n), lambda k: F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.substring(text, i, k)))))


def contained(works: DataFrame, asked: DataFrame, k: int = 2) -> DataFrame:
    """qid, id, rank of works (id, work_name, title, series) whose name or title stands in the
    asked name, or holds it, case aside: names inside the question first, long ones first.

    No work is compared with each question: substrings of the questions are looked up among the
    works' names and titles, and the questions' starts among the works' substrings, by equal keys.
    Works that differ only in id are ranked before; questions that ask for the same are one.
    """
    works = works.select("id", "work_name", "title", "series")
    q = asked.select("name", "s").where("name is not null").distinct().withColumn("_q", F.lower("name"))
    q = stored(q.withColumn("_n", F.monotonically_increasing_id()), "names")
    # of works alike the first k: the others would come after them
    spread = int(works.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    alike = stored(ranked(works, ["work_name", "title", "series"], [F.col("id")], k).drop("rank").repartition(spread), "works")
    own = ranked(alike, ["work_name", "series"], [F.col("id")], k).drop("rank").select("*", F.lower("work_name").alias("_p"))
    most = alike.agg(F.max(F.greatest(F.length(F.lower("work_name")), F.length(F.lower("title"))))).first()[0] or 0
    parts = q.select("_n", F.explode(pieces(F.col("_q"), most)).alias("_p"))
    begin = F.substring("_q", 1, START).alias("_p")
    starts = few(q.select("_n", "_q", begin), PIECES)
    lengths = q.select(F.length(begin).alias("n")).agg(F.array_sort(F.collect_set("n")).alias("_l"))
    name, title, none = F.lower("work_name"), F.lower("title"), F.array().cast("array<string>")
    held = lambda c: F.coalesce(runs(c, F.col("_l")), none)
    both = F.when(F.contains(title, name), held(title)).otherwise(F.array_union(held(title), held(name)))
    long = alike.crossJoin(F.broadcast(lengths)).select("id", "work_name", "title", "series", F.explode(both).alias("_p"))
    long = long.join(starts, "_p").where(F.coalesce(F.contains(title, F.col("_q")), F.lit(False)) | F.contains(name, F.col("_q")))
    row = ["id", "work_name", "title", "series"]
    parts = few(parts, PIECES)
    hits = own.join(parts, "_p").select("_n", *row).unionByName(alike.withColumn("_p", F.lower("title")).join(parts, "_p").select("_n", *row)).unionByName(long.select("_n", *row))
    hits = hits.join(few(q.select("_n", "_q", "s"), PIECES), "_n").where(fits("s", "series")).withColumn("_in", F.when(F.contains("_q", F.lower("work_name")), 0).otherwise(1))
    order = [F.col("_in"), F.length("work_name").desc(), F.col("id")]
    # a work is found in up to three ways: three times as many are ranked before the same ones are put together
    hits = ranked(hits.select("_n", *row, "_in"), ["_n"], order, 3 * k).drop("rank").distinct()
    best = ranked(hits, ["_n"], order, k).select("_n", "id", "rank")
    best = best.join(q.select("_n", "name", F.col("s").alias("_s")), "_n")
    return asked.select("qid", "name", "s").join(best, (asked["name"] == best["name"]) & F.equal_null(asked["s"], best["_s"])).select("qid", "id", "rank")


def chain(asked: DataFrame, tiers: list) -> DataFrame:
    """qid, id, rank, tier of the first of tiers (functions of asked rows) that finds anything; each
    is asked only for what those before it left empty. What a tier finds (a few rows for each
    question) is stored: the next tier and the result read it."""
    left, found = stored(asked, "asked"), None
    for n, search in enumerate(tiers):
        got = stored(search(left).select("qid", "id", "rank").withColumn("tier", F.lit(n)), "tier")
        found = got if found is None else found.unionByName(got)
        if n + 1 < len(tiers):
            left = left.join(got.select("qid").distinct(), "qid", "left_anti")
    return found


def nearest(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """qid, id, rank: the k rows (kind, id, grade) of the asked kind that are nearest to grade g: of each
    kind and grade its first k rows, then those."""
    first = ranked(rows.join(few(asked.select("kind").distinct()), "kind", "left_semi"), ["kind", "grade"], [F.col("id")], k).select("kind", "id", "grade")
    pairs = first.join(few(asked.select("qid", "kind", "g")), "kind")
    return ranked(pairs, ["qid"], [F.abs(F.col("grade") - F.col("g")), F.col("id")], k).select("qid", "id", "rank")


def nearest_any(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    """The same whatever the kind: of each grade its first k rows, then those nearest to g."""
    first = ranked(rows, ["grade"], [F.col("id")], k).select("id", "grade")
    pairs = theta(asked.select("qid", "g"), first)
    return ranked(pairs, ["qid"], [F.abs(F.col("grade") - F.col("g")), F.col("id")], k).select("qid", "id", "rank")
