"""Names and outlines are looked up by equal keys; the rows are those of comparing all with all."""

import random
import re

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.operators import lookup, retrieval


def plan(df):
    return df._jdf.queryExecution().toString()


def brute(works, asked, k=2):
    q, name, title = F.lower("name"), F.lower("work_name"), F.lower("title")
    on = lookup.fits("s", "series") & (F.contains(q, name) | F.contains(name, q) | F.contains(title, q) | F.contains(q, title))
    hits = works.crossJoin(asked).where(on).withColumn("_in", F.when(F.contains(q, name), 0).otherwise(1))
    return retrieval.ranked(hits, ["qid"], [F.col("_in"), F.length("work_name").desc(), F.col("id")], k).select("qid", "id", "rank")


def test_contained_is_what_all_pairs_give(spark):
    some = random.Random(1)
    text = lambda n: "".join(some.choice("aB é") for _ in range(some.randint(0, n)))
    works = [(i, text(4), text(12), some.choice(["KNTT", "CD", None])) for i in range(300)] + [(900, None, "abcabcabcabcaaa", "CD"), (901, None, None, "CD"), (902, "xx abcabcabcabcaaa yy", "zz", "CD")]
    asked = [(i, text(14), some.choice(["KNTT", "", None])) for i in range(80)] + [(900, None, None), (901, "", None), (902, "bcabcabcabcaa", None), (903, "bcabcabcabcaa", None)]
    works, asked = spark.createDataFrame(works, "id int, work_name string, title string, series string"), spark.createDataFrame(asked, "qid int, name string, s string")
    got = lookup.contained(works, asked)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, brute(works, asked).collect()))
    assert not re.search(r"(NestedLoop|Cartesian)[^\n]*contains", plan(got), re.I)


def test_nearest_pairs_only_the_first_rows_of_a_grade(spark):
    some = random.Random(2)
    rows = spark.createDataFrame([(i, some.choice("ab"), some.randint(1, 4)) for i in range(400)], "id int, kind string, grade int")
    asked = spark.createDataFrame([(i, some.choice(["a", "b", "c", None]), some.randint(0, 6)) for i in range(30)], "qid int, kind string, g int")
    got = lookup.nearest(rows, asked, 2)
    pairs = rows.join(asked, "kind").withColumn("rank", F.row_number().over(W.partitionBy("qid").orderBy(F.abs(F.col("grade") - F.col("g")), "id"))).where("rank <= 2")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, pairs.select("qid", "id", "rank").collect()))
    # rows are ranked before they meet what is asked, and after
    assert plan(got).split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("WindowGroupLimit") == 2
