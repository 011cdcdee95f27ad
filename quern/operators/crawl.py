"""Seeds, walks over links and chains of pages, as joins; fetching itself is left out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.retrieval import ranked
from quern.sources.shared import stored

SERIES = ["KNTT", "CTST", "CD"]


def seeds(spark: SparkSession, site: str = "https://school.example", grades: int = 9) -> DataFrame:
    """grade, series, url: where each grade's and series' walk begins."""
    series = spark.createDataFrame([(s,) for s in SERIES], "series string")
    return spark.range(1, grades + 1).select(F.col("id").cast("int").alias("grade")).join(F.broadcast(series), F.lit(True)).withColumn("url", F.lower(F.concat_ws("/", F.lit(site), "series", "grade")))


def walk(start: DataFrame, links: DataFrame, depth: int | None, cap: int | None) -> DataFrame:
    """page, depth, article of all that a walk from start (page) sees over links (src, dst, k, sub).

    Sub-categories are followed down to `depth` (None: until nothing new is seen), no more than `cap`
    of a page in the order of k (None: all); articles of every page seen are taken. What was seen on
    a higher level isn't seen again, so circles end. Each level is a table before the next begins.
    """
    sub = links.where("sub").select("src", "dst", "k")
    sub = (ranked(sub, ["src"], [F.col("k"), F.col("dst")], cap) if cap else sub).select("src", "dst")
    seen = level = start.distinct().withColumn("depth", F.lit(0))
    n = 0
    while depth is None or n < depth:
        n += 1
        level = level.join(sub, level["page"] == sub["src"]).select(F.col("dst").alias("page")).distinct().join(seen.select("page"), "page", "left_anti").withColumn("depth", F.lit(n))
        if depth is None:
            level = stored(level, "level")
            if level.isEmpty():
                break
        seen = seen.unionByName(level)
        if depth is None and n % 16 == 0:
            seen = stored(seen, "seen")
    articles = links.where("not sub").join(seen, F.col("src") == F.col("page")).groupBy(F.col("dst").alias("page")).agg((F.min("depth") + 1).alias("depth"))
    return seen.withColumn("article", F.lit(False)).unionByName(articles.withColumn("article", F.lit(True)))


def chains(pages: DataFrame, follows: DataFrame, longest: int | None = None) -> DataFrame:
    """first, page, place of pages (page) that follow each other (src, dst) in chains of any length.

    Steps are doubled: a page that knows who stands n pages before it learns in one join who stands
    2n before, so rounds grow with the logarithm of the longest chain; pages that know their first
    page are done. A page that several lead to follows the smallest. Pages in a circle, and those
    after one, have no first page: first and place are null. Where the length of the longest chain is
    known, `longest` saves the count of the pages that else bounds the rounds.
    """
    before = follows.where("src <> dst").groupBy(F.col("dst").alias("page")).agg(F.min("src").alias("first"))
    known = pages.select("page").distinct()
    before = before.join(known.withColumnRenamed("page", "first"), "first", "left_semi")
    at = stored(known.join(before, "page", "left").select("page", F.coalesce("first", "page").alias("first"), F.col("first").isNotNull().cast("long").alias("place"), F.col("first").isNull().alias("done")), "chain")
    for _ in range((longest or at.count()).bit_length() + 1):
        left = at.where("not done")
        if left.isEmpty():
            break
        jump = at.select(F.col("page").alias("first"), F.col("first").alias("_f"), F.col("place").alias("_p"), F.col("done").alias("_d"))
        moved = left.join(jump, "first").select("page", F.col("_f").alias("first"), (F.col("place") + F.col("_p")).alias("place"), F.col("_d").alias("done"))
        at = stored(at.where("done").unionByName(moved), "chain")
    return at.select(F.when(F.col("done"), F.col("first")).alias("first"), "page", F.when(F.col("done"), F.col("place")).alias("place"))
