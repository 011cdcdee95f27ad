"""Names with live wildcards in titles, by trigrams instead of a scan for each name.

Every fixed run of a pattern (between % and _) of three characters or more stands in each title that
fits, with all its trigrams. A pattern is looked up by its RAREST trigrams, by equal keys; titles that
have all of them are compared with the whole pattern. A trigram that very many titles hold is looked
up in parts of about PART titles, so that no trigram is one task's work. Patterns without three fixed
characters in a row fit almost anything and are compared with all titles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.retrieval import few, theta
from quern.sources.shared import stored

RAREST, PART = 3, 50_000


def of(text: Column) -> Column:
    """The different trigrams of a text in small letters."""
    last = F.length(text) - 2
    return F.when(last > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substring(text, i, F.lit(3))))).otherwise(F.array().cast("array<string>"))


def fixed(name: Column) -> Column:
    """The different trigrams of the fixed runs of a pattern, in small letters. A backslash makes
    the next sign fixed; runs are cut there too, so fewer trigrams are asked for."""
    return F.array_distinct(F.flatten(F.transform(F.split(F.lower(name), r"\\.|[%_\\]"), of)))


def named(works: DataFrame, asked: DataFrame) -> DataFrame:
    """works (title and others) and the asked rows (qid, name and others) whose name, a pattern of
    ILIKE, stands in the title."""
    fits = F.ilike("title", F.concat(F.lit("%"), F.col("name"), F.lit("%")))
    asked = stored(asked.withColumn("_t", fixed(F.col("name"))), "asked")
    short, long = asked.where("size(_t) = 0").drop("_t"), asked.where("size(_t) > 0")
    out = None
    if not long.isEmpty():
        # a place for each row: other columns may repeat
        placed = stored(works.withColumn("_row", F.monotonically_increasing_id()), "works")
        postings = stored(placed.select("_row", F.explode(of(F.lower("title"))).alias("_g")), "trigrams")
        grams = long.select("qid", "name", F.explode("_t").alias("_g")).distinct()
        held = postings.join(few(grams.select("_g").distinct(), 200_000), "_g", "left_semi").groupBy("_g").agg(F.count("*").alias("_n"))
        some = grams.join(held, "_g", "left").groupBy("qid", "name").agg(F.slice(F.array_sort(F.collect_list(F.struct(F.coalesce("_n", F.lit(0)).alias("n"), F.col("_g").alias("g")))), 1, RAREST).alias("x"))
        # a trigram that no title holds: no title fits
        some = some.where(F.get("x.n", F.lit(0)) > 0).select("qid", "name", F.size("x").alias("_need"), F.explode("x").alias("x"))
        parts = F.ceil(F.col("x.n") / PART).cast("int")
        some = some.select("qid", "name", "_need", F.col("x.g").alias("_g"), parts.alias("_parts"), F.explode(F.sequence(F.lit(0), parts - 1)).alias("_part"))
        hot = few(some.select("_g", "_parts").where("_parts > 1").distinct(), 200_000)
        cut = postings.join(hot, "_g", "left").withColumn("_part", F.coalesce(F.pmod(F.xxhash64("_row"), F.col("_parts")).cast("int"), F.lit(0))).drop("_parts")
        hits = cut.join(few(some.drop("_parts"), 200_000), ["_g", "_part"]).groupBy("qid", "name", "_need", "_row").agg(F.count("*").alias("_k")).where("_k = _need").select("qid", F.col("name").alias("_name"), "_row")
        found = placed.join(hits, "_row").drop("_row")
        out = found.join(few(long.drop("_t").withColumnRenamed("qid", "_q"), 200_000), (F.col("qid") == F.col("_q")) & (F.col("_name") == F.col("name"))).drop("_q", "_name").where(fits)
    if out is None or not short.isEmpty():
        rest = theta(works, short, fits)
        out = rest if out is None else rest.select(*out.columns).unionByName(out)
    return out
