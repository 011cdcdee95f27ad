"""Percentiles that are kept by hour and merged to days: counts in buckets whose bounds grow by a
fixed factor. Merging adds counts, so a day read from its hours equals a day read from its events,
and old hours are never read again. A percentile is off by the relative error `error` at most."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ERROR = 0.01


def factor(error: float = ERROR) -> float:
    return (1 + error) / (1 - error)


def bucket(value: Column, error: float = ERROR) -> Column:
    """The bucket k of a value: factor^(k - 1) < value <= factor^k. Values up to 0 have one of
    their own (null)."""
    return F.when(value > 0, F.ceil(F.round(F.log(value) / math.log(factor(error)), 9)))


def middle(k: Column, error: float = ERROR) -> Column:
    """The value that stands for a bucket, within the error of all that it holds."""
    f = factor(error)
    return F.coalesce(F.round(2 * F.pow(F.lit(f), k) / (f + 1), 6), F.lit(0.0))


def hours(events: DataFrame, time: str = "ts", by: str = "event_type", value: str = "value") -> DataFrame:
    """by, hour, k, n: counts of each hour's buckets; also over a stream with a watermark. Events
    without a time or value are left out."""
    rows = events.where(F.col(time).isNotNull() & F.col(value).isNotNull())
    counts = rows.groupBy(F.col(by), F.window(time, "1 hour").alias("w"), bucket(F.col(value)).alias("k")).agg(F.count("*").alias("n"))
    return counts.select(by, F.col("w.start").alias("hour"), "k", "n")


def percentiles(kept: DataFrame, by: list[str], shares: list[float]) -> DataFrame:
    """by, n, p50 and so on, of the buckets (k, n) of kept: the smallest value that the share of all
    events does not exceed. Buckets are few (hundreds for a value over ten powers of ten)."""
    each = kept.groupBy(*by, "k").agg(F.sum("n").alias("n"))
    w = W.partitionBy(*by)
    seen = F.sum("n").over(w.orderBy(F.asc_nulls_first("k")).rowsBetween(W.unboundedPreceding, 0))
    rows = each.withColumn("upto", seen).withColumn("all", F.sum("n").over(w)).withColumn("at", middle(F.col("k")))
    picks = [F.min(F.when(F.col("upto") >= F.ceil(p * F.col("all")), F.col("at"))).alias(f"p{round(100 * p)}") for p in shares]
    return rows.groupBy(*by).agg(F.sum("n").alias("n"), *picks)
