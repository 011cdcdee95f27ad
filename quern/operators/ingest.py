"""Idempotent ingest: upserts, unique keys, resume, dedupe."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(batches: DataFrame, key: str, order: Column, first: list[str], last: list[str]) -> DataFrame:
    """One row for each key with its version; first columns keep the oldest value, last take
    the newest. A grouped aggregate, so a hot key is combined before the shuffle."""
    return batches.groupBy(key).agg(F.count("*").alias("version"), *(F.min_by(c, order).alias(c) for c in first), *(F.max_by(c, order).alias(c) for c in last))


def unseen(new: DataFrame, done: DataFrame, key: str) -> DataFrame:
    return new.join(done.select(key).distinct(), key, "left_anti")


def first_of(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """keys and the smallest order value of each distinct key; nulls are one key."""
    return df.groupBy(*keys).agg(F.min(order).alias(order))


def insert_counts(rows: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """by, seen, inserted, skipped_dup: of rows with equal keys one goes in; nulls are one key."""
    each = rows.groupBy(*by, *key).agg(F.count("*").alias("n"))
    return each.groupBy(*by).agg(F.sum("n").alias("seen"), F.count("*").alias("inserted")).withColumn("skipped_dup", F.col("seen") - F.col("inserted"))


def flushes(points: DataFrame, by: str, size: int) -> DataFrame:
    """by, points, flushes, last_flush: batches of `size` points, the last one what is left."""
    n = points.groupBy(by).agg(F.count("*").alias("points")).withColumn("flushes", F.ceil(F.col("points") / size))
    return n.withColumn("last_flush", F.col("points") - size * (F.col("flushes") - 1))
