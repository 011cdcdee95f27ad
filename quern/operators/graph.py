"""Nodes and edges as tables: joins of fixed length, audit and repair."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def merge_nodes(old: DataFrame, new: DataFrame, key: str, on_match: list[str]) -> DataFrame:
    """old with new merged in: unknown nodes come whole, known ones only change on_match."""
    cols = [c for c in old.columns if c != key]
    both = old.withColumnsRenamed({c: f"_o_{c}" for c in cols}).withColumn("_in", F.lit(True)).join(new, key, "full")
    pick = lambda c: F.coalesce(F.col(c), F.col(f"_o_{c}")) if c in on_match else F.when(F.col("_in"), F.col(f"_o_{c}")).otherwise(F.col(c))
    return both.select(key, *(pick(c).alias(c) for c in cols))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Nodes that no edge leads to."""
    return nodes.join(edges.select(F.col("dst").alias("node_id")).distinct(), "node_id", "left_anti")


def either_end(hits: DataFrame, edges: DataFrame) -> DataFrame:
    """hits joined to the edges that they begin or end: two equal-key joins, no OR."""
    one = hits.join(edges, hits["node_id"] == edges["src"])
    return one.unionByName(hits.join(edges, hits["node_id"] == edges["dst"]))


def materialise(nodes: DataFrame, carried: DataFrame, targets: str) -> DataFrame:
    """src, dst of the ids in each node's array of targets, as far as the target is a node."""
    edges = carried.select(F.col("node_id").alias("src"), F.explode(targets).alias("dst"))
    return edges.join(nodes.select(F.col("node_id").alias("dst")), "dst").select("src", "dst")


def link_by(orphaned: DataFrame, known: DataFrame, key: str, value: str, otherwise: Column) -> DataFrame:
    """orphaned with the smallest value of known rows with their key, else a synthetic one."""
    first = known.groupBy(key).agg(F.min(value).alias("_v"))
    return orphaned.join(first, key, "left").withColumn(value, F.coalesce("_v", otherwise)).withColumn("synthetic", F.col("_v").isNull()).drop("_v")


def reload(old: DataFrame, new: DataFrame, edges: DataFrame, label: str, labels: list[str]) -> tuple[DataFrame, DataFrame]:
    """Nodes after the old ones of the labels went and the new ones came, and those edges (src,
    dst) whose ends are both there."""
    nodes = old.where(~F.col(label).isin(labels)).unionByName(new)
    ids = nodes.select("id").distinct()
    there = edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return nodes, there.select("src", "dst")


def along(start: DataFrame, edges: DataFrame, relations: list[str]) -> DataFrame:
    """start (node_id and others) with end: where a path over edges (src, rel, dst) of the given
    relations, one after the other, leads from each node. The relation is a filter of each scan."""
    out = start.withColumn("end", F.col("node_id"))
    for rel in relations:
        step = edges.where(F.col("rel") == rel).select(F.col("src").alias("end"), "dst")
        out = out.join(step, "end").drop("end").withColumnRenamed("dst", "end")
    return out


def inherit(nodes: DataFrame, source: DataFrame, edges: DataFrame, relations: list[str], column: str, unset: list[str]) -> DataFrame:
    """nodes with `column` taken from the nodes of source that a path of relations comes from, where
    it is null or one of unset; of several sources the smallest value."""
    given = along(source.where(F.col(column).isNotNull()).select("node_id", F.col(column).alias("_v")), edges, relations)
    best = given.groupBy(F.col("end").alias("node_id")).agg(F.min("_v").alias("_v"))
    bare = F.col(column).isNull() | F.col(column).isin(unset)
    return nodes.join(best, "node_id", "left").withColumn(column, F.when(bare, F.coalesce("_v", column)).otherwise(F.col(column))).drop("_v")


def adopt(works: DataFrame, units: DataFrame, lessons: DataFrame, series: DataFrame, legacy: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(units, unit -> work, series -> unit) after every work (id, url, title, series) has a unit.

    A work belongs to the units (unit_id, name, series) whose lesson (unit_id, url) has its address.
    The others get a unit by name (title, or address without one) and series (legacy without one),
    made once however many works ask for it, or found where it is there; it is tied to its series
    (code) if that is known.
    """
    by_url = works.join(lessons.select("unit_id", "url").distinct(), "url").select("unit_id", F.col("id").alias("work_id"))
    bare = works.join(by_url.select(F.col("work_id").alias("id")).distinct(), "id", "left_anti")
    bare = bare.select("id", F.coalesce("title", "url").alias("name"), F.coalesce("series", F.lit(legacy)).alias("series"), F.col("series").alias("_own"))
    own = units.groupBy("name", "series").agg(F.min("unit_id").alias("_old"))
    made = bare.select("name", "series").distinct().join(own, ["name", "series"], "left")
    made = made.withColumn("unit_id", F.coalesce("_old", F.concat_ws("|", F.lit("new"), "name", "series")))
    new = made.where("_old is null").select("unit_id", "name", "series")
    ties = bare.join(made, ["name", "series"])
    tied = ties.join(series.select(F.col("code").alias("_own")), "_own", "left_semi").select(F.col("_own").alias("code"), "unit_id").distinct()
    return units.select("unit_id", "name", "series").withColumn("synthetic", F.lit(False)).unionByName(new.withColumn("synthetic", F.lit(True))), by_url.unionByName(ties.select("unit_id", F.col("id").alias("work_id"))), tied
