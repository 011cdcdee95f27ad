"""What the operators share: the shared folder, size-checked joins, links to components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of (long) keys up to which a side is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Rows that go to Python at once; texts are long, and a batch lies in both processes.
ARROW_KEY, ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000

#: The temporary folder of each application on a single machine.
_local: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; a temporary one only on a single machine."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = _local.setdefault(spark.sparkContext.applicationId, "") or "file://" + tempfile.mkdtemp(prefix="quern-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, lost executors lose nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.written_path = path
    return out


def remove(table: DataFrame) -> None:
    """Removes a table that `written` made and that nothing reads any more."""
    path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table.written_path)
    path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Ends a step: removes its tables, lets Spark drop the shuffle files of the plans that made
    them, and executors give back the heap that it needed."""
    for df in tables:
        remove(df)
    gc.collect()
    spark._jvm.System.gc()
    relieve(spark)


def relieve(spark: SparkSession) -> None:
    """Lets executors collect garbage, and so give heap back that an earlier step needed: the next
    one's Python workers need room beside it. One task for each executor. A matter of memory only;
    results don't depend on it."""
    n = max(1, spark.sparkContext._jsc.sc().getExecutorMemoryStatus().size() - 1)  # and the driver
    collect = F.java_method(F.lit("java.lang.System"), F.lit("gc"))
    spark.range(0, n, 1, n).select(collect.alias("gc")).write.format("noop").mode("overwrite").save()


def small(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df, marked for broadcast if its counted rows are few enough; else a shuffle joins it."""
    return F.broadcast(df) if rows <= limit else df


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Connected components of edges (a long, b long): node, comp (its smallest node).

    Alternates large-star and small-star steps until the edges stay the same; each step
    is a grouped minimum and a join, so that no node's neighbours meet in one place.
    Rows with a null end or a = b link nothing. Nodes without an edge are not returned.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    e0 = e = written(e, name)
    seen = None
    while True:
        # Large star: neighbours above u go to the smallest neighbour of u.
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        e = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # Small star: u and its neighbours below it go to the smallest of them.
        low = e.groupBy("a").agg(F.min("b").alias("m"))
        e = e.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("x")).select("x.*").where("a <> b").distinct()
        e, last = written(e, name), e0
        remove(last)
        e0 = e
        now = e.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == seen:
            break
        seen = now
    return e.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


def _flat(df: DataFrame) -> DataFrame:
    return df.toDF(*(f"_c{i}" for i in range(len(df.columns))))


def chosen(df: DataFrame, **kinds: str) -> DataFrame:
    """The named columns only, cast; other columns may have any names, also alike but for case."""
    return _flat(df).select(*(F.col(f"_c{df.columns.index(n)}").cast(kind).alias(n) for n, kind in kinds.items()))


def stowed(df: DataFrame, without: str | None = None, **kinds: str) -> DataFrame:
    """chosen columns, and the whole row, or all but one column, as `_row` for unstowed."""
    rest = [F.col(f"_c{i}") for i, n in enumerate(df.columns) if n != without] or [F.lit(0).alias("_none")]
    return _flat(df).select(*(F.col(f"_c{df.columns.index(n)}").cast(kind).alias(n) for n, kind in kinds.items()), F.struct(*rest).alias("_row"))


def unstowed(df: DataFrame, columns: list[str], **new: str) -> DataFrame:
    """The rows that stowed put away, with the columns of new taken from df."""
    return df.select(*((F.col(new[c]) if c in new else F.col(f"_row._c{i}")).alias(c) for i, c in enumerate(columns)))


def prepare(spark: SparkSession) -> None:
    """Python workers on this machine find the library where the driver found it (on a cluster
    it is installed or sent with --py-files), and get whole texts in batches of ARROW_ROWS
    unless the session has a size of its own."""
    if spark.conf.get(ARROW_KEY) == "10000":
        spark.conf.set(ARROW_KEY, str(ARROW_ROWS))
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in paths.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [paths, root]))
