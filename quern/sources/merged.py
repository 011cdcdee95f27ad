"""A table that batches are merged into: rows by key, versions counted, replays without effect.

Keys are dealt to a fixed number of buckets. A merge reads and rewrites only the buckets that its
batch touches, into a folder of its own; then a manifest (one small file: the folder of each bucket,
and the last batch of each source) is put in place by a rename, which is the only moment that
readers see. A batch that a manifest already names is left out, so a batch that runs again after a
failure, or twice, counts once. One writer at a time: a manifest that came in between is an error.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Merged:
    """path; key of the rows, the column that orders them in time, columns that keep their first
    value, columns that take the newest."""

    path: str
    key: str
    order: str
    first: tuple[str, ...] = ()
    last: tuple[str, ...] = ()
    buckets: int = 64

    def files(self, spark: SparkSession):
        jvm, root = spark._jvm, spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return jvm, root.getFileSystem(spark._jsc.hadoopConfiguration())

    def manifest(self, spark: SparkSession) -> dict:
        """The newest manifest; {"version": 0} of a table that nothing was merged into."""
        jvm, fs = self.files(spark)
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        names = sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []
        names = [n for n in names if n.endswith(".json") and not n.startswith(".")]
        if not names:
            return {"version": 0, "buckets": {}, "batches": {}, "schema": None}
        return json.loads("".join(r["value"] for r in spark.read.text(f"{self.path}/manifests/{names[-1]}").collect()))

    def publish(self, spark: SparkSession, found: dict) -> None:
        jvm, fs = self.files(spark)
        path = jvm.org.apache.hadoop.fs.Path
        name = f"{self.path}/manifests/{found['version']:012d}.json"
        draft = path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = fs.create(draft, True)
        out.write(bytearray(json.dumps(found).encode()))
        out.close()
        if fs.exists(path(name)) or not fs.rename(draft, path(name)):
            raise RuntimeError(f"another writer has published {name}")

    def read(self, spark: SparkSession) -> DataFrame | None:
        """key, version, first and last columns; None before the first merge."""
        found = self.manifest(spark)
        return self._rows(spark, found, list(found["buckets"])).select(self.key, "version", *self.first, *self.last) if found["schema"] else None

    def _rows(self, spark: SparkSession, found: dict, buckets: list[str]) -> DataFrame:
        paths = sorted({f"{self.path}/data/{found['buckets'][b]}/_bucket={b}" for b in buckets if b in found["buckets"]})
        reader = spark.read.schema(found["schema"])
        return reader.parquet(*paths) if paths else spark.createDataFrame([], found["schema"])

    def merge(self, batch: DataFrame, source: str, batch_id: int) -> bool:
        """Merges a batch (key, order and all columns); False if it is in the table already. Rows
        with equal keys each count as a version; null keys are one key."""
        spark, found = batch.sparkSession, None
        found = self.manifest(spark)
        if found["batches"].get(source, -1) >= batch_id:
            return False
        new = batch.groupBy(self.key).agg(F.count("*").alias("version"), F.min(self.order).alias("_first"), F.max(self.order).alias("_last"), *(F.min_by(c, self.order).alias(c) for c in self.first), *(F.max_by(c, self.order).alias(c) for c in self.last))
        new = new.withColumn("_bucket", F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int"))
        kept = new.drop("_bucket").schema
        touched = [str(r[0]) for r in new.select("_bucket").distinct().collect()]
        state = found | {"schema": found["schema"] or ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept)}
        old = self._rows(spark, state, touched)
        pair = old.select(*(F.col(c).alias(f"_o_{c}") for c in old.columns)).join(new, F.col(f"_o_{self.key}").eqNullSafe(F.col(self.key)), "full")
        mine = lambda c: F.col(f"_o_{c}")
        earlier, later = mine("_first").isNotNull() & (F.col("_first").isNull() | (mine("_first") <= F.col("_first"))), F.col("_last").isNotNull() & (mine("_last").isNull() | (mine("_last") <= F.col("_last")))
        out = pair.select(
            F.when(F.col("version").isNull(), mine(self.key)).otherwise(F.col(self.key)).alias(self.key),
            (F.coalesce(mine("version"), F.lit(0)) + F.coalesce("version", F.lit(0))).alias("version"),
            F.least(mine("_first"), F.col("_first")).alias("_first"),
            F.greatest(mine("_last"), F.col("_last")).alias("_last"),
            *(F.when(earlier, mine(c)).otherwise(F.col(c)).alias(c) for c in self.first),
            *(F.when(later, F.col(c)).otherwise(mine(c)).alias(c) for c in self.last),
        )
        folder = f"{found['version'] + 1:012d}-{uuid.uuid4().hex[:8]}"
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        out.withColumn("_bucket", bucket).repartition("_bucket").write.partitionBy("_bucket").parquet(f"{self.path}/data/{folder}")
        self.publish(spark, {"version": found["version"] + 1, "buckets": found["buckets"] | dict.fromkeys(touched, folder), "batches": found["batches"] | {source: batch_id}, "schema": state["schema"]})
        return True
