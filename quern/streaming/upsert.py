"""Incremental crawl: a stream of pages, each address once within the watermark, merged into a table
by address; points sent on in batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row

from quern.sources.merged import Merged


def fresh(pages: DataFrame, time: str = "crawled_at", delay: str = "7 days") -> DataFrame:
    """New (url, content_hash) pairs of a stream; state older than the delay goes."""
    return pages.withWatermark(time, delay).dropDuplicatesWithinWatermark(["url", "content_hash"])


def write_batches(stream: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch once; readers take the newest version of an address."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def merge_batches(stream: DataFrame, table: Merged, checkpoint: str, source: str = "stream"):
    """Merges each micro-batch into the table; one that runs again changes nothing."""
    return stream.writeStream.foreachBatch(lambda batch, n: table.merge(batch, source, n) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def send(points: DataFrame, by: str, size: int, flush: Callable[[object, list], None]) -> None:
    """Gives flush(value of by, rows) at most `size` rows at once: each task holds less than that of
    each value, and sends what is left at its end. Points that come again after a lost task are
    the receiver's upserts."""

    def run(rows: Iterator[Row]) -> None:
        held: dict[object, list] = {}
        for r in rows:
            own = held.setdefault(r[by], [])
            own.append(r)
            if len(own) >= size:
                flush(r[by], own)
                held[r[by]] = []
        for value, own in held.items():
            if own:
                flush(value, own)

    points.foreachPartition(run)
