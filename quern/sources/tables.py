"""Readers and sinks: tables of a folder, JSON Lines with a quarantine for bad lines, JSON arrays,
tables that are made where they are missing, copies."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, bad lines) of JSON Lines files; blank lines are skipped. One pass parses,
    since the raw line is kept beside it."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select("value", F.from_json("value", schema + ", _bad string", {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}).alias("x"))
    return parsed.where("x._bad is null").select("x.*").drop("_bad"), parsed.where("x._bad is not null").select(F.col("value").alias("line"))


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """A folder of JSON Lines for each value of column."""
    df.write.mode("append").partitionBy(column).json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """A folder of files that each hold one JSON array of rows; `json_array` reads it back."""
    lines = df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value"))

    def arrays(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # a row waits for the next: the last one closes the array
        for part in parts:
            for line in part["value"]:
                if held is not None:
                    yield pd.DataFrame({"value": [held + ","]})
                held = ("[" if held is None else "") + line
        if held is not None:
            yield pd.DataFrame({"value": [held + "]"]})

    lines.mapInPandas(arrays, "value string").write.mode("overwrite").text(path)


def create_if_missing(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The table at path; an empty one of the schema is made where there is none."""
    spark.createDataFrame([], schema).write.mode("ignore").parquet(path)
    return spark.read.schema(schema).parquet(path)


def apply_schema(spark: SparkSession, script: str) -> None:
    """Runs a script's statements in their order; they are parted by semicolons at line ends."""
    for statement in re.split(r";\s*(?:\n|\Z)", script):
        if statement.strip():
            spark.sql(statement)


def snapshot(spark: SparkSession, folder: str, names: list[str], to: str) -> dict[str, int]:
    """Copies tables of a folder and counts their rows; a copy that lost rows is an error."""
    counts = {}
    for name in names:
        rows = table(spark, folder, name)
        rows.write.mode("overwrite").parquet(f"{to}/{name}.parquet")
        counts[name] = table(spark, to, name).count()
        if counts[name] != rows.count():
            raise RuntimeError(f"the copy of {name} has {counts[name]} rows")
    return counts


def samples(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """A reading and a concept to begin with, as rows of the two bases."""
    reading = spark.createDataFrame([(1, "Lượm", "Tố Hữu", 2, "KNTT", 5, "Một em bé liên lạc nhanh nhẹn và gan dạ.")], "id int, title string, author string, grade int, series string, week int, body string")
    concept = spark.createDataFrame([(1, "Từ ghép", "Từ do nhiều tiếng có nghĩa hợp thành.", 4, '["bàn ghế", "xe đạp"]')], "id int, name string, definition string, grade int, examples string")
    return reading, concept
