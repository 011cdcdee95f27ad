"""From documents to packed training sequences: STAGES, each over all that the one before kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quern.llm import jaccard, language, mixing, packing, suffixes
from quern.llm.common import chosen, prepare, relieve, shared_dir, small, stowed, unstowed, written
from quern.llm.queries import tokenizer_path

#: Bytes of a passage that the suffix-array stage removes: fifty short words.
REPEAT_BYTES = 200
REPEAT_GRAM = 48


def ready(spark: SparkSession) -> None:
    prepare(spark)
    relieve(spark)


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language. Null, empty and letterless texts go; repeated rows stay or go
    together; a null id, language or source says nothing and drops nothing. Whole texts are read,
    however long. An empty table stays empty; other columns stay, whatever their names."""
    ready(spark)
    return language.accepted(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies, that with the smallest id; of rows of a class
    that repeat this id, one. Rows without an id or without words stay."""
    ready(spark)
    found = written(jaccard.linked(chosen(docs, doc_id="long", text="string")).where("class_key is not null"), "near-copies")
    best = found.where("kept").groupBy("class_key").agg(F.min("t1").alias("best"))
    gone = found.join(best, "class_key").where("not kept or t1 <> best").select("doc_id", "t1").distinct()
    alike = found.where("kept").groupBy("doc_id", "t1").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "t1")
    marks = written(gone.withColumn("gone", F.lit(True)).unionByName(alike.withColumn("gone", F.lit(False)).join(gone, ["doc_id", "t1"], "left_anti")), "near-copies-gone")
    rows = stowed(docs, doc_id="long", text="string").withColumn("t1", F.xxhash64("text")).drop("text").join(small(marks, marks.count()), ["doc_id", "t1"], "left")
    # rows alike in id and text: one of them
    order = W.partitionBy("doc_id", "t1").orderBy(F.xxhash64("_row"))
    several = rows.where("not gone").withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")
    return unstowed(rows.where("gone is null").unionByName(several), docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages that stand anywhere else; those of nothing else go, and so do
    texts of white space only. A null text stays null, a null id stays; repeated rows of
    REPEAT_BYTES or more empty each other; a shorter text has nothing to lose. n_chars is counted
    anew. An empty table stays empty; other columns stay, whatever their names."""
    ready(spark)
    left = suffixes.remove_repeats(docs, REPEAT_BYTES, REPEAT_GRAM)
    # by place: other columns may be called like these but for case
    left = left.toDF(*(f"c{i}" for i in range(len(docs.columns))))
    text = F.col(f"c{docs.columns.index('text')}")
    left = left.where(text.isNull() | text.rlike(r"[^\x00-\x20]"))
    return left.select(*((F.length(text).cast("long") if n == "n_chars" else F.col(f"c{i}")).alias(n) for i, n in enumerate(docs.columns)))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, twice at most. A null text has size 0, a null
    source is one of its own, null and repeated ids are rows like others, ties at a source's last
    block go by hash. An empty table stays empty; other columns stay, whatever their names."""
    ready(spark)
    return mixing.mixture(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces and the training sequences that hold them. A null or empty text is its end
    token alone; longer documents than a sequence are cut, nothing is dropped; null and repeated
    ids are documents like others. An empty table gives no rows; other columns are ignored."""
    ready(spark)
    return packing.pack_documents(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("language ID", identify_language),
    ("n-gram Jaccard join", drop_near_copies),
    ("suffix-array dedup", drop_repeats),
    ("mixing sources to target weights", mix_sources),
    ("best-fit packing", pack_sequences),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the last stage returns for documents; each stage's rows are a table on the way."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{base}/{k}")
        docs = spark.read.parquet(f"{base}/{k}")
    return docs
