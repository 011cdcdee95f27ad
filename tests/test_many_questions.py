"""Many questions in one pass over the index of words; shares of tasks while it is built."""

import random

import pytest
from pyspark.sql import functions as F

from quern.operators import postings
from tests.test_indexed import built_of, plain_all_words


@pytest.mark.parametrize("bucket", [3, 4096])
def test_many_questions_find_what_all_words_finds(spark, monkeypatch, bucket):
    monkeypatch.setattr(postings, "BLOCK", 15)
    pick = random.Random(bucket)
    vocab = [f"w{k}" for k in range(12)]
    rows = [(i, pick.choice(vocab)) for i in range(300) for _ in range(pick.randrange(14))] + [(i, "all") for i in range(300)] * 2 + [(None, "w1"), (5, None)]
    asked = [(q, pick.choice([*vocab, "all", "all", "nowhere"])) for q in range(60) for _ in range(1 + q % 4)] + [(99, None), (7, "w1"), (7, "w1")]
    got = postings.many(spark.createDataFrame(asked, "qid long, w string"), built_of(spark, rows, bucket), 5)
    assert sorted((r.qid, r.id, r["rank"]) for r in got.collect()) == sorted(plain_all_words(rows, asked, 5))


def test_a_task_builds_a_bounded_share(spark, monkeypatch):
    """Texts are dealt to more tasks than cores once there are many, whatever Spark would put together."""
    monkeypatch.setattr(postings, "BUCKET", 20)
    shares, real = [], postings.stored
    monkeypatch.setattr(postings, "stored", lambda df, name, path=None: shares.append(df.rdd.getNumPartitions()) or real(df, name, path))
    texts = spark.range(400).select("id", F.lit("one two").alias("t"))
    assert postings.built(texts, lambda c: F.split(c, " "), 20).count() == 2 * 20
    assert shares[0] >= 20
