"""Search by matrix products against brute force in SQL, and how scores are shown."""

import random

import duckdb
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import products, retrieval
from quern.plans import catalogue


def plan(df):
    return df._jdf.queryExecution().toString()


def written(spark, path, rows):
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{path}/embeddings.parquet/*.parquet'")
    return con


def same(spark, con, path, names):
    show = lambda found: sorted(repr(tuple("nan" if v != v else v for v in r)) for r in found)
    for name in names:
        df = catalogue.QUERIES[name](spark, str(path))
        order = sorted(df.columns)
        assert show(map(tuple, df.select(*order).collect())) == show(con.execute(f"SELECT {', '.join(order)} FROM ({catalogue.ORACLE_SQL[name]})").fetchall()), name


def test_products_give_the_rows_of_sql(spark, tmp_path, monkeypatch):
    """Copies tie, so that small ids go first; a null vector comes last and one of zeros first, as in
    SQL; labels may be null; cells and chunks are small here, so that all meet in several."""
    for name, n in {"PART": 40, "BLOCK": 3, "CHUNK": 7, "PAIRS": 5}.items():
        monkeypatch.setattr(products, name, n)
    some = random.Random(3)
    rows = [(i, [float(some.randint(-2, 2)), 1.0, float(i % 3)], None if i % 41 == 7 else i % 6) for i in range(400)]
    rows[13], rows[77] = (13, None, 2), (77, [0.0, 0.0, 0.0], 3)
    con = written(spark, tmp_path, rows)
    same(spark, con, tmp_path, ["semantic_topk_band", "semantic_topk_lte", "semantic_nofilter", "global_merge_top3", "semantic_relax_on_empty", "recall_precision_mrr"])


def test_pairs_are_never_rows(spark):
    points = spark.range(300).select(F.col("id").alias("vec_id"), F.array(F.col("id") + 1.0, F.lit(1.0)).alias("embedding"), (F.col("id") % 4).cast("int").alias("label"))
    asked = points.where("vec_id % 50 = 0").selectExpr("vec_id AS qid", "embedding AS qvec", "label AS grade")
    for df in (retrieval.semantic_all(asked, points, 2), retrieval.semantic(asked, points, 2), retrieval.semantic(asked, points, 2, low=1)):
        assert "cogroup" in plan(df).lower() and "zip_with" not in plan(df)
    assert products.best(asked, points, 2).count() <= 2 * asked.count()


def test_scores_are_shown_as_sql_rounds_them(spark):
    """0.38315 as a double lies below the half of its fifth digit, 0.00005 above."""
    some = random.Random(2)
    scores = [0.38315, 0.00005, 0.12345, 0.37955, -0.00001, -0.0, 0.0, 1.0, -1.0, 12345.67895, 0.03125, 0.99995, float("nan"), *(some.randint(-10_000, 10_000) / 1e4 + 5e-5 for _ in range(300)), *(some.random() for _ in range(100))]
    points = spark.createDataFrame([(i, s) for i, s in enumerate(scores)], "i int, s double")
    got = [r[0] for r in points.orderBy("i").select(text.four_digits(F.col("s"))).collect()]
    assert got == [duckdb.execute("SELECT format('{:.4f}', ?::DOUBLE)", [s]).fetchone()[0] for s in scores]


def test_context_rounds_as_sql(spark, tmp_path):
    some = random.Random(5)
    con = written(spark, tmp_path, [(i, [some.gauss(0, 1) for _ in range(3)], 1 + i % 2) for i in range(10_000)])
    same(spark, con, tmp_path, ["context_format"])
