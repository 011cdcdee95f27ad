"""Readers, rules and streaming on small inputs."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quern.functions import rules
from quern.functions import text as X
from quern.operators import crawl, graph, hooks, lookup, retrieval, route
from quern.sources import tables
from quern.streaming import upsert


def test_json_lines_quarantine(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"url": "u", "n": 1}\n\n{"url": \n')
    good, bad = tables.json_lines(spark, str(tmp_path), "url string, n int")
    assert [tuple(r) for r in good.collect()] == [("u", 1)] and bad.count() == 1


def test_json_array_and_partitioned_sink(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"t": "x", "n": 1}, {"t": "y", "n": 2}]')
    df = tables.json_array(spark, str(tmp_path / "a.json"), "t string, n int")
    tables.write_by(df, str(tmp_path / "out"), "t")
    assert {tuple(r) for r in spark.read.json(str(tmp_path / "out")).select("t", "n").collect()} == {("x", 1), ("y", 2)}


def test_rules_see_letters_of_all_scripts(spark):
    df = spark.createDataFrame([("trận điện",), ("tíchứ",), ("tích",)], "q string")
    got = [r[0] for r in df.select(rules.first_rule(F.col("q"), [("a", [r"trận\s+\w+"]), ("b", [r"tích\b"])], None)).collect()]
    assert got == ["a", None, "b"]


def test_fold_and_words(spark):
    row = spark.createDataFrame([("Đường  Trần_Hưng ĐẠO",)], "q string").select(X.accent_fold(F.col("q")), X.slug(F.col("q")), X.word_count(F.col("q"))).first()
    assert tuple(row) == ("duong tran hung dao", "uong_tran_hung_ao", 3)


def test_merge_keeps_what_is_known(spark):
    old = spark.createDataFrame([(1, "a", None), (2, "b", "s")], "node_id int, title string, source string")
    new = spark.createDataFrame([(2, "c", "t"), (3, "d", "u")], "node_id int, title string, source string")
    got = {tuple(r) for r in graph.merge_nodes(old, new, "node_id", ["source"]).collect()}
    assert got == {(1, "a", None), (2, "b", "t"), (3, "d", "u")}


def test_stream_takes_each_page_once(spark, tmp_path):
    src, t = tmp_path / "in", datetime(2024, 1, 1)
    spark.createDataFrame([("u", "h", t), ("u", "h", t), ("v", "h", t)], "url string, content_hash string, crawled_at timestamp").write.parquet(str(src))
    stream = spark.readStream.schema("url string, content_hash string, crawled_at timestamp").parquet(str(src))
    upsert.write_batches(upsert.fresh(stream), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_many_queries_meet_all_points_in_blocks(spark, monkeypatch):
    points = spark.createDataFrame([(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(60)], "vec_id long, embedding array<double>")
    asked = points.where("vec_id % 5 = 0").selectExpr("vec_id AS qid", "embedding AS qvec")
    few = retrieval.semantic_all(asked, points, 4).collect()
    monkeypatch.setattr(retrieval, "FEW", 5)
    assert sorted(retrieval.semantic_all(asked, points, 4).collect()) == sorted(few)


@pytest.mark.parametrize("chars", [500_000, 0])
def test_names_are_found_with_and_without_inner_words(spark, monkeypatch, chars):
    monkeypatch.setattr(retrieval, "NAME_CHARS", chars)
    texts = spark.createDataFrame([(1, "one two three four"), (1, "one two three four"), (2, "xone two threex"), (3, "two"), (4, None), (5, "a  b")], "id int, t string")
    names = spark.createDataFrame([(7, "ne two thr"), (8, "two"), (9, "a  b"), (10, "wo thr")], "name_id int, name string")
    got = sorted((r["name_id"], r["id"]) for r in retrieval.containing(texts, names).collect())
    assert got == [(7, 1), (7, 1), (7, 2), (8, 1), (8, 1), (8, 2), (8, 3), (9, 5), (10, 1), (10, 1), (10, 2)]


def test_json_array_sink_comes_back(spark, tmp_path):
    df = spark.createDataFrame([(k, None if k % 3 == 0 else f"t {k}") for k in range(20)], "n int, t string").repartition(3)
    tables.write_json_array(df, str(tmp_path / "out"))
    back = tables.json_array(spark, str(tmp_path / "out"), "n int, t string")
    assert sorted(map(tuple, back.collect()), key=str) == sorted(map(tuple, df.collect()), key=str)


def test_tables_are_made_once_and_copied(spark, tmp_path):
    path = str(tmp_path / "kb.parquet")
    assert tables.create_if_missing(spark, path, "id int, name string").count() == 0
    spark.createDataFrame([(1, "a")], "id int, name string").write.mode("append").parquet(path)
    assert tables.create_if_missing(spark, path, "id int, name string").count() == 1
    assert tables.snapshot(spark, str(tmp_path), ["kb"], str(tmp_path / "copy")) == {"kb": 1}
    reading, concept = tables.samples(spark)
    assert reading.first()["grade"] == 2 and concept.count() == 1


def test_schema_script_runs_statement_by_statement(spark):
    tables.apply_schema(spark, "CREATE OR REPLACE TEMP VIEW one AS SELECT ';' AS a;\nCREATE OR REPLACE TEMP VIEW two AS SELECT a || a AS b FROM one;\n")
    assert spark.table("two").first()["b"] == ";;"


def test_wildcards_in_names_are_live_and_filters_may_be_absent(spark):
    works = spark.createDataFrame([(1, "Cây tre", 6, "CD"), (2, "Cây trầu", 7, "KNTT"), (3, "cây", 5, "CD"), (4, "Sông", 6, "CD")], "id int, title string, grade int, series string")
    asked = spark.createDataFrame([(1, "cây", None, None), (2, "c_y tr%u", None, None), (3, "cây", 6, "CD"), (4, "cây", 9, None), (5, "núi", 6, None), (6, "s%g", 6, "CD")], "qid int, name string, g int, s string")
    got = {}
    for r in lookup.exact(works, asked).collect():
        got.setdefault(r.qid, {})[r["rank"]] = (r.id, r.score)
    assert got == {1: {1: (3, 1.0), 2: (1, 0.8), 3: (2, 0.8)}, 2: {1: (2, 0.8)}, 3: {1: (1, 0.8)}, 4: {1: (3, 1.0), 2: (1, 0.8), 3: (2, 0.8)}, 6: {1: (4, 0.8)}}


def test_a_name_means_the_own_grade_or_all(spark):
    events = spark.createDataFrame([(1, "Trận Bạch Đằng 938", 6), (2, "Trận Bạch Đằng 1288", 7), (3, "Lam Sơn", 7)], "id int, title string, grade int")
    asked = spark.createDataFrame([(1, "bạch đằng", 7), (2, "bạch đằng", 9), (3, "lam sơn", 4)], "qid int, name string, g int")
    assert sorted((r.qid, r.id) for r in lookup.of_own_grade(events, asked).collect()) == [(1, 2), (2, 1), (2, 2), (3, 3)]


def test_tiers_are_asked_for_what_is_left_only(spark):
    asked = spark.createDataFrame([(1,), (2,), (3,)], "qid int")
    tier = lambda ids: lambda a: a.where(F.col("qid").isin(ids)).select("qid", F.col("qid").alias("id"), F.lit(1).alias("rank"))
    assert sorted((r.qid, r.tier) for r in lookup.chain(asked, [tier([2]), tier([1, 2])]).collect()) == [(1, 1), (2, 0)]


def test_walk_keeps_depth_cap_and_what_was_seen(spark):
    links = spark.createDataFrame([("a", "b", 1, True), ("a", "c", 2, True), ("a", "d", 3, True), ("b", "a", 1, True), ("b", "e", 2, True), ("e", "f", 1, True), ("c", "x", 1, False), ("d", "y", 1, False), ("e", "z", 1, False), ("b", "x", 1, False)], "src string, dst string, k long, sub boolean")
    got = {tuple(r) for r in crawl.walk(spark.createDataFrame([("a",)], "page string"), links, depth=2, cap=2).collect()}
    assert got == {("a", 0, False), ("b", 1, False), ("c", 1, False), ("e", 2, False), ("x", 2, True), ("z", 3, True)}


def test_chains_of_any_length(spark):
    pages = spark.range(20).withColumnRenamed("id", "page")
    follows = spark.createDataFrame([(k, k + 1) for k in range(16) if k != 4], "src long, dst long")
    got = {r["page"]: (r["first"], r["place"]) for r in crawl.chains(pages, follows, longest=16).collect()}
    assert got == {k: (0, k) if k < 5 else (5, k - 5) if k < 17 else (k, 0) for k in range(20)}


def test_only_the_titles_of_social_sciences_retag(spark):
    rows = spark.createDataFrame([("kb_math_exercises", "Toán 5"), ("kb_social_exercises", "Khoa học Xã hội 6"), ("Math base", "x"), ("Ngữ văn", "x")], "source string, title string")
    assert [r[0] for r in rows.select(route.retag(F.lit("none"), F.col("source"), F.col("title"))).collect()] == ["none", "soc", "toan", "ngu_van"]


@pytest.mark.parametrize(("answer", "want"), [('```json\n{"label": "SOLUTION", "confidence": 0.2}\n```', ("SOLUTION", 0.2)), ('{"label": "SOLUTION"}', ("SOLUTION", 0.7)), ("no", ("NOISE", 0.0)), (None, ("NOISE", 0.0))])
def test_labels_of_a_model(spark, answer, want):
    df = spark.createDataFrame([(answer,)], "a string")
    assert tuple(df.select(*hooks.label(F.lit(None).cast("string"), F.col("a"))).first()) == want
    assert tuple(df.select(*hooks.label(F.lit("QUESTION"), F.col("a"))).first()) == ("QUESTION", 1.0)


def test_replies_without_a_model(spark):
    rows = spark.createDataFrame([("greeting", 0, None), ("off_topic", 2, "x"), ("lookup_reading", 1, "a"), ("lookup_reading", 0, None)], "i string, n int, l string")
    got = [r[0] for r in rows.select(hooks.reply(F.col("i"), F.col("n"), F.col("l"))).collect()]
    assert got == [hooks.WELCOME, hooks.ASIDE, "Chị tìm được 1 kết quả cho em nè:\na", "Chị chưa tìm thấy thông tin phù hợp cho câu hỏi của em. Intent detected: lookup_reading"]


def test_slugs_drop_letters_without_an_ascii_base(spark):
    row = spark.createDataFrame([(" Đồng—bằng sông_Cửu Long! ",)], "q string").select(X.slug(F.col("q"))).first()
    assert row[0] == "ongbang_song_cuu_long"
