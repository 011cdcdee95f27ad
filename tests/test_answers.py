"""Questions of every kind against rows worked out by hand: what they are about, and what they find."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from quern.operators import answer, hooks, route

#: question, grade: intent, subject, route.
ROUTED = [
    ("Xin chào!", 5, "greeting", None, None),
    ("em đây", 5, "greeting", None, None),
    ("tuần này học những gì ạ", 5, "lookup_curriculum", None, "curriculum"),
    ("hôm nay lớp mình học bài gì", 3, "lookup_curriculum", None, "curriculum"),
    ("bài 3 trang 45 lớp 5", 5, "lookup_specific", None, "global"),
    ("trang 7 lớp 3", None, "lookup_specific", None, "global"),
    ("từ láy là gì", 4, "explain_concept", "ngu_van", "concepts"),
    ("phân biệt danh từ và động từ", 4, "lookup_reading", "ngu_van", "reading"),
    ("giúp em tả con mèo", 4, "writing_outline", "ngu_van", "outline"),
    ("tả cây bàng giúp em", 4, "writing_outline", "ngu_van", "outline"),
    ("kể chuyện Tấm Cám", 6, "writing_outline", "ngu_van", "outline"),
    ("đọc cho em bài Cây tre nhé", 6, "lookup_reading", "ngu_van", "reading"),
    ("soạn bài Nhớ rừng lớp 8", 8, "lookup_reading", "ngu_van", "reading"),
    # without a page or exercise a question is a reading that is looked for, whatever its words
    ("tính diện tích hình thang", 5, "lookup_reading", "ngu_van", "reading"),
    ("quang hợp ở thực vật là gì", 7, "lookup_reading", "ngu_van", "reading"),
    ("cuộc khởi nghĩa Lam Sơn năm 1418", 6, "lookup_reading", "ngu_van", "reading"),
    ("khí hậu châu Á", 7, "lookup_reading", "ngu_van", "reading"),
    ("pháp luật và đạo đức", 7, "lookup_reading", "ngu_van", "reading"),
    ("tích phân", 9, "lookup_reading", "ngu_van", "reading"),
    ("tíchứ", 9, "lookup_reading", "ngu_van", "reading"),
    ("", 9, "lookup_reading", "ngu_van", "reading"),
    ("School nghĩa là gì", 6, "lookup_reading", "ngu_van", "reading"),
    ("trang 12 lớp 6 tính phương trình", 6, "lookup_specific", "toan", "math"),
    ("bài 4 trang 20 về quang hợp", 6, "lookup_specific", "khtn", "science"),
    ("bài 2 trang 31 khí hậu châu Á", 6, "lookup_specific", "dia_li", "social"),
    ("bài 5 trang 9 pháp luật", 6, "lookup_specific", "gdcd", "social"),
    ("bài 1 trang 3 kháng chiến", 6, "lookup_specific", "lich_su", "social"),
    ("bài 1 trang 2 grammar", 6, "lookup_specific", "tieng_anh", "global"),
    # literature by page has no route
    ("bài 2 trang 31 nhân vật", 4, "lookup_specific", "tieng_viet", None),
    ("bài 2 trang 31 nhân vật", 6, "lookup_specific", "ngu_van", None),
    ("bài 2 trang 31 nhân vật", None, "lookup_specific", "ngu_van", None),
]


def test_routes_by_hand(spark):
    rows = spark.createDataFrame([(k, q, g) for k, (q, g, *_) in enumerate(ROUTED)], "qid int, q string, grade int")
    got = {r.qid: (r.intent, r.subject, r.route) for r in route.understand(rows).collect()}
    assert got == {k: tuple(x[2:]) for k, x in enumerate(ROUTED)}
    assert {x[4] for x in ROUTED} == {None, "curriculum", "global", "concepts", "reading", "outline", "math", "science", "social"}


POINTS = [(1, [1.0, 0.0], 5, "math"), (2, [0.6, 0.8], 5, "math"), (3, [0.0, 1.0], 9, "math"), (11, [1.0, 0.0], 7, "science"), (12, [0.0, 1.0], 3, "science"), (21, [0.8, 0.6], 6, "social"), (31, [1.0, 0.0], 4, "reading"), (32, [0.8, 0.6], 5, "reading"), (33, [0.0, 1.0], 8, "reading"), (41, [1.0, 0.0], 3, "concepts"), (42, [0.6, 0.8], 8, "concepts"), (43, [0.8, 0.6], 2, "concepts")]
READING = [("reading", 31, 1, 1.0, 3), ("reading", 32, 2, 0.8, 3)]

#: question, grade, series, intent of a model: base, id, rank, score, tier of what is found.
FOUND = [
    ("trang 12 lớp 5 phương trình", 5, "KNTT", None, [("math", 1, 1, 1.0, None), ("math", 2, 2, 0.6, None)]),
    # the band of science begins at grade 6 and is empty: searched without it
    ("bài 4 trang 20 về quang hợp", 5, "KNTT", None, [("science", 11, 1, 1.0, None), ("science", 12, 2, 0.0, None)]),
    ("bài 2 trang 31 khí hậu châu Á", 5, "KNTT", None, [("social", 21, 1, 0.8, None)]),
    ("từ láy là gì", 5, "KNTT", None, [("concepts", 41, 1, 1.0, None), ("concepts", 43, 2, 0.8, None)]),
    ("trang 7 lớp 5", 5, "KNTT", None, [("concepts", 41, 1, 1.0, None), ("math", 1, 2, 1.0, None), ("reading", 31, 3, 1.0, None)]),
    ("đọc cho em bài Cây tre nhé", 5, "KNTT", None, [("texts", 101, 1, 1.0, 0)]),
    # a series that the text isn't in: nothing by name, so the nearest vectors
    ("đọc cho em bài Cây tre nhé", 5, "CD", None, READING),
    ("đọc cho em bài Cây tre nhé", 5, "", None, [("texts", 101, 1, 1.0, 0)]),
    ("Tóm tắt bài Làng", 5, "CD", None, [("summaries", 201, 1, 0.9, 1)]),
    ("đọc bài Mưa rào", 5, "KNTT", None, [("readings", 401, 1, 1.0, 2), ("readings", 402, 2, 0.8, 2)]),
    ("đọc bài Mưa rào", 0, None, None, [("readings", 401, 1, 1.0, 2), ("readings", 402, 2, 0.8, 2)]),
    ("soạn bài Không Có Thật", 5, "KNTT", None, READING),
    ("Vũ Nương là ai", 5, "KNTT", "character_info", [("guides", 301, 1, 0.85, 1)]),
    ("kể về làng", 5, "CD", "story_summary", [("summaries", 201, 1, 0.9, 0)]),
    ("xyz", 5, "KNTT", "story_summary", [(b, i, r, s, 2) for b, i, r, s, _ in READING]),
    ("giúp em tả con mèo", 5, "KNTT", None, [("outlines", 501, 1, 1.0, 0)]),
    ("giúp em tả con mèo", 8, "KNTT", None, [("outlines", 501, 1, 1.0, 1)]),
    ("tả cây bàng", 5, "KNTT", None, [("samples", 601, 1, 0.7, 2)]),
    ("kể chuyện Tấm Cám", 5, "KNTT", None, [("samples", 601, 1, 0.7, 3)]),
    # no kind of writing, or no grade: no outline
    ("dàn ý", 5, "KNTT", None, []),
    ("giúp em tả con mèo", 0, "KNTT", None, []),
    ("tuần này học những gì ạ", 5, "KNTT", None, [("weeks", 701, 1, 1.0, None), ("weeks", 702, 2, 1.0, None)]),
    ("tuần này học những gì ạ", 5, "", None, []),
    ("tuần này học những gì ạ", 0, "KNTT", None, []),
    ("Xin chào!", 5, "KNTT", None, []),
    ("bài 2 trang 31 nhân vật", 5, "KNTT", None, []),
]


@pytest.fixture(scope="module")
def bases(spark):
    works = lambda *rows: spark.createDataFrame(list(rows), "id long, work_name string, title string, series string")
    kinds = lambda *rows: spark.createDataFrame(list(rows), "id long, kind string, grade int")
    readings = spark.createDataFrame([(401, "Mưa rào", 5, "KNTT"), (402, "Mưa rào mùa hạ", 5, "KNTT"), (403, "Nắng", 5, "CD")], "id long, title string, grade int, series string")
    weeks = spark.createDataFrame([(701, 5, "KNTT", 3), (702, 5, "KNTT", 3), (703, 5, "CD", 3), (704, 5, "KNTT", 4)], "id long, grade int, series string, week int")
    points = spark.createDataFrame(POINTS, "vec_id long, embedding array<double>, label int, source string")
    return answer.Bases(points, works((101, "cây tre", "Cây tre Việt Nam", "KNTT")), works((201, "làng", "Làng", "CD")), works((301, "vũ nương", "Chuyện Vũ Nương", "KNTT")), readings, kinds((501, "ta_con_vat", 5), (502, "ta_con_vat", 3)), kinds((601, "ta_cay", 2)), weeks)


def questions(spark, rows):
    return spark.createDataFrame([(k, q, [1.0, 0.0], g, s, 3, i) for k, (q, g, s, i, *_) in enumerate(rows)], "qid long, q string, qvec array<double>, grade int, series string, week int, intent string")


def test_answers_by_hand(spark, bases):
    asked, found = answer.answers(questions(spark, FOUND), bases)
    got = {}
    for r in found.orderBy("qid", "rank").collect():
        got.setdefault(r.qid, []).append((r.base, r.id, r["rank"], r.score, r.tier))
    assert {k: got.get(k, []) for k in range(len(FOUND))} == {k: x[4] for k, x in enumerate(FOUND)}
    assert {r.route for r in found.collect()} == {"math", "science", "social", "concepts", "global", "reading", "story", "outline", "curriculum"}
    assert asked.count() == len(FOUND)


def test_answers_without_questions_or_bases(spark, bases):
    none = questions(spark, FOUND).limit(0)
    assert answer.answers(none, bases)[1].count() == 0
    empty = answer.Bases(*(getattr(bases, f).limit(0) for f in answer.Bases.__dataclass_fields__))
    assert answer.answers(questions(spark, FOUND), empty)[1].count() == 0


def test_replies_and_subjects_after_a_search(spark, bases):
    asked, found = answer.answers(questions(spark, FOUND), bases)
    n = found.groupBy("qid").agg(F.count("*").alias("n"))
    rows = asked.join(n, "qid", "left").select("qid", "intent", hooks.reply(F.col("intent"), F.coalesce("n", F.lit(0)), F.lit("x")).alias("reply")).collect()
    by = {r.qid: r.reply for r in rows}
    assert by[0].startswith("Chị tìm được 2 kết quả") and by[24] == hooks.WELCOME and by[19] == "Chị chưa tìm thấy thông tin phù hợp cho câu hỏi của em. Intent detected: writing_outline"
    said = spark.createDataFrame([("Math 5", "x", "toan"), ("Toán 5", "x", "toan"), ("KHTN 7", "x", "khtn"), ("kb_math", "x", "own"), ("kb_social", "Khoa học Xã hội 7", "soc"), ("Khái niệm", "x", "ngu_van"), ("Khoa học", "Xã hội", "khtn"), ("kb", "x", "own"), (None, None, "own")], "source string, title string, want string")
    assert all(r.got == r.want for r in said.select("want", route.retag(F.lit("own"), F.col("source"), F.col("title")).alias("got")).collect())
