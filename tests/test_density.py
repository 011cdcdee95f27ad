"""Main content of pages made by hand, none of which has an article."""

from __future__ import annotations

from pyspark.sql import functions as F

from quern.functions import density

LONG = "It was a long road that led from the village over the hill and down to the river where the old mill stood, and nobody had walked it for years."
MORE = "When the rain came the water rose above the wheel, the miller moved his sacks to the loft, and his daughter counted them twice every evening by lamp light."
MENU = "<ul><li><a href=/>Home</a></li><li><a href=/a>About us</a></li><li><a href=/b>All our many books and other things to read</a></li></ul>"


def found(spark, *pages):
    rows = spark.createDataFrame(list(enumerate(pages)), "k int, html string")
    return [r.t for r in density.main_content(rows, "html", "t").orderBy("k").collect()]


def test_long_blocks_stay_and_menus_go(spark):
    page = f"<html><head><title>T</title><script>var a = '<p>{LONG}</p>';</script></head><body><div>{MENU}</div><div class=x><h1>The mill</h1><p>{LONG}</p><p>A short line.</p><p>{MORE}</p></div><div>{MENU}<p>Contact</p></div><!-- <p>{LONG}</p> --></body></html>"
    assert found(spark, page) == [f"The mill\n{LONG}\nA short line.\n{MORE}"]


def test_tables_stay_and_repeated_blocks_go(spark):
    page = f"<body><p>{LONG}</p><table><tr><th>Year</th><th>Sacks</th></tr><tr><td>1890</td><td><b>12</b></td></tr><tr><td><a href=/x>link</a></td><td><a href=/y>more</a></td></tr></table><p>{MORE}</p><p>{LONG}</p></body>"
    assert found(spark, page) == [f"{LONG}\nYear | Sacks\n1890 | 12\n{MORE}"]


def test_links_inside_long_text_stay(spark):
    half = LONG.replace("the village", "<a href='/v'>the village</a>")
    links = " ".join(f"<a href=/{k}>one of many words</a>" for k in range(20))
    assert found(spark, f"<div>{half}</div><div>{links}</div><p>tail</p>") == [LONG]


def test_headings_without_content_go(spark):
    assert found(spark, f"<h2>Lost</h2><ul><li><a href=/>x</a></li></ul><p>{LONG}</p><p>{MORE}</p>") == [f"{LONG}\n{MORE}"]


def test_odd_pages(spark):
    got = found(spark, None, "", "plain", "<p>" * 50, "a \x01 b " + LONG, f"<div><p>{LONG}<p>{MORE}", LONG + " " + "word " * 50_000)
    assert got[:4] == ["", "", "", ""] and got[4] == "a b " + LONG and got[5] == f"{LONG}\n{MORE}" and got[6].count("word") == 50_000
    assert density.main_content(spark.createDataFrame([], "html string"), "html", "t").count() == 0


def test_each_block_is_worked_out_once(spark):
    rows = spark.createDataFrame([("".join(f"<p>{LONG} {k}</p>" for k in range(3000)),)], "html string")
    kept = density.marked(rows, "html", "m").select(F.size(F.filter("m", lambda b: b["content"])).alias("n"))
    assert kept.first()["n"] == 3000
