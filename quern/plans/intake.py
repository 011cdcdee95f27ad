"""Queries of the way in: seeds, walks over links, addresses, texts, ingest and graph repair, each
with its SQL. Tables play the roles named in `catalogue`; where links are walked, regions are
seeds, nations their sub-categories, and customers and orders what these list."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions import rules as R
from quern.functions import text as X
from quern.functions import urls as U
from quern.operators import crawl, graph, ingest, retrieval
from quern.plans.catalogue import query, texts_query, values
from quern.sources.tables import table

_HOST = "lower(regexp_extract(url, '://([^/?#]+)', 1))"
_host = lambda: F.lower(F.regexp_extract("url", "://([^/?#]+)", 1))

# Addresses ---------------------------------------------------------------------------------------
_LINKS = [
    "https://x.example/van-ban-co-to-trang-12-sgk-lop-6-tap-1-ket-noi-tri-thuc-a1234.html",
    "https://x.example/soan-bai-nho-rung-lop-8-chan-troi-sang-tao-a77.html",
    "/phan-tich-bai-tho-lop_9-canh-dieu-a5.html",
    "/bo-cuc-truyen-kieu-tap_2",
    "/tap-lam-van-ta-cay-TRANG-3-lop-4",
    "/thuc-hanh-tieng-viet-trang-20",
    "/chinh-ta-nghe-viet",
    "/ke-chuyen-tuan-2",
    "/bai-doc-mua-xuan",
    "/on-tap-cuoi-nam",
    "/de-thi-hoc-ki-lop-5",
    "/giai-toan-lop-5-bai-1-trang-9",
    "/vo-bai-tap-toan-lop-3-tap-1-a9.html",
    "/giai-vbt-toan-lop-3",
    "/sbt-toan-7-canh-dieu",
    "/ly-thuyet-phan-so-lop-4",
    "/toan-lop-6-bai-3",
    "/khoa-hoc-tu-nhien-7-kntt-bai-2",
    "/khtn-lop-8-ctst",
    "/giao-duc-cong-dan-9-chan-troi-sang-tao-c12.html",
    "/lich-su-dia-li-lop-6-canh-dieu",
    "/cd-nhac",
    "",
]


@texts_query(_LINKS, "addresses", f"SELECT qid, {U.lesson_sql('q', R.READING_URLS)} FROM {values(_LINKS)}")
def url_reading(rows):
    """Page, grade, volume, article, series and type from a reading's address."""
    return rows.select("qid", *(c.alias(n) for n, c in U.lesson(F.col("q"), R.READING_URLS).items()))


@texts_query(_LINKS, "addresses", f"SELECT qid, {U.lesson_sql('q', R.MATHS_URLS)} FROM {values(_LINKS)}")
def url_maths(rows):
    return rows.select("qid", *(c.alias(n) for n, c in U.lesson(F.col("q"), R.MATHS_URLS).items()))


@texts_query(_LINKS, "addresses", f"SELECT qid, {U.SCIENCE_GRADE_SQL.format(u='q')} AS grade, {R.sql_first_rule('q', R.SERIES_SHORT, 'KNTT')} AS series, 'khtn' AS subject, 'khtn_lesson' AS content_type FROM {values(_LINKS)}")
def url_science(rows):
    """Grade 6 to 9 and series (abbreviations count wherever they stand) of a science lesson."""
    q = F.col("q")
    return rows.select("qid", U.science_grade(q).alias("grade"), R.first_rule(q, R.SERIES_SHORT, "KNTT").alias("series"), F.lit("khtn").alias("subject"), F.lit("khtn_lesson").alias("content_type"))


@texts_query(_LINKS, "addresses", f"SELECT qid, coalesce(TRY_CAST(regexp_extract(q, 'lop-([0-9]+)', 1) AS INTEGER), TRY_CAST(regexp_extract(q, '-([0-9]+)-', 1) AS INTEGER)) AS grade, {R.sql_first_rule('q', R.SERIES_LISTING, 'KNTT')} AS series, CASE WHEN contains(q, 'giao-duc-cong-dan') THEN 'gdcd' ELSE 'lich_su_dia_li' END AS subject FROM {values(_LINKS)}")
def url_social(rows):
    """Grade, series and subject of a listing of history, geography and civics."""
    q = F.col("q")
    return rows.select("qid", U.listing_grade(q).alias("grade"), R.first_rule(q, R.SERIES_LISTING, "KNTT").alias("series"), F.when(F.contains(q, F.lit("giao-duc-cong-dan")), "gdcd").otherwise("lich_su_dia_li").alias("subject"))


@texts_query(_LINKS, "addresses", f"SELECT qid, NOT {U.any_sql('q', R.NOT_LESSON)} AND {U.any_sql('q', R.LESSON)} AS lesson, NOT {U.any_sql('q', R.NOT_PRIMARY)} AND (contains(q, '-bai-') OR regexp_matches(q, '^/bai-[0-9]+')) AS primary_lesson, CASE WHEN contains(q, '/van-ban-') THEN 'van_ban' WHEN contains(q, '/soan-bai-') THEN CASE WHEN {U.any_sql('q', R.NOT_GUIDE)} THEN 'skip' ELSE 'soan_bai' END WHEN contains(q, '/tac-gia-') OR contains(q, '/tom-tat-') THEN 'tom_tat' ELSE 'skip' END AS feed FROM {values(_LINKS)}")
def lesson_links(rows):
    """Which addresses are lessons, by two lists of what is let in and out, and the feed of each."""
    q = F.col("q")
    has = lambda p: F.contains(q, F.lit(p))
    feed = F.when(has("/van-ban-"), "van_ban").when(has("/soan-bai-"), F.when(U.has_any(q, R.NOT_GUIDE), "skip").otherwise("soan_bai")).when(has("/tac-gia-") | has("/tom-tat-"), "tom_tat").otherwise("skip")
    return rows.select("qid", (~U.has_any(q, R.NOT_LESSON) & U.has_any(q, R.LESSON)).alias("lesson"), (~U.has_any(q, R.NOT_PRIMARY) & (has("-bai-") | q.rlike("^/bai-[0-9]+"))).alias("primary_lesson"), feed.alias("feed"))


@query(f"WITH u AS (SELECT page_id, {U.lesson_sql('url', R.READING_URLS)} FROM pages) SELECT page_id, CASE WHEN page_id % 2 = 0 THEN CAST(nullif(page_id % 10, 0) AS INTEGER) ELSE grade END AS grade, CASE WHEN page_id % 3 = 0 THEN 'CD' ELSE series END AS series FROM u")
def metadata_override(spark, d):
    """Grade and series that the walk brings along stand before the address's, also if null."""
    rows = table(spark, d, "pages").select("page_id", *(c.alias(n) for n, c in U.lesson(F.col("url"), R.READING_URLS).items()))
    own = F.nullif(F.col("page_id") % 10, F.lit(0)).cast("int")
    return rows.select("page_id", F.when(F.col("page_id") % 2 == 0, own).otherwise(F.col("grade")).alias("grade"), F.when(F.col("page_id") % 3 == 0, "CD").otherwise(F.col("series")).alias("series"))


_TITLE = "trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1))"
_title = lambda: F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))


@query(f"WITH p AS (SELECT page_id, lower({_TITLE}) AS t, lower(url) AS u, {R.sql_first_rule('lower(url)', R.READING_URLS, 'unknown')} AS k FROM pages) SELECT page_id, CASE WHEN contains(u, 'van-ban-') OR starts_with(t, 'văn bản ') THEN 'van_ban' WHEN k <> 'unknown' THEN k ELSE {R.sql_first_rule("t || ' ' || u", R.CONTENT, 'unknown')} END AS kind FROM p")
def content_reclass(spark, d):
    """Types by title and address: a whole text first, then the type that is known, then rules."""
    rows = table(spark, d, "pages").select("page_id", F.lower(_title()).alias("t"), F.lower("url").alias("u"))
    known = R.first_rule(F.col("u"), R.READING_URLS, "unknown")
    whole = F.contains("u", F.lit("van-ban-")) | F.startswith("t", F.lit("văn bản "))
    return rows.select("page_id", F.when(whole, "van_ban").when(known != "unknown", known).otherwise(R.first_rule(F.concat_ws(" ", "t", "u"), R.CONTENT, "unknown")).alias("kind"))


@query("SELECT page_id, link, CASE WHEN starts_with(link, 'http') THEN link WHEN starts_with(link, '/') THEN base || link ELSE base || '/' || link END AS address, split_part(link, '/', -1) AS segment FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/?#]+') AS base, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages)")
def absolute_links(spark, d):
    links = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://[^/?#]+", 0).alias("base"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("link"))
    return links.select("page_id", "link", X.absolute(F.col("link"), F.col("base")).alias("address"), F.substring_index("link", "/", -1).alias("segment"))


# Walks ---------------------------------------------------------------------------------------------
@query("SELECT g.grade, s.series, lower('https://school.example/' || s.series || '/' || g.grade) AS url, count(page_id) AS pages FROM (SELECT CAST(unnest(range(1, 10)) AS INTEGER) AS grade) g CROSS JOIN (VALUES ('KNTT'), ('CTST'), ('CD')) AS s(series) LEFT JOIN pages ON page_id % 9 + 1 = g.grade AND ['KNTT', 'CTST', 'CD'][CAST(page_id % 3 AS INTEGER) + 1] = s.series GROUP BY ALL")
def seed_table(spark, d):
    """27 seeds, one for each grade and series, and the pages that each has led to."""
    seeds = crawl.seeds(spark)
    of = F.element_at(F.array(*map(F.lit, crawl.SERIES)), (F.col("page_id") % 3 + 1).cast("int"))
    got = table(spark, d, "pages").groupBy((F.col("page_id") % 9 + 1).cast("int").alias("grade"), of.alias("series")).agg(F.count("*").alias("pages"))
    return seeds.join(F.broadcast(got), ["grade", "series"], "left").select("grade", "series", "url", F.coalesce("pages", F.lit(0)).alias("pages"))


_WALK = (
    "l AS (SELECT 'r' || r_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS k, true AS sub FROM nation JOIN region ON n_regionkey = r_regionkey UNION ALL SELECT 'n' || c_nationkey, 'c' || c_custkey, c_custkey, true FROM customer UNION ALL SELECT 'n' || s_nationkey, 's' || s_suppkey, s_suppkey, false FROM supplier UNION ALL SELECT 'c' || o_custkey, 'o' || o_orderkey, o_orderkey, false FROM orders), "
    "f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY k, dst) AS n FROM l WHERE sub) WHERE n <= 20), "
    "v AS (SELECT 'r' || r_regionkey AS page, 0 AS depth FROM region UNION ALL SELECT f.dst, 1 FROM f WHERE starts_with(src, 'r') UNION ALL SELECT g.dst, 2 FROM f JOIN f g ON f.dst = g.src WHERE starts_with(f.src, 'r'))"
)


@query(f"WITH {_WALK} SELECT page, depth, false AS article FROM v UNION ALL SELECT dst, min(depth) + 1, true FROM v JOIN l ON page = src AND NOT sub GROUP BY dst")
def crawl_walk(spark, d):
    """From seeds over sub-categories, two levels deep and twenty of each page, to articles."""
    link = lambda name, src, dst, key, sub: table(spark, d, name).select(F.concat(F.lit(src[0]), src[1]).alias("src"), F.concat(F.lit(dst[0]), dst[1]).alias("dst"), F.col(key).cast("long").alias("k"), F.lit(sub).alias("sub"))
    links = link("nation", ("r", "n_regionkey"), ("n", "n_nationkey"), "n_nationkey", True).unionByName(link("customer", ("n", "c_nationkey"), ("c", "c_custkey"), "c_custkey", True)).unionByName(link("supplier", ("n", "s_nationkey"), ("s", "s_suppkey"), "s_suppkey", False)).unionByName(link("orders", ("c", "o_custkey"), ("o", "o_orderkey"), "o_orderkey", False))
    return crawl.walk(table(spark, d, "region").select(F.concat(F.lit("r"), "r_regionkey").alias("page")), links, depth=2, cap=20)


@query("WITH RECURSIVE n AS (SELECT doc_id AS page, CASE WHEN (doc_id + 1) % 10 <> 0 AND doc_id + 1 IN (SELECT doc_id FROM documents) THEN doc_id + 1 END AS next FROM documents), c(first, page, place) AS (SELECT page, page, 0 FROM n WHERE page NOT IN (SELECT next FROM n WHERE next IS NOT NULL) UNION ALL SELECT c.first, n.next, c.place + 1 FROM c JOIN n ON n.page = c.page WHERE n.next IS NOT NULL) SELECT first, page, place FROM c")
def next_chain(spark, d):
    """Pages of listings that lead to the next: the first page of each and the place in it."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page"))
    after = docs.select((F.col("page") + 1).alias("page"), F.col("page").alias("before")).where("page % 10 <> 0").join(docs, "page")
    return crawl.chains(docs, after.select(F.col("before").alias("src"), F.col("page").alias("dst"))).withColumn("place", F.col("place").cast("int"))


@query("SELECT p_brand AS volume, p_type AS lesson, arg_max(p_name, p_partkey) AS title FROM part GROUP BY 1, 2")
def two_level_titles(spark, d):
    """Lessons below volumes; of a lesson that comes again the last title stays."""
    rows = table(spark, d, "part").select(F.col("p_brand").alias("volume"), F.col("p_type").alias("lesson"), "p_partkey", F.col("p_name").alias("title"))
    return rows.groupBy("volume", "lesson").agg(F.max_by("title", "p_partkey").alias("title"))


@query(f"SELECT host, link, CAST(row_number() OVER (PARTITION BY host ORDER BY p, k) AS INTEGER) AS rank FROM (SELECT {_HOST} AS host, link, min(page_id) AS p, arg_min(k, page_id * 100000 + k) AS k FROM (SELECT url, page_id, unnest(x) AS link, generate_subscripts(x, 1) - 1 AS k FROM (SELECT *, regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1) AS x FROM pages)) GROUP BY 1, 2)")
def ordered_links(spark, d):
    """Distinct links of each host in the order in which they were first seen."""
    links = table(spark, d, "pages").select(_host().alias("host"), "page_id", F.posexplode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("k", "link"))
    first = links.groupBy("host", "link").agg(F.min(F.struct("page_id", "k")).alias("at"))
    return retrieval.ranked(first, ["host"], [F.col("at")]).select("host", "link", "rank")


# Ingest ----------------------------------------------------------------------------------------------
_EXTRACTED = "SELECT page_id, regexp_replace(url, '[?#].*$', '') AS url, sha256(html) AS hash FROM pages"


@query(f"WITH p AS ({_EXTRACTED}) SELECT page_id FROM p WHERE page_id % 3 = 0 AND NOT EXISTS (SELECT 1 FROM p o WHERE o.page_id % 3 <> 0 AND o.url = p.url AND o.hash = p.hash)")
def append_extracted(spark, d):
    """Rows to append: those whose address and content are not there yet."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), F.sha2("html", 256).alias("hash"))
    return rows.where("page_id % 3 = 0").join(rows.where("page_id % 3 <> 0").select("url", "hash").distinct(), ["url", "hash"], "left_anti").select("page_id")


@query("SELECT source, count(*) AS seen, count(DISTINCT n_chars) AS inserted, count(*) - count(DISTINCT n_chars) AS skipped_dup FROM documents GROUP BY source")
def kb_insert_counts(spark, d):
    """Rows of a base with a unique key: how many go in, how many are skipped as repeated."""
    return ingest.insert_counts(table(spark, d, "documents"), ["source"], ["n_chars"])


@query("SELECT label, count(*) AS points, CAST(ceil(count(*) / 50.0) AS BIGINT) AS flushes, count(*) - 50 * (CAST(ceil(count(*) / 50.0) AS BIGINT) - 1) AS last_flush FROM (SELECT vec_id % 97 AS id, arg_max(label, vec_id) AS label FROM embeddings GROUP BY 1) GROUP BY label")
def vector_upsert(spark, d):
    """Points by id, the newest stays; how many batches of fifty each collection's upsert takes."""
    newest = ingest.upsert(table(spark, d, "embeddings").select((F.col("vec_id") % 97).alias("id"), "vec_id", "label"), "id", F.col("vec_id"), [], ["label"])
    return ingest.flushes(newest, "label", 50)


@query("WITH n AS (SELECT conv_id * 1000 + turn AS id, role, conv_id % 2 AS fresh FROM conversations), kept AS (SELECT id, role FROM n WHERE fresh = 1 OR role NOT IN ('user', 'assistant')), e AS (SELECT id AS src, id + 1 AS dst FROM n WHERE fresh = 1) SELECT kept.id, kept.role, e.dst FROM kept LEFT JOIN (SELECT e.* FROM e JOIN kept a ON a.id = src JOIN kept b ON b.id = dst) e ON e.src = kept.id")
def graph_reload(spark, d):
    """Nodes of the reloaded labels go, the new ones come, then edges between nodes that are there."""
    nodes = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "role", (F.col("conv_id") % 2).alias("fresh"))
    fresh = nodes.where("fresh = 1").select("id", "role")
    kept, edges = graph.reload(nodes.where("fresh = 0").select("id", "role"), fresh, fresh.select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")), "role", ["user", "assistant"])
    return kept.join(edges.withColumnRenamed("src", "id"), "id", "left").select("id", "role", "dst")


@query("SELECT CAST(n_chars % 9 + 1 AS INTEGER) AS grade, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY n_chars % 9 + 1, text")
def dedupe_per_grade(spark, d):
    """The first of equal texts in each grade, by hash."""
    rows = table(spark, d, "documents").select((F.col("n_chars") % 9 + 1).cast("int").alias("grade"), "doc_id", F.sha2("text", 256).alias("h"))
    return rows.groupBy("grade", "h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("WITH t AS (SELECT doc_id, source, text, coalesce(quality, 0) AS tier FROM documents LEFT JOIN labels USING (doc_id)) SELECT min(doc_id) AS doc_id, tier, count(*) AS copies FROM t GROUP BY tier, CASE WHEN tier = 1 THEN text ELSE regexp_replace(lower(text), '[^\\p{L}\\p{N}]+', '', 'g') END")
def tier_dedupe(spark, d):
    """Good rows are one where their texts are equal; poor ones where all letters and digits of
    their texts are, case aside."""
    labels = table(spark, d, "labels").select("doc_id", "quality")
    rows = table(spark, d, "documents").select("doc_id", "text").join(labels, "doc_id", "left").withColumn("tier", F.coalesce("quality", F.lit(0)))
    rough = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", "")
    key = F.sha2(F.when(F.col("tier") == 1, F.col("text")).otherwise(rough), 256)
    return rows.groupBy("tier", key.alias("key")).agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).select("doc_id", "tier", "copies")


@query("SELECT doc_id, source FROM documents WHERE nullif(n_chars % 10, 0) IS NOT NULL AND nullif(source, 'src0') IS NOT NULL")
def required_fields(spark, d):
    """Rows without a grade (0 is none) or a series go."""
    rows = table(spark, d, "documents").select("doc_id", F.nullif(F.col("n_chars") % 10, F.lit(0)).alias("grade"), F.nullif(F.col("source"), F.lit("src0")).alias("source"))
    return rows.dropna(subset=["grade", "source"]).select("doc_id", "source")


@query("SELECT page_id, year(current_date) AS crawled_year, length(html) > 0 AS fetched FROM pages")
def stamped(spark, d):
    """Rows with the time of the crawl."""
    rows = table(spark, d, "pages").withColumn("crawled_at", F.current_timestamp())
    return rows.select("page_id", F.year("crawled_at").cast("long").alias("crawled_year"), (F.length("html") > 0).alias("fetched"))


@query(f"SELECT {_HOST} AS host, count(*) AS pages, round(count(*) FILTER (length(html) >= 3000) / (1.0::DOUBLE * count(*)), 6) AS success, round(count(DISTINCT regexp_replace(url, '[?#].*$', '')) / (1.0::DOUBLE * count(*)), 6) AS coverage, round(1 - count(DISTINCT html) / (1.0::DOUBLE * count(*)), 6) AS dup_rate FROM pages GROUP BY 1")
def crawl_quality(spark, d):
    """Shares of pages long enough, of addresses among fetches, and of copies, by host."""
    rows = table(spark, d, "pages").select(_host().alias("host"), F.regexp_replace("url", "[?#].*$", "").alias("u"), F.sha2("html", 256).alias("h"), (F.length("html") >= 3000).alias("ok"))
    by = rows.groupBy("host").agg(F.count("*").alias("pages"), F.count_if("ok").alias("ok"), F.countDistinct("u").alias("u"), F.countDistinct("h").alias("h"))
    return by.select("host", "pages", F.round(F.col("ok") / F.col("pages"), 6).alias("success"), F.round(F.col("u") / F.col("pages"), 6).alias("coverage"), F.round(1 - F.col("h") / F.col("pages"), 6).alias("dup_rate"))


# Texts ---------------------------------------------------------------------------------------------
def composed(c: Column) -> Column:
    """Composed letters (NFC), in Arrow batches: Spark has no such function."""

    @F.pandas_udf(T.StringType())
    def nfc(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            yield s.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return nfc(c)


_MARKED = ["Tiếng Việt", "é", "é", "Å", "plain", ""]


@texts_query(_MARKED, "documents", f"SELECT qid, md5(nfc_normalize(q)) AS hash, length(nfc_normalize(q)) AS n FROM {values(_MARKED)}")
def nfc_text(rows):
    rows = rows.select("qid", composed(F.col("q")).alias("t"))
    return rows.select("qid", F.md5("t").alias("hash"), F.length("t").cast("long").alias("n"))


_CHEMISTRY = ["H<sub>2</sub>SO<SUB> 4 </SUB>", "Na<sup>+</sup> và x<sup>2</sup>, a<sub>12</sub>", "không"]


def _small_sql(c: str) -> str:
    for tag, signs in (("sub", X.SUBSCRIPT), ("sup", X.SUPERSCRIPT)):
        for a, b in zip(*signs, strict=True):
            c = f"regexp_replace({c}, '(?i)<{tag}[^>]*>\\s*[{a}]\\s*</{tag}>', '{b}', 'g')" if a != "-" else f"regexp_replace({c}, '(?i)<{tag}[^>]*>\\s*-\\s*</{tag}>', '{b}', 'g')"
    return c


@texts_query(_CHEMISTRY, "html", f"SELECT qid, md5({_small_sql('q')}) AS hash FROM {values(_CHEMISTRY)}")
def sub_sup(rows):
    """Digits and charges of formulas as characters of their own."""
    return rows.select("qid", F.md5(X.small_signs(F.col("q"))).alias("hash"))


_FORMULAS = ['<p>S: <span class="MathJax" data-latex="S = \\frac{1}{2}a">S = ...</span></p>', '<script type="math/tex">x^2</script> và <img src="a.png" alt="a_1 + b"> <img alt="ảnh">', "không có"]


@texts_query(_FORMULAS, "html", r"""SELECT qid, md5(regexp_replace(regexp_replace(regexp_replace(q, '(?is)<span[^>]*class="[^"]*(?:MathJax|mjx-chtml)[^>]*data-latex="([^"]*)"[^>]*>.*?</span>', ' $$\1$$ ', 'g'), '(?is)<script[^>]*type="math/tex[^"]*"[^>]*>(.*?)</script>', ' $$\1$$ ', 'g'), '(?is)<img[^>]*alt="([^"]*[\\_^][^"]*)"[^>]*>', ' $$\1$$ ', 'g')) AS hash FROM """ + values(_FORMULAS))
def mathjax_keep(rows):
    """Formulas that markup hides stand in the text between double dollars."""
    return rows.select("qid", F.md5(X.keep_formulas(F.col("q"))).alias("hash"))


_SPOKEN_V2 = "regexp_replace(q, '[$]', '', 'g')"
for _p, _said in X.SPEECH_V2[1:]:
    _SPOKEN_V2 = f"regexp_replace({_SPOKEN_V2}, {R.quoted(_p)}, {R.quoted(_said.replace('$', chr(92)))}, 'g')"
for _sign, _said in X.SIGNS:
    _SPOKEN_V2 = f"replace({_SPOKEN_V2}, '{_sign}', ' {_said} ')"
_FORMULA = [r"$$S = \frac{1}{2} \cdot a \cdot h$$", r"\sqrt{16} \pm 2 ≠ x²", "2 × 3 ÷ 1 ≤ ∞"]


@texts_query(_FORMULA, "documents", "SELECT * FROM (VALUES (0, 'S bằng 1 chia 2 nhân a nhân h'), (1, 'căn bậc hai của 16 cộng hoặc trừ 2 khác x bình phương'), (2, '2 nhân 3 chia 1 nhỏ hơn hoặc bằng vô cực')) AS v(qid, speech)", rf"SELECT qid, trim(regexp_replace({_SPOKEN_V2}, '\s+', ' ', 'g')) AS speech FROM (SELECT doc_id AS qid, text AS q FROM documents)")
def formula_speech(rows):
    return rows.select("qid", X.formula_speech(F.col("q")).alias("speech"))


_SCENES = ["Hình 2.1 và hình 3.5, Bảng 1.1", "Quan sát hình bên", "dựa vào lược đồ, trả lời", "như hình dưới", "không có gì", "hình 2"]


@texts_query(_SCENES, "documents", f"SELECT qid, CAST(len(regexp_extract_all(q, '[Hh]ình [0-9]+[.][0-9]+')) + len(regexp_extract_all(q, '[Bb]ảng [0-9]+[.][0-9]+')) AS INTEGER) AS refs, len(regexp_extract_all(q, '[Hh]ình [0-9]+[.][0-9]+')) + len(regexp_extract_all(q, '[Bb]ảng [0-9]+[.][0-9]+')) > 2 AS leans, {R.sql_score('q', R.FIGURES)} > 0 AS depends FROM {values(_SCENES)}")
def figure_refs(rows):
    """Texts that need a figure: more than two references, or a phrase that points at one."""
    refs = F.regexp_count("q", F.lit(r"[Hh]ình [0-9]+\.[0-9]+")) + F.regexp_count("q", F.lit(r"[Bb]ảng [0-9]+\.[0-9]+"))
    return rows.select("qid", refs.alias("refs"), (refs > 2).alias("leans"), (R.score(F.col("q"), R.FIGURES) > 0).alias("depends"))


_GLOSSARY = ["school /skuːl/ (n): trường học\nplay (v)- chơi\nbig house (adj): nhà to", "không có từ nào"]
_VOCAB = r"(?m)^(\w+(?: \w+)?)[ ]*(/[^/\n]+/)?[ ]*\((\w+)\)[:-][ ]*([^\n]+)$"


@texts_query(_GLOSSARY, "lessons", rf"SELECT qid, CAST(row_number() OVER (PARTITION BY qid ORDER BY k) AS INTEGER) AS rank, regexp_extract(m, '{_VOCAB}', 1) AS word, regexp_extract(m, '{_VOCAB}', 2) AS sound, regexp_extract(m, '{_VOCAB}', 3) AS kind, trim(regexp_extract(m, '{_VOCAB}', 4)) AS meaning FROM (SELECT qid, unnest(x) AS m, generate_subscripts(x, 1) AS k FROM (SELECT qid, regexp_extract_all(q, '{_VOCAB}') AS x FROM {values(_GLOSSARY)}))")
def vocab_rows(rows):
    """Glossary lines: word, sound, kind, meaning."""
    lines = rows.select("qid", F.posexplode(F.regexp_extract_all("q", F.lit(_VOCAB), 0)).alias("k", "m"))
    part = lambda n: F.regexp_extract("m", _VOCAB, n)
    return lines.select("qid", (F.col("k") + 1).alias("rank"), part(1).alias("word"), part(2).alias("sound"), part(3).alias("kind"), F.trim(part(4)).alias("meaning"))


_UNITS = ["https://x.example/getting-started-unit-1-lop-6", "/a-closer-look-2-unit-12-abc", "/skills-1-unit-3", "/grammar-unit-x", "/khac"]


@texts_query(_UNITS, "addresses", f"SELECT qid, {R.sql_first_rule('q', R.SECTIONS, None)} AS section, TRY_CAST(regexp_extract(q, '-unit-([0-9]+)', 1) AS INTEGER) AS unit FROM {values(_UNITS)}")
def unit_sections(rows):
    return rows.select("qid", R.first_rule(F.col("q"), R.SECTIONS, None).alias("section"), U.number(F.col("q"), "-unit-([0-9]+)").alias("unit"))


_LESSONS = ["Chương 1: Nguyên tử và phân tử", "Chương 2. Ánh sáng", "Chương 3 Tế bào", "Chương 4: Lịch sử thế giới", "Khí hậu châu Á", "đếm hình vuông rồi nhân với phân số", "căn bậc hai và hàm số", "axit muối oxi muối axit", "gì đó"]
_COUNTS = {s: " + ".join(f"(length(t) - length(replace(t, {R.quoted(w.lower())}, ''))) / {len(w)}" for w in words) for s, words in R.SCIENCE}
_SCIENCE_TOP = "greatest(" + ", ".join(s for s, _ in R.SCIENCE) + ")"


@texts_query(_LESSONS, "documents", f"WITH c AS (SELECT qid, t, " + ", ".join(f"CAST({c} AS BIGINT) AS {s}" for s, c in _COUNTS.items()) + f" FROM (SELECT qid, lower(q) AS t FROM {values(_LESSONS)})) SELECT qid, coalesce(CASE WHEN contains(t, 'chương') THEN {R.sql_first_rule('t', R.CHAPTERS, None)} END, CASE WHEN {_SCIENCE_TOP} > 3 THEN CASE " + " ".join(f"WHEN {s} = {_SCIENCE_TOP} THEN '{s}'" for s, _ in R.SCIENCE) + f" END END, 'unknown') AS branch, {R.sql_first_rule('t', R.HISTORY_OR_GEOGRAPHY, None)} AS side, list_filter([" + ", ".join(f"CASE WHEN {R.sql_score('t', p)} > 0 THEN {R.quoted(n)} END" for n, p in R.GRADE_HINTS) + "], lambda x: x IS NOT NULL) AS hints FROM c")
def branch_detect(rows):
    """The science branch (by a chapter's title, else by words that occur more than three times),
    history or geography, and the grades that words hint at."""
    t = F.col("t")
    rows = rows.select("qid", F.lower("q").alias("t"))
    rows = rows.select("*", *(sum((X.occurrences(t, w.lower()) for w in words), F.lit(0)).alias(s) for s, words in R.SCIENCE))
    names = [s for s, _ in R.SCIENCE]
    best = F.greatest(*names)
    by_words = F.when(best > 3, F.coalesce(*(F.when(F.col(s) == best, F.lit(s)) for s in names)))
    chapter = F.when(F.contains(t, F.lit("chương")), R.first_rule(t, R.CHAPTERS, None))
    hints = F.filter(F.array(*(F.when(R.score(t, p) > 0, F.lit(n)) for n, p in R.GRADE_HINTS)), lambda x: x.isNotNull())
    return rows.select("qid", F.coalesce(chapter, by_words, F.lit("unknown")).alias("branch"), R.first_rule(t, R.HISTORY_OR_GEOGRAPHY, None).alias("side"), hints.alias("hints"))


_READ = ["đọc cho em bài Cây tre", "soạn bài Nhớ rừng", "tóm tắt bài Lão Hạc", "cho em nghe bài Lượm", "hôm nay trời đẹp"]


@texts_query(_READ, "conversations", f"SELECT qid, {R.sql_score('lower(q)', R.READING)} AS asks FROM {values(_READ)}")
def reading_request(rows):
    """How many patterns of a request to read something out a text fits; nothing routes by it."""
    return rows.select("qid", R.score(F.lower("q"), R.READING).alias("asks"))


# Pages ---------------------------------------------------------------------------------------------
_NOISE = "(?is)<(script|style|nav|form|iframe|ins|header|footer)[^>]*>.*?</(script|style|nav|form|iframe|ins|header|footer)>|<div class=\"(?:ad|quang-cao)\">.*?</div>|<!--.*?-->"
_PARTS = "(?is)<(?:p|h2|h3|h4|li)[^>]*>([^<]{15,})"


@query(f"WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '{_NOISE}', ' ', 'g'), '{_PARTS}', 1) AS x FROM pages), u AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) AS k FROM b) SELECT page_id, count(*) AS blocks, count(DISTINCT trim(t)) AS distinct_blocks, md5(string_agg(t, chr(10) ORDER BY k)) AS hash FROM (SELECT page_id, trim(t) AS t, min(k) AS k FROM u WHERE NOT regexp_matches(lower(t), '{'|'.join(R.GARBAGE)}') GROUP BY 1, 2) GROUP BY page_id")
def page_clean(spark, d):
    """Blocks without the noise around them and without boilerplate, each once on its page."""
    bare = F.regexp_replace("html", _NOISE, " ")
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all(bare, F.lit(_PARTS), 1)).alias("k", "t"))
    kept = found.where(~F.lower("t").rlike("|".join(R.GARBAGE))).groupBy("page_id", F.trim("t").alias("t")).agg(F.min("k").alias("k"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "t"))), lambda x: x["t"]), "\n")
    return kept.groupBy("page_id").agg(F.count("*").alias("blocks"), F.countDistinct("t").alias("distinct_blocks"), F.md5(body).alias("hash"))


_PLANS = ["Mở đầu ở đây\nTiểu sử\nsinh năm 1907\nToàn văn bài thơ\ncâu một\ncâu hai\n\nTóm tắt\nngắn thôi", "I. Nội dung\ný chính\nTác giả\nai đó", "chỉ có mở đầu"]
_HEAD = r"(?i)^(I+\.?\s+|[1-9]\.\s+)?(Toàn văn|Văn bản|Tác phẩm|Nội dung|Bố cục|Tóm tắt|Tiểu sử|Tác giả)"


@texts_query(_PLANS, "documents", rf"""WITH l AS (SELECT qid, unnest(x) AS s, generate_subscripts(x, 1) AS k FROM (SELECT qid, list_transform(string_split(q, chr(10)), lambda t: trim(t)) AS x FROM {values(_PLANS)})), m AS (SELECT *, regexp_matches(s, '{_HEAD}') AS h FROM l WHERE s <> ''), n AS (SELECT *, coalesce(last_value(CASE WHEN h THEN split_part(lower(regexp_replace(s, '^(I+\.?\s+|[1-9]\.\s+)', '')), ' ', 1) END IGNORE NULLS) OVER (PARTITION BY qid ORDER BY k ROWS UNBOUNDED PRECEDING), 'intro') AS section FROM m), b AS (SELECT qid, section, string_agg(s, chr(10) ORDER BY k) FILTER (NOT h) AS body, CASE WHEN starts_with(section, 'toàn') THEN 0 WHEN starts_with(section, 'văn') THEN 1 WHEN starts_with(section, 'nội') THEN 2 WHEN starts_with(section, 'tóm') THEN 3 WHEN starts_with(section, 'intro') THEN 4 END AS prio FROM n GROUP BY qid, section) SELECT qid, arg_min(section, prio) AS section, md5(arg_min(body, prio)) AS hash FROM b WHERE prio IS NOT NULL AND body IS NOT NULL GROUP BY qid""")
def section_priority(rows):
    """The body of the section that counts most: the whole text, the passage, the content, the
    summary, or what stands before all."""
    from quern.operators import blocks

    lines = rows.select("qid", F.posexplode(F.split("q", "\n")).alias("k", "s")).select("qid", "k", F.trim("s").alias("s")).where("s <> ''")
    key = F.substring_index(F.lower(F.regexp_replace("s", r"^(I+\.?\s+|[1-9]\.\s+)", "")), " ", 1)
    parts = blocks.sections(lines, "qid", "k", F.col("s").rlike(_HEAD), key, "s").where("n_lines > 0")
    starts = lambda p: F.startswith("section", F.lit(p))
    prio = F.coalesce(*(F.when(starts(p), F.lit(n)) for n, p in enumerate(("toàn", "văn", "nội", "tóm", "intro"))))
    return parts.withColumn("prio", prio).where("prio is not null").groupBy("qid").agg(F.min_by("section", "prio").alias("section"), F.md5(F.min_by("body", "prio")).alias("hash"))


_THEORY = ["Diện tích là $$S = a \\times b$$ và $$P$$", "không có công thức"]


@texts_query(_THEORY, "documents", "SELECT qid, substr(q, 1, 500) AS definition, nullif(regexp_extract(q, '[$][$](.+?)[$][$]', 1), '') AS formula FROM " + values(_THEORY))
def theory_row(rows):
    """A concept's definition and its first formula."""
    return rows.select("qid", F.substring("q", 1, 500).alias("definition"), F.nullif(F.regexp_extract("q", r"[$][$](.+?)[$][$]", 1), F.lit("")).alias("formula"))


_SOLVED = ["Bài 1: Tính, xem [Hình 1]\nLời giải: Bước 1 cộng\nBước 2 trừ\nĐáp số: 5", "Bài 2: Kẻ theo hình vẽ\nLời giải: Đáp số: 7 cm", "chưa giải"]


@texts_query(_SOLVED, "lessons", r"SELECT qid, trim(split_part(q, 'Lời giải:', 1)) AS problem, CAST(len(regexp_extract_all(split_part(q, 'Lời giải:', 2), 'Bước [0-9]+')) AS INTEGER) AS steps, nullif(trim(regexp_extract(q, 'Đáp số: ([^\n]+)', 1)), '') AS answer, contains(split_part(q, 'Lời giải:', 1), '[Hình') OR contains(lower(split_part(q, 'Lời giải:', 1)), 'hình vẽ') AS has_figure FROM " + values(_SOLVED) + " WHERE contains(q, 'Lời giải:')")
def exercise_row(rows):
    """An exercise with its steps, its answer, and whether it needs a figure."""
    problem = F.trim(F.substring_index("q", "Lời giải:", 1))
    solution = F.split_part("q", F.lit("Lời giải:"), F.lit(2))
    answer = F.nullif(F.trim(F.regexp_extract("q", r"Đáp số: ([^\n]+)", 1)), F.lit(""))
    figure = F.contains(problem, F.lit("[Hình")) | F.contains(F.lower(problem), F.lit("hình vẽ"))
    return rows.where(F.contains("q", F.lit("Lời giải:"))).select("qid", problem.alias("problem"), F.regexp_count(solution, F.lit("Bước [0-9]+")).alias("steps"), answer.alias("answer"), figure.alias("has_figure"))
