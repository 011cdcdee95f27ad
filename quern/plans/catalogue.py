"""Every query of the library over its whole tables, and SQL that gives the same rows.

Roles of the tables: embeddings are a vector collection (label: grade; queries are the rows with
vec_id divisible by 50), documents extracted content, pages raw pages, conversations ordered
blocks (user: question, assistant: solution), benchmark lookup names, events a monitoring log.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import text as X
from quern.operators import blocks, graph, ingest, products, retrieval
from quern.sources.tables import table

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
#: Of operators on texts: f(spark) over a few texts that fit every rule, and SQL for its rows.
FIXTURES: dict = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        ORACLE_SQL[f.__name__] = sql
        return f

    return add


def vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    points = table(spark, d, "embeddings")
    return points.where(F.col("vec_id") % 50 == 0).select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec"), F.col("label").alias("grade")), points


def frame(spark: SparkSession, texts: list[str]) -> DataFrame:
    return spark.createDataFrame(list(enumerate(texts)), "qid int, q string")


def values(texts: list[str]) -> str:
    return "(VALUES " + ", ".join(f"({k}, {R.quoted(t)})" for k, t in enumerate(texts)) + ") AS v(qid, q)"


#: Whole columns of texts.
COLUMNS = {
    "documents": "SELECT doc_id AS qid, text AS q FROM documents",
    "conversations": "SELECT conv_id * 1000 + turn AS qid, text AS q FROM conversations",
    "pages": "SELECT page_id AS qid, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS q FROM pages",
    "addresses": "SELECT page_id AS qid, url AS q FROM pages",
    "html": "SELECT page_id AS qid, html AS q FROM pages",
    # whole documents laid out as lessons, a third for each part: none of the tables holds exercises or glossaries
    "lessons": "SELECT doc_id AS qid, 'Mở đầu' || chr(10) || '** Câu 1 ** ' || substr(text, 1, n) || chr(10) || '**Phương pháp giải:** xem lại' || chr(10) || '**Lời giải:** ' || substr(text, n + 1, n) || chr(10) || 'Bài 2 quan sát hình ' || source || chr(10) || 'Phương pháp giải: cộng lại' || chr(10) || 'Lời giải chi tiết: ' || substr(text, 2 * n + 1) || chr(10) || 'Đáp số: ' || n_chars || chr(10) || source || ' /' || lang || '/ (n): ' || lang AS q FROM (SELECT *, length(text) // 3 AS n FROM documents)",
}


def column(spark: SparkSession, d: str, name: str) -> DataFrame:
    rows = table(spark, d, {"addresses": "pages", "html": "pages", "lessons": "documents"}.get(name, name))
    if name == "lessons":
        n = F.expr("length(text) div 3").cast("int")
        part = lambda a, b: F.substring("text", a, b)
        q = F.concat(F.lit("Mở đầu\n** Câu 1 ** "), part(F.lit(1), n), F.lit("\n**Phương pháp giải:** xem lại\n**Lời giải:** "), part(n + 1, n), F.lit("\nBài 2 quan sát hình "), "source", F.lit("\nPhương pháp giải: cộng lại\nLời giải chi tiết: "), part(2 * n + 1, F.length("text")), F.lit("\nĐáp số: "), F.col("n_chars").cast("string"), F.lit("\n"), "source", F.lit(" /"), "lang", F.lit("/ (n): "), "lang")
        return rows.select(F.col("doc_id").alias("qid"), q.alias("q"))
    if name in ("addresses", "html"):
        return rows.select(F.col("page_id").alias("qid"), F.col("url" if name == "addresses" else "html").alias("q"))
    if name == "pages":
        return rows.select(F.col("page_id").alias("qid"), F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("q"))
    return rows.select((F.col("doc_id") if name == "documents" else F.col("conv_id") * 1000 + F.col("turn")).alias("qid"), F.col("text").alias("q"))


def texts_query(texts: list[str], over: str, sql: str, whole: str | None = None):
    """A query of f(rows: qid, q) over a whole column of COLUMNS, and a fixture over fixed texts, by
    the same SQL (or `whole`, where that isn't of use)."""

    def add(f):
        FIXTURES[f.__name__] = (lambda spark: f(frame(spark, texts)), sql)
        QUERIES[f.__name__] = lambda spark, d: f(column(spark, d, over))
        ORACLE_SQL[f.__name__] = whole or sql.replace(values(texts), f"({COLUMNS[over]}) AS v(qid, q)")
        return f

    return add


# Retrieval -----------------------------------------------------------------------------------
_Q = "q AS (SELECT vec_id AS qid, CAST(embedding AS DOUBLE[]) AS qv, label AS grade FROM embeddings WHERE vec_id % 50 = 0), e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings)"
_TOP = "SELECT qid, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT qid, vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM e JOIN q ON {on})) WHERE rank <= {k}"
_BAND = "label BETWEEN greatest({lo}, grade - 1) AND grade + 1"


@query(f"WITH {_Q} {_TOP.format(on=_BAND.format(lo=1), k=5)}")
def semantic_topk_band(spark, d):
    return retrieval.semantic(*vectors(spark, d), 5, low=1)


@query(f"WITH {_Q} {_TOP.format(on='label <= grade', k=3)}")
def semantic_topk_lte(spark, d):
    return retrieval.semantic(*vectors(spark, d), 3)


@query(f"WITH {_Q} {_TOP.format(on=_BAND.format(lo=4), k=3)}")
def exercise_topk_low4(spark, d):
    return retrieval.semantic(*vectors(spark, d), 3, low=4)


@query(f"WITH {_Q} {_TOP.format(on=_BAND.format(lo=6), k=3)}")
def exercise_topk_low6(spark, d):
    return retrieval.semantic(*vectors(spark, d), 3, low=6)


@query(f"WITH {_Q}, s AS ({_TOP.format(on=_BAND.format(lo=6), k=3)}), l AS ({_TOP.format(on='true', k=3)}) SELECT *, 0 AS tier FROM s UNION ALL SELECT *, 1 AS tier FROM l WHERE qid NOT IN (SELECT qid FROM s)")
def semantic_relax_on_empty(spark, d):
    q, points = vectors(spark, d)
    wide = lambda some: retrieval.semantic(some.withColumn("grade", F.lit(1 << 30)), points, 3)
    return retrieval.relaxed(q, retrieval.semantic(q, points, 3, low=6), wide)


@query(f"WITH {_Q}, t AS ({_TOP.format(on=_BAND.format(lo=1), k=3)}) SELECT qid, vec_id, score, rank, substr(text, 1, 200) AS preview, lang FROM t JOIN documents ON doc_id = vec_id")
def semantic_hydrate(spark, d):
    """The k hits first, their wide rows after."""
    hits = retrieval.semantic(*vectors(spark, d), 3, low=1)
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 200).alias("preview"), "lang")
    return docs.join(retrieval.few(hits), "vec_id").select("qid", "vec_id", "score", "rank", "preview", "lang")


@query(f"WITH {_Q}, t AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid, src ORDER BY score DESC, vec_id) AS INTEGER) AS r FROM (SELECT qid, vec_id, vec_id % 5 AS src, round(list_cosine_similarity(v, qv), 6) AS score FROM e JOIN q ON {_BAND.format(lo=1)})), m AS (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, src, r) AS INTEGER) AS rank FROM t WHERE r <= 3) SELECT qid, src, vec_id, score, rank FROM m WHERE rank <= 3")
def global_merge_top3(spark, d):
    """Five collections, three hits of each, the best three of all."""
    q, points = vectors(spark, d)
    wide = q.withColumn("label", F.explode(F.sequence(F.greatest(F.lit(1), F.col("grade") - 1), F.greatest(F.lit(1), F.col("grade") + 1)))).where("label <= grade + 1").withColumn("src", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(4).cast("long"))))
    scored = products.best(wide, points.withColumn("src", F.col("vec_id") % 5), 3, ("label", "src"), ("src",))
    best = retrieval.ranked(scored, ["qid", "src"], [F.desc("score"), F.col("vec_id")], 3).withColumnRenamed("rank", "r")
    return retrieval.ranked(best, ["qid"], [F.desc("score"), F.col("src"), F.col("r")], 3).select("qid", "src", "vec_id", "score", "rank")


@query(f"WITH {_Q}, t AS ({_TOP.format(on=_BAND.format(lo=1), k=5)}) SELECT qid, count(*) AS n, string_agg('- ' || rank || ' [' || vec_id || ']: ' || format('{{:.4f}}', score), chr(10) ORDER BY rank) AS context FROM t GROUP BY qid")
def context_format(spark, d):
    return retrieval.context(retrieval.semantic(*vectors(spark, d), 5, low=1), F.format_string("- %d [%d]: %s", "rank", "vec_id", X.four_digits(F.col("score"))))


@query(f"WITH {_Q}, a AS ({_TOP.format(on=_BAND.format(lo=1), k=5)}), b AS ({_TOP.format(on='label <= grade', k=5)}) SELECT qid, vec_id AS id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS rrf FROM (SELECT * FROM a UNION ALL SELECT * FROM b) GROUP BY qid, vec_id")
def rrf_fuse(spark, d):
    q, points = vectors(spark, d)
    both = retrieval.semantic(q, points, 5, low=1).unionByName(retrieval.semantic(q, points, 5))
    return retrieval.fuse(both.select("qid", F.col("vec_id").alias("id"), "rank"))


@query(f"WITH {_Q}, t AS ({_TOP.format(on='true', k=6)}), h AS (SELECT t.qid, t.rank, (a.label = b.label)::INT AS hit FROM t JOIN embeddings a ON a.vec_id = t.qid JOIN embeddings b ON b.vec_id = t.vec_id WHERE t.vec_id <> t.qid) SELECT count(DISTINCT qid) AS n, round(avg(m), 6) AS hit_at_5, round(avg(p), 6) AS precision, round(avg(rr), 6) AS mrr FROM (SELECT qid, max(hit) AS m, avg(hit) AS p, coalesce(max(CASE WHEN hit = 1 THEN 1.0::DOUBLE / rank END), 0) AS rr FROM h GROUP BY qid)")
def recall_precision_mrr(spark, d):
    """Relevant: the same label. The query itself is no hit."""
    q, points = vectors(spark, d)
    hits = retrieval.semantic(q.withColumn("grade", F.lit(1 << 30)), points, 6).where("vec_id <> qid")
    rel = hits.join(retrieval.few(q.select("qid", F.col("grade").alias("want"))), "qid").join(points.select("vec_id", "label"), "vec_id").withColumn("hit", (F.col("want") == F.col("label")).cast("int"))
    each = rel.groupBy("qid").agg(F.max("hit").alias("m"), F.avg("hit").alias("p"), F.coalesce(F.max(F.when(F.col("hit") == 1, 1.0 / F.col("rank"))), F.lit(0.0)).alias("rr"))
    return each.agg(F.count("*").alias("n"), F.round(F.avg("m"), 6).alias("hit_at_5"), F.round(F.avg("p"), 6).alias("precision"), F.round(F.avg("rr"), 6).alias("mrr"))


def looked_up(spark: SparkSession, d: str, name) -> DataFrame:
    names = table(spark, d, "benchmark").select(F.col("item_id").alias("name_id"), name.alias("name"))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.lower("text").alias("t"))
    hits = retrieval.containing(docs, names).select(F.col("name_id").alias("item_id"), F.col("id").alias("doc_id"), "n_chars", F.when(F.startswith("t", "name"), 0).otherwise(1).alias("tier"))
    best = retrieval.ranked(hits, ["item_id"], [F.col("tier"), F.col("n_chars"), F.col("doc_id")], 5)
    return best.select("item_id", "doc_id", F.when(F.col("tier") == 0, 1.0).otherwise(0.8).alias("score"), "rank")


@query("WITH q AS (SELECT item_id, lower(text) AS name FROM benchmark), h AS (SELECT item_id, doc_id, CASE WHEN starts_with(lower(text), name) THEN 0 ELSE 1 END AS tier, n_chars FROM q JOIN documents ON contains(lower(text), name)) SELECT item_id, doc_id, CASE WHEN tier = 0 THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY tier, n_chars, doc_id) AS INTEGER) AS rank FROM h) WHERE rank <= 5")
def exact_lookup(spark, d):
    """Names in texts whatever their case, exact starts first."""
    return looked_up(spark, d, F.lower("text"))


@query("SELECT g, p_partkey, p_size, rank FROM (SELECT g, p_partkey, p_size, CAST(row_number() OVER (PARTITION BY g ORDER BY abs(p_size - g), p_partkey) AS INTEGER) AS rank FROM part, (SELECT unnest(range(1, 51)) AS g)) WHERE rank <= 2")
def nearest_grade(spark, d):
    """The two parts of nearest size for each grade: for each size its two first, then those."""
    first = retrieval.ranked(table(spark, d, "part").select("p_partkey", "p_size"), ["p_size"], [F.col("p_partkey")], 2).drop("rank")
    grades = spark.range(1, 51).select(F.col("id").alias("g"))
    pairs = first.join(F.broadcast(grades), F.lit(True))
    return retrieval.ranked(pairs, ["g"], [F.abs(F.col("p_size") - F.col("g")), F.col("p_partkey")], 2).select("g", "p_partkey", "p_size", "rank")


@query("SELECT o_orderkey, o_custkey, c_name, coalesce(c_mktsegment, 'none') AS segment FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0")
def curriculum_left_join(spark, d):
    right = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return table(spark, d, "orders").select("o_orderkey", "o_custkey").join(right, "o_custkey", "left").select("o_orderkey", "o_custkey", "c_name", F.coalesce("c_mktsegment", F.lit("none")).alias("segment"))


@query("WITH t AS (SELECT source, d.doc_id, CASE WHEN quality = 1 AND toxic = 0 THEN 0 WHEN quality = 0 THEN 1 ELSE 2 END AS tier FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id) SELECT source, tier, count(*) AS n, min(doc_id) AS first_id FROM (SELECT *, min(tier) OVER (PARTITION BY source) AS m FROM t) WHERE tier = m GROUP BY source, tier")
def fallback_chain(spark, d):
    """Approved samples of a source, else poor ones, else any: one aggregate, no window."""
    labels = table(spark, d, "labels")
    tier = F.when((F.col("quality") == 1) & (F.col("toxic") == 0), 0).when(F.col("quality") == 0, 1).otherwise(2)
    by = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left").groupBy("source", tier.alias("tier")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"))
    return retrieval.first_tier(by, "source").select("source", "tier", "n", "first_id")


@query("WITH q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{4,}'))) AS w FROM benchmark), t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY 1, 2), f AS (SELECT w, count(*) AS df FROM t GROUP BY w), s AS (SELECT item_id, doc_id, round(sum((1 + ln(tf)) * ln((SELECT count(*) FROM documents) / (1.0::DOUBLE * df) + 1)), 6) AS score FROM q JOIN t USING (w) JOIN f USING (w) GROUP BY 1, 2) SELECT item_id, doc_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s) WHERE rank <= 10")
def lexical_topk(spark, d):
    """TF-IDF; texts are cut to the queries' words before anything is shuffled."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0)
    q = table(spark, d, "benchmark").select("item_id", F.explode(F.array_distinct(words("text"))).alias("w"))
    docs = table(spark, d, "documents")
    n = docs.count()
    terms = docs.select("doc_id", F.explode(words("text")).alias("w")).join(retrieval.few(q.select("w").distinct(), 200_000), "w", "left_semi").groupBy("doc_id", "w").agg(F.count("*").alias("tf"))
    df = terms.groupBy("w").agg(F.count("*").alias("df"))
    scored = terms.join(retrieval.few(df, 200_000), "w").join(retrieval.few(q, 200_000), "w").groupBy("item_id", "doc_id").agg(F.round(F.sum((1 + F.log("tf")) * F.log(F.lit(float(n)) / F.col("df") + 1)), 6).alias("score"))
    return retrieval.ranked(scored, ["item_id"], [F.desc("score"), F.col("doc_id")], 10)


# Text, classification ------------------------------------------------------------------------
_SAY = ["Xin chào!", "tuần này học những gì ạ", "bài 3 trang 45 lớp 5", "từ láy là gì", "phân biệt danh từ và động từ", "giúp em tả con mèo", "tả cây bàng giúp em", "đọc cho em bài Cây tre nhé", "soạn bài Nhớ rừng lớp 8", "tính diện tích hình thang", "quang hợp ở thực vật là gì", "cuộc khởi nghĩa Lam Sơn năm 1418", "khí hậu châu Á", "pháp luật và đạo đức", "tích phân", "tíchứ", "", "kể chuyện Tấm Cám", "School nghĩa là gì", "grammar unit 5: present simple?", "từ playground nghĩa là gì ?"]


@texts_query(_SAY, "conversations", f"SELECT qid, {R.sql_first_rule('lower(trim(q))', R.INTENT, 'lookup_reading')} AS intent, {R.sql_first_rule('lower(trim(q))', R.WRITING, None)} AS writing_type, coalesce(TRY_CAST(regexp_extract(q, '[0-9]+') AS INTEGER), -1) AS first_number FROM {values(_SAY)}")
def intent_rules(rows):
    q = F.lower(F.trim("q"))
    return rows.select("qid", R.first_rule(q, R.INTENT, "lookup_reading").alias("intent"), R.first_rule(q, R.WRITING, None).alias("writing_type"), F.expr("coalesce(try_cast(regexp_extract(q, '[0-9]+', 0) as int), -1)").alias("first_number"))


@texts_query(_SAY, "conversations", f"SELECT qid, CASE WHEN length(n) > 2 THEN n END AS lesson FROM (SELECT qid, trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(q)), {R.quoted(R.LESSON_LEAD)}, ''), {R.quoted(R.LESSON_TAIL)}, ''), 'lớp\\s+[0-9]+.*$', '')) AS n FROM {values(_SAY)})")
def lesson_name(rows):
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim("q")), R.LESSON_LEAD, ""), R.LESSON_TAIL, "")
    n = F.trim(F.regexp_replace(n, r"lớp\s+[0-9]+.*$", ""))
    return rows.select("qid", F.when(F.length(n) > 2, n).alias("lesson"))


_SCORES = ", ".join(f"{R.sql_score('lower(q)', p)} AS {s}" for s, p in R.SUBJECTS)
_NAMES = [s for s, _ in R.SUBJECTS]
_BEST = "greatest(" + ", ".join(_NAMES) + ")"


@texts_query(_SAY, "conversations", f"SELECT qid, CASE WHEN {_BEST} = 0 THEN NULL " + " ".join(f"WHEN {s} = {_BEST} THEN '{s}'" for s in _NAMES) + f" END AS subject, CASE WHEN {_BEST} = 0 THEN 0.0::DOUBLE ELSE round({_BEST} / (1.0::DOUBLE * ({_BEST} + list_sort([{', '.join(_NAMES)}], 'DESC')[2])), 3) END AS confidence FROM (SELECT qid, {_SCORES} FROM {values(_SAY)})")
def subject_detect(rows):
    """Pattern hits by subject; the first declared wins ties; confidence against the runner-up."""
    q = rows.select("qid", *(R.score(F.lower("q"), p).alias(s) for s, p in R.SUBJECTS))
    best, order = F.greatest(*_NAMES), F.sort_array(F.array(*_NAMES), asc=False)
    subject = F.when(best == 0, F.lit(None))
    for s in _NAMES:
        subject = subject.when(F.col(s) == best, F.lit(s))
    return q.select("qid", subject.alias("subject"), F.when(best == 0, 0.0).otherwise(F.round(best / (best + order[1]), 3)).alias("confidence"))


_FOLD = "trim(regexp_replace(lower(replace(replace(strip_accents({c}), 'đ', 'd'), 'Đ', 'D')), '[^a-z0-9]+', ' ', 'g'))"


@texts_query(_SAY, "documents", f"SELECT qid, {_FOLD.format(c='q')} AS folded, regexp_replace(regexp_replace(lower(regexp_replace(strip_accents(q), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9_]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM {values(_SAY)}")
def accent_fold(rows):
    return rows.select("qid", X.accent_fold(F.col("q")).alias("folded"), X.slug(F.col("q")).alias("slug"))


# The same replacements for an engine that writes groups as \1.
_SPOKEN = "q"
for _pattern, _said in X.SPEECH:
    _SPOKEN = f"regexp_replace({_SPOKEN}, {R.quoted(_pattern)}, {R.quoted(_said.replace('$', chr(92)))}, 'g')"
_SPOKEN = f"SELECT qid, trim({_SPOKEN}) AS speech FROM ({COLUMNS['documents']})"
_TEX = [r"$\frac{7}{10}$", r"x^2 + y^3 = z^{10}", r"a \times b \div c", r"\sqrt x \approx 3", r"2 \+ 3 \- 1 \neq 5 \ge 4"]


@texts_query(_TEX, "documents", "SELECT * FROM (VALUES (0, '7 phần 10'), (1, 'x bình phương + y lập phương = z mũ 10'), (2, 'a nhân b chia c'), (3, 'căn bậc hai của x xấp xỉ 3'), (4, '2 cộng 3 trừ 1 khác 5 lớn hơn hoặc bằng 4')) AS v(qid, speech)", _SPOKEN)
def latex_speech(rows):
    return rows.select("qid", X.latex_speech(F.col("q")).alias("speech"))


@query("SELECT page_id, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, regexp_extract(url, '://[^/]+/([a-z]{2})/', 1) AS lang, TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT) AS article, contains(url, '?') AS has_query, CASE WHEN regexp_matches(url, '[?&]page=') THEN 'listing' WHEN contains(url, '#') THEN 'anchor' WHEN regexp_matches(url, '[.]html') THEN 'article' ELSE 'other' END AS kind FROM pages")
def url_metadata(spark, d):
    u = F.col("url")
    kind = F.when(u.rlike("[?&]page="), "listing").when(F.contains(u, F.lit("#")), "anchor").when(u.rlike("[.]html"), "article").otherwise("other")
    return table(spark, d, "pages").select("page_id", F.lower(F.regexp_extract(u, "://([^/?#]+)", 1)).alias("host"), F.regexp_extract(u, "://[^/]+/([a-z]{2})/", 1).alias("lang"), F.expr("try_cast(regexp_extract(url, '/([0-9]+)', 1) as bigint)").alias("article"), F.contains(u, F.lit("?")).alias("has_query"), kind.alias("kind"))


@query("SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title, CAST(len(regexp_extract_all(html, '(?i)<a href=')) AS INTEGER) AS n_links FROM pages")
def page_title(spark, d):
    return table(spark, d, "pages").select("page_id", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"), F.regexp_count("html", F.lit("(?i)<a href=")).alias("n_links"))


@query("SELECT host, link, count(*) AS n FROM (SELECT lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link FROM pages) GROUP BY host, link")
def page_links(spark, d):
    return table(spark, d, "pages").select(F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("link")).groupBy("host", "link").agg(F.count("*").alias("n"))


@query(r"SELECT page_id, trim(regexp_replace(regexp_replace(coalesce(nullif(regexp_extract(b, '(?is)<article[^>]*>(.*?)(</article>|$)', 1), ''), b), '(?s)<[^>]*(>|$)', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM (SELECT page_id, regexp_replace(html, '(?is)<(?:script|style)[^>]*>.*?</(?:script|style)>|<!--.*?-->', ' ', 'g') AS b FROM pages)")
def main_text(spark, d):
    return table(spark, d, "pages").select("page_id", X.main_text(F.col("html")).alias("text"))


_BLOCK = "(?is)<(?:p|h1|h2|h3|li)[^>]*>(.*?)(?:</(?:p|h1|h2|h3|li)>|$)"


@query(f"WITH b AS (SELECT page_id, regexp_extract_all(regexp_replace(html, '(?is)<script.*?</script>', '', 'g'), '{_BLOCK}', 1) AS x FROM pages), u AS (SELECT page_id, unnest(x) AS t, generate_subscripts(x, 1) - 1 AS pos FROM b) SELECT page_id, CAST(row_number() OVER w - 1 AS INTEGER) AS dom_order, CAST(length(t) AS INTEGER) AS n, CAST(coalesce(sum(length(t) + 1) OVER (PARTITION BY page_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM u WHERE length(t) >= 15 WINDOW w AS (PARTITION BY page_id ORDER BY pos)")
def page_blocks(spark, d):
    found = table(spark, d, "pages").select("page_id", F.posexplode(F.regexp_extract_all(F.regexp_replace("html", "(?is)<script.*?</script>", ""), F.lit(_BLOCK), 1)).alias("pos", "t")).where(F.length("t") >= 15)
    return blocks.offsets(found, "page_id", "pos", "t").select("page_id", "dom_order", F.length("t").alias("n"), "char_start")


_WHOLE = [("short", [r"(?s)^.{0,60}\z"]), ("licence", ["licen[sc]e", "copyright"]), ("shout", [r"!![^\n]*!!"])]


@query(f"SELECT doc_id, {R.sql_first_rule('lower(text)', _WHOLE, 'unknown')} AS content_type, CASE WHEN lang = 'en' THEN 'reading' WHEN lang IN ('fr', 'de') THEN 'concepts' ELSE 'samples' END AS kb FROM documents")
def content_type_reclass(spark, d):
    """Rules over whole texts; short is a text of 60 characters at most."""
    kb = F.when(F.col("lang") == "en", "reading").when(F.col("lang").isin("fr", "de"), "concepts").otherwise("samples")
    return table(spark, d, "documents").select("doc_id", R.first_rule(F.lower("text"), _WHOLE, "unknown").alias("content_type"), kb.alias("kb"))


_TITLES = ["Soạn bài Nhớ rừng", "van-ban-co-to-a12", "Phân tích nhân vật", "Tóm tắt truyện", "Dàn ý tả mẹ", "Bài đọc tuần 2", "ôn tập giữa kì", "khác", "Luyện từ và câu tuần 3", "Chính tả nghe viết", "Ke-chuyen tuan 4", "Đề thi học kì 1", "Trang 45 sgk lớp 5", "Lớp 2, sách giáo khoa mới", "trang bìa"]


@texts_query(_TITLES, "pages", f"SELECT qid, CASE WHEN contains(lower(q), 'van-ban-') OR starts_with(lower(q), 'văn bản ') THEN 'van_ban' ELSE {R.sql_first_rule('lower(q)', R.CONTENT, 'unknown')} END AS kind FROM {values(_TITLES)}")
def title_reclass(rows):
    q = F.lower("q")
    kind = F.when(F.contains(q, F.lit("van-ban-")) | F.startswith(q, F.lit("văn bản ")), "van_ban").otherwise(R.first_rule(q, R.CONTENT, "unknown"))
    return rows.select("qid", kind.alias("kind"))


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars, round(avg(CAST(len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) AS DOUBLE)), 6) AS mean_words FROM documents GROUP BY lang, source")
def route_stats(spark, d):
    return table(spark, d, "documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.round(F.avg(F.regexp_count("text", F.lit(r"[^ \t\n\r]+"))), 6).alias("mean_words"))


# Blocks --------------------------------------------------------------------------------------
_C = "PARTITION BY conv_id ORDER BY turn"


@query(f"SELECT conv_id, turn, CAST(row_number() OVER ({_C}) - 1 AS INTEGER) AS dom_order, CAST(coalesce(sum(length(text) + 1) OVER ({_C} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS char_start FROM conversations")
def block_offsets(spark, d):
    return blocks.offsets(table(spark, d, "conversations"), "conv_id", "turn", "text").select("conv_id", "turn", "dom_order", "char_start")


@query(f"SELECT conv_id, turn, q AS question_turn FROM (SELECT *, last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER ({_C} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS q FROM conversations) WHERE role = 'assistant'")
def qa_link(spark, d):
    return blocks.carry(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user", "turn", "question_turn").where("role = 'assistant'").select("conv_id", "turn", "question_turn")


@query(f"WITH m AS (SELECT *, sum((role = 'user')::INT) OVER ({_C}) AS g FROM conversations), p AS (SELECT conv_id, g, min(CASE WHEN role = 'user' THEN text END) AS question, string_agg(CASE WHEN role = 'assistant' THEN text END, chr(10) ORDER BY turn) AS answer FROM m WHERE g > 0 GROUP BY conv_id, g) SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY g) AS pair, question, answer FROM p WHERE answer IS NOT NULL")
def qa_pairs(spark, d):
    return blocks.pairs(table(spark, d, "conversations"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", "text")


@query(f"SELECT conv_id, turn, role FROM (SELECT *, max((role = 'assistant')::INT) OVER ({_C}) AS s FROM conversations) WHERE s = 0")
def take_while(spark, d):
    return blocks.take_while(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "assistant")


@query("SELECT role, count(*) AS n, count(DISTINCT conv_id) AS conversations FROM conversations GROUP BY role")
def count_by_label(spark, d):
    return table(spark, d, "conversations").groupBy("role").agg(F.count("*").alias("n"), F.countDistinct("conv_id").alias("conversations"))


# Ingest --------------------------------------------------------------------------------------
_KEY = "regexp_replace(url, '[?#].*$', '')"


@query(f"SELECT u AS url, count(*) AS version, sha256(arg_min(html, page_id)) AS first_hash, max(page_id) AS last_page FROM (SELECT {_KEY} AS u, * FROM pages) GROUP BY u")
def raw_upsert_version(spark, d):
    """The newest hash and id, the oldest html, a version for each time."""
    rows = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id", F.sha2("html", 256).alias("first_hash"), F.col("page_id").alias("last_page"))
    return ingest.upsert(rows, "url", F.col("page_id"), ["first_hash"], ["last_page"])


@query("SELECT source, n_chars, min(doc_id) AS doc_id FROM documents GROUP BY source, n_chars")
def kb_unique_insert(spark, d):
    return ingest.first_of(table(spark, d, "documents"), ["source", "n_chars"], "doc_id")


@query(f"SELECT page_id FROM pages WHERE page_id % 2 = 1 AND {_KEY} NOT IN (SELECT {_KEY} FROM pages WHERE page_id % 2 = 0)")
def resume_antijoin(spark, d):
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("key"))
    return ingest.unseen(rows.where("page_id % 2 = 1"), rows.where("page_id % 2 = 0"), "key").select("page_id")


@query("SELECT min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY text")
def exact_dedupe(spark, d):
    """By hash, so that no text is shuffled."""
    return table(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("h")).groupBy("h").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")).drop("h")


@query("SELECT lang, count(*) AS n, count(DISTINCT text) AS kept, round(1 - count(DISTINCT text) / (1.0::DOUBLE * count(*)), 6) AS dup_rate FROM documents GROUP BY lang")
def dup_rate(spark, d):
    by = table(spark, d, "documents").select("lang", F.sha2("text", 256).alias("h")).groupBy("lang", "h").agg(F.count("*").alias("c")).groupBy("lang").agg(F.sum("c").alias("n"), F.count("*").alias("kept"))
    return by.withColumn("dup_rate", F.round(1 - F.col("kept") / F.col("n"), 6))


@query("SELECT d.doc_id, quality, n_chars FROM documents d JOIN labels l USING (doc_id) WHERE quality = 1 AND toxic = 0 AND n_chars >= 100")
def quality_gate(spark, d):
    good = table(spark, d, "labels").where("quality = 1 and toxic = 0")
    return table(spark, d, "documents").where("n_chars >= 100").select("doc_id", "n_chars").join(good, "doc_id").select("doc_id", "quality", "n_chars")


@query("SELECT page_id FROM pages WHERE NOT regexp_matches(url, 'utm_|[?]page=') AND regexp_matches(url, '/(en|fr|de|es)/')")
def url_deny_allow(spark, d):
    return table(spark, d, "pages").where(~F.col("url").rlike("utm_|[?]page=") & F.col("url").rlike("/(en|fr|de|es)/")).select("page_id")


@query("SELECT lang, doc_id, rank FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '|7'), doc_id) AS INTEGER) AS rank FROM documents) WHERE rank <= 30")
def sample_stratified(spark, d):
    """Thirty of each language in the order of a seeded hash."""
    return retrieval.ranked(table(spark, d, "documents").select("lang", "doc_id"), ["lang"], [F.sha2(F.concat_ws("|", "doc_id", F.lit(7)).cast("binary"), 256), F.col("doc_id")], 30)


# Monitoring, payloads ------------------------------------------------------------------------
@query("SELECT event_type, count(*) AS n, quantile_cont(value, 0.5) AS p50, quantile_cont(value, 0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type")
def latency_percentiles(spark, d):
    """Exact; by value and count first, so equal values travel once."""
    by = table(spark, d, "events").groupBy("event_type", "value").agg(F.count("*").alias("c"))
    return by.groupBy("event_type").agg(F.sum("c").alias("n"), *(F.expr(f"percentile(value, {p}, c)").alias(f"p{round(100 * p)}") for p in (0.5, 0.95, 0.99)))


@query("SELECT event_type, CAST(json_extract(props, '$.k') AS INTEGER) AS k, count(*) AS n FROM events GROUP BY 1, 2")
def json_payload(spark, d):
    return table(spark, d, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k")).groupBy("event_type", "k").agg(F.count("*").alias("n"))


# Graph: conversations are documents, turns are nodes, the next turn is an edge -----------------
_NODES = "n AS (SELECT conv_id * 1000 + turn AS node_id, role, conv_id, length(text) AS size FROM conversations), g AS (SELECT x.node_id AS src, 'SOLVES' AS rel, y.node_id AS dst FROM n x JOIN n y ON y.node_id = x.node_id - 1 AND y.conv_id = x.conv_id WHERE x.role = 'assistant' AND y.role = 'user')"


def nodes_edges(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    nodes = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), "role", "conv_id", F.length("text").alias("size"))
    before = nodes.where("role = 'user'").select(F.col("node_id").alias("dst"), "conv_id")
    edges = nodes.where("role = 'assistant'").select(F.col("node_id").alias("src"), (F.col("node_id") - 1).alias("dst"), "conv_id").join(before, ["dst", "conv_id"])
    return nodes, edges.select("src", F.lit("SOLVES").alias("rel"), "dst")


@query(f"WITH {_NODES} SELECT role, count(*) AS n FROM n WHERE node_id NOT IN (SELECT dst FROM g) GROUP BY role")
def orphans(spark, d):
    return graph.orphans(*nodes_edges(spark, d)).groupBy("role").agg(F.count("*").alias("n"))


@query(f"WITH {_NODES} SELECT node_id, src, dst FROM n JOIN g ON node_id = src UNION ALL SELECT node_id, src, dst FROM n JOIN g ON node_id = dst")
def graph_solves_or_join(spark, d):
    nodes, edges = nodes_edges(spark, d)
    return graph.either_end(nodes.select("node_id"), edges).select("node_id", "src", "dst")


@query(f"WITH {_NODES} SELECT count(*) AS nodes, count(*) FILTER (role = 'user') AS questions, count(*) FILTER (role = 'assistant') AS solutions, count(*) FILTER (size > 200) AS large, (SELECT count(*) FROM g) AS edges FROM n")
def audit_counts(spark, d):
    """All conditional counts in one pass over each table."""
    nodes, edges = nodes_edges(spark, d)
    role = F.col("role")
    one = nodes.agg(F.count("*").alias("nodes"), F.count_if(role == "user").alias("questions"), F.count_if(role == "assistant").alias("solutions"), F.count_if(F.col("size") > 200).alias("large"))
    return one.join(edges.agg(F.count("*").alias("edges")), F.lit(True))


@query("SELECT c_custkey AS node_id, c_name AS title, CASE WHEN c_custkey % 2 = 1 OR c_custkey % 3 = 0 THEN 'new' ELSE 'old' END AS source FROM customer")
def node_merge(spark, d):
    rows = table(spark, d, "customer")
    old = rows.where("c_custkey % 2 = 0").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("title"), F.lit("old").alias("source"))
    new = rows.where("c_custkey % 2 = 1 or c_custkey % 3 = 0").select(F.col("c_custkey").alias("node_id"), F.col("c_name").alias("title"), F.lit("new").alias("source"))
    return graph.merge_nodes(old, new, "node_id", ["source"])


@query(f"WITH {_NODES}, s AS (SELECT conv_id, min(role) AS series FROM n GROUP BY conv_id) SELECT g.src, g.dst, s.series FROM g JOIN n ON n.node_id = g.src JOIN s USING (conv_id)")
def series_propagate(spark, d):
    """A document's series along its nodes to their edges."""
    nodes, edges = nodes_edges(spark, d)
    series = nodes.groupBy("conv_id").agg(F.min("role").alias("series"))
    return edges.join(nodes.select(F.col("node_id").alias("src"), "conv_id"), "src").join(series, "conv_id").select("src", "dst", "series")


@query("SELECT n_regionkey AS region, n_nationkey AS nation, n_name AS name FROM (SELECT *, min(CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END) OVER (PARTITION BY n_regionkey) AS m FROM nation) WHERE CASE WHEN n_nationkey % 5 = 0 THEN 0 ELSE 1 END = m")
def disambiguate(spark, d):
    rows = table(spark, d, "nation").withColumn("tier", F.when(F.col("n_nationkey") % 5 == 0, 0).otherwise(1))
    return retrieval.first_tier(rows, "n_regionkey").select(F.col("n_regionkey").alias("region"), F.col("n_nationkey").alias("nation"), F.col("n_name").alias("name"))


@query("SELECT page_id, lower(strip_accents(title)) AS folded FROM (SELECT page_id, trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)) AS title FROM pages) WHERE lower(strip_accents(title)) <> lower(title)")
def lookup_diff(spark, d):
    """Lookup fields that a normalised form would change."""
    title = F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1))
    rows = table(spark, d, "pages").select("page_id", title.alias("title"))
    return rows.select("page_id", "title", F.lower(F.regexp_replace(F.translate("title", X.FOLD_FROM[:-2], X.FOLD_TO[:-2]), r"\p{M}", "")).alias("folded")).where(~F.col("folded").eqNullSafe(F.lower("title"))).select("page_id", "folded")
