"""Queries over a knowledge base: lookups by name, tiers, filters that may be absent, lessons of a
week, outlines, subjects and routes, each with its SQL. Documents are readings: the first words are
the title, n_chars gives grade and series; benchmark texts and vectors are what is asked."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.operators import graph, lookup, postings, retrieval, route
from quern.operators.crawl import SERIES
from quern.plans.catalogue import _BAND, _NODES, _Q, _SAY, _TOP, ORACLE_SQL, QUERIES, nodes_edges, query, texts_query, values, vectors
from quern.plans.curation import _EVAL, asked_all, collection_of, evaluated
from quern.sources.shared import stored
from quern.sources.tables import table

_SERIES = "['KNTT', 'CTST', 'CD'][CAST({c} % 3 AS INTEGER) + 1]"
_KB = rf"kb AS (SELECT doc_id AS id, regexp_extract(text, '^[^\n.!?]{{1,60}}') AS title, CAST(n_chars % 9 + 1 AS INTEGER) AS grade, {_SERIES.format(c='n_chars')} AS series, lang, text FROM documents)"
_ASKED = r"a AS (SELECT item_id AS qid, CASE WHEN item_id % 2 = 0 THEN regexp_extract(t, '^[^\s.,]+') ELSE regexp_extract(t, '^[^\s.,]+') || '%' || regexp_extract(t, '^[^\s.,]+\s([^\s.,]{1,2})', 1) END AS name, CASE WHEN item_id % 3 > 0 THEN CAST(item_id % 9 + 1 AS INTEGER) END AS g, CASE WHEN item_id % 4 = 1 THEN 'KNTT' END AS s FROM (SELECT item_id, lower(text) AS t FROM benchmark))"


def series(c) -> F.Column:
    return F.element_at(F.array(*map(F.lit, SERIES)), (F.col(c) % 3 + 1).cast("int"))


def readings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.regexp_extract("text", r"^[^\n.!?]{1,60}", 0).alias("title"), (F.col("n_chars") % 9 + 1).cast("int").alias("grade"), series("n_chars").alias("series"), "lang", "text")


def names(spark: SparkSession, d: str) -> DataFrame:
    """Names with a live wildcard in every second; some with a grade, some with a series."""
    t = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("t"))
    first, second = F.regexp_extract("t", r"^[^\s.,]+", 0), F.regexp_extract("t", r"^[^\s.,]+\s([^\s.,]{1,2})", 1)
    name = F.when(F.col("item_id") % 2 == 0, first).otherwise(F.concat(first, F.lit("%"), second))
    return t.select(F.col("item_id").alias("qid"), name.alias("name"), F.when(F.col("item_id") % 3 > 0, (F.col("item_id") % 9 + 1).cast("int")).alias("g"), F.when(F.col("item_id") % 4 == 1, "KNTT").alias("s"))


# Names -----------------------------------------------------------------------------------------
_HITS = "h AS (SELECT a.*, kb.* FROM kb JOIN a ON title ILIKE '%' || name || '%')"


@query(f"WITH {_KB}, {_ASKED}, {_HITS}, f AS (SELECT * FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS m FROM (SELECT *, CASE WHEN (g IS NULL OR g = grade) AND (s IS NULL OR s = series) THEN 0 ELSE 1 END AS tier FROM h)) WHERE tier = m) SELECT qid, id, CASE WHEN lower(title) = lower(name) THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN title ILIKE name THEN 0 ELSE 1 END, grade, id) AS INTEGER) AS rank FROM f) WHERE rank <= 5")
def reading_exact(spark, d):
    """By name with live wildcards, grade and series if asked, without them if that finds none."""
    return lookup.exact(readings(spark, d).drop("text"), names(spark, d))


@query(f"WITH {_KB}, {_ASKED}, {_HITS} SELECT qid, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY grade, id) AS INTEGER) AS rank FROM h WHERE g IS NULL OR grade <= g) WHERE rank <= 3")
def concepts_by_name(spark, d):
    """Concepts of no higher grade than asked, the lowest first."""
    return lookup.upto_grade(readings(spark, d).drop("text"), names(spark, d))


@query(f"WITH {_KB}, {_ASKED}, {_HITS} SELECT qid, id FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS m FROM (SELECT *, CASE WHEN count(*) OVER (PARTITION BY qid) = 1 OR grade = g THEN 0 ELSE 1 END AS tier FROM h)) WHERE tier = m")
def disambiguate_names(spark, d):
    """What a name means: the only one, those of the asker's grade, or all."""
    return lookup.of_own_grade(readings(spark, d).drop("text"), names(spark, d))


@query(f"WITH {_KB}, {_ASKED} SELECT qid, count(*) AS n FROM a JOIN kb ON (g IS NULL OR g = grade) AND (s IS NULL OR s = series) GROUP BY qid")
def optional_filters(spark, d):
    """Rows that each question's filters leave; a filter that isn't asked for lets all pass."""
    cells = readings(spark, d).groupBy("grade", "series").agg(F.count("*").alias("n"))
    return retrieval.theta(cells, names(spark, d), lookup.fits("g", "grade") & lookup.fits("s", "series")).groupBy("qid").agg(F.sum("n").alias("n"))


_WORK = "w AS (SELECT *, regexp_extract(title, '^[^ ]+ [^ ]+ [^ ]+') AS work_name FROM kb)"
_ON = "(a.s IS NULL OR a.s = w.series) AND (contains(lower(name), lower(work_name)) OR contains(lower(work_name), lower(name)) OR contains(lower(title), lower(name)) OR contains(lower(name), lower(title)))"
_CONTAINED = "SELECT qid, id, rank FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN contains(lower(name), lower(work_name)) THEN 0 ELSE 1 END, length(work_name) DESC, id) AS INTEGER) AS rank FROM w JOIN {a} a ON {on} WHERE {of}) WHERE rank <= 2"
_WANT = f"a AS (SELECT vec_id AS qid, v AS qv, label AS g, label AS grade, lower(substr(title, 1, 14)) AS name, CASE WHEN vec_id % 4 = 1 THEN 'KNTT' END AS s FROM e LEFT JOIN kb ON id = vec_id WHERE vec_id % 50 = 0)"


def works(spark: SparkSession, d: str) -> DataFrame:
    return readings(spark, d).select("id", "title", "grade", "series", F.regexp_extract("title", "^[^ ]+ [^ ]+ [^ ]+", 0).alias("work_name"))


def wanted(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Every search, with the start of its document's title as the name asked for; and the points."""
    q, points = vectors(spark, d)
    titles = readings(spark, d).select(F.col("id").alias("qid"), F.lower(F.substring("title", 1, 14)).alias("name"))
    return retrieval.few(q).join(titles, "qid", "left").select("qid", "qvec", "grade", F.col("grade").alias("g"), "name", F.when(F.col("qid") % 4 == 1, "KNTT").alias("s")), points


@query(f"WITH {_Q}, {_KB}, {_WORK}, {_WANT} {_CONTAINED.format(a='a', on=_ON, of='true')}")
def literature_lookup(spark, d):
    """Works whose name or title holds the question or stands in it; two each."""
    return lookup.contained(works(spark, d), wanted(spark, d)[0])


_EXACT = "SELECT qid, id, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY CASE WHEN title ILIKE name THEN 0 ELSE 1 END, grade, id) AS INTEGER) AS rank FROM (SELECT *, min(tier) OVER (PARTITION BY qid) AS m FROM (SELECT a.qid, a.name, w.id, w.title, w.grade, CASE WHEN (g IS NULL OR g = w.grade) AND (s IS NULL OR s = series) THEN 0 ELSE 1 END AS tier FROM w JOIN {a} a ON title ILIKE '%' || name || '%')) WHERE tier = m) WHERE rank <= 5"


@query(
    f"WITH {_Q}, {_KB}, {_WORK}, {_WANT}, t0 AS ({_CONTAINED.format(a='a', on=_ON, of='id % 3 = 0')}), a1 AS (SELECT * FROM a WHERE qid NOT IN (SELECT qid FROM t0)), t1 AS ({_CONTAINED.format(a='a1', on=_ON, of='id % 3 = 1')}), a2 AS (SELECT * FROM a1 WHERE qid NOT IN (SELECT qid FROM t1)), t2 AS ({_EXACT.format(a='a2')}), a3 AS (SELECT * FROM a2 WHERE qid NOT IN (SELECT qid FROM t2)), "
    f"t3 AS (SELECT qid, vec_id AS id, rank FROM (SELECT qid, vec_id, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT qid, vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM e JOIN a3 ON {_BAND.format(lo=1)})) WHERE rank <= 3) "
    "SELECT *, 0 AS tier FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3"
)
def literature_chain(spark, d):
    """Whole texts, else summaries, else readings by name, else the nearest vectors."""
    asks, points = wanted(spark, d)
    own = works(spark, d)
    tiers = [lambda a: lookup.contained(own.where("id % 3 = 0"), a), lambda a: lookup.contained(own.where("id % 3 = 1"), a), lambda a: lookup.exact(own, a.drop("grade", "qvec")), lambda a: retrieval.semantic(a.select("qid", "qvec", "grade"), points, 3, low=1).withColumnRenamed("vec_id", "id")]
    return lookup.chain(asks, tiers)


_OUT = "o AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS kind, p_size % 9 + 1 AS grade FROM part WHERE p_brand < 'Brand#3'), m AS (SELECT p_partkey AS id, p_brand || ' ' || p_type AS kind, p_size % 9 + 1 AS grade FROM part WHERE p_brand >= 'Brand#3'), a AS (SELECT p_partkey AS qid, CASE WHEN p_partkey % 200 > 0 THEN p_brand || ' ' || p_type END AS kind, (p_size + 4) % 9 + 1 AS g FROM part WHERE p_partkey % 50 = 0)"
_NEXT = "SELECT qid, id, rank FROM (SELECT qid, id, CAST(row_number() OVER (PARTITION BY qid ORDER BY abs(grade - g), id) AS INTEGER) AS rank FROM {rows} r JOIN {a} a ON {on}) WHERE rank <= {k}"


@query(
    f"WITH {_OUT}, t0 AS ({_NEXT.format(rows='o', a='a', on='r.kind = a.kind AND grade = g', k=1)}), a1 AS (SELECT * FROM a WHERE qid NOT IN (SELECT qid FROM t0)), t1 AS ({_NEXT.format(rows='o', a='a1', on='r.kind = a.kind', k=1)}), a2 AS (SELECT * FROM a1 WHERE qid NOT IN (SELECT qid FROM t1)), t2 AS ({_NEXT.format(rows='m', a='a2', on='r.kind = a.kind', k=2)}), a3 AS (SELECT * FROM a2 WHERE qid NOT IN (SELECT qid FROM t2)), t3 AS ({_NEXT.format(rows='m', a='a3', on='true', k=2)}) "
    "SELECT *, 0 AS tier FROM t0 UNION ALL SELECT *, 1 FROM t1 UNION ALL SELECT *, 2 FROM t2 UNION ALL SELECT *, 3 FROM t3"
)
def outline_chain(spark, d):
    """The outline of a kind and grade, else of the nearest grade, else samples of the kind, else any.
    Brands that sort before #3 have outlines, the others samples; each fourth question names no kind."""
    kinds = lambda df: df.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", "p_brand", "p_type").alias("kind"), (F.col("p_size") % 9 + 1).alias("grade"))
    parts = table(spark, d, "part")
    outlines, samples = kinds(parts.where("p_brand < 'Brand#3'")), kinds(parts.where("p_brand >= 'Brand#3'"))
    asks = kinds(parts.where("p_partkey % 50 = 0").withColumn("p_size", F.col("p_size") + 4)).withColumnsRenamed({"id": "qid", "grade": "g"}).withColumn("kind", F.when(F.col("qid") % 200 > 0, F.col("kind")))
    same = lambda a: lookup.nearest(outlines.withColumn("_g", F.col("grade")), a, 1).join(asks.select("qid", "g"), "qid").join(outlines.select("id", "grade"), "id").where("grade = g")
    return lookup.chain(asks, [same, lambda a: lookup.nearest(outlines, a, 1), lambda a: lookup.nearest(samples, a, 2), lambda a: lookup.nearest_any(samples, a, 2)])


@query(f"WITH p AS (SELECT n_nationkey AS qid, n_nationkey % 9 + 1 AS grade, {_SERIES.format(c='n_nationkey')} AS series, n_nationkey + 1 AS week FROM nation), s AS (SELECT o_orderkey AS id, o_orderkey % 9 + 1 AS grade, {_SERIES.format(c='o_orderkey')} AS series, o_orderkey % 35 + 1 AS week, o_orderpriority AS topic, o_custkey FROM orders) SELECT qid, id, 'Tuần ' || s.week || ': ' || topic AS title, 'Chủ điểm: ' || topic || chr(10) || 'Bài đọc: ' || coalesce(c_name, '') AS content FROM p JOIN s USING (grade, series, week) LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0")
def curriculum_week(spark, d):
    """Lessons of a week for a grade and series, with their readings as far as there are any."""
    profiles = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), (F.col("n_nationkey") % 9 + 1).cast("long").alias("grade"), series("n_nationkey").alias("series"), (F.col("n_nationkey") + 1).cast("long").alias("week"))
    plan = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9 + 1).alias("grade"), series("o_orderkey").alias("series"), (F.col("o_orderkey") % 35 + 1).alias("week"), F.col("o_orderpriority").alias("topic"), F.col("o_custkey").alias("c_custkey"))
    rows = plan.join(retrieval.few(profiles), ["grade", "series", "week"]).join(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name"), "c_custkey", "left")
    return rows.select("qid", "id", F.format_string("Tuần %d: %s", "week", "topic").alias("title"), F.concat(F.lit("Chủ điểm: "), "topic", F.lit("\nBài đọc: "), F.coalesce("c_name", F.lit(""))).alias("content"))


@query(f"WITH p AS (SELECT n_nationkey AS qid, n_nationkey % 9 + 1 AS grade, {_SERIES.format(c='n_nationkey')} AS series, n_nationkey + 1 AS page, CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 4 + 1 END AS number FROM nation) SELECT qid, l_orderkey AS id, l_linenumber AS number FROM lineitem JOIN p ON l_partkey % 9 + 1 = grade AND {_SERIES.format(c='l_suppkey')} = series AND l_orderkey % 50 + 1 = page AND (number IS NULL OR number = l_linenumber)")
def exercise_by_page(spark, d):
    """Exercises of a grade, series and page, and of a number if one is asked for."""
    asked = table(spark, d, "nation").select(F.col("n_nationkey").alias("qid"), (F.col("n_nationkey") % 9 + 1).cast("long").alias("grade"), series("n_nationkey").alias("series"), (F.col("n_nationkey") + 1).cast("long").alias("page"), F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey") % 4 + 1).alias("asked"))
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("number"), (F.col("l_partkey") % 9 + 1).alias("grade"), series("l_suppkey").alias("series"), (F.col("l_orderkey") % 50 + 1).alias("page"))
    return rows.join(retrieval.few(asked), ["grade", "series", "page"]).where(lookup.fits("asked", "number")).select("qid", "id", "number")


# Search ------------------------------------------------------------------------------------------
@query(f"WITH {_Q} {_TOP.format(on=_BAND.format(lo=1) + ' AND vec_id % 3 = qid % 3', k=3)}")
def semantic_series(spark, d):
    """The nearest of the grade band and of the same series; the same for exercises of one kind."""
    q, points = vectors(spark, d)
    return retrieval.semantic(q.withColumn("series", F.col("qid") % 3), points.withColumn("series", F.col("vec_id") % 3), 3, low=1, also=("series",))


@query("WITH p AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM benchmark), t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{3,}')) AS w FROM documents) GROUP BY 1, 2), s AS (SELECT qid, doc_id, count(*) AS n, round(sum(1 + ln(tf)), 6) AS score FROM p JOIN t USING (w) GROUP BY 1, 2), m AS (SELECT qid, count(*) AS n FROM p GROUP BY 1) SELECT qid, doc_id, score, rank FROM (SELECT s.*, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s JOIN m USING (qid, n)) WHERE rank <= 10")
def lexical_all(spark, d):
    """Texts that hold all of a question's words, those with more of them first, by a stored index
    of words."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{3,}"), 0)
    index = postings.built(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), words)
    asked = table(spark, d, "benchmark").select(F.col("item_id").alias("qid"), F.explode(words("text")).alias("w"))
    return postings.all_words(asked, index, 10).withColumnRenamed("id", "doc_id")


@query(f"WITH {_NODES}, q AS (SELECT item_id, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{5,}}'))) AS w FROM benchmark), t AS (SELECT conv_id * 1000 + turn AS node_id, role, unnest(list_distinct(regexp_extract_all(lower(text), '[a-z]{{5,}}'))) AS w FROM conversations), h AS (SELECT item_id, node_id, role, count(*) AS n FROM q JOIN t USING (w) GROUP BY ALL), p AS (SELECT DISTINCT item_id, src, dst FROM h JOIN g ON node_id = src OR node_id = dst) SELECT item_id, dst AS node_id, 0.95::DOUBLE AS score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY dst, src) AS INTEGER) AS rank FROM p) WHERE rank <= 5 UNION ALL SELECT item_id, node_id, 1.0::DOUBLE, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY n DESC, node_id) AS INTEGER) AS rank FROM h WHERE role = 'system') WHERE rank <= 2")
def graph_lesson_search(spark, d):
    """Five questions with their solutions, then two passages, by common words; fixed scores."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), 0)))
    q = table(spark, d, "benchmark").select("item_id", words("text").alias("w"))
    nodes = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), "role", words("text").alias("w"))
    hits = nodes.join(retrieval.few(q, 200_000), "w").groupBy("item_id", "node_id", "role").agg(F.count("*").alias("n"))
    pairs = graph.either_end(hits.select("item_id", "node_id"), nodes_edges(spark, d)[1]).select("item_id", "src", "dst").distinct()
    qa = retrieval.ranked(pairs, ["item_id"], [F.col("dst"), F.col("src")], 5).select("item_id", F.col("dst").alias("node_id"), F.lit(0.95).alias("score"), "rank")
    passages = retrieval.ranked(hits.where("role = 'system'"), ["item_id"], [F.desc("n"), F.col("node_id")], 2)
    return qa.unionByName(passages.select("item_id", "node_id", F.lit(1.0).alias("score"), "rank"))


_ANSWER = "CASE lang WHEN 'en' THEN 'Đề bài: ' || title || chr(10) || 'Lời giải: ' || substr(text, 1, 200) WHEN 'fr' THEN 'Đề bài/Câu hỏi: ' || title || chr(10) || 'Lời giải/Đáp án: ' || substr(text, 1, 200) WHEN 'de' THEN 'Vấn đề/Câu hỏi: ' || title || chr(10) || 'Kiến thức/Lời giải: ' || substr(text, 1, 200) ELSE 'Khái niệm: ' || title || chr(10) || 'Định nghĩa: ' || substr(text, 1, 200) || chr(10) END"


@query(f"WITH {_KB} SELECT id, CASE lang WHEN 'en' THEN 'Toán ' ELSE 'KHTN ' END || grade || ' (' || series || ')' AS title, md5({_ANSWER}) AS hash FROM kb")
def answer_projection(spark, d):
    """What is shown of a hit, by the base that it comes from."""
    part = lambda a, b, end="": F.concat(F.lit(a), "title", F.lit("\n" + b), F.substring("text", 1, 200), F.lit(end))
    lang = F.col("lang")
    shown = F.when(lang == "en", part("Đề bài: ", "Lời giải: ")).when(lang == "fr", part("Đề bài/Câu hỏi: ", "Lời giải/Đáp án: ")).when(lang == "de", part("Vấn đề/Câu hỏi: ", "Kiến thức/Lời giải: ")).otherwise(part("Khái niệm: ", "Định nghĩa: ", "\n"))
    title = F.format_string("%s %d (%s)", F.when(lang == "en", "Toán").otherwise("KHTN"), "grade", "series")
    return readings(spark, d).select("id", title.alias("title"), F.md5(shown).alias("hash"))


@query(f"WITH {_KB} SELECT grade, CASE WHEN grade <= 5 THEN 'tieng_viet' ELSE 'ngu_van' END AS subject, count(*) AS n FROM kb GROUP BY 1")
def subject_backfill(spark, d):
    """The subject that readings get by their grade."""
    return readings(spark, d).groupBy("grade").agg(F.count("*").alias("n")).select("grade", F.when(F.col("grade") <= 5, "tieng_viet").otherwise("ngu_van").alias("subject"), "n")


@query(f"WITH i AS ({ORACLE_SQL['route_questions']}), l AS ({ORACLE_SQL['literature_chain']}), r AS ({ORACLE_SQL['retrieve_routed']}) SELECT qid, subject, 'literature' AS base, l.id, l.rank, tier FROM i JOIN l USING (qid) WHERE route = 'reading' UNION ALL SELECT qid, subject, r.source, r.vec_id, r.rank, NULL FROM i JOIN r USING (qid) WHERE route <> 'reading'")
def orchestrate(spark, d):
    """Every search by its route: readings through the tiers of literature, all else through the
    collections."""
    # stored, or filters by route would spell all rules out again
    asked = stored(asked_all(spark, d), "asked")
    about = retrieval.few(asked.select("qid", "subject", "route"))
    chain = QUERIES["literature_chain"](spark, d).join(about.where("route = 'reading'"), "qid")
    points = table(spark, d, "embeddings").select("vec_id", "embedding", "label", collection_of("vec_id").alias("source"))
    other = route.retrieve(asked.where("route <> 'reading'"), points).join(about, "qid")
    return chain.select("qid", "subject", F.lit("literature").alias("base"), "id", "rank", "tier").unionByName(other.select("qid", "subject", F.col("source").alias("base"), F.col("vec_id").alias("id"), "rank", F.lit(None).cast("int").alias("tier")))


_HITS_OF = "SELECT qid, count(*) AS retrieved_sources, md5(string_agg('- Đoạn ' || rank || ' [' || vec_id || '] (' || coalesce(title, '') || '): ' || coalesce(text, ''), chr(10) ORDER BY rank)) AS context FROM r LEFT JOIN kb ON id = vec_id GROUP BY qid"


@query(f"WITH {_KB}, r AS ({ORACLE_SQL['retrieve_routed']}), i AS ({ORACLE_SQL['route_questions']}), c AS ({_HITS_OF}) SELECT qid, intent, coalesce(retrieved_sources, 0) AS retrieved_sources, coalesce(context, md5('')) AS context FROM i LEFT JOIN c USING (qid)")
def retrieve_endpoint(spark, d):
    """What the service answers for every search: intent, number of hits, and their context."""
    asked = asked_all(spark, d).select("qid", "intent")
    hits = QUERIES["retrieve_routed"](spark, d)
    texts = readings(spark, d).select(F.col("id").alias("vec_id"), "title", "text")
    rows = texts.join(retrieval.few(hits), "vec_id", "right")
    line = F.format_string("- Đoạn %d [%d] (%s): %s", "rank", "vec_id", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    got = retrieval.context(rows.select("qid", "vec_id", "rank", "title", "text"), line)
    return asked.join(got, "qid", "left").select("qid", "intent", F.coalesce("n", F.lit(0)).alias("retrieved_sources"), F.md5(F.coalesce("context", F.lit(""))).alias("context"))


# Subjects, routes -----------------------------------------------------------------------------------
_SUBJECT = (
    "s AS (SELECT qid, q, CASE WHEN qid % 10 > 0 THEN CAST(qid % 9 + 1 AS INTEGER) END AS grade, "
    + ", ".join(f"{R.sql_score('lower(q)', p)} AS {n}" for n, p in R.SUBJECTS)
    + f", {R.sql_score('lower(q)', R.LITERATURE)} AS lit FROM {{rows}}), b AS (SELECT *, greatest({', '.join(n for n, _ in R.SUBJECTS)}, lit) AS best, list_sort([{', '.join(n for n, _ in R.SUBJECTS)}, lit], 'DESC')[2] AS second FROM s), "
    "u AS (SELECT qid, q, CASE WHEN best = 0 THEN NULL " + " ".join(f"WHEN {n} = best THEN '{n}'" for n, _ in R.SUBJECTS) + " WHEN grade <= 5 THEN 'tieng_viet' ELSE 'ngu_van' END AS subject, CASE WHEN best = 0 THEN 0.0::DOUBLE ELSE round(best / (1.0::DOUBLE * (best + second)), 3) END AS confidence FROM b)"
)

_SUBJECT_SAY = _SUBJECT.replace("{rows}", values(_SAY))


def graded(rows: DataFrame) -> DataFrame:
    """rows (qid, q) with a grade, or none for every tenth, and the subject."""
    return route.with_subject(rows.withColumn("grade", F.when(F.col("qid") % 10 > 0, (F.col("qid") % 9 + 1).cast("int"))))


@texts_query(_SAY, "conversations", f"WITH {_SUBJECT_SAY} SELECT qid, subject, confidence FROM u")
def subject_by_grade(rows):
    """The subject with literature by grade, and how sure it is."""
    return graded(rows).select("qid", "subject", "confidence")


# Questions with grades; what comes of them was worked out by hand from the patterns.
_CASES = [("Đọc bài Mưa rào", 2, "tieng_viet", 1.0), ("Đọc bài Tắt đèn", 8, "ngu_van", 1.0), ("Từ láy là gì lớp 4", 4, None, 0.0), ("Tính diện tích tam giác vuông", 5, "toan", 1.0), ("Phân số tối giản là gì", 3, "toan", 1.0), ("Phân tử là gì", 7, "khtn", 1.0), ("Book nghĩa là gì", 6, "tieng_anh", 1.0), ("Trận Chi Lăng năm nào", 6, "lich_su", 1.0), ("Đồng bằng sông Cửu Long", 7, "dia_li", 1.0), ("Tiết kiệm là gì", 5, "gdcd", 1.0), ("lực và phân số", None, "toan", 0.5), ("tác giả của bài thơ viết năm 1418", None, "ngu_van", 0.667)]


@query("SELECT * FROM (VALUES " + ", ".join(f"({k}, {R.quoted(s) if s else 'NULL'}, {c}::DOUBLE)" for k, (_, _, s, c) in enumerate(_CASES)) + ") AS v(qid, subject, confidence)")
def subject_cases(spark, d):
    """One question for each subject and rule, against rows worked out by hand."""
    rows = spark.createDataFrame([(k, q, g) for k, (q, g, _, _) in enumerate(_CASES)], "qid int, q string, grade int")
    return route.with_subject(rows).select("qid", "subject", "confidence")


_ROUTED = "r(subject, asks, main, other) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else str(x) if isinstance(x, bool) else R.quoted(x) for x in row) + ")" for row in route.ROUTES) + ")"


@texts_query(_SAY, "conversations", f"WITH {_SUBJECT_SAY}, {_ROUTED}, i AS (SELECT *, {R.sql_first_rule('lower(trim(q))', R.INTENT, 'lookup_reading')} = 'explain_concept' AS concept FROM u) SELECT qid, i.subject, coalesce(main, 'global') AS main, coalesce(other, main, 'global') AS other FROM i LEFT JOIN r ON r.subject = i.subject AND (asks IS NULL OR asks = concept)")
def collections_for(rows):
    """The collection for a question's subject and intent, and the one that stands in for it."""
    rows = graded(rows).withColumn("intent", R.first_rule(F.lower(F.trim("q")), R.INTENT, "lookup_reading"))
    return route.collections(rows).select("qid", "subject", "main", "other")


@texts_query(_SAY, "conversations", f"WITH {_SUBJECT_SAY} SELECT CASE WHEN confidence < 0.5 THEN 'model_only' ELSE 'retrieve' END AS way, subject, count(*) AS n FROM u GROUP BY ALL")
def confidence_gate(rows):
    """Questions whose subject is unsure go to the model without retrieval."""
    way = F.when(F.col("confidence") < route.CONFIDENT, "model_only").otherwise("retrieve")
    return graded(rows).groupBy(way.alias("way"), "subject").agg(F.count("*").alias("n"))


_SOURCES = [("kb_math_exercises", "Toán"), ("kb_khtn_exercises", "KHTN"), ("kb_social_exercises", "Khoa học Xã hội"), ("kb_sgk_reading", "Bài"), ("kb_language_concepts", "Từ")]
_HAS = {n: " OR ".join(f"contains({at}, {R.quoted(p)})" for p in parts) for n, at, parts in route.RETAG}


@query(f"WITH m AS ({ORACLE_SQL['global_merge_top3']}), t AS (SELECT qid, [" + ", ".join(R.quoted(s) for s, _ in _SOURCES) + "][CAST(src AS INTEGER) + 1] AS source, [" + ", ".join(R.quoted(t) for _, t in _SOURCES) + "][CAST(src AS INTEGER) + 1] || ' ' || vec_id AS title FROM m WHERE rank = 1) SELECT qid, CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in _HAS.items()) + " ELSE 'unknown' END AS subject FROM t")
def retag(spark, d):
    """The subject that the best hit of a search over all collections gives; only the social
    sciences' titles say it in the words that are looked for."""
    best = QUERIES["global_merge_top3"](spark, d).where("rank = 1")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _SOURCES)), (F.col("src") + 1).cast("int"))
    return best.select("qid", route.retag(F.lit("unknown"), pick(0), F.concat_ws(" ", pick(1), "vec_id")).alias("subject"))


@query(f"WITH {_EVAL} SELECT expected, count(*) AS n, count(*) FILTER (a AND NOT b) AS wins, count(*) FILTER (b AND NOT a) AS losses, round((count(*) FILTER (a AND NOT b) + 0.5::DOUBLE * count(*) FILTER (a = b)) / count(*), 6) AS win_rate FROM (SELECT qid, any_value(expected) AS expected, bool_or(hit AND arm = 'profile') AS a, bool_or(hit AND arm = 'cold') AS b FROM v GROUP BY qid HAVING count(*) = 2) GROUP BY expected")
def win_rate(spark, d):
    """Query by query, how often one arm hits where the other doesn't, by subject; ties are halves."""
    each = evaluated(spark, d).groupBy("qid").agg(F.count("*").alias("arms"), F.first("expected").alias("expected"), F.bool_or(F.col("hit") & (F.col("arm") == "profile")).alias("a"), F.bool_or(F.col("hit") & (F.col("arm") == "cold")).alias("b")).where("arms = 2")
    by = each.groupBy("expected").agg(F.count("*").alias("n"), F.count_if(F.expr("a and not b")).alias("wins"), F.count_if(F.expr("b and not a")).alias("losses"), F.count_if(F.expr("a = b")).alias("ties"))
    return by.select("expected", "n", "wins", "losses", F.round((F.col("wins") + 0.5 * F.col("ties")) / F.col("n"), 6).alias("win_rate"))
