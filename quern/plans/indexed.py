"""Queries that go through what is stored and kept: neighbours by lists around centroids, words by
posting blocks, duplicates by signed projections, merged tables, walks to their end, paths of typed
edges, percentiles by hour. What an index finds exactly has the SQL of a scan; what it finds
approximately is measured against one."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from quern.functions import density
from quern.functions import rules as R
from quern.operators import answer, crawl, duplicates, graph, monitor, nearest, postings, retrieval, route
from quern.operators.crawl import SERIES
from quern.plans.catalogue import _BAND, _Q, _TOP, ORACLE_SQL, QUERIES, query, vectors
from quern.plans.curation import _EVERY, _SOURCE, _UNDERSTOOD, _DIM, _best_of, _pairs, collection_of
from quern.plans.knowledge import _CONTAINED, _EXACT, _KB, _NEXT, _ON, _SERIES, _WORK, readings, series, works
from quern.sources.merged import Merged
from quern.sources.shared import new_path
from quern.sources.tables import table
from quern.streaming import upsert


def unchecked(f):
    """A query whose rows SQL can't give."""
    QUERIES[f.__name__] = f
    return f


# Neighbours ----------------------------------------------------------------------------------------
@unchecked
def semantic_index(spark, d):
    """Five neighbours of each query by the index, over as many lists as tuning finds."""
    q, points = vectors(spark, d)
    return nearest.search(nearest.unbound(q), nearest.built(points), 5)


@query(ORACLE_SQL["semantic_nofilter"])
def semantic_index_exact(spark, d):
    """The same over all lists: the exact scan, by matrix products."""
    q, points = vectors(spark, d)
    index = nearest.built(points)
    return nearest.search(nearest.unbound(q), index, 5, len(index.centroids))


@query(f"WITH {_Q} {_TOP.format(on=_BAND.format(lo=1), k=5)}")
def semantic_index_band(spark, d):
    """All lists, labels within one of the query's."""
    q, points = vectors(spark, d)
    index = nearest.built(points)
    asked = q.select("qid", "qvec", F.greatest(F.lit(1), F.col("grade") - 1).alias("low"), (F.col("grade") + 1).alias("high"))
    return nearest.search(asked, index, 5, len(index.centroids))


@query(f"WITH {_Q} SELECT count(*) AS queries, 5 * count(*) AS wanted, true AS enough FROM q")
def index_recall(spark, d):
    """Of all queries' true neighbours the index finds nine in ten at least."""
    q, points = vectors(spark, d)
    index = nearest.built(points)
    asked = nearest.unbound(q)
    got = nearest.recall(nearest.search(asked, index, 5), nearest.search(asked, index, 5, len(index.centroids)))
    return got.select("queries", "wanted", (F.col("recall") >= 0.9).alias("enough"))


# Words ---------------------------------------------------------------------------------------------
@query("WITH q AS (SELECT conv_id AS qid, regexp_extract_all(lower(text), '[a-z]{4,}') AS w FROM conversations WHERE turn = 0), p AS (SELECT DISTINCT qid, unnest([w[1], w[2]]) AS w FROM q), a AS (SELECT * FROM p WHERE w IS NOT NULL), t AS (SELECT doc_id, w, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z]{4,}')) AS w FROM documents) GROUP BY 1, 2), s AS (SELECT qid, doc_id, count(*) AS n, round(sum(1 + ln(tf)), 6) AS score FROM a JOIN t USING (w) GROUP BY 1, 2), m AS (SELECT qid, count(*) AS n FROM a GROUP BY 1) SELECT qid, doc_id, score, rank FROM (SELECT s.*, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS INTEGER) AS rank FROM s JOIN m USING (qid, n)) WHERE rank <= 5")
def lexical_opening(spark, d):
    """Texts with the words that each conversation opens with (two words are the question), in one
    pass over the index: there are about as many questions as texts."""
    words = lambda c: F.regexp_extract_all(F.lower(c), F.lit("[a-z]{4,}"), 0)
    index = postings.built(table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.col("text").alias("t")), words)
    first = table(spark, d, "conversations").where("turn = 0").select(F.col("conv_id").alias("qid"), F.explode(F.slice(words("text"), 1, 2)).alias("w"))
    return postings.many(first, index, 5).withColumnRenamed("id", "doc_id")


# Duplicates ----------------------------------------------------------------------------------------
@query("WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings) SELECT x.vec_id, min(y.vec_id) AS duplicate_of_id FROM e x LEFT JOIN e y ON y.vec_id < x.vec_id AND list_cosine_similarity(x.v, y.v) > 0.9 GROUP BY x.vec_id")
def vector_duplicates(spark, d):
    """What each vector is a duplicate of, whatever the labels: the first with a cosine above 0.9."""
    return duplicates.duplicates(table(spark, d, "embeddings"))


# Merged tables -------------------------------------------------------------------------------------
@query(ORACLE_SQL["raw_upsert_version"])
def stream_upsert(spark, d):
    """Pages as a stream of four batches, merged by address into a table that stays: the oldest
    hash, the newest id, a version for each time."""
    incoming = new_path(spark, "incoming")
    rows = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id", F.sha2("html", 256).alias("first_hash"), F.col("page_id").alias("last_page"))
    rows.repartition(4).write.parquet(incoming)
    kept = Merged(new_path(spark, "raw-pages"), "url", "page_id", ("first_hash",), ("last_page",))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(incoming)
    upsert.merge_batches(stream, kept, new_path(spark, "raw-pages-log")).awaitTermination()
    return kept.read(spark)


# Walks to their end --------------------------------------------------------------------------------
@query("WITH RECURSIVE l AS (SELECT doc_id AS src, unnest([doc_id * 2 + 1, doc_id * 2 + 2, doc_id // 3]) AS dst FROM documents), s AS (SELECT src, dst FROM l WHERE dst IN (SELECT doc_id FROM documents)), v(page, depth) AS (SELECT 0::BIGINT, 0 UNION SELECT dst, depth + 1 FROM v JOIN s ON src = page WHERE depth < 30) SELECT page, min(depth) AS depth, false AS article FROM v GROUP BY page")
def crawl_closure(spark, d):
    """All that links lead to, with links back: each page on the level where it is seen first."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("src"))
    links = docs.select("src", F.posexplode(F.array(F.col("src") * 2 + 1, F.col("src") * 2 + 2, F.floor(F.col("src") / 3))).alias("k", "dst")).join(docs.withColumnRenamed("src", "dst"), "dst", "left_semi")
    return crawl.walk(spark.range(1).select(F.col("id").alias("page")), links.withColumn("sub", F.lit(True)), None, None)


@query("WITH RECURSIVE n AS (SELECT doc_id AS page, doc_id + 1 AS next FROM documents WHERE doc_id + 1 IN (SELECT doc_id FROM documents)), c(first, page, place) AS (SELECT doc_id, doc_id, 0::BIGINT FROM documents WHERE doc_id NOT IN (SELECT next FROM n) UNION ALL SELECT c.first, n.next, c.place + 1 FROM c JOIN n ON n.page = c.page) SELECT first, page, place FROM c")
def long_chain(spark, d):
    """Pages that each lead to the next, as long as there is one."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("page"))
    return crawl.chains(docs, docs.select(F.col("page").alias("src"), (F.col("page") + 1).alias("dst")).join(docs.withColumnRenamed("page", "dst"), "dst", "left_semi"))


# Typed edges ---------------------------------------------------------------------------------------
@query("SELECT 'o' || o_orderkey AS node_id, CASE WHEN o_orderkey % 4 < 2 THEN coalesce(r_name, CASE WHEN o_orderkey % 4 = 0 THEN 'LEGACY' END) ELSE o_orderpriority END AS series FROM orders LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey")
def series_inherited(spark, d):
    """Orders without a series of their own take that of the region that three relations lead from."""
    key = lambda sign, c: F.concat(F.lit(sign), F.col(c))
    edge = lambda name, rel, src, dst: table(spark, d, name).select(key(*src).alias("src"), F.lit(rel).alias("rel"), key(*dst).alias("dst"))
    edges = edge("nation", "HAS_NATION", ("r", "n_regionkey"), ("n", "n_nationkey")).unionByName(edge("customer", "HAS_CUSTOMER", ("n", "c_nationkey"), ("c", "c_custkey"))).unionByName(edge("orders", "HAS_ORDER", ("c", "o_custkey"), ("o", "o_orderkey")))
    own = F.when(F.col("o_orderkey") % 4 == 0, "LEGACY").when(F.col("o_orderkey") % 4 > 1, F.col("o_orderpriority"))
    nodes = table(spark, d, "orders").select(key("o", "o_orderkey").alias("node_id"), own.alias("series"))
    source = table(spark, d, "region").select(key("r", "r_regionkey").alias("node_id"), F.col("r_name").alias("series"))
    return graph.inherit(nodes, source, edges, ["HAS_NATION", "HAS_CUSTOMER", "HAS_ORDER"], "series", ["LEGACY"])


_OWN = "CASE WHEN {c} % 3 > 0 THEN ['KNTT', 'CTST', 'CD'][CAST({c} % 7 % 3 AS INTEGER) + 1] END"
_ADOPT = (
    f"w AS (SELECT doc_id AS id, 'u' || n_chars % 500 AS url, CASE WHEN doc_id % 7 > 0 THEN source || lang END AS title, {_OWN.format(c='doc_id')} AS series FROM documents), "
    f"u AS (SELECT 's' || s_suppkey AS unit_id, 'src' || s_suppkey % 5 || 'en' AS name, coalesce({_OWN.format(c='s_suppkey')}, 'LEGACY') AS series, 'u' || s_suppkey * 7 AS url FROM supplier), "
    "b AS (SELECT u.unit_id, w.id FROM w JOIN u USING (url)), o AS (SELECT id, coalesce(title, url) AS name, coalesce(series, 'LEGACY') AS series, series AS own FROM w WHERE id NOT IN (SELECT id FROM b)), "
    "f AS (SELECT name, series, min(unit_id) AS old FROM u GROUP BY ALL), m AS (SELECT o.*, coalesce(old, 'new|' || name || '|' || series) AS unit_id, old FROM o LEFT JOIN f USING (name, series)), "
    "a AS (SELECT unit_id, name, series, false AS synthetic FROM u UNION ALL SELECT DISTINCT unit_id, name, series, true FROM m WHERE old IS NULL), "
    "t AS (SELECT unit_id, id FROM b UNION ALL SELECT unit_id, id FROM m), k AS (SELECT DISTINCT unit_id FROM m WHERE own IN ('KNTT', 'CTST'))"
)


@query(f"WITH {_ADOPT} SELECT a.unit_id, a.name, a.series, a.synthetic, count(t.id) AS works, bool_or(k.unit_id IS NOT NULL) AS tied FROM a LEFT JOIN t ON t.unit_id = a.unit_id LEFT JOIN k ON k.unit_id = a.unit_id GROUP BY ALL")
def units_adopted(spark, d):
    """Works without a unit get one, made once for each name and series, tied to a known series."""
    own = lambda c: F.when(F.col(c) % 3 > 0, F.element_at(F.array(*map(F.lit, SERIES)), (F.col(c) % 7 % 3 + 1).cast("int")))
    works = table(spark, d, "documents").select(F.col("doc_id").alias("id"), F.concat(F.lit("u"), F.col("n_chars") % 500).alias("url"), F.when(F.col("doc_id") % 7 > 0, F.concat("source", "lang")).alias("title"), own("doc_id").alias("series"))
    rows = table(spark, d, "supplier").select(F.concat(F.lit("s"), "s_suppkey").alias("unit_id"), F.concat(F.lit("src"), F.col("s_suppkey") % 5, F.lit("en")).alias("name"), F.coalesce(own("s_suppkey"), F.lit("LEGACY")).alias("series"), F.concat(F.lit("u"), F.col("s_suppkey") * 7).alias("url"))
    known = spark.createDataFrame([("KNTT",), ("CTST",)], "code string")
    units, ties, tied = graph.adopt(works, rows.drop("url"), rows.select("unit_id", "url"), known, "LEGACY")
    n = ties.groupBy("unit_id").agg(F.count("*").alias("works"))
    marked = tied.select("unit_id").distinct().withColumn("tied", F.lit(True))
    return units.join(n, "unit_id", "left").join(marked, "unit_id", "left").select("unit_id", "name", "series", "synthetic", F.coalesce("works", F.lit(0)).alias("works"), F.coalesce("tied", F.lit(False)).alias("tied"))


# Monitoring ----------------------------------------------------------------------------------------
_LOG, _F = repr(math.log(monitor.factor())), repr(monitor.factor())
_AT = f"coalesce(round(2 * pow({_F}, k) / ({_F} + 1), 6), 0.0)"


@query(
    f"WITH h AS (SELECT event_type, date_trunc('hour', ts) AS hour, CASE WHEN value > 0 THEN ceil(round(ln(value) / {_LOG}, 9)) END AS k, count(*) AS n FROM events WHERE ts IS NOT NULL AND value IS NOT NULL GROUP BY ALL), e AS (SELECT event_type, CAST(hour AS DATE) AS day, k, sum(n) AS n FROM h GROUP BY ALL), "
    f"w AS (SELECT *, {_AT} AS mid, sum(n) OVER (PARTITION BY event_type, day ORDER BY k NULLS FIRST) AS upto, sum(n) OVER (PARTITION BY event_type, day) AS whole FROM e) "
    "SELECT event_type, day, CAST(sum(n) AS BIGINT) AS n, " + ", ".join(f"min(mid) FILTER (upto >= ceil({p}::DOUBLE * whole)) AS p{round(100 * p)}" for p in (0.5, 0.95, 0.99)) + " FROM w GROUP BY event_type, day"
)
def latency_days(spark, d):
    """Percentiles of each day, merged from counts that are kept by hour; within one in a hundred."""
    kept = monitor.hours(table(spark, d, "events")).withColumn("day", F.to_date("hour"))
    return monitor.percentiles(kept, ["event_type", "day"], [0.5, 0.95, 0.99])


# Questions of every kind ---------------------------------------------------------------------------
#: Each search asks in one of these ways, the title of its document in the middle.
_ASK = [("Đọc cho em bài ", " nhé"), ("tuần này học những gì ạ", None), ("Từ láy là gì", None), ("giúp em tả con mèo", None), ("bài 3 trang 45 tính diện tích hình thang ", ""), ("bài 4 trang 20 quang hợp ở thực vật ", ""), ("bài 2 trang 31 khí hậu châu Á ", ""), ("trang 7 lớp 3", None), ("Xin chào!", None), ("dàn ý kể chuyện", None), ("Tóm tắt bài ", ""), ("soạn bài ", " đi")]
_ASKED = "CASE (qid // 50) % {n} ".format(n=len(_ASK)) + " ".join(f"WHEN {k} THEN " + (f"'{a}'" if z is None else f"'{a}' || t || '{z}'") for k, (a, z) in enumerate(_ASK)) + " END"
_QUESTIONS = f"SELECT qid, {_ASKED} AS q, grade FROM (SELECT vec_id AS qid, label AS grade, coalesce(substr(title, 1, 14), '') AS t FROM embeddings LEFT JOIN kb ON id = vec_id WHERE vec_id % 50 = 0)"
_LESSON = f"trim(regexp_replace(regexp_replace(regexp_replace(lower(trim(q)), {R.quoted(R.LESSON_LEAD)}, ''), {R.quoted(R.LESSON_TAIL)}, ''), 'lớp\\s+[0-9]+.*$', ''))"
_SERIES_OF = "CASE WHEN qid % 4 = 1 THEN 'KNTT' WHEN qid % 4 = 0 THEN '' ELSE 'CTST' END"
_KINDS = [k for k, _ in R.WRITING]
_WRITTEN = "SELECT p_partkey AS id, [" + ", ".join(map(R.quoted, _KINDS)) + f"][CAST(p_partkey % {len(_KINDS)} AS INTEGER) + 1] AS kind, p_size % 9 + 1 AS grade FROM part"
_SEARCHED = f"a AS (SELECT qid, grade, dim.source, low, CASE WHEN route = 'global' THEN {route.GLOBAL_HITS} ELSE k END AS k, p.v AS qv FROM u JOIN dim ON route = dim.source OR route = 'global' JOIN p ON p.vec_id = qid), f AS ({_best_of.format(rows=_pairs.format(asked='a') + ' WHERE CASE WHEN low IS NULL THEN label BETWEEN 0 AND grade ELSE label BETWEEN greatest(low, grade - 1) AND grade + 1 END')}), e0 AS (SELECT * FROM a WHERE (qid, source) NOT IN (SELECT (qid, source) FROM f)), g AS (SELECT * FROM f UNION ALL {_best_of.format(rows=_pairs.format(asked='e0'))})"
_RETRIEVED = f"SELECT qid, source, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, r) AS INTEGER) AS rank FROM g) WHERE rank <= {route.MERGED}"
_FALL = "{name} AS ({sql}), {rest} AS (SELECT * FROM {of} WHERE qid NOT IN (SELECT qid FROM {name}))"
_ANSWERS = (
    f"{_Q}, {_KB}, {_WORK}, {_UNDERSTOOD.replace(_EVERY, _QUESTIONS)}, p AS (SELECT vec_id, label, {_SOURCE} AS source, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), dim(source, k, low) AS (VALUES {_DIM}), {_SEARCHED}, "
    f"n AS (SELECT u.qid, u.route, u.grade, CASE WHEN length(l) > 2 THEN l ELSE q END AS name, nullif(u.grade, 0) AS g, nullif({_SERIES_OF.replace('qid', 'u.qid')}, '') AS s, {R.sql_first_rule('lower(trim(q))', R.WRITING, None)} AS kind, p.v AS qv, u.qid // 50 % 35 + 1 AS week FROM u JOIN (SELECT qid, q, {_LESSON} AS l FROM ({_QUESTIONS})) x USING (qid) JOIN p ON p.vec_id = u.qid), "
    f"r0 AS (SELECT * FROM n WHERE route = 'reading'), {_FALL.format(name='t0', rest='r1', of='r0', sql=_CONTAINED.format(a='r0', on=_ON, of='id % 3 = 0'))}, {_FALL.format(name='t1', rest='r2', of='r1', sql=_CONTAINED.format(a='r1', on=_ON, of='id % 3 = 1'))}, "
    + _FALL.format(name="t2", rest="r3", of="r2", sql=_EXACT.format(a="r2").replace("SELECT qid, id, rank FROM", "SELECT qid, id, rank, CASE WHEN lower(title) = lower(name) THEN 1.0::DOUBLE ELSE 0.8::DOUBLE END AS score FROM", 1))
    + f", t3 AS (SELECT qid, vec_id AS id, rank, score FROM (SELECT qid, vec_id, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM (SELECT qid, vec_id, round(list_cosine_similarity(v, qv), 6) AS score FROM p JOIN r3 ON source = 'reading' AND {_BAND.format(lo=1).replace('grade', 'r3.grade')})) WHERE rank <= 3), "
    f"b AS ({_WRITTEN}), o AS (SELECT * FROM b WHERE id % 7 < 4), m AS (SELECT * FROM b WHERE id % 7 >= 4), o0 AS (SELECT qid, kind, g FROM n WHERE route = 'outline' AND kind IS NOT NULL AND g > 0), "
    f"{_FALL.format(name='d0', rest='o1', of='o0', sql=_NEXT.format(rows='o', a='o0', on='r.kind = a.kind AND grade = g', k=1))}, {_FALL.format(name='d1', rest='o2', of='o1', sql=_NEXT.format(rows='o', a='o1', on='r.kind = a.kind', k=1))}, {_FALL.format(name='d2', rest='o3', of='o2', sql=_NEXT.format(rows='m', a='o2', on='r.kind = a.kind', k=2))}, d3 AS ({_NEXT.format(rows='m', a='o3', on='true', k=2)}), "
    f"c AS (SELECT n.qid, h.id, CAST(row_number() OVER (PARTITION BY n.qid ORDER BY h.id) AS INTEGER) AS rank FROM n JOIN (SELECT o_orderkey AS id, o_orderkey % 9 + 1 AS grade, {_SERIES.format(c='o_orderkey')} AS series, o_orderkey % 35 + 1 AS week FROM orders) h ON h.grade = n.g AND h.series = n.s AND h.week = n.week WHERE route = 'curriculum'), "
    f"v AS ({_RETRIEVED}), e9 AS (SELECT qid, source AS base, vec_id AS id, rank, score, NULL::INTEGER AS tier FROM v WHERE qid IN (SELECT qid FROM n WHERE route <> 'reading')"
    " UNION ALL SELECT qid, 'texts', id, rank, 1.0::DOUBLE, 0 FROM t0 UNION ALL SELECT qid, 'summaries', id, rank, 0.9::DOUBLE, 1 FROM t1 UNION ALL SELECT qid, 'readings', id, rank, score, 2 FROM t2 UNION ALL SELECT qid, 'reading', id, rank, score, 3 FROM t3"
    " UNION ALL SELECT qid, 'outlines', id, rank, 1.0::DOUBLE, 0 FROM d0 UNION ALL SELECT qid, 'outlines', id, rank, 1.0::DOUBLE, 1 FROM d1 UNION ALL SELECT qid, 'samples', id, rank, 0.7::DOUBLE, 2 FROM d2 UNION ALL SELECT qid, 'samples', id, rank, 0.7::DOUBLE, 3 FROM d3"
    " UNION ALL SELECT qid, 'weeks', id, rank, 1.0::DOUBLE, NULL FROM c)"
)


@query(f"WITH {_ANSWERS} SELECT n.qid, n.route, base, id, rank, score, tier FROM e9 JOIN n USING (qid)")
def answers_by_route(spark, d):
    """Every search as a question of one of a dozen kinds, each by its own route."""
    q, points = vectors(spark, d)
    titles = readings(spark, d).select(F.col("id").alias("qid"), F.substring("title", 1, 14).alias("t"))
    way, t = F.floor(F.col("qid") / 50) % len(_ASK), F.coalesce("t", F.lit(""))
    text = F
    for k, (a, z) in enumerate(_ASK):
        text = text.when(way == k, F.lit(a) if z is None else F.concat(F.lit(a), t, F.lit(z)))
    asked = retrieval.few(q).join(titles, "qid", "left").select("qid", text.alias("q"), "qvec", "grade", F.when(F.col("qid") % 4 == 1, "KNTT").when(F.col("qid") % 4 == 0, "").otherwise("CTST").alias("series"), (F.floor(F.col("qid") / 50) % 35 + 1).alias("week"))
    own = works(spark, d)
    kind = F.element_at(F.array(*map(F.lit, _KINDS)), (F.col("p_partkey") % len(_KINDS) + 1).cast("int"))
    written = table(spark, d, "part").select(F.col("p_partkey").alias("id"), kind.alias("kind"), (F.col("p_size") % 9 + 1).alias("grade"))
    weeks = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 9 + 1).alias("grade"), series("o_orderkey").alias("series"), (F.col("o_orderkey") % 35 + 1).alias("week"))
    bases = answer.Bases(points.select("vec_id", "embedding", "label", collection_of("vec_id").alias("source")), own.where("id % 3 = 0"), own.where("id % 3 = 1"), own.where("id % 3 = 2"), own, written.where("id % 7 < 4"), written.where("id % 7 >= 4"), weeks)
    return answer.answers(asked, bases)[1]


# Content by density --------------------------------------------------------------------------------------
_D = density
_q = R.quoted
_BARE = f"trim(regexp_replace(regexp_replace({{c}}, {_q(_D.TAG)}, ' ', 'g'), {_q(_D.SPACE)}, ' ', 'g'))"
_MAIN = (
    f"a AS (SELECT page_id, regexp_replace(translate(coalesce(html, ''), chr(1) || chr(2) || chr(3), '   '), {_q(_D.NOISE)}, ' ', 'g') AS h FROM pages), "
    f"b AS (SELECT page_id, string_split(regexp_replace(regexp_replace(regexp_replace(regexp_replace(h, {_q(_D.CELL)}, ' | ', 'g'), {_q(_D.ROW)}, chr(1) || chr(2), 'g'), {_q(_D.HEAD)}, chr(1) || chr(3), 'g'), {_q(_D.BREAK)}, chr(1), 'g'), chr(1)) AS p FROM a), "
    f"c AS (SELECT page_id, unnest(p) AS p, generate_subscripts(p, 1) AS i FROM b), d AS (SELECT page_id, i, CASE WHEN starts_with(p, chr(2)) THEN 'row' WHEN starts_with(p, chr(3)) THEN 'head' ELSE '' END AS kind, translate(p, chr(2) || chr(3), '') AS p FROM c), "
    f"e AS (SELECT page_id, i, kind, {_BARE.format(c='p')} AS t, {_BARE.format(c=f'regexp_replace(p, {_q(_D.LINK)}, chr(32), chr(103))')} AS o FROM d), "
    "f AS (SELECT *, len(string_split(t, ' ')) AS words, (length(replace(t, ' ', '')) - length(replace(o, ' ', ''))) / (1.0::DOUBLE * length(replace(t, ' ', ''))) AS links FROM e WHERE t <> ''), "
    "g AS (SELECT *, coalesce(lag(links) OVER w, 0) AS bl, coalesce(lag(words) OVER w, 0) AS bw, coalesce(lead(words) OVER w, 0) AS aw FROM f WINDOW w AS (PARTITION BY page_id ORDER BY i)), "
    f"h AS (SELECT *, links <= {_D.LINKS!r} AND (kind = 'row' OR NOT CASE WHEN bl > {_D.LINKS_BEFORE!r} THEN words <= {_D.MID} AND aw <= {_D.MID_NEXT} ELSE words <= {_D.SHORT} AND aw <= {_D.SHORT_NEXT} AND bw <= {_D.SHORT_BEFORE} END) AS yes FROM g), "
    "k AS (SELECT *, CASE WHEN kind = 'head' THEN coalesce(lead(yes) OVER (PARTITION BY page_id ORDER BY i), false) ELSE yes END AS kept FROM h), "
    "m AS (SELECT page_id, t, min(i) AS i FROM k WHERE kept GROUP BY page_id, t), n AS (SELECT page_id, count(*) AS blocks, md5(string_agg(t, chr(10) ORDER BY i)) AS hash FROM m GROUP BY page_id)"
)


@query(f"WITH {_MAIN} SELECT page_id, coalesce(blocks, 0) AS blocks, coalesce(hash, md5('')) AS hash FROM pages LEFT JOIN n USING (page_id)")
def main_content(spark, d):
    """What of each page is content by the words and links of its blocks; a hash of the text."""
    text = density.main_content(table(spark, d, "pages").select("page_id", "html"), "html", "t")
    return text.select("page_id", F.when(F.col("t") == "", 0).otherwise(F.size(F.split("t", "\n"))).cast("long").alias("blocks"), F.md5("t").alias("hash"))
