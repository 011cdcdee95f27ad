"""More queries of the library with their SQL: segmentation, exercises, labels, routing,
evaluation arms, containment and repair. Tables play the roles named in `catalogue`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.functions import text as X
from quern.operators import blocks, graph, ingest, retrieval, route
from quern.plans.catalogue import _BAND, _KEY, _NAMES, _NODES, _Q, _SCORES, _TITLES, _TOP, nodes_edges, query, texts_query, values, vectors
from quern.sources.tables import table


# Retrieval -----------------------------------------------------------------------------------
@query(f"WITH {_Q} {_TOP.format(on='true', k=5)}")
def semantic_nofilter(spark, d):
    return retrieval.semantic_all(*vectors(spark, d), 5)


@query(f"WITH {_Q}, t AS ({_TOP.format(on=_BAND.format(lo=1), k=3)}) SELECT qid, count(*) AS n, string_agg('- Đoạn ' || rank || ' [' || vec_id || '] (' || lang || '): ' || substr(text, 1, 80), chr(10) ORDER BY rank) AS context FROM t JOIN documents ON doc_id = vec_id GROUP BY qid")
def context_format_api(spark, d):
    hits = retrieval.few(retrieval.semantic(*vectors(spark, d), 3, low=1))
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), F.substring("text", 1, 80).alias("body"), "lang")
    return retrieval.context(docs.join(hits, "vec_id"), F.format_string("- Đoạn %d [%d] (%s): %s", "rank", "vec_id", "lang", "body"))


@query(f"WITH {_Q}, t AS ({_TOP.format(on=_BAND.format(lo=1), k=3)}), l AS (SELECT qid, to_json(list({{'id': vec_id, 'score': score}} ORDER BY rank)) AS items FROM t GROUP BY qid) SELECT qid, CAST(json_extract(unnest(CAST(items AS JSON[])), '$.id') AS BIGINT) AS id FROM l")
def retrieval_log(spark, d):
    """Hits stored as a JSON array beside the query, and read back."""
    hits = retrieval.semantic(*vectors(spark, d), 3, low=1)
    log = hits.groupBy("qid").agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score"))), lambda x: F.struct(x["vec_id"].alias("id"), x["score"].alias("score")))).alias("items"))
    return log.select("qid", F.explode(F.from_json("items", "array<struct<id:bigint,score:double>>")).alias("x")).select("qid", "x.id")


_KEYWORDS = "list_distinct(regexp_extract_all(lower(text), '[a-z]{5,}'))"


@query(f"WITH q AS (SELECT item_id, unnest({_KEYWORDS}) AS w FROM benchmark), t AS (SELECT conv_id, turn, role, unnest({_KEYWORDS}) AS w FROM conversations), s AS (SELECT item_id, role, conv_id, turn, count(*) AS n FROM q JOIN t USING (w) GROUP BY ALL), r AS (SELECT *, CAST(row_number() OVER (PARTITION BY item_id, role ORDER BY n DESC, conv_id, turn) AS INTEGER) AS rank FROM s WHERE role <> 'system') SELECT item_id, CASE WHEN role = 'user' THEN 0 ELSE 1 END AS branch, conv_id, turn, least(1.0::DOUBLE, n / (CASE WHEN role = 'user' THEN 10.0::DOUBLE ELSE 20.0::DOUBLE END) + 0.5::DOUBLE) AS score, rank FROM r WHERE rank <= CASE WHEN role = 'user' THEN 5 ELSE 2 END")
def graph_keyword_scores(spark, d):
    """Five questions, then two passages, by common words; each branch scales its own scores."""
    words = lambda c: F.explode(F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit("[a-z]{5,}"), 0)))
    q = table(spark, d, "benchmark").select("item_id", words("text").alias("w"))
    nodes = table(spark, d, "conversations").where("role <> 'system'").select("conv_id", "turn", "role", words("text").alias("w"))
    user = F.col("role") == "user"
    found = nodes.join(retrieval.few(q, 200_000), "w").groupBy("item_id", "role", "conv_id", "turn").agg(F.count("*").alias("n"))
    best = retrieval.ranked(found, ["item_id", "role"], [F.desc("n"), F.col("conv_id"), F.col("turn")], 5).where(user | (F.col("rank") <= 2))
    return best.select("item_id", F.when(user, 0).otherwise(1).alias("branch"), "conv_id", "turn", F.least(F.lit(1.0), F.col("n") / F.when(user, 10.0).otherwise(20.0) + 0.5).alias("score"), "rank")


def contained(spark: SparkSession, d: str, start) -> DataFrame:
    q = table(spark, d, "benchmark").select("item_id", F.lower("text").alias("q"))
    docs = table(spark, d, "documents").where("text <> ''").select(F.col("doc_id").alias("id"), F.lower("text").alias("t"))
    longest = q.agg(F.max(F.length("q"))).first()[0] or 0
    short = docs.where(F.length("t") <= longest)
    size = F.length("t").alias("size")
    inside = retrieval.theta(short, q, F.contains("q", "t")).select("item_id", F.col("id").alias("doc_id"), size, F.lit(0).alias("direction"))
    around = retrieval.containing(docs, q.select(F.col("item_id").alias("name_id"), start.alias("name"))).select(F.col("name_id").alias("item_id"), F.col("id").alias("doc_id"), size, F.lit(1).alias("direction"))
    hits = inside.unionByName(around).groupBy("item_id", "doc_id").agg(F.min("direction").alias("direction"), F.max("size").alias("size"))
    return retrieval.ranked(hits, ["item_id"], [F.col("direction"), F.desc("size"), F.col("doc_id")], 2).select("item_id", "doc_id", "direction", "rank")


@query("WITH q AS (SELECT item_id, lower(text) AS q FROM benchmark), t AS (SELECT doc_id, lower(text) AS t FROM documents WHERE text <> ''), h AS (SELECT item_id, doc_id, CASE WHEN contains(q, t) THEN 0 ELSE 1 END AS direction, length(t) AS size FROM q JOIN t ON contains(q, t) OR contains(t, q)) SELECT item_id, doc_id, direction, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY direction, size DESC, doc_id) AS INTEGER) AS rank FROM h) WHERE rank <= 2")
def graph_contains_join(spark, d):
    """Texts inside the query, else whole queries inside the text; longest first, two each."""
    return contained(spark, d, F.col("q"))


@query("SELECT doc_id, length(coalesce(text, source)) AS size FROM documents ORDER BY size DESC, doc_id LIMIT 20")
def longest_first(spark, d):
    size = F.length(F.coalesce("text", "source")).cast("long")
    return table(spark, d, "documents").select("doc_id", size.alias("size")).orderBy(F.desc("size"), "doc_id").limit(20)


# Evaluation ----------------------------------------------------------------------------------
# Expected subjects that several detected ones satisfy.
_FAMILY = {"soc": ["lich_su", "dia_li", "gdcd", "soc"], "ngu_van": ["ngu_van", "tieng_viet"]}
_EXPECTED = ["cross", "soc", "ngu_van", "toan", "khtn"]
_DETECTED = ["toan", "lich_su", "tieng_viet", "toan", "khtn", "ngu_van", "dia_li", "ngu_van", "gdcd", "tieng_anh"]
_pick = lambda names, at: "[" + ", ".join(f"'{n}'" for n in names) + f"][{at} + 1]"
_ARMS = " UNION ALL ".join(f"SELECT '{arm}' AS arm, * FROM ({_TOP.format(on=on, k=4)})" for arm, on in (("profile", _BAND.format(lo=1)), ("cold", "true")))
_EVAL = (
    f"{_Q}, t AS ({_ARMS}), j AS (SELECT arm, t.qid, t.rank, x.label AS want, y.label AS got FROM t JOIN embeddings x ON x.vec_id = t.qid JOIN embeddings y ON y.vec_id = t.vec_id WHERE t.qid <> t.vec_id), "
    f"o AS (SELECT arm, qid, {_pick(_EXPECTED, 'any_value(want) % 5')} AS expected, {_pick(_DETECTED, 'arg_min(got, rank) % 10')} AS detected, (any_value(want) % 5 = 0 OR bool_or(want = got)) AS hit FROM j GROUP BY arm, qid), "
    "v AS (SELECT *, (hit OR expected = 'cross' OR expected = detected"
    + "".join(f" OR (expected = '{k}' AND detected IN ({', '.join(R.quoted(n) for n in names)}))" for k, names in _FAMILY.items())
    + ") AS correct FROM o)"
)


def evaluated(spark: SparkSession, d: str) -> DataFrame:
    """arm, qid, expected, detected, hit, correct: with the grade band, and without."""
    q, points = vectors(spark, d)
    arms = retrieval.semantic(q, points, 4, low=1).withColumn("arm", F.lit("profile")).unionByName(retrieval.semantic_all(q, points, 4).withColumn("arm", F.lit("cold")))
    labels = points.select("vec_id", F.col("label").alias("got"))
    rows = arms.where("vec_id <> qid").join(retrieval.few(q.select("qid", F.col("grade").alias("want"))), "qid").join(labels, "vec_id")
    name = lambda names, at: F.element_at(F.array(*map(F.lit, names)), (at + 1).cast("int"))
    each = rows.groupBy("arm", "qid", "want").agg(F.min_by("got", "rank").alias("top"), F.bool_or(F.col("want") == F.col("got")).alias("found"))
    return judged(each.select("arm", "qid", name(_EXPECTED, F.col("want") % 5).alias("expected"), name(_DETECTED, F.col("top") % 10).alias("detected"), (F.col("found") | (F.col("want") % 5 == 0)).alias("hit")))


def judged(rows: DataFrame) -> DataFrame:
    """rows with correct: a hit, any subject where it may cross, the same or one of its family."""
    fits = F.col("hit") | (F.col("expected") == "cross") | (F.col("expected") == F.col("detected"))
    for name, family in _FAMILY.items():
        fits = fits | ((F.col("expected") == name) & F.col("detected").isin(family))
    return rows.withColumn("correct", fits)


@query(f"WITH {_EVAL} SELECT arm, count(*) AS total, count(*) FILTER (hit) AS hits, count(*) FILTER (correct) AS correct, round(100.0::DOUBLE * count(*) FILTER (hit) / count(*), 6) AS hit_pct FROM v GROUP BY arm")
def two_arm_eval(spark, d):
    by = evaluated(spark, d).groupBy("arm").agg(F.count("*").alias("total"), F.count_if("hit").alias("hits"), F.count_if("correct").alias("correct"))
    return by.withColumn("hit_pct", F.round(100.0 * F.col("hits") / F.col("total"), 6))


@query(f"WITH {_EVAL} SELECT expected, detected, count(*) AS n, count(*) FILTER (correct) AS correct FROM v GROUP BY expected, detected")
def subject_alias_accuracy(spark, d):
    return evaluated(spark, d).groupBy("expected", "detected").agg(F.count("*").alias("n"), F.count_if("correct").alias("correct"))


@query(f"WITH {_EVAL} SELECT arm, qid, expected, detected FROM v WHERE NOT correct")
def failures(spark, d):
    return evaluated(spark, d).where("not correct").select("arm", "qid", "expected", "detected")


@query("SELECT lang AS stratum, doc_id AS id, rank FROM (SELECT lang, doc_id, CAST(row_number() OVER (PARTITION BY lang ORDER BY sha256(doc_id || '|11'), doc_id) AS INTEGER) AS rank FROM documents WHERE n_chars >= 100) WHERE rank <= 30 UNION ALL SELECT 'cross', item_id, rank FROM (SELECT item_id, CAST(row_number() OVER (ORDER BY item_id) AS INTEGER) AS rank FROM benchmark) WHERE rank <= 10")
def eval_set(spark, d):
    """Thirty of each stratum by a seeded hash and ten fixed ones across strata."""
    docs = table(spark, d, "documents").where("n_chars >= 100").select(F.col("lang").alias("stratum"), F.col("doc_id").alias("id"))
    some = retrieval.ranked(docs, ["stratum"], [F.sha2(F.concat_ws("|", "id", F.lit(11)).cast("binary"), 256), F.col("id")], 30)
    fixed = table(spark, d, "benchmark").select(F.lit("cross").alias("stratum"), F.col("item_id").alias("id")).orderBy("id").limit(10)
    return some.unionByName(retrieval.ranked(fixed, ["stratum"], [F.col("id")]))


@query("SELECT event_type, CAST(date_trunc('day', ts) AS DATE) AS day, count(*) AS n, count(DISTINCT user_id) AS users, round(count(*) FILTER (value > 100) / (1.0::DOUBLE * count(*)), 6) AS high_rate FROM events GROUP BY 1, 2")
def events_by_type(spark, d):
    rows = table(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.count_if(F.col("value") > 100).alias("high"))
    return rows.select("event_type", "day", "n", "users", F.round(F.col("high") / F.col("n"), 6).alias("high_rate"))


# Text ----------------------------------------------------------------------------------------
@query(r"SELECT doc_id, length(t) AS n, md5(t) AS hash, CAST(len(regexp_extract_all(t, '[^\t\n\f\r ]+')) AS BIGINT) AS words FROM (SELECT doc_id, substr(trim(regexp_replace(regexp_replace(text, '\n{3,}', chr(10) || chr(10), 'g'), '[ \t]+', ' ', 'g')), 1, 15000) AS t FROM documents)")
def clean_text(spark, d):
    t = table(spark, d, "documents").select("doc_id", X.clean(F.col("text")).alias("t"))
    return t.select("doc_id", F.length("t").cast("long").alias("n"), F.md5("t").alias("hash"), F.regexp_count("t", F.lit(r"[^\t\n\f\r ]+")).cast("long").alias("words"))


@query("SELECT doc_id, substr(md5(text), 1, 8) AS short_id, sha256(text) AS content_hash FROM documents")
def content_hash(spark, d):
    return table(spark, d, "documents").select("doc_id", F.substring(F.md5("text"), 1, 8).alias("short_id"), F.sha2("text", 256).alias("content_hash"))


_RAW = ["Nhớ rừng (Thế Lữ) | Trang học\nĐọc [bài](http://a.b/c) tại https://a.b/d nhé\n\n\n\nHết >> Xem thêm: bài khác\ncuối", "Truyện Kiều (Nguyễn Du)\n[ ... ] Trăm năm trong cõi người ta 👉 Soạn bài", "Không có gì", "Bài (x) | A | B\n[...]Một đoạn trích\nBình luận hay", '```json\n{"label": "QUESTION", "confidence": 0.9}\n```', '{"label": "SOLUTION"} c++ & "x_y"?']
_WS = r"'^\s+|\s+$'"


@texts_query(_RAW, "documents", rf"""SELECT qid, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(q, '(?s)>> Xem thêm.*', ''), '\[[^\n]*?\]\(http[^)]+\)', '', 'g'), 'https?://[^\t\n\f\r ]+', '', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), {_WS}, '', 'g') AS clean,
nullif(regexp_extract(q, '\(([^)]{{3,60}})\)', 1), '') AS author, trim(split_part(split_part(q, chr(10), 1), '|', 1)) AS title, CASE WHEN regexp_matches(lower(q), 'truyện|chuyện|đoạn trích|văn xuôi') THEN 'truyen' ELSE 'tho' END AS genre,
nullif(regexp_replace(regexp_extract(q, '(?s)\[\s*[.]{{3}}\s*\](.*?)(?:Bình luận|👉|Luyện Bài|Báo lỗi|$)', 1), {_WS}, '', 'g'), '') AS span,
trim(regexp_replace(regexp_replace(q, '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g')) AS terms,
json_extract_string(CASE WHEN contains(q, '"label"') THEN regexp_extract(q, '(?s)\{{[^}}]*\}}') END, '$.label') AS label FROM {values(_RAW)}""")
def text_fields(rows):
    """Cleaned text, author, title, genre, marked span, search terms, fenced JSON."""
    q = F.col("q")
    label = F.get_json_object(F.when(F.contains(q, F.lit('"label"')), F.regexp_extract(q, r"(?s)\{[^}]*\}", 0)), "$.label")
    genre = F.when(F.lower(q).rlike("truyện|chuyện|đoạn trích|văn xuôi"), "truyen").otherwise("tho")
    return rows.select("qid", X.drop_links(q).alias("clean"), X.author(q).alias("author"), X.title(q).alias("title"), genre.alias("genre"), X.marked_span(q).alias("span"), X.search_terms(q).alias("terms"), label.alias("label"))


_CUTS = ["! ", "\n", ". De ", ". The "]


@query("SELECT doc_id, length(CASE " + " ".join(f"WHEN strpos(text, {m}) - 1 > 200 THEN substr(text, 1, strpos(text, {m}) - 1)" for m in ("'! '", "chr(10)", "'. De '", "'. The '")) + " ELSE text END) AS n FROM documents")
def clip_at_marker(spark, d):
    """Text up to the first marker, in the markers' order, that stands after 200 characters."""
    return table(spark, d, "documents").select("doc_id", F.length(X.clip(F.col("text"), _CUTS, 200)).cast("long").alias("n"))


_COUNTED = ["the", "der", "que", "los"]


@query("SELECT doc_id, CASE WHEN m > 3 THEN CASE " + " ".join(f"WHEN c{k} = m THEN '{w}'" for k, w in enumerate(_COUNTED)) + " END ELSE 'unknown' END AS subject FROM (SELECT *, greatest(c0, c1, c2, c3) AS m FROM (SELECT doc_id, " + ", ".join(f"CAST((length(t) - length(replace(t, '{w}', ''))) / {len(w)} AS BIGINT) AS c{k}" for k, w in enumerate(_COUNTED)) + " FROM (SELECT doc_id, lower(text) AS t FROM documents)))")
def keyword_subject(spark, d):
    """The keyword that occurs most, if more than three times; the first declared wins ties."""
    counts = table(spark, d, "documents").select("doc_id", *(X.occurrences(F.lower("text"), w).alias(w) for w in _COUNTED))
    best = F.greatest(*_COUNTED)
    subject = F.coalesce(*(F.when(F.col(w) == best, F.lit(w)) for w in _COUNTED))
    return counts.select("doc_id", F.when(best > 3, subject).otherwise("unknown").alias("subject"))


_EX = [
    "Mở đầu\n ** CH1** Quan sát hình 2, nêu tên.\n**Phương pháp giải:** xem lại\n**Lời giải chi tiết:** Đó là tế bào thực vật. **Hết**\n** Câu 2 ** Tính lực.\nLời giải: 5 N, hướng lên trên.",
    "Tính 1 + 1.\n**Trả lời:** Bằng hai, như đã học.",
    "Không có lời đáp",
    "**Bài 1** Vẽ sơ đồ.\nLời giải: ngắn",
]
_strip = lambda c: f"regexp_replace(replace({c}, '**', ''), {_WS}, '', 'g')"


@texts_query(_EX, "lessons", rf"""WITH b AS (SELECT qid, x, generate_subscripts(x, 1) - 1 AS part, unnest(x) AS b FROM (SELECT qid, regexp_split_to_array(q, '\n\s*\*\*\s*(?:CH|Câu|Bài)\s*[0-9]+\s*\*\*') AS x FROM {values(_EX)})), k AS (SELECT *, CASE {' '.join(f"WHEN contains(b, '{m}') THEN '{m}'" for m in R.SOLUTION_MARKS)} END AS kw FROM b), s AS (SELECT qid, part, {_strip("split_part(split_part(split_part(b, kw, 1), '**Phương pháp giải:**', 1), 'Phương pháp giải:', 1)")} AS problem, {_strip("substr(b, strpos(b, kw) + length(kw))")} AS solution FROM k WHERE kw IS NOT NULL)
SELECT qid, CAST(part AS INTEGER) AS part, problem, solution, regexp_matches(lower(problem), 'hình |sơ đồ|quan sát') AS has_figure FROM s WHERE length(solution) >= 10""")
def exercise_split(rows):
    return blocks.exercises(rows, "qid", "q", R.SOLUTION_MARKS)


_MATHS = ["Lý thuyết chung\nCâu 1 Tính tổng theo Hình 3\nPhương pháp giải: cộng lại\nLời giải chi tiết: bằng 7\nLuyen tap Bài 2 Rút gọn\nLời giải chi tiết: x\nCâu 3 Bỏ qua", "Câu 9 Chỉ có cách làm\nPhương pháp giải: thử", "không có gì"]


@texts_query(_MATHS, "lessons", rf"""WITH b AS (SELECT qid, generate_subscripts(x, 1) - 1 AS part, unnest(x) AS b FROM (SELECT qid, string_split(regexp_replace(q, '\n(([A-Za-z ]+ )?(?:Câu|Bài) [0-9]+)', chr(1) || '\1', 'g'), chr(1)) AS x FROM {values(_MATHS)})), k AS (SELECT *, contains(b, 'Phương pháp giải:') AS p, contains(b, 'Lời giải chi tiết:') AS s FROM b)
SELECT qid, CAST(part AS INTEGER) AS part, regexp_replace(d, {_WS}, '', 'g') AS problem, regexp_replace(CASE WHEN s THEN substr(b, strpos(b, 'Lời giải chi tiết:') + 18) ELSE substr(b, strpos(b, 'Phương pháp giải:') + 17) END, {_WS}, '', 'g') AS solution, contains(d, 'Hình ') OR contains(lower(d), 'hình vẽ') AS has_figure FROM (SELECT *, split_part(b, CASE WHEN p THEN 'Phương pháp giải:' ELSE 'Lời giải chi tiết:' END, 1) AS d FROM k WHERE p OR s)""")
def exercise_split_maths(rows):
    """Chunks from one numbered heading to the next; what stands before the first is a chunk."""
    return blocks.numbered(rows, "qid", "q", "Phương pháp giải:", "Lời giải chi tiết:")


# Labels and routes -----------------------------------------------------------------------------
_BLOCKS = ["Câu 1: Ai là tác giả?", "câu 12 nêu ý chính", "Trả lời: Thế Lữ", "Lời giải chi tiết: như sau", "- gạch đầu dòng", "Phương pháp giải: đọc kĩ", "Hướng dẫn giải bài", "Soạn bài Nhớ rừng", "Đoạn văn thường", "Nội dung chính của bài"]
# What marks a block, in the order of the checks.
_V1 = [("EDITORIAL_INTRO", "^(?:.*)(tóm tắt cốt truyện|nội dung chính|soạn bài)"), ("QUESTION", "^câu .{0,25}:"), ("SOLUTION", "^(trả lời:|lời giải:|- )")]
_V2 = [("QUESTION", r"^(câu\s+[0-9]+|trả lời câu hỏi\s*[0-9]+)"), ("SOLUTION", "^(trả lời:|lời giải chi tiết:)"), ("EDITORIAL_INTRO", "^(hướng dẫn giải|phương pháp giải:|soạn bài|hướng dẫn phân tích)")]
_case = lambda labels: "CASE " + " ".join(f"WHEN regexp_matches(lower(q), '{p}') THEN '{n}'" for n, p in labels) + " ELSE 'NOISE' END"


@texts_query(_BLOCKS, "conversations", f"SELECT qid, {_case(_V1)} AS v1, {_case(_V2)} AS v2, {_case(_V2)} NOT IN ('NOISE', 'EDITORIAL_INTRO', 'RELATED_CONTENT') AS stays FROM {values(_BLOCKS)}")
def block_label(rows):
    """Heading rules for blocks; what no rule knows is noise unless a labelling hook says more."""
    q = F.lower("q")
    label = lambda rules: R.first_rule(q, [(n, [p]) for n, p in rules], "NOISE")
    rows = rows.select("qid", label(_V1).alias("v1"), label(_V2).alias("v2"))
    return rows.withColumn("stays", ~F.col("v2").isin("NOISE", "EDITORIAL_INTRO", "RELATED_CONTENT"))


_KIND = f"CASE WHEN contains(lower(q), 'van-ban-') OR starts_with(lower(q), 'văn bản ') THEN 'van_ban' ELSE {R.sql_first_rule('lower(q)', R.CONTENT, 'unknown')} END"
# Content types of the reading base.
_READING = ["van_ban", "bai_doc", "soan_van", "phan_tich", "tom_tat", "on_tap", "ke_chuyen"]


@texts_query(_TITLES, "pages", f"SELECT kind, kb, count(*) AS n FROM (SELECT kind, CASE WHEN kind IN ({', '.join(map(R.quoted, _READING))}) THEN 'reading' WHEN kind = 'luyen_tu_va_cau' THEN 'concepts' WHEN kind = 'tap_lam_van' THEN 'samples' ELSE 'other' END AS kb FROM (SELECT CASE WHEN k = 'unknown' AND grade >= 6 THEN 'soan_van' ELSE k END AS kind FROM (SELECT {_KIND} AS k, unnest(range(4, 8)) AS grade FROM {values(_TITLES)}))) GROUP BY kind, kb")
def kb_route(rows):
    """Titles of four grades to knowledge bases, counted by type."""
    q = F.lower("q")
    kind = F.when(F.contains(q, F.lit("van-ban-")) | F.startswith(q, F.lit("văn bản ")), "van_ban").otherwise(R.first_rule(q, R.CONTENT, "unknown"))
    rows = rows.select(kind.alias("k"), F.explode(F.sequence(F.lit(4), F.lit(7))).alias("grade"))
    rows = rows.select(F.when((F.col("k") == "unknown") & (F.col("grade") >= 6), "soan_van").otherwise(F.col("k")).alias("kind"))
    kb = F.when(F.col("kind").isin(_READING), "reading").when(F.col("kind") == "luyen_tu_va_cau", "concepts").when(F.col("kind") == "tap_lam_van", "samples").otherwise("other")
    return rows.groupBy("kind", kb.alias("kb")).agg(F.count("*").alias("n"))


_ROUTES = [("en", "view", "concepts", None), ("en", "click", "exercises", "concepts"), ("fr", "view", "topics", None), ("de", "error", "grammar", "sections")]


@query("WITH r(lang, kind, main, other) AS (VALUES " + ", ".join("(" + ", ".join("NULL" if x is None else f"'{x}'" for x in row) + ")" for row in _ROUTES) + "), k AS (SELECT lang, ['view', 'click', 'error'][CAST(doc_id % 3 AS INTEGER) + 1] AS kind FROM documents) SELECT lang, kind, coalesce(main, 'global') AS collection, coalesce(other, main, 'global') AS fallback, count(*) AS n FROM k LEFT JOIN r USING (lang, kind) GROUP BY ALL")
def collection_route(spark, d):
    """Subject and intent to a collection and its fallback: one row of a small table each."""
    routes = spark.createDataFrame(_ROUTES, "lang string, kind string, main string, other string")
    kind = F.element_at(F.array(*map(F.lit, ("view", "click", "error"))), (F.col("doc_id") % 3 + 1).cast("int"))
    asked = table(spark, d, "documents").groupBy("lang", kind.alias("kind")).agg(F.count("*").alias("n"))
    return asked.join(F.broadcast(routes), ["lang", "kind"], "left").select("lang", "kind", F.coalesce("main", F.lit("global")).alias("collection"), F.coalesce("other", "main", F.lit("global")).alias("fallback"), "n")


@query("SELECT doc_id FROM documents WHERE n_chars >= 100 AND len(regexp_extract_all(text, '[^ \\t\\n\\r]+')) >= 30 AND NOT regexp_matches(lower(text), 'copyright|licen[sc]e|cookie')")
def min_length_filter(spark, d):
    rows = table(spark, d, "documents").where("n_chars >= 100")
    return rows.where((F.regexp_count("text", F.lit(r"[^ \t\n\r]+")) >= 30) & ~F.lower("text").rlike("copyright|licen[sc]e|cookie")).select("doc_id")


@query("SELECT lang, count(*) AS scanned, count(*) FILTER (text NOT ILIKE '%licen_e%') AS plain, count(*) FILTER (source IS NOT NULL AND (quality IS NULL OR quality = 0)) AS planned FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def planned_repairs(spark, d):
    """Dry run: rows scanned and rows that a repair would change."""
    rows = table(spark, d, "documents").select("doc_id", "lang", "source", (~F.ilike("text", F.lit("%licen_e%"))).alias("plain")).join(table(spark, d, "labels"), "doc_id", "left")
    legacy = F.col("source").isNotNull() & (F.col("quality").isNull() | (F.col("quality") == 0))
    return rows.groupBy("lang").agg(F.count("*").alias("scanned"), F.count_if("plain").alias("plain"), F.count_if(legacy).alias("planned"))


# Blocks, graph ---------------------------------------------------------------------------------
@query(r"WITH l AS (SELECT doc_id, unnest(x) AS t, generate_subscripts(x, 1) AS pos FROM (SELECT doc_id, string_split(text, chr(10)) AS x FROM documents)), m AS (SELECT doc_id, pos, trim(t) AS s, regexp_matches(trim(t), '^[^.!?]{1,40}$') AS h FROM l WHERE trim(t) <> ''), n AS (SELECT *, coalesce(last_value(CASE WHEN h THEN lower(split_part(s, ' ', 1)) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING), 'intro') AS section FROM m) SELECT doc_id, section, count(*) FILTER (NOT h) AS n_lines, md5(coalesce(string_agg(s, chr(10) ORDER BY pos) FILTER (NOT h), '')) AS body_hash FROM n GROUP BY doc_id, section")
def section_segment(spark, d):
    """Lines under the last heading above them; a heading that comes again goes on."""
    lines = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "t")).select("doc_id", "pos", F.trim("t").alias("s")).where("s <> ''")
    key = F.lower(F.substring_index("s", " ", 1))
    return blocks.sections(lines, "doc_id", "pos", F.col("s").rlike("^[^.!?]{1,40}$"), key, "s").select("doc_id", "section", "n_lines", F.md5("body").alias("body_hash"))


@query("SELECT conv_id, turn, next_turn FROM (SELECT conv_id, turn, role, lead(turn) OVER w AS next_turn, lead(role) OVER w AS next_role FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user' AND next_role = 'assistant'")
def qa_sibling(spark, d):
    """Questions whose next block is an answer."""
    return blocks.siblings(table(spark, d, "conversations").select("conv_id", "turn", "role"), "conv_id", "turn", F.col("role") == "user", F.col("role") == "assistant", "next_turn")


@query("WITH n AS (SELECT conv_id * 1000 + turn AS node_id, role FROM conversations), t AS (SELECT node_id AS src, unnest([node_id - 1, node_id - 3]) AS dst FROM n WHERE role = 'assistant') SELECT src, dst, count(*) AS n FROM t JOIN n ON node_id = dst GROUP BY src, dst")
def edge_materialise(spark, d):
    """Edges that nodes carry in an array, as far as both ends are there."""
    nodes = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("node_id"), "role")
    carried = nodes.select("node_id", F.when(F.col("role") == "assistant", F.array(F.col("node_id") - 1, F.col("node_id") - 3)).alias("targets"))
    return graph.materialise(nodes, carried, "targets").groupBy("src", "dst").agg(F.count("*").alias("n"))


@query(f"WITH {_NODES} SELECT src, rel, dst FROM g JOIN n ON node_id = dst")
def path_list(spark, d):
    nodes, edges = nodes_edges(spark, d)
    return edges.join(nodes.select(F.col("node_id").alias("dst")), "dst").select("src", "rel", "dst")


@query(f"WITH p AS (SELECT page_id, {_KEY} AS url, lower(regexp_extract(url, '://([^/?#]+)', 1)) AS host FROM pages), l AS (SELECT url, min(host) AS unit FROM p WHERE page_id % 2 = 0 GROUP BY url) SELECT page_id, coalesce(unit, 'LEGACY ' || p.url) AS unit, unit IS NULL AS synthetic FROM p LEFT JOIN l USING (url) WHERE page_id % 2 = 1")
def repair_link(spark, d):
    """Orphans to the unit of a lesson with their address, else to a unit of their own."""
    rows = table(spark, d, "pages").select("page_id", F.regexp_replace("url", "[?#].*$", "").alias("url"), F.lower(F.regexp_extract("url", "://([^/?#]+)", 1)).alias("host"))
    return graph.link_by(rows.where("page_id % 2 = 1").select("page_id", "url"), rows.where("page_id % 2 = 0").select("url", F.col("host").alias("unit")), "url", "unit", F.concat(F.lit("LEGACY "), "url")).select("page_id", "unit", "synthetic")


# Crawl -----------------------------------------------------------------------------------------
_HOST = "lower(regexp_extract(url, '://([^/?#]+)', 1))"


@query(f"WITH l AS (SELECT {_HOST} AS host, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS link, page_id FROM pages), f AS (SELECT host, link, min(page_id) AS seen FROM l WHERE starts_with(link, '/') GROUP BY host, link), n AS (SELECT * FROM f WHERE host || link NOT IN (SELECT {_HOST} || regexp_extract(url, '://[^/?#]+(/[^?#]*)', 1) FROM pages)) SELECT host, link, last AS segment, rank FROM (SELECT *, split_part(link, '/', -1) AS last, CAST(row_number() OVER (PARTITION BY host ORDER BY seen, link) AS INTEGER) AS rank FROM n) WHERE rank <= 20")
def crawl_frontier(spark, d):
    """At most twenty links of each host that no page has, those seen first first."""
    host = F.lower(F.regexp_extract("url", "://([^/?#]+)", 1))
    pages = table(spark, d, "pages")
    links = pages.select(host.alias("host"), F.explode(F.regexp_extract_all("html", F.lit('<a href="([^"]*)"'), 1)).alias("link"), "page_id").where(F.startswith("link", F.lit("/")))
    first = links.groupBy("host", "link").agg(F.min("page_id").alias("seen"))
    done = pages.select(host.alias("host"), F.regexp_extract("url", "://[^/?#]+(/[^?#]*)", 1).alias("link"))
    new = first.join(done.distinct(), ["host", "link"], "left_anti")
    return retrieval.ranked(new, ["host"], [F.col("seen"), F.col("link")], 20).select("host", "link", F.substring_index("link", "/", -1).alias("segment"), "rank")


@query(f"SELECT {_KEY} AS url, arg_max(trim(regexp_extract(html, '(?is)<title>(.*?)</title>', 1)), page_id) AS title FROM pages GROUP BY 1")
def last_title(spark, d):
    rows = table(spark, d, "pages").select(F.regexp_replace("url", "[?#].*$", "").alias("url"), "page_id", F.trim(F.regexp_extract("html", "(?is)<title>(.*?)</title>", 1)).alias("title"))
    return ingest.upsert(rows, "url", F.col("page_id"), [], ["title"]).select("url", "title")


# From question to hits -------------------------------------------------------------------------
# Every search of the collection (vec_id divisible by 50), asked by the text of its document.
_EVERY = "SELECT vec_id AS qid, coalesce(text, '') AS q, label AS grade FROM embeddings LEFT JOIN documents ON doc_id = vec_id WHERE vec_id % 50 = 0"
_MOST = "greatest(" + ", ".join(_NAMES) + ", lit)"
_listed = lambda names: ", ".join(map(R.quoted, names))
_UNDERSTOOD = (
    f"i AS (SELECT qid, grade, {R.sql_first_rule('lower(trim(q))', R.INTENT, 'lookup_reading')} AS intent, {_SCORES}, {R.sql_score('lower(q)', R.LITERATURE)} AS lit FROM ({_EVERY})), "
    f"s AS (SELECT qid, grade, intent, CASE WHEN intent IN ({_listed(route.LITERATURE_INTENTS)}) THEN 'ngu_van' WHEN {_MOST} = 0 THEN NULL " + " ".join(f"WHEN {n} = {_MOST} THEN '{n}'" for n in _NAMES) + " WHEN grade <= 5 THEN 'tieng_viet' ELSE 'ngu_van' END AS subject FROM i), "
    f"u AS (SELECT *, CASE WHEN intent IN ({_listed(route.NO_SEARCH)}) THEN NULL WHEN subject = 'toan' THEN 'math' WHEN subject = 'khtn' THEN 'science' WHEN subject IN ({_listed(route.SOCIAL)}) THEN 'social' WHEN subject IN ('ngu_van', 'tieng_viet') THEN CASE intent WHEN 'lookup_reading' THEN 'reading' WHEN 'explain_concept' THEN 'concepts' WHEN 'writing_outline' THEN 'outline' END WHEN intent = 'lookup_curriculum' THEN 'curriculum' ELSE 'global' END AS route FROM s)"
)
_DIM = ", ".join(f"('{s}', {k}, {low if low is not None else 'NULL'})" for s, k, low in route.COLLECTIONS)
_SOURCE = "[" + ", ".join(f"'{s}'" for s, _, _ in route.COLLECTIONS) + "][CAST(vec_id % 5 AS INTEGER) + 1]"
_best_of = "SELECT qid, source, vec_id, score, r FROM (SELECT *, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, vec_id) AS r FROM ({rows})) WHERE r <= k"
_pairs = "SELECT qid, a.source, k, p.vec_id, round(list_cosine_similarity(p.v, a.qv), 6) AS score FROM {asked} a JOIN p ON p.source = a.source"




def collection_of(n: str):
    """The collection of a point, by its number modulo 5."""
    return F.element_at(F.array(*(F.lit(s) for s, _, _ in route.COLLECTIONS)), (F.col(n) % 5 + 1).cast("int"))


def asked_all(spark: SparkSession, d: str) -> DataFrame:
    """Every search with the text of the document of its number, or no text."""
    q, _ = vectors(spark, d)
    texts = table(spark, d, "documents").select(F.col("doc_id").alias("qid"), F.col("text").alias("q"))
    return route.understand(retrieval.few(q).join(texts, "qid", "left").withColumn("q", F.coalesce("q", F.lit(""))))


@query(f"WITH {_UNDERSTOOD} SELECT qid, intent, subject, route FROM u")
def route_questions(spark, d):
    return asked_all(spark, d).select("qid", "intent", "subject", "route")


@query(f"WITH {_UNDERSTOOD}, dim(source, k, low) AS (VALUES {_DIM}), p AS (SELECT vec_id, label, {_SOURCE} AS source, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), a AS (SELECT qid, grade, dim.source, low, CASE WHEN route = 'global' THEN {route.GLOBAL_HITS} ELSE k END AS k, p.v AS qv FROM u JOIN dim ON route = dim.source OR route = 'global' JOIN p ON p.vec_id = qid), t AS ({_best_of.format(rows=_pairs.format(asked='a') + ' WHERE CASE WHEN low IS NULL THEN label BETWEEN 0 AND grade ELSE label BETWEEN greatest(low, grade - 1) AND grade + 1 END')}), e AS (SELECT * FROM a WHERE (qid, source) NOT IN (SELECT (qid, source) FROM t)), m AS (SELECT * FROM t UNION ALL {_best_of.format(rows=_pairs.format(asked='e'))}) SELECT qid, source, vec_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, source, r) AS INTEGER) AS rank FROM m) WHERE rank <= {route.MERGED}")
def retrieve_routed(spark, d):
    """Every search end to end; the collections are the points by vec_id modulo 5."""
    return route.retrieve(asked_all(spark, d), table(spark, d, "embeddings").select("vec_id", "embedding", "label", collection_of("vec_id").alias("source")))
