"""Queries around a language model, each with its SQL; what the model says is written into the
query (by length or number of the row), so that every way of answering and of failing comes up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.operators import hooks, retrieval
from quern.plans.catalogue import ORACLE_SQL, QUERIES, query
from quern.plans.curation import _V2, asked_all
from quern.plans.knowledge import _KB, readings
from quern.sources.tables import table

_SAID = ['```json\n{"label": "QUESTION", "intent": "story_summary", "confidence": 0.9}\n```', '{"label": "SOLUTION", "intent": "gossip"}', "sorry", None, '```\n{"label": "NOISE", "intent": "greeting", "confidence": "high"}\n```']
_ANSWER = "CASE length(text) % 5 " + " ".join(f"WHEN {k} THEN {R.quoted(a) if a else 'NULL'}" for k, a in enumerate(_SAID)) + " END"
_BARE = r"CASE WHEN starts_with(trim(ans), '```') THEN trim(regexp_extract(ans, '(?s)```(?:json)?\s*(.*?)\s*```', 1)) ELSE trim(ans) END"
_FIELD = "json_extract_string(TRY_CAST(j AS JSON), '$.{f}')"
_RULE = "CASE " + " ".join(f"WHEN regexp_matches(lower(text), '{p}') THEN '{n}'" for n, p in _V2) + " END"


def said(n: Column) -> Column:
    return F.element_at(F.array(*(F.lit(a).cast("string") for a in _SAID)), (n % 5 + 1).cast("int"))


_ANSWERED = f"a AS (SELECT *, {_BARE} AS j FROM (SELECT conv_id, turn, text, {_ANSWER} AS ans FROM conversations))"


@query(f"WITH {_ANSWERED}, f AS (SELECT *, {_RULE} AS rule, {_FIELD.format(f='label')} AS l, TRY_CAST({_FIELD.format(f='confidence')} AS DOUBLE) AS c FROM a) SELECT conv_id, turn, coalesce(rule, l, 'NOISE') AS label, CASE WHEN rule IS NOT NULL THEN 1.0::DOUBLE WHEN l IS NOT NULL THEN coalesce(c, 0.7::DOUBLE) ELSE 0.0::DOUBLE END AS confidence FROM f")
def label_fallback(spark, d):
    """Blocks that no rule knows get the model's label, or are noise where it has none."""
    rule = R.first_rule(F.lower("text"), [(n, [p]) for n, p in _V2], None)
    label, sure = hooks.label(rule, said(F.length("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", label.alias("label"), sure.alias("confidence"))


@query(f"WITH {_ANSWERED}, f AS (SELECT *, {_FIELD.format(f='intent')} AS i, TRY_CAST({_FIELD.format(f='confidence')} AS DOUBLE) AS c FROM a) SELECT conv_id, turn, CASE WHEN i IS NULL THEN 'lookup_reading' WHEN i IN ({', '.join(map(R.quoted, hooks.INTENTS))}) THEN i ELSE 'off_topic' END AS intent, CASE WHEN i IS NULL THEN 0.4::DOUBLE ELSE coalesce(c, 0.5::DOUBLE) END AS confidence FROM f")
def intent_fallback(spark, d):
    """A model's intent, checked; a reading is looked for where there is no answer."""
    intent, sure = hooks.intent(said(F.length("text")))
    return table(spark, d, "conversations").select("conv_id", "turn", intent.alias("intent"), sure.alias("confidence"))


_PUT = "CASE length(text) % 4 WHEN 0 THEN 'Xin lỗi, không rõ' WHEN 1 THEN 'Từ khóa: \"' || substr(text, 1, 20) || '\"' WHEN 2 THEN ' x ' END"


@query(f"SELECT conv_id, turn, md5(CASE WHEN length(trim(t)) > 2 THEN trim(t) ELSE text END) AS question FROM (SELECT *, replace(replace(replace(CASE WHEN contains(ans, 'Xin lỗi') THEN text ELSE ans END, '\"', ''), 'Câu viết lại:', ''), 'Từ khóa:', '') AS t FROM (SELECT conv_id, turn, text, {_PUT} AS ans FROM conversations))")
def rewrite_cleanup(spark, d):
    """Questions as a model puts them, cleaned; the question itself where that leaves nothing."""
    n = F.length("text") % 4
    put = F.when(n == 0, "Xin lỗi, không rõ").when(n == 1, F.concat(F.lit('Từ khóa: "'), F.substring("text", 1, 20), F.lit('"'))).when(n == 2, " x ")
    return table(spark, d, "conversations").select("conv_id", "turn", F.md5(hooks.rewritten(F.col("text"), put)).alias("question"))


@query(f"WITH {_KB}, a AS (SELECT *, CASE id % 3 WHEN 0 THEN '{{\"lop\": ' || (id % 12 + 1) || ', \"bo_sach\": \"CD\"}}' WHEN 1 THEN 'lớp 9' END AS j FROM kb WHERE grade = 7 AND series = 'KNTT' AND title NOT ILIKE '%kết nối tri thức%') SELECT id, coalesce(TRY_CAST({_FIELD.format(f='lop')} AS INTEGER), grade) AS new_grade, coalesce({_FIELD.format(f='bo_sach')}, series) AS new_series, {_FIELD.format(f='lop')} IS NOT NULL AS answered FROM a")
def metadata_audit(spark, d):
    """Rows whose series is in doubt, with the grade and series that a model says; a dry run."""
    rows = readings(spark, d).where("grade = 7 and series = 'KNTT'").where(~F.ilike("title", F.lit("%kết nối tri thức%")))
    ans = F.when(F.col("id") % 3 == 0, F.format_string('{"lop": %d, "bo_sach": "CD"}', F.col("id") % 12 + 1)).when(F.col("id") % 3 == 1, "lớp 9")
    grade = hooks.field(ans, "lop")
    return rows.select("id", F.coalesce(grade.try_cast("int"), "grade").alias("new_grade"), F.coalesce(hooks.field(ans, "bo_sach"), "series").alias("new_series"), grade.isNotNull().alias("answered"))


_LISTED = "string_agg('📖 [' || rank || '] ' || coalesce(title, '') || chr(10) || '   ' || coalesce(substr(text, 1, 200), '') || '...', chr(10) ORDER BY rank)"


@query(f"WITH {_KB}, r AS ({ORACLE_SQL['retrieve_routed']}), i AS ({ORACLE_SQL['route_questions']}), c AS (SELECT qid, count(*) AS n, {_LISTED} AS listed FROM r LEFT JOIN kb ON id = vec_id GROUP BY qid) SELECT qid, md5(CASE WHEN intent IN ('greeting', 'encouragement') THEN '{hooks.WELCOME}' WHEN intent = 'off_topic' THEN '{hooks.ASIDE}' WHEN n > 0 THEN 'Chị tìm được ' || n || ' kết quả cho em nè:' || chr(10) || listed ELSE 'Chị chưa tìm thấy thông tin phù hợp cho câu hỏi của em. Intent detected: ' || intent END) AS answer FROM i LEFT JOIN c USING (qid)")
def templated_answers(spark, d):
    """Answers without a model, for every search."""
    hits = QUERIES["retrieve_routed"](spark, d)
    rows = readings(spark, d).select(F.col("id").alias("vec_id"), "title", F.substring("text", 1, 200).alias("text")).join(retrieval.few(hits), "vec_id", "right")
    line = F.format_string("📖 [%d] %s\n   %s...", "rank", F.coalesce("title", F.lit("")), F.coalesce("text", F.lit("")))
    got = retrieval.context(rows.select("qid", "rank", "title", "text"), line)
    return asked_all(spark, d).select("qid", "intent").join(got, "qid", "left").select("qid", F.md5(hooks.reply(F.col("intent"), F.coalesce("n", F.lit(0)), F.col("context"))).alias("answer"))


_BUCKETS = "[" + ", ".join(f"CAST(len(list_filter(w, lambda x: x = '{c}')) AS INTEGER)" for c in hooks.DIMENSIONS) + "]"


@query(f"SELECT conv_id, turn, {_BUCKETS} AS vector FROM (SELECT conv_id, turn, list_transform(regexp_extract_all(lower(CASE WHEN role = 'user' THEN 'query: ' ELSE 'passage: ' END || text), '[a-z]+'), lambda x: substr(md5(x), 1, 1)) AS w FROM conversations)")
def hash_embed(spark, d):
    """Questions and passages as counts of their words' hashes, with the prefix of their kind."""
    text = F.col("text")
    vector = F.when(F.col("role") == "user", hooks.embedded(text, "query: ")).otherwise(hooks.embedded(text, "passage: "))
    return table(spark, d, "conversations").select("conv_id", "turn", vector.alias("vector"))


@query(f"WITH {_KB} SELECT id, md5('Em là học sinh lớp ' || grade || '. Đặt một câu hỏi ngắn về đoạn sau, không giải thích:' || chr(10) || substr(text, 1, 800)) AS prompt, trim(regexp_replace(ans, '^\"+|\"+$', '', 'g')) AS question FROM (SELECT *, CASE WHEN id % 3 = 0 THEN '\"câu hỏi ' || id || '\"' END AS ans FROM kb) WHERE ans IS NOT NULL")
def question_prompts(spark, d):
    """Prompts for questions about readings, and the questions; rows without one go."""
    ans = F.when(F.col("id") % 3 == 0, F.format_string('"câu hỏi %d"', "id"))
    rows = readings(spark, d).select("id", F.md5(hooks.question_prompt(F.col("grade"), F.col("text"))).alias("prompt"), hooks.question(ans).alias("question"))
    return rows.where("question is not null")


@query("SELECT lang AS subject, count(*) AS n, round(avg((1 + 2 * quality + 2 * (1 - toxic)) / 5.0::DOUBLE), 6) AS faithfulness FROM documents JOIN labels USING (doc_id) GROUP BY lang")
def faithfulness(spark, d):
    """A judge's marks of one to five, as a mean share, by subject."""
    marks = table(spark, d, "labels").select("doc_id", (1 + 2 * F.col("quality") + 2 * (1 - F.col("toxic"))).alias("mark"))
    rows = table(spark, d, "documents").select("doc_id", F.col("lang").alias("subject")).join(marks, "doc_id")
    return rows.groupBy("subject").agg(F.count("*").alias("n"), F.round(F.avg(F.col("mark") / 5.0), 6).alias("faithfulness"))
