"""A query for each operator over its whole table, and SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, jaccard, language, lattice, media, mixing, neardup, packing, pages, phrases, quality, resample, suffixes
from .common import prepare


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(table(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op3_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lattice.lm_score(table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return quality.grade(docs, quality.train(docs, quality.graded(table(spark, sf_dir, "labels")), 3))


def op5_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digests(media.to_media(table(spark, sf_dir, "documents"))).drop("error")


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(table(spark, sf_dir, "documents"))


def op7_embedding_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_dedup(table(spark, sf_dir, "embeddings"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op9_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest_repeats(table(spark, sf_dir, "documents"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), 10)


#: A conversation of control strings, beside those of the table.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def op12_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = "conv_id long, turn long, role string, text string"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    return chat.digest(chat.examples(rows.unionByName(spark.createDataFrame(PROBE, kinds))))


def op13_phrase_mining(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def language_id_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op10's operator where all four kinds of evidence speak: main texts of pages, the language
    that their markup declares, the suffix of their address, and their host."""
    rows = table(spark, sf_dir, "pages")
    said = rows.select("page_id", F.nullif(F.regexp_extract("html", r"(?i)<html[^>]*\blang=[\"']?([a-z]+)", 1), F.lit("")).alias("lang"), pages.host_of("url").alias("host"))
    texts = pages.extract(rows).join(said, "page_id").select(F.col("page_id").alias("doc_id"), "text", "lang", "host")
    return language.identify(texts, "lang", "host").withColumnRenamed("doc_id", "page_id")


QUERIES = {f.__name__: f for f in (op1_ngram_jaccard_join, op2_best_fit_packing, op3_lm_scoring, op4_quality_classifier, op5_media_columns, op6_source_mixing, op7_embedding_neardup, op8_html_extraction, op9_suffix_array_dedup, op10_language_id, op11_importance_resampling, op12_chat_formatting, op13_phrase_mining, language_id_pages)}

_COMPONENTS = """
, reach(a, b) AS (SELECT {id}, {id} FROM {nodes} UNION SELECT r.a, p.b FROM reach r JOIN both_ways p ON r.b = p.a)
, comp AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
"""

OP1_SQL = (
    r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
f AS (SELECT doc_id, w, min(doc_id) OVER (PARTITION BY w) AS rep, count(*) OVER (PARTITION BY w) AS copies FROM d WHERE len(w) > 0),
r AS (SELECT DISTINCT rep, w, copies FROM f),
s AS (SELECT DISTINCT rep, unnest(list_transform(range(1, greatest(len(w) - 4, 1) + 1), lambda i: list_aggregate(w[i:i + 4], 'string_agg', ' '))) AS g FROM r),
n AS (SELECT rep, count(*) AS m FROM s GROUP BY rep),
p AS (SELECT x.rep AS a, y.rep AS b, count(*) AS inter FROM s x JOIN s y ON x.g = y.g AND x.rep < y.rep GROUP BY 1, 2),
link AS (SELECT a, b FROM p JOIN n u ON u.rep = a JOIN n v ON v.rep = b WHERE inter >= 0.8 * (u.m + v.m - inter) - 1e-9),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link)"""
    + _COMPONENTS.format(id="rep", nodes="r")
    + """
, c AS (SELECT k.a, sum(r.copies) AS k FROM both_ways k JOIN r ON r.rep = k.b GROUP BY k.a)
SELECT d.doc_id, coalesce(comp.c, d.doc_id) AS class_id, coalesce(f.rep, d.doc_id) AS copy_of, CAST(coalesce(c.k, 0) + coalesce(f.copies - 1, 0) AS BIGINT) AS n_links, coalesce(comp.c, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN f ON f.doc_id = d.doc_id LEFT JOIN comp ON comp.a = f.rep LEFT JOIN c ON c.a = f.rep
"""
)

OP7_SQL = (
    """
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
link AS (SELECT x.vec_id AS a, y.vec_id AS b FROM v x JOIN v y ON x.label = y.label AND x.vec_id < y.vec_id WHERE list_cosine_similarity(x.e, y.e) >= 0.93),
both_ways AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link)"""
    + _COMPONENTS.format(id="vec_id", nodes="v")
    + """
, c AS (SELECT a, count(*) AS k FROM both_ways GROUP BY a)
SELECT v.vec_id, CAST(coalesce(c.k, 0) AS BIGINT) AS n_links, comp.c AS component_id, v.vec_id = comp.c AS kept
FROM v JOIN comp ON comp.a = v.vec_id LEFT JOIN c ON c.a = v.vec_id
"""
)

OP11_SQL = """
WITH RECURSIVE bits(i, k, c) AS (SELECT CAST(range AS BIGINT), 0, CAST(range AS BIGINT) FROM range(256) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
m AS (SELECT regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark),
x AS (SELECT doc_id, unnest(w) AS w FROM d), y AS (SELECT unnest(w) AS w FROM m),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM x UNION SELECT w FROM y)),
b AS (SELECT w, xor(list_reduce(list_transform(range(1, length(h), 2), lambda i: CAST('0x' || substr(h, i, 2) AS BIGINT)), lambda c, z: xor(c >> 8, t[xor(c & 255, z) + 1]), 4294967295), 4294967295) % 10000 AS b FROM v, crc),
s AS (SELECT b, count(*) AS s FROM x JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM y JOIN b USING (w) GROUP BY b),
g AS (SELECT b, CAST(floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((s + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b)),
q AS (SELECT doc_id, CAST(floor(sum(g)::DOUBLE / count(*)) AS BIGINT) AS weight FROM x JOIN b USING (w) JOIN g USING (b) GROUP BY doc_id),
r AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN q USING (doc_id)),
p AS (SELECT doc_id, n_features, weight, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS k FROM p)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND k <= (SELECT count(*) * 10 // 100 FROM p WHERE n_features >= 20) THEN k END AS rank FROM o
"""

_CONTROL = r"[\[<]\\*(?:/?(?:INST|SYSTEM_PROMPT|TURN)\]|SEP\]|/?s>)"
OP12_SQL = rf"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT * FROM (VALUES {', '.join(f"({i}, {t}, '{r}', '{x}')" for i, t, r, x in PROBE)})),
e AS (SELECT *, length(text) + len(regexp_extract_all(text, '{_CONTROL}')) AS said FROM c),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) = 1 AS last, sum(said + CASE role WHEN 'user' THEN 15 WHEN 'system' THEN 32 WHEN 'assistant' THEN 5 ELSE 19 + length(role) + len(regexp_extract_all(role, '{_CONTROL}')) END) OVER (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING) AS z FROM e)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(z + 3) FILTER (role = 'assistant' OR last) AS BIGINT) AS formatted_chars, count(*) FILTER (role = 'assistant' OR last) AS n_examples
FROM p GROUP BY conv_id
"""

OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]') AS p FROM documents),
s AS (SELECT lang, regexp_extract_all(unnest(p), '[^\x20\x09]+') AS w FROM d),
o AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM s),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM (SELECT *, unnest([1, 2, 3, 4]) AS k FROM o) WHERE i + k - 1 <= len(w)),
n AS (SELECT lang, count(*) AS n FROM o GROUP BY lang),
f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30),
c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
u AS (SELECT lang, phrase, a, w, unnest(range(1, k)) AS cut FROM c),
v AS (SELECT u.lang, u.phrase, u.a, u.cut, x.f AS l, y.f AS r, CAST(2000000::HUGEINT * u.a // (x.f + y.f) AS BIGINT) AS score FROM u JOIN f x ON x.lang = u.lang AND x.phrase = array_to_string(w[1:cut], ' ') JOIN f y ON y.lang = u.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
b AS (SELECT lang, phrase, a, l, r, score FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS j FROM v) WHERE j = 1),
z AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(a) AS longer FROM (SELECT lang, a, w, k, i, unnest([2, 3]) AS m FROM (SELECT *, unnest(range(1, k + 1)) AS i FROM c WHERE k > 2)) WHERE m < k AND i + m - 1 <= k GROUP BY ALL),
q AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, a DESC, b.phrase) AS rank FROM b LEFT JOIN z ON z.lang = b.lang AND z.phrase = b.phrase WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank, phrase, a, l, r, n, score FROM q JOIN n USING (lang) WHERE rank <= 2000
"""

ORACLE_SQL = {"op1_ngram_jaccard_join": OP1_SQL, "op7_embedding_neardup": OP7_SQL, "op11_importance_resampling": OP11_SQL, "op12_chat_formatting": OP12_SQL, "op13_phrase_mining": OP13_SQL}
