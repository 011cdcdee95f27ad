"""State that runs through ordered blocks, as windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def offsets(blocks: DataFrame, doc: str, order: str, text: str) -> DataFrame:
    """blocks with dom_order, char_start, char_end; one separator between blocks."""
    w = W.partitionBy(doc).orderBy(order)
    start = F.coalesce(F.sum(F.length(text) + 1).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return blocks.withColumn("dom_order", F.row_number().over(w) - 1).withColumn("char_start", start.cast("long")).withColumn("char_end", F.col("char_start") + F.length(text))


def carry(blocks: DataFrame, doc: str, order: str, is_source: Column, value: str, name: str) -> DataFrame:
    """blocks with the value of the nearest source block before each."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return blocks.withColumn(name, F.last(F.when(is_source, F.col(value)), ignorenulls=True).over(w))


def pairs(blocks: DataFrame, doc: str, order: str, is_question: Column, is_answer: Column, text: str) -> DataFrame:
    """doc, pair, question, answer: a question with all answers up to the next; questions
    without an answer have no number."""
    w = W.partitionBy(doc).orderBy(order)
    marked = blocks.withColumn("_q", F.sum(is_question.cast("int")).over(w)).where("_q > 0")
    body = marked.groupBy(doc, "_q").agg(F.min(F.when(is_question, F.struct(order, text))).getField(text).alias("question"), F.array_sort(F.collect_list(F.when(is_answer, F.struct(order, text)))).alias("_a"))
    body = body.where(F.size("_a") > 0).withColumn("answer", F.array_join(F.transform("_a", lambda x: x[text]), "\n"))
    return body.withColumn("pair", F.row_number().over(W.partitionBy(doc).orderBy("_q")).cast("long")).select(doc, "pair", "question", "answer")


def take_while(blocks: DataFrame, doc: str, order: str, stop: Column) -> DataFrame:
    """blocks before the first that stops."""
    w = W.partitionBy(doc).orderBy(order)
    return blocks.withColumn("_s", F.max(stop.cast("int")).over(w)).where("_s = 0").drop("_s")


def sections(lines: DataFrame, doc: str, order: str, is_header: Column, key: Column, text: str) -> DataFrame:
    """doc, section, n_lines, body: lines under the last header above them, `intro` before the
    first; headers with equal keys share a section."""
    w = W.partitionBy(doc).orderBy(order).rowsBetween(W.unboundedPreceding, 0)
    lines = lines.withColumn("_h", is_header)
    placed = lines.withColumn("section", F.coalesce(F.last(F.when(F.col("_h"), key), ignorenulls=True).over(w), F.lit("intro")))
    own = F.array_sort(F.collect_list(F.when(~F.col("_h"), F.struct(order, text))))
    return placed.groupBy(doc, "section").agg(F.count_if(~F.col("_h")).alias("n_lines"), F.array_join(F.transform(own, lambda x: x[text]), "\n").alias("body"))


def siblings(blocks: DataFrame, doc: str, order: str, is_question: Column, is_answer: Column, name: str) -> DataFrame:
    """doc, order, name: questions and the place of the answer right after them."""
    w = W.partitionBy(doc).orderBy(order)
    near = blocks.withColumn("_q", is_question).withColumn(name, F.lead(order).over(w)).withColumn("_a", F.lead(is_answer).over(w))
    return near.where("_q and _a").select(doc, order, name)


def _strip(c: Column) -> Column:
    return F.regexp_replace(F.replace(c, F.lit("**"), F.lit("")), r"^\s+|\s+$", "")


def exercises(texts: DataFrame, doc: str, text: str, marks: list[str]) -> DataFrame:
    """doc, part, problem, solution, has_figure: blocks between bold numbered headings, cut at
    the first of marks (in their order) that they hold; blocks without one, and solutions of
    fewer than ten characters, go."""
    parts = texts.select(doc, F.posexplode(F.split(text, r"\n\s*\*\*\s*(?:CH|Câu|Bài)\s*[0-9]+\s*\*\*")).alias("part", "_b"))
    mark = F.coalesce(*(F.when(F.contains(F.col("_b"), F.lit(m)), F.lit(m)) for m in marks))
    cut = parts.withColumn("_m", mark).where("_m is not null")
    problem = F.expr("substring_index(substring_index(substring_index(_b, _m, 1), '**Phương pháp giải:**', 1), 'Phương pháp giải:', 1)")
    cut = cut.select(doc, "part", _strip(problem).alias("problem"), _strip(F.expr("substring(_b, locate(_m, _b) + length(_m))")).alias("solution"))
    return cut.where(F.length("solution") >= 10).withColumn("has_figure", F.lower("problem").rlike("hình |sơ đồ|quan sát"))


def numbered(texts: DataFrame, doc: str, text: str, method: str, answer: str) -> DataFrame:
    """doc, part, problem, solution, has_figure: chunks that begin at numbered headings, cut at the
    method or else the answer; the solution is the answer or else the method."""
    chunks = F.split(F.regexp_replace(text, r"\n(([A-Za-z ]+ )?(?:Câu|Bài) [0-9]+)", "\x01$1"), "\x01")
    parts = texts.select(doc, F.posexplode(chunks).alias("part", "_b"))
    has = lambda m: F.contains(F.col("_b"), F.lit(m))
    after = lambda m: F.expr(f"substring(_b, locate('{m}', _b) + {len(m)})")
    problem = F.when(has(method), F.substring_index("_b", method, 1)).otherwise(F.substring_index("_b", answer, 1))
    trim = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")
    cut = parts.where(has(method) | has(answer)).select(doc, "part", problem.alias("_p"), trim(F.when(has(answer), after(answer)).otherwise(after(method))).alias("solution"))
    figure = F.contains("_p", F.lit("Hình ")) | F.contains(F.lower("_p"), F.lit("hình vẽ"))
    return cut.select(doc, "part", trim(F.col("_p")).alias("problem"), "solution", figure.alias("has_figure"))
