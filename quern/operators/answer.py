"""One plan for questions of every kind: each retriever sees only the questions that are routed to
it, and all that is found is one table.

Routes: vectors (`math`, `science`, `social`, `concepts`, `global`), the tiers of literature
(`reading`; `story` for characters and summaries), outlines by kind of writing and grade, lessons of
a week. Questions without a route, or without what their route needs (a kind and grade, a grade and
series), find nothing. A tier is asked only for what those before it left empty.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.operators import lookup, retrieval, route
from quern.sources.shared import stored

# Scores of what names find, by the tier that finds it.
TEXT, SUMMARY, GUIDE, OUTLINE, SAMPLE, WEEK = 1.0, 0.9, 0.85, 1.0, 0.7, 1.0
STORY = ["character_info", "story_summary"]
VECTORS = ["math", "science", "social", "concepts", "global"]


@dataclass(frozen=True)
class Bases:
    """points (vec_id, embedding, label, source); texts, summaries, guides (id, work_name, title,
    series); readings (id, title, grade, series); outlines, samples (id, kind, grade); weeks (id,
    grade, series, week)."""

    points: DataFrame
    texts: DataFrame
    summaries: DataFrame
    guides: DataFrame
    readings: DataFrame
    outlines: DataFrame
    samples: DataFrame
    weeks: DataFrame


def lesson(q: F.Column) -> F.Column:
    """The name in a question, without what leads to it and what follows, or null."""
    n = F.regexp_replace(F.regexp_replace(F.lower(F.trim(q)), R.LESSON_LEAD, ""), R.LESSON_TAIL, "")
    n = F.trim(F.regexp_replace(n, r"lớp\s+[0-9]+.*$", ""))
    return F.when(F.length(n) > 2, n)


def understood(questions: DataFrame) -> DataFrame:
    """questions (qid, q, qvec, grade, series, week) with intent, subject, route, name and kind. An
    intent that the questions already have (of a model) goes before that of the rules."""
    given = questions.withColumnRenamed("intent", "_said") if "intent" in questions.columns else questions.withColumn("_said", F.lit(None).cast("string"))
    rows = route.understand(given).withColumn("route", F.when(F.col("_said").isNull(), F.col("route")).when(F.col("_said").isin(STORY), "story").otherwise(F.col("route"))).withColumn("intent", F.coalesce("_said", "intent"))
    return rows.drop("_said").withColumns({"name": F.coalesce(lesson(F.col("q")), F.col("q")), "kind": R.first_rule(F.lower(F.trim("q")), R.WRITING, None)})


def tiers(asked: DataFrame, searches: list) -> DataFrame:
    """qid, base, id, rank, score, tier: what the first of searches (base, function of asked rows,
    score or None for its own) finds for each question."""
    found, left = None, asked
    for n, (base, search, score) in enumerate(searches):
        got = search(left)
        got = stored(got.select("qid", F.lit(base).alias("base"), F.col("id").cast("long").alias("id"), "rank", (F.col("score") if score is None else F.lit(score)).cast("double").alias("score"), F.lit(n).alias("tier")), "tier")
        found = got if found is None else found.unionByName(got)
        left = left.join(got.select("qid").distinct(), "qid", "left_anti")
    return found


def near(points: DataFrame, source: str, k: int):
    """A tier: the k nearest points of a collection in the grade's band."""
    own = points.where(F.col("source") == source)
    return lambda a: retrieval.semantic(a.select("qid", "qvec", "grade"), own, k, low=1).withColumnRenamed("vec_id", "id")


def outlined(asked: DataFrame, bases: Bases) -> DataFrame:
    asked = asked.where(F.col("kind").isNotNull() & (F.col("g") > 0))
    same = lambda a: lookup.nearest(bases.outlines.join(retrieval.few(a.select("kind", F.col("g").alias("grade")).distinct()), ["kind", "grade"], "left_semi"), a, 1).join(a.select("qid", "g"), "qid").join(bases.outlines.select("id", "grade"), "id").where("grade = g")
    return tiers(asked, [("outlines", same, OUTLINE), ("outlines", lambda a: lookup.nearest(bases.outlines, a, 1), OUTLINE), ("samples", lambda a: lookup.nearest(bases.samples, a, 2), SAMPLE), ("samples", lambda a: lookup.nearest_any(bases.samples, a, 2), SAMPLE)])


def answers(questions: DataFrame, bases: Bases) -> tuple[DataFrame, DataFrame]:
    """(questions with intent, subject and route; qid, route, base, id, rank, score, tier)."""
    asked = stored(understood(questions), "questions")
    # 0 is no grade and no series where names are looked up
    named = asked.select("qid", "route", "name", "kind", F.nullif("grade", F.lit(0)).alias("g"), F.nullif("series", F.lit("")).alias("s"), "qvec", "grade", "week")
    of = lambda *names: named.where(F.col("route").isin(*names))
    contained = lambda works: lambda a: lookup.contained(works, a)
    exact = lambda a: lookup.exact(bases.readings, a.select("qid", "name", "g", "s"))
    vectors = route.retrieve(asked.where(F.col("route").isin(VECTORS)), bases.points).select("qid", F.col("source").alias("base"), F.col("vec_id").alias("id"), "rank", "score", F.lit(None).cast("int").alias("tier"))
    reading = tiers(of("reading"), [("texts", contained(bases.texts), TEXT), ("summaries", contained(bases.summaries), SUMMARY), ("readings", exact, None), ("reading", near(bases.points, "reading", 3), None)])
    story = tiers(of("story"), [("summaries", contained(bases.summaries), SUMMARY), ("guides", contained(bases.guides), GUIDE), ("reading", near(bases.points, "reading", 2), None)])
    wanted = of("curriculum").where("g is not null and s is not null").select("qid", F.col("g").alias("grade"), F.col("s").alias("series"), F.coalesce("week", F.lit(1)).alias("week"))
    weeks = bases.weeks.join(retrieval.few(wanted), ["grade", "series", "week"])
    weeks = retrieval.ranked(weeks, ["qid"], [F.col("id")]).select("qid", F.lit("weeks").alias("base"), "id", "rank", F.lit(WEEK).alias("score"), F.lit(None).cast("int").alias("tier"))
    every = vectors
    for part in (reading, story, outlined(of("outline"), bases), weeks):
        every = every.unionByName(part)
    return asked, every.join(retrieval.few(asked.select("qid", "route")), "qid").select("qid", "route", "base", "id", "rank", "score", "tier")
