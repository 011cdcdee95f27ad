"""From questions to hits: intent, subject, route, and band-filtered search by route."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions import rules as R
from quern.operators import products
from quern.operators.retrieval import ranked
from quern.sources.shared import stored

# Intents that need no search, and those that are about literature whatever the
# words say; collections with the subject or intent that leads to them, their hits, and the
# lowest label of their band (null: all labels up to the grade).
NO_SEARCH = ["greeting", "encouragement", "off_topic"]
LITERATURE_INTENTS = ["lookup_reading", "character_info", "story_summary", "explain_concept", "writing_outline", "writing_sample"]
COLLECTIONS = [("math", 3, 1), ("science", 3, 6), ("social", 3, 4), ("reading", 3, 1), ("concepts", 2, None)]
SOCIAL = ["lich_su", "dia_li", "gdcd"]
GLOBAL_HITS = 2
MERGED = 3


# Collections by subject and whether a concept is asked for (null: either), with the
# collection that stands in; and what the source or title of the best hit tells of the subject.
ROUTES = [("toan", True, "math_concepts", None), ("toan", False, "math_exercises", "math_concepts"), ("khtn", None, "science_topics", None), ("tieng_anh", True, "english_vocab", "english_sections"), ("tieng_anh", False, "english_grammar", "english_sections"), ("lich_su", None, "history_events", None), ("dia_li", None, "geography_regions", None), ("gdcd", None, "ethics_content", None)]
RETAG = [("toan", "source", ["Math", "Toán"]), ("khtn", "source", ["KHTN", "Khoa học"]), ("soc", "title", ["Xã hội"]), ("ngu_van", "source", ["Tiếng Việt", "Ngữ văn", "Khái niệm"])]
CONFIDENT = 0.5


def with_subject(rows: DataFrame) -> DataFrame:
    """rows (q, grade) with subject and confidence: that with most pattern hits, the first
    declared on a tie and literature last; confidence against the runner-up, 1 without one."""
    low = F.lower("q")
    names = [s for s, _ in R.SUBJECTS]
    scored = rows.withColumns({f"_{s}": R.score(low, p) for s, p in R.SUBJECTS} | {"_lit": R.score(low, R.LITERATURE)})
    all_of = [*(f"_{s}" for s in names), "_lit"]
    best, second = F.greatest(*all_of), F.sort_array(F.array(*all_of), asc=False)[1]
    reading = F.when(F.col("grade") <= 5, "tieng_viet").otherwise("ngu_van")
    subject = F.coalesce(*(F.when((best > 0) & (F.col(f"_{s}") == best), F.lit(s)) for s in names), F.when(best > 0, reading))
    confidence = F.when(best == 0, 0.0).otherwise(F.round(best / (best + second), 3))
    return scored.withColumns({"subject": subject, "confidence": confidence}).drop(*all_of)


def collections(rows: DataFrame) -> DataFrame:
    """rows (subject, intent) with main and other: the collection to search, and the next."""
    spark = rows.sparkSession
    dim = F.broadcast(spark.createDataFrame(ROUTES, "_s string, _c boolean, main string, other string"))
    asks = F.col("intent") == "explain_concept"
    found = rows.join(dim, (F.col("subject") == F.col("_s")) & (F.col("_c").isNull() | (F.col("_c") == asks)), "left").drop("_s", "_c")
    return found.withColumn("main", F.coalesce("main", F.lit("global"))).withColumn("other", F.coalesce("other", "main"))


def retag(subject: Column, source: Column, title: Column) -> Column:
    """The subject after a search over everything, by what its best hit says of itself."""
    out = F
    for name, where, parts in RETAG:
        at = source if where == "source" else title
        hit = F.contains(at, F.lit(parts[0]))
        for p in parts[1:]:
            hit = hit | F.contains(at, F.lit(p))
        out = out.when(hit, F.lit(name))
    return out.otherwise(subject)


def understand(queries: DataFrame) -> DataFrame:
    """queries (qid, q, grade and others) with intent, subject and route.

    The subject is that with most pattern hits, the first declared on a tie and literature last,
    as `tieng_viet` up to grade 5 and `ngu_van` above or without a grade; null without any hit.
    Routes: a collection, `outline`, `curriculum`, `global`, or null where nothing is searched.
    """
    low = F.lower("q")
    names = [s for s, _ in R.SUBJECTS]
    scored = queries.withColumns({f"_{s}": R.score(low, p) for s, p in R.SUBJECTS} | {"_lit": R.score(low, R.LITERATURE), "intent": R.first_rule(F.lower(F.trim("q")), R.INTENT, "lookup_reading")})
    best = F.greatest(*(f"_{s}" for s in names), "_lit")
    found = F.coalesce(*(F.when((best > 0) & (F.col(f"_{s}") == best), F.lit(s)) for s in names), F.when(best > 0, F.when(F.col("grade") <= 5, "tieng_viet").otherwise("ngu_van")))
    subject = F.when(F.col("intent").isin(LITERATURE_INTENTS), "ngu_van").otherwise(found)
    scored = scored.withColumn("subject", subject).drop("_lit", *(f"_{s}" for s in names))
    about, intent = F.col("subject"), F.col("intent")
    text = F.when(intent == "lookup_reading", "reading").when(intent == "explain_concept", "concepts").when(intent == "writing_outline", "outline")
    other = F.when(intent == "lookup_curriculum", "curriculum").otherwise("global")
    route = F.when(~intent.isin(NO_SEARCH), F.when(about == "toan", "math").when(about == "khtn", "science").when(about.isin(SOCIAL), "social").when(about.isin("ngu_van", "tieng_viet"), text).otherwise(other))
    return scored.withColumn("route", route)


def retrieve(routed: DataFrame, points: DataFrame) -> DataFrame:
    """qid, source, vec_id, score, rank: the best MERGED hits of each routed query (qid, qvec,
    grade, route) among points (vec_id, embedding, label, source).

    A collection without any hit in the band is searched without it. All collections go
    through one search; a global route takes GLOBAL_HITS of each and merges them by score.
    """
    spark = points.sparkSession
    # stored: a few rows for each question, that several steps read
    routed = stored(routed, "routed")
    dim = F.broadcast(spark.createDataFrame(COLLECTIONS, "source string, k int, low int"))
    wide = routed.join(dim, (F.col("route") == F.col("source")) | (F.col("route") == "global"))
    asked = wide.select("qid", "qvec", "grade", "source", "low", F.when(F.col("route") == "global", GLOBAL_HITS).otherwise(F.col("k")).alias("k"))
    begin = F.when(F.col("low").isNull(), F.lit(0)).otherwise(F.greatest("low", F.col("grade") - 1))
    end = F.when(F.col("low").isNull(), F.col("grade")).otherwise(F.col("grade") + 1)
    band = asked.withColumn("_a", begin.cast("int")).withColumn("_z", end.cast("int")).where("_a <= _z").withColumn("label", F.explode(F.sequence("_a", "_z")))
    most = max(GLOBAL_HITS, *(n for _, n, _ in COLLECTIONS))
    search = lambda on, side: ranked(products.best(side, points, most, on, ("source", "k")), ["qid", "source"], [F.desc("score"), F.col("vec_id")], most).where("rank <= k")
    strict = stored(search(("source", "label"), band), "strict")
    empty = asked.join(strict.select("qid", "source").distinct(), ["qid", "source"], "left_anti")
    both = strict.unionByName(search(("source",), empty)).withColumnRenamed("rank", "r")
    return ranked(both, ["qid"], [F.desc("score"), F.col("source"), F.col("r")], MERGED).select("qid", "source", "vec_id", "score", "rank")
