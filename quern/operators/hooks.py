"""What stands around calls to a language model: prompts, reading of answers, and what holds where
no model answers. The model itself is a column of answers that the caller fills, null without one."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Intents, labels' default confidence, and replies that need no model.
INTENTS = ["lookup_reading", "lookup_curriculum", "lookup_specific", "explain_concept", "spelling_rule", "writing_outline", "writing_sample", "writing_feedback", "character_info", "story_summary", "greeting", "encouragement", "off_topic"]
LABEL_CONFIDENCE, INTENT_CONFIDENCE, FALLBACK_CONFIDENCE = 0.7, 0.5, 0.4
SORRY = "Xin lỗi"
LEADS = ["Câu viết lại:", "Từ khóa:"]
WELCOME = "Chào em! Chị có thể giúp gì cho em nào? 😊"
ASIDE = "Hmm, câu này không liên quan đến bài học lắm đâu em ơi. Em hỏi chị về bài học nhé!"
DIMENSIONS = "0123456789abcdef"


def unfenced(answer: Column) -> Column:
    """JSON without the fence that a model may put around it."""
    inner = F.trim(F.regexp_extract(answer, r"(?s)```(?:json)?\s*(.*?)\s*```", 1))
    return F.when(F.startswith(F.trim(answer), F.lit("```")), inner).otherwise(F.trim(answer))


def field(answer: Column, name: str) -> Column:
    """A field of a JSON answer, or null, also where the answer isn't JSON."""
    return F.get_json_object(unfenced(answer), f"$.{name}")


def label(rule: Column, answer: Column) -> tuple[Column, Column]:
    """(label, confidence): the rule's, else the model's, else noise."""
    said = field(answer, "label")
    sure = F.coalesce(field(answer, "confidence").try_cast("double"), F.lit(LABEL_CONFIDENCE))
    return F.coalesce(rule, said, F.lit("NOISE")), F.when(rule.isNotNull(), 1.0).when(said.isNotNull(), sure).otherwise(0.0)


def intent(answer: Column) -> tuple[Column, Column]:
    """(intent, confidence) of a model's answer; no answer is a reading that is looked for, and
    an intent that isn't one is off the topic."""
    said = field(answer, "intent")
    known = F.when(said.isin(INTENTS), said).otherwise("off_topic")
    sure = F.coalesce(field(answer, "confidence").try_cast("double"), F.lit(INTENT_CONFIDENCE))
    return F.when(said.isNull(), "lookup_reading").otherwise(known), F.when(said.isNull(), FALLBACK_CONFIDENCE).otherwise(sure)


def rewritten(question: Column, answer: Column) -> Column:
    """The question as the model puts it, or as it was where the model has nothing to say."""
    text = F.replace(F.when(F.contains(answer, F.lit(SORRY)), question).otherwise(answer), F.lit('"'), F.lit(""))
    for lead in LEADS:
        text = F.replace(text, F.lit(lead), F.lit(""))
    return F.when(F.length(F.trim(text)) > 2, F.trim(text)).otherwise(question)


def reply(intent: Column, hits: Column, listed: Column) -> Column:
    """An answer from templates: hits is the number of what was found, listed its lines."""
    found = F.concat(F.format_string("Chị tìm được %d kết quả cho em nè:\n", hits), listed)
    nothing = F.concat(F.lit("Chị chưa tìm thấy thông tin phù hợp cho câu hỏi của em. Intent detected: "), intent)
    return F.when(intent.isin("greeting", "encouragement"), WELCOME).when(intent == "off_topic", ASIDE).when(hits > 0, found).otherwise(nothing)


def embedded(text: Column, prefix: str) -> Column:
    """A stand-in for an embedding: how many words fall to each of sixteen hashes, the kind of
    text (`query: `, `passage: `) before it."""
    words = F.transform(F.regexp_extract_all(F.lower(F.concat(F.lit(prefix), text)), F.lit("[a-z]+"), 0), lambda w: F.substring(F.md5(w), 1, 1))
    count = lambda d: F.size(F.filter(words, lambda h: h == F.lit(d)))
    return F.array(*map(count, DIMENSIONS))


def question_prompt(grade: Column, text: Column) -> Column:
    """What a model is asked for a pupil's question about a text."""
    return F.format_string("Em là học sinh lớp %d. Đặt một câu hỏi ngắn về đoạn sau, không giải thích:\n%s", grade, F.substring(text, 1, 800))


def question(answer: Column) -> Column:
    """The question in the answer, without quotes around it, or null."""
    return F.nullif(F.trim(F.regexp_replace(F.trim(answer), '^"+|"+$', "")), F.lit(""))
