"""Main content of a page by text and link density, without a tag or name that marks it.

A page is cut into blocks at its block tags. Whether a block is content follows from its own words
and links and those of the blocks before and after it: long blocks with few links are, short ones
only in company. Rows of tables (cells with a bar between them) and headings stay before content;
blocks that are repeated within the page go but for the first. All in the row, no shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Shares of a block's characters in links, and words, at which blocks count as content.
LINKS, LINKS_BEFORE = 1 / 3, 5 / 9
SHORT, SHORT_NEXT, SHORT_BEFORE = 16, 15, 4
MID, MID_NEXT = 40, 17

NOISE = r"(?is)<!--.*?-->|<(?:script|style|noscript|template|iframe|head|select)\b[^>]*>.*?</(?:script|style|noscript|template|iframe|head|select)>"
#: Block tags part blocks; rows and headings say so.
ROW, HEAD = r"(?i)<tr\b[^>]*>", r"(?i)<h[1-6]\b[^>]*>"
CELL = r"(?i)</t[dh]>\s*<t[dh]\b[^>]*>"
BREAK = r"(?i)</?(?:address|article|aside|blockquote|body|center|dd|details|dialog|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|main|nav|ol|p|pre|section|summary|table|tbody|tfoot|thead|tr|ul|caption)\b[^>]*>"
LINK, TAG, SPACE = r"(?is)<a\b[^>]*>.*?</a>", r"(?s)<[^>]*(?:>|$)", r"[ \t\n\r\f\x0B]+"
#: Signs that no text holds: they part blocks, and begin rows and headings.
PART, IS_ROW, IS_HEAD = "\x01", "\x02", "\x03"


def bare(html: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(html, TAG, " "), SPACE, " "))


def blocks(html: Column) -> Column:
    """Structs of text, words, links (share), kind (of a row, a heading, or ''), in page order."""
    h = F.regexp_replace(F.translate(F.coalesce(html, F.lit("")), PART + IS_ROW + IS_HEAD, "   "), NOISE, " ")
    h = F.regexp_replace(F.regexp_replace(F.regexp_replace(h, CELL, " | "), ROW, PART + IS_ROW), HEAD, PART + IS_HEAD)
    parts = F.split(F.regexp_replace(h, BREAK, PART), PART)

    def block(p: Column) -> Column:
        kind = F.when(F.startswith(p, F.lit(IS_ROW)), "row").when(F.startswith(p, F.lit(IS_HEAD)), "head").otherwise("")
        body = F.translate(p, IS_ROW + IS_HEAD, "")
        other = F.when(F.contains(body, F.lit("<")), F.length(F.regexp_replace(F.regexp_replace(F.regexp_replace(body, LINK, " "), TAG, " "), SPACE, "")))
        return F.struct(bare(body).alias("text"), other.alias("other"), kind.alias("kind"))

    def sized(b: Column) -> Column:
        own = F.length(F.replace(b["text"], F.lit(" "), F.lit("")))
        return F.struct(b["text"].alias("text"), F.size(F.split(b["text"], " ")).alias("words"), F.coalesce((own - b["other"]) / F.greatest(own, F.lit(1)), F.lit(0.0)).alias("links"), b["kind"].alias("kind"))

    return F.transform(F.filter(F.transform(parts, block), lambda b: b["text"] != ""), sized)


def content(own: Column, before: Column, after: Column) -> Column:
    """Whether a block is content, from itself and the blocks around it (null at the ends)."""
    words = lambda b: F.coalesce(b["words"], F.lit(0))
    led = F.coalesce(before["links"], F.lit(0.0)) > LINKS_BEFORE
    alone = F.when(led, (words(own) <= MID) & (words(after) <= MID_NEXT)).otherwise((words(own) <= SHORT) & (words(after) <= SHORT_NEXT) & (words(before) <= SHORT_BEFORE))
    return (own["links"] <= LINKS) & ((own["kind"] == "row") | ~alone)


def marked(pages: DataFrame, html: str, name: str) -> DataFrame:
    """pages with name: the blocks of column html (text, content); headings are content before content.

    Each step is a column of its own: inside a lambda, Spark works an expression out again for
    every element."""
    at = lambda b, i: F.get(b, i)
    one = F.transform("_b", lambda x, i: F.struct(x["text"].alias("text"), x["kind"].alias("kind"), content(x, at(F.col("_b"), i - 1), at(F.col("_b"), i + 1)).alias("content")))
    two = F.transform("_c", lambda x, i: F.struct(x["text"].alias("text"), (F.when(x["kind"] == "head", F.coalesce(at(F.col("_c"), i + 1)["content"], F.lit(False))).otherwise(x["content"])).alias("content")))
    return pages.withColumn("_b", blocks(F.col(html))).withColumn("_c", one).withColumn(name, two).drop("_b", "_c")


def main_content(pages: DataFrame, html: str, name: str) -> DataFrame:
    """pages with name: the content blocks of column html, each text once, with a line end between."""
    texts = F.transform(F.filter("_m", lambda b: b["content"]), lambda b: b["text"])
    return marked(pages, html, "_m").withColumn(name, F.array_join(F.array_distinct(texts), "\n")).drop("_m")
