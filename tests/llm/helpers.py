"""Small tables and plain counterparts of the operators."""

from __future__ import annotations

import re

SPACE = re.compile(rb"[\x20\x09-\x0D]+")
ODD_TEXTS = [None, "", " \t\n", "a", "é", "one two three four", "one two three four five", "x" * 5000, "word " * 400, "Ünïcödé 文字 \U0001f600 <|endoftext|> don't", "a b c"]


def documents(spark, texts, **columns):
    """documents with doc_id from 0, and columns whose names clash with inner ones."""
    rows = [(k, t, "en", f"src{k % 3}", len(t or "")) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df


def clashing(df):
    from pyspark.sql import functions as F

    names = ["Text", "rep", "h", "t1", "spans", "src", "_row", "size", "a.b", "chunk", "kept", "_c0"]
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(names)))


def word_list(text):
    return [w.lower() for w in SPACE.split((text or "").encode()) if w]


def shingle_set(text, n=5):
    w = word_list(text)
    return {tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set()


def close(pairs, nodes):
    low = {n: n for n in nodes}
    moved = True
    while moved:
        moved = False
        for a, b in pairs:
            m = min(low[a], low[b])
            moved |= low[a] != m or low[b] != m
            low[a] = low[b] = m
    return low
