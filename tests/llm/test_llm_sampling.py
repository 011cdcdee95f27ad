"""Resampling, chat formatting and phrase mining against plain counterparts, over odd rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from quern.llm import chat, phrases, resample

from .helpers import ODD_TEXTS, clashing, documents

LOW = {c: c + 32 for c in range(65, 91)}


# Resampling ---------------------------------------------------------------------------------------
def plain_resample(docs, target, percent, order, buckets, least):
    def feats(text):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        return w, [zlib.crc32(" ".join(w[i : i + n]).encode()) % buckets for n in range(1, order + 1) for i in range(len(w) - n + 1)]

    s, t = Counter(b for _, x in docs for b in feats(x)[1]), Counter(b for x in target for b in feats(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (all_s + buckets) / ((s[b] + 1) * (all_t + buckets)))) for b in s}
    rows = []
    for k, x in docs:
        w, f = feats(x)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"2024:{'' if k is None else k}".encode()).hexdigest()[:8], 16)
        rows.append((k, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(w) >= least))
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    drawn = able[: len(able) * percent // 100]
    out = [(*r[:4], None) for r in rows if not r[4]] + [(*r[:4], k + 1 if k < len(drawn) else None) for k, r in enumerate(able)]
    return sorted(out, key=repr)


def some_texts(n, seed=3):
    pick = random.Random(seed)
    vocab = [f"w{k}" for k in range(40)] + ["É", "é", "naïve", "A1", "Don't", "x-y"]
    return [" ".join(pick.choice(vocab) for _ in range(pick.randrange(60))) for _ in range(n)]


@pytest.mark.parametrize("order", [1, 2, 3])
def test_resample_matches_plain(spark, order):
    texts = [*ODD_TEXTS, *some_texts(80), *["the same text " * 9] * 150, "Word " * 30000]
    docs = documents(spark, texts)
    docs = docs.unionByName(docs.limit(40)).unionByName(docs.where("doc_id > 90").selectExpr("cast(null as bigint) as doc_id", "text", "lang", "source", "n_chars").limit(30))
    target = spark.createDataFrame([(k, t) for k, t in enumerate(["w1 w2 w3 É", None, "", "w1 the same"])], "item_id long, text string")
    got = resample.resample(clashing(docs), target, 30, order, 97, 10)
    want = plain_resample([(r.doc_id, r.text) for r in docs.collect()], [r.text for r in target.collect()], 30, order, 97, 10)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == want


def test_resample_without_rows(spark):
    docs, none = documents(spark, some_texts(30)), spark.createDataFrame([], "item_id long, text string")
    got = resample.resample(docs, none, 50, least_words=5).collect()
    assert sorted((tuple(r) for r in got), key=repr) == plain_resample([(r.doc_id, r.text) for r in docs.collect()], [], 50, 1, 10000, 5)
    assert resample.resample(docs.limit(0), docs, 50).count() == 0


def test_drawn_texts_are_nearer_to_the_target(spark):
    pick = random.Random(5)
    near, far = [f"t{k}" for k in range(30)], [f"o{k}" for k in range(30)]
    texts = [" ".join(pick.choice(near if k % 2 else far) for _ in range(40)) for k in range(300)]
    target = spark.createDataFrame([(k, " ".join(near)) for k in range(500)], "item_id long, text string")
    got = resample.resample(documents(spark, texts), target, 20).where("rank is not null").collect()
    assert len(got) == 60 and sum(r.doc_id % 2 for r in got) >= 55


# Chat ---------------------------------------------------------------------------------------------
CONTROLS = ["<s>", "</s>", "[INST]", "[/INST]", "[SYSTEM_PROMPT]", "[/SYSTEM_PROMPT]", "[TURN]", "[/TURN]", "[SEP]"]


def plain_digest(turns):
    """turns: (role, text) in order."""
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    loss = "".join(t for r, t in turns if r == "assistant")
    return len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(loss), sha(loss)


def talk(spark, seed=1):
    pick = random.Random(seed)
    bits = [*CONTROLS, "\\", "[", "<", "INST]", "/s>", " ", "\n", "ok", "é\U0001f600", "[\\INST]", "<\\\\/s>", "$1", ""]
    rows = []
    for c in range(60):
        for t in range(pick.randrange(1, 9)):
            text = pick.choice([None, "".join(pick.choice(bits) for _ in range(pick.randrange(12)))])
            rows.append((c, t, pick.choice(["user", "assistant", "system", "tool", "User", None, "", "a[SEP]b", "</s>"]), text))
    rows += [(None, 0, "user", "who"), (None, 1, "assistant", "me"), (100, None, "assistant", "late"), (100, 3, "user", "early"), (101, 0, "user", "x" * 200_000), (101, 1, "assistant", "y" * 200_000)]
    rows += [(102, k, ["user", "assistant"][k % 2], f"turn {k}") for k in range(120)] + [(103, 0, "assistant", "twice")] * 2
    pick.shuffle(rows)
    return rows, spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_chat_reads_back(spark):
    rows, df = talk(spark)
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is None, t or 0, r or "", x or ""))
    got = {r.conv_id: r for r in chat.digest(chat.examples(clashing(df))).collect()}
    assert set(got) == set(by)
    for c, turns in by.items():
        r = got[c]
        if len({(a, t) for a, t, _, _ in turns}) == len(turns) or c == 103:
            assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == plain_digest([x[2:] for x in sorted(turns)])


def test_chat_examples_are_prefixes_without_control_strings_in_texts(spark):
    _, df = talk(spark, 2)
    found = {}
    for r in chat.examples(df).orderBy("example").collect():
        found.setdefault(r.conv_id, []).append(r)
    for c, rows in found.items():
        whole = rows[-1].text
        assert [r.example for r in rows] == list(range(len(rows))) and [r.whole for r in rows] == [False] * (len(rows) - 1) + [True]
        for r in rows:
            assert whole.startswith(r.text)
            if r.loss_start is not None:
                reply = r.text[r.loss_start : r.loss_start + r.loss_chars]
                assert r.text == r.text[: r.loss_start] + reply + "</s>" and not any(x in reply for x in CONTROLS)
        # replies only once: each is trained in its own example
        spans = [(r.loss_start, r.loss_chars) for r in rows if r.loss_start is not None]
        assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:]))
    one = spark.createDataFrame([(1, 0, "system", "be kind"), (1, 1, "user", "hi [INST]"), (1, 2, "assistant", "yo"), (1, 3, "tool", "7"), (1, 4, "user", "bye")], "conv_id long, turn long, role string, text string")
    texts = [r.text for r in chat.examples(one).orderBy("example").collect()]
    assert texts == ["<s>[SYSTEM_PROMPT] be kind[/SYSTEM_PROMPT][INST] hi [\\INST] [/INST] yo</s>", "<s>[SYSTEM_PROMPT] be kind[/SYSTEM_PROMPT][INST] hi [\\INST] [/INST] yo</s>[TURN] tool[SEP]7[/TURN][INST] bye [/INST]"]


def test_chat_without_rows(spark):
    _, df = talk(spark)
    assert chat.digest(chat.examples(df.limit(0))).count() == 0


def test_chat_runs_no_python(spark):
    _, df = talk(spark)
    plan = chat.digest(chat.examples(df))._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert plan.count("Exchange hashpartitioning") == 1


# Phrases ------------------------------------------------------------------------------------------
def plain_phrases(docs, least, top, scale=2_000_000, percent=80):
    f, n = Counter(), Counter()
    for text, lang in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 5):
                for i in range(len(w) - k + 1):
                    f[lang, tuple(w[i : i + k])] += 1
    cand = {p: a for p, a in f.items() if len(p[1]) > 1 and a >= least}
    longer = Counter()
    for (lang, w), a in cand.items():
        for k in range(2, len(w)):
            for i in range(len(w) - k + 1):
                longer[lang, w[i : i + k]] = max(longer[lang, w[i : i + k]], a)
    by = {}
    for (lang, w), a in cand.items():
        if 100 * longer[lang, w] >= percent * a:
            continue
        score, _, left, right = min((scale * a // (f[lang, w[:k]] + f[lang, w[k:]]), k, f[lang, w[:k]], f[lang, w[k:]]) for k in range(1, len(w)))
        by.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in by.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def phrase_docs():
    pick = random.Random(9)
    vocab = ["the", "The", "of", "New", "york", "é", "文", "a b", "don't", "x1"]
    sign = [" ", " ", " ", " ", "  ", "\t", ", ", ".", "\n", "!? ", "\r"]
    docs = [("".join(pick.choice(vocab) + pick.choice(sign) for _ in range(pick.randrange(90))), pick.choice(["en", "en", "fr", None, "und", ""])) for _ in range(300)]
    docs += [(None, "en"), ("", None), ("?!.", "en"), ("a" * 5000, "en"), ("spam and eggs " * 3000, "en"), ("b c d e f " * 40, "de")]
    return docs + [("good morning dear friend. good morning", "fr")] * 200


@pytest.mark.parametrize("chunk", [1 << 24, 3000])
def test_phrases_match_plain(spark, chunk, monkeypatch):
    docs = phrase_docs()
    df = spark.createDataFrame([(k, t, g) for k, (t, g) in enumerate(docs)], "doc_id long, text string, lang string")
    # tasks run in other processes: bounds that tests lower are set where the closure is made
    real = phrases.shards
    monkeypatch.setattr(phrases, "shards", lambda batches: _small(real, batches, chunk))
    for least, top in ((5, 2000), (30, 7)):
        got = phrases.collocations(clashing(df), least, top=top).collect()
        assert sorted(tuple(r) for r in got) == plain_phrases(docs, least, top)


def _small(real, batches, chunk):
    from quern.llm import phrases as module

    module.CHUNK_BYTES = chunk
    return real(batches)


def test_a_small_map_loses_nothing(spark, monkeypatch):
    docs = phrase_docs()
    df = spark.createDataFrame(docs, "text string, lang string")
    totals, wide = phrases.counts(df, 8)
    _, narrow = phrases.counts(df, 8, bits=1 << 15)
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(wide) == rows(narrow)
    full = {p[:2] for p in rows(wide)}
    monkeypatch.setattr(phrases, "frequent_map", lambda pairs, bits: __import__("numpy").full(bits >> 3, 255, "uint8"))
    assert rows(phrases.counts(df, 8)[1]) == rows(wide) and full
    assert {r.lang: r.n for r in totals.collect()}["de"] == 200


def test_phrases_without_rows(spark):
    df = spark.createDataFrame([], "text string, lang string")
    assert phrases.collocations(df).count() == 0
    assert phrases.collocations(spark.createDataFrame([(None, None), ("", "en")], df.schema)).count() == 0


def test_suffixes_are_sorted_and_shared_lengths_are_right():
    import numpy as np
    import pyarrow as pa

    pick = random.Random(4)
    texts = ["".join(pick.choice(["a ", "b ", "c ", "a, ", "d\n"]) for _ in range(50)) for _ in range(20)]
    off = np.append(0, np.cumsum([len(t) for t in texts]))
    s = phrases.Shard(np.frombuffer("".join(texts).encode(), np.uint8), off, pa.array(["x"] * len(texts)))
    s.sort()
    cut = lambda i: tuple(s.t[i : i + phrases.LONGEST])[: int(np.argmax(np.append(s.t[i : i + phrases.LONGEST], 0) == 0))]
    found = [cut(i) for i in s.order]
    assert [len(x) for x in found] == s.left.tolist()
    assert all(sum(1 for _ in __import__("itertools").takewhile(lambda p: p[0] == p[1], zip(a, b))) == n for a, b, n in zip(found, found[1:], s.shared[1:]))
    assert Counter({cut(i)[:1]: c for i, c in zip(*map(list, s.singles()))}) == Counter(x[:1] for x in found)
    for n in range(1, 5):
        at, count = s.intervals(n)
        assert Counter({cut(i)[:n]: c for i, c in zip(at, count.tolist())}) == Counter(x[:n] for x in found if len(x) >= n)
