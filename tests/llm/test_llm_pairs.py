"""N-gram Jaccard join, suffix-array dedup and embedding near-dedup against brute force."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from quern.llm import arrays, jaccard, neardup, suffixes

from .helpers import ODD_TEXTS, clashing, close, documents, shingle_set


def near_texts(seed=3):
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(300)]
    texts = list(ODD_TEXTS)
    for _ in range(12):
        base = [rng.choice(words) for _ in range(rng.randint(6, 120))]
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(rng.choice([" ", "\n"]).join(copy).upper() if rng.random() < 0.2 else " ".join(copy))
    return texts


def jaccard_brute(texts):
    sets = [shingle_set(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    links = Counter(x for p in pairs for x in p)
    low = close(pairs, range(len(texts)))
    return {(k, low[k], links[k]) for k in range(len(texts))}


def test_jaccard_join_is_brute_force(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BUCKET_BLOCK", 3)
    monkeypatch.setattr(jaccard, "GROUP_BLOCK", 2)
    texts = near_texts()
    got = jaccard.jaccard_join(clashing(documents(spark, texts)))
    assert got.columns == ["doc_id", "class_id", "copy_of", "n_links", "kept"]
    assert {(r.doc_id, r.class_id, r.n_links) for r in got.collect()} == jaccard_brute(texts)


def test_jaccard_join_repeats_nulls_and_empty(spark):
    df = documents(spark, ["a b c d e f", "x y"])
    rows = {(r.doc_id, r.class_id, r.n_links) for r in jaccard.jaccard_join(df.union(df).union(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1)], df.schema))).collect()}
    assert rows == {(0, 0, 1), (1, 1, 1), (None, None, 0)}
    assert jaccard.jaccard_join(df.limit(0)).count() == 0


def test_pruning_bound():
    from math import comb

    for n in (16, 160):
        m = jaccard.least_matches(n, 0.8, 1e-6)
        tail = lambda k: sum(comb(n + 1, x) * 0.8**x * 0.2 ** (n + 1 - x) for x in range(k + 1))  # noqa: B023, E731
        assert tail(m) >= 1e-6 and (m == 0 or tail(m - 1) < 1e-6)


def repeated_bytes(texts, n):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + n] for b in data for i in range(len(b) - n + 1))
    for b in data:
        gone = np.zeros(len(b) + 1, bool)
        for i in range(len(b) - n + 1):
            if seen[b[i : i + n]] > 1:
                gone[i : i + n] = True
        yield b, gone


def repeats_brute(texts, n, passage, words):
    out = []
    for k, ((b, gone), (_, near)) in enumerate(zip(repeated_bytes(texts, n), repeated_bytes(texts, passage), strict=True)):
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        spans = [m.span() for m in re.finditer(rb"[^\x20\x09-\x0D]+", b)]
        edge = np.flatnonzero(np.diff(np.append(False, near).astype(int)))
        told = sum(sum(s <= x and y <= e for x, y in spans) >= words for s, e in zip(edge[::2], edge[1::2], strict=True))
        out.append((k, len(b), int(gone.sum()), int((gone[1:] < gone[:-1]).sum()), hashlib.sha256(kept).hexdigest(), told))
    return set(out)


def repeating_texts(seed=5):
    rng = random.Random(seed)
    line = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    shared = [line(rng.randint(30, 160)) for _ in range(6)]
    texts = [*ODD_TEXTS, "z" * 300, "ab" * 100, shared[0], shared[0]]
    for _ in range(25):
        texts.append("".join(rng.choice([line(rng.randint(0, 80)), rng.choice(shared), rng.choice(shared)[: rng.randint(20, 100)]]) for _ in range(4)))
    return texts


@pytest.mark.parametrize("hot", [4000, 3])
def test_repeats_are_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(suffixes, "HOT", hot)
    texts = repeating_texts()
    got = suffixes.digest_repeats(clashing(documents(spark, texts)), 40, 12, 24, 8, 3)
    want = repeats_brute(texts, 40, 24, 3)
    assert {tuple(r) for r in got.collect()} == want
    assert {r[5] for r in want} > {0, 1}


def test_texts_meet_their_places_once(spark, monkeypatch):
    """Also where anchors are hot: else a larger input would shuffle its texts twice."""
    plans, write = [], suffixes.written
    monkeypatch.setattr(suffixes, "HOT", 3)
    monkeypatch.setattr(suffixes, "written", lambda df, name: plans.append((name, df._jdf.queryExecution().optimizedPlan().toString())) or write(df, name))
    suffixes.marked(documents(spark, repeating_texts()), 40, 12)
    assert "hot-strings" in dict(plans)
    assert [name for name, plan in plans if "Join" in plan and "wanted" in plan] == ["parts"]


def test_repeats_of_rows_alike_and_null_ids(spark):
    df = documents(spark, ["a passage that stands in two rows", "alone", None])
    twice = df.union(df).union(df.selectExpr("CAST(NULL AS BIGINT)", "text", "lang", "source", "n_chars"))
    rows = sorted((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_removed, r.n_passages) for r in suffixes.digest_repeats(twice, 20, 8, 10, 5, 3).collect())
    assert rows == sorted((null, 0 if null else k, n, n if n > 20 else 0, int(n > 20)) for k, n in ((0, 33), (1, 5), (2, 0)) for null in (False, False, True))


def test_repeats_on_empty_and_removal(spark):
    df = documents(spark, ["q" * 10 + "shared passage of some length here" + "é" * 3, "shared passage of some length here!", None, "short"])
    assert suffixes.digest_repeats(df.limit(0), 20, 8).count() == 0
    wide = clashing(df)
    out = suffixes.remove_repeats(wide, 20, 8)
    assert out.columns == wide.columns
    assert {(r[0], r[1]) for r in out.collect()} == {(0, "q" * 10 + "é" * 3), (1, "!"), (2, None), (3, "short")}


def test_multikey_order():
    rng = np.random.default_rng(1)
    text = rng.integers(0, 2, (200, 24)).astype(np.uint8)
    text[:, 5:] = 0
    gid = rng.integers(0, 5, 200)
    order, common = suffixes.multikey(gid, text)
    want = sorted(range(200), key=lambda k: (gid[k], bytes(text[k])))
    assert [(gid[k], bytes(text[k])) for k in order] == [(gid[k], bytes(text[k])) for k in want]
    for k in range(1, 200):
        a, b = text[order[k - 1]], text[order[k]]
        same = 0 if gid[order[k - 1]] != gid[order[k]] else int(np.argmin(np.append(a == b, False)))
        assert common[k] == same


def test_neardup_is_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(30, 16))
    x = np.concatenate([base, base[:10] + 0.15 * rng.normal(size=(10, 16)), base[:3], np.repeat(base[4:5], 9, axis=0)]).astype(np.float32)
    rows = [(k, [float(v) for v in e], int(k % 2) if k < 40 else 0) for k, e in enumerate(x)]
    rows += [(100, None, 0), (101, [0.0] * 16, 0), (102, [float("nan")] + [1.0] * 15, 0), (103, [1.0, None], 0), (104, rows[0][1], None), (105, [], 0), (106, [1.0] * 8, 0), (107, [1.0] * 8, 0), (108, [float("inf")] * 16, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    good = {r[0]: (np.array(r[1], np.float32).astype(float), r[2]) for r in rows if r[0] < 100 or r[0] in (106, 107)}
    pairs = [(a, b) for a in good for b in good if a < b and good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] / np.sqrt((good[a][0] @ good[a][0]) * (good[b][0] @ good[b][0])) >= 0.93]
    links, low = Counter(v for p in pairs for v in p), close(pairs, [r[0] for r in rows])
    for block in (2048, 5):
        got = neardup.near_dedup(clashing(df), block=block).collect()
        assert {tuple(r) for r in got} == {(r[0], links[r[0]], low[r[0]], low[r[0]] == r[0]) for r in rows}
    assert neardup.near_dedup(df.limit(0)).count() == 0


def test_equal_angles_fill_blocks(spark, monkeypatch):
    """A dimension with fewer vectors than components has no axes; its vectors still make blocks."""
    rng = np.random.default_rng(7)
    x = rng.normal(size=(60, 64))
    x[30:40] = x[:10] + 0.05 * rng.normal(size=(10, 64))
    rows = [(k, [float(v) for v in e], 0) for k, e in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    tables = {}
    keep = neardup.written
    monkeypatch.setattr(neardup, "written", lambda t, name: tables.setdefault(name, keep(t, name)))
    got = {r.vec_id: (r.n_links, r.component_id) for r in neardup.near_dedup(df, block=10).collect()}
    assert got == {k: (int(k < 10 or 30 <= k < 40), k - 30 if 30 <= k < 40 else k) for k in range(60)}
    held = [r["count"] for r in tables["vectors-by-angle"].groupBy("own").count().collect()]
    assert len(held) >= 4 and max(held) <= 30


def test_labels_and_words():
    assert list(arrays.labels(6, np.array([5, 4, 1]), np.array([4, 2, 0]))) == [0, 0, 2, 3, 2, 2]
    data = np.frombuffer(b" a bb\x0bccdd", np.uint8)
    start, end, at = arrays.words(data, np.array([0, 0, 7, 10]))
    assert [bytes(data[s:e]) for s, e in zip(start, end, strict=True)] == [b"a", b"bb", b"c", b"cdd"]
    assert list(at) == [0, 0, 3, 4]
