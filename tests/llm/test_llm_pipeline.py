"""The stages of the pipeline, each over odd rows, against plain counterparts."""

import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from .helpers import ODD_TEXTS, close, shingle_set, word_list
from .test_llm_pairs import near_texts, repeated_bytes, repeating_texts

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
STAGE = dict(corpus_pipeline.STAGES)
ENGLISH = "the cat sat on the mat and then it went to the other house with all of them {}"
GERMAN = "der hund und die katze sind nicht in das haus gegangen weil es dort so dunkel war {}"


def table(spark, rows):
    return spark.createDataFrame([(k, t, lang, src, None if t is None else len(t)) for k, t, lang, src in rows], SCHEMA)


def clash(df):
    """Other columns, with names like the stages' own."""
    return df.select("*", *(F.lit(k).alias(n) for k, n in enumerate(["Text", "rep", "t1", "h", "spans", "src", "gone", "a.b", "_c0"])))


def odd_rows():
    rows = [(k, ENGLISH.format(k) if k % 2 else GERMAN.format(k), "en" if k % 2 else "de", f"s{k % 3}") for k in range(24)]
    rows += [(100 + k, t, "en", None) for k, t in enumerate(ODD_TEXTS)]
    rows += [(None, ENGLISH.format("null"), "en", "s0"), (None, None, None, None), (7, ENGLISH.format("again"), None, "s1"), rows[3], rows[3]]
    return rows


@pytest.mark.parametrize("name", [n for n, _ in corpus_pipeline.STAGES])
def test_stages_on_odd_and_empty_tables(spark, name):
    df = clash(table(spark, odd_rows()))
    out = STAGE[name](spark, df, "")
    out.collect()
    assert STAGE[name](spark, df.limit(0), "").count() == 0
    if name != corpus_pipeline.STAGES[-1][0]:
        assert out.columns == df.columns
        assert [f.dataType for f in out.schema] == [f.dataType for f in df.schema]


def test_language_stage_keeps_what_has_a_language(spark):
    rows = odd_rows()
    out = [r.text for r in STAGE["language ID"](spark, table(spark, rows), "").collect()]
    want = Counter(t for _, t, _, _ in rows if t and ("the cat" in t or "der hund" in t))
    got = Counter(t for t in out if t and ("the cat" in t or "der hund" in t))
    assert got == want
    assert not {None, "", " \t\n"} & set(out)


def test_near_copy_stage_keeps_one_of_each_class(spark):
    texts = near_texts()
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    # ids that repeat: rows alike, one that is a copy but for case, one with another text
    long = [k for k, t in enumerate(texts) if t and len(word_list(t)) > 20]
    rows += [rows[long[0]], (long[1], texts[long[1]].upper(), "en", "s"), (long[2], "quite another text than the one before", "en", "s"), (None, texts[long[3]], "en", "s")]
    sets = [shingle_set(t) if k is not None else set() for k, t, *_ in rows]
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9]
    low = close(pairs, range(len(rows)))
    classes = defaultdict(list)
    for i, (k, *_) in enumerate(rows):
        if sets[i]:
            classes[low[i]].append(k)
    want = Counter(min(ids) for ids in classes.values())
    want.update(k for i, (k, *_) in enumerate(rows) if not sets[i])
    out = STAGE["n-gram Jaccard join"](spark, clash(table(spark, rows)), "").collect()
    assert Counter(r.doc_id for r in out) == want


def test_repeat_stage_removes_repeated_bytes(spark, monkeypatch):
    monkeypatch.setattr(corpus_pipeline, "REPEAT_BYTES", 40)
    monkeypatch.setattr(corpus_pipeline, "REPEAT_GRAM", 12)
    texts = repeating_texts()
    rows = [(k, t, "en", "s") for k, t in enumerate(texts)]
    left = {}
    for k, (b, gone) in enumerate(repeated_bytes(texts, 40)):
        text = bytes(x for x, g in zip(b, gone, strict=False) if not g).decode("utf-8", "ignore")
        if texts[k] is None:
            left[k] = None
        elif any(ord(c) > 0x20 for c in text):
            left[k] = text
    out = STAGE["suffix-array dedup"](spark, table(spark, rows), "").collect()
    # a character cut in its middle goes as a whole, so texts may differ in such bytes only
    assert {r.doc_id for r in out} == set(left)
    assert all(r.text == left[r.doc_id] or abs(len(r.text) - len(left[r.doc_id])) <= 4 for r in out)
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in out)


def test_mixing_stage_repeats_rows_towards_targets(spark):
    rows = [(k, " ".join(["w"] * (k % 40 + 1)), "en", f"s{k % 3}") for k in range(3000)]
    size = Counter()
    for _, t, _, s in rows:
        size[s] += len(t.split())
    total = 1.5 * sum(size.values())
    want = {s: min(2 * size[s], total * w / 6) for s, w in zip(sorted(size), (3, 1, 2), strict=True)}
    excess = total - sum(want.values())
    for _ in range(20):
        free = {s: w for s, w in zip(sorted(size), (3, 1, 2), strict=True) if want[s] < 2 * size[s]}
        for s, w in free.items():
            want[s] = min(2 * size[s], want[s] + excess * w / sum(free.values()))
        excess = total - sum(want.values())
    out = STAGE["mixing sources to target weights"](spark, table(spark, rows), "")
    got, times = Counter(), Counter()
    for r in out.collect():
        got[r.source] += len(r.text.split())
        times[r.doc_id] += 1
    assert max(times.values()) <= 2
    for s in size:
        assert got[s] == pytest.approx(want[s], rel=0.01)
    again = STAGE["mixing sources to target weights"](spark, table(spark, rows), "")
    assert Counter(r.doc_id for r in again.collect()) == times


def test_packing_stage_places_every_token_once(spark):
    tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(tokenizers.path("word_bpe_49k.json"))
    plain.encode_special_tokens = True
    rows = odd_rows() + [(None, None, None, None)] * 200
    want = Counter()
    for k, t, *_ in rows:
        ids = plain.encode(t or "", add_special_tokens=False).ids + [0]
        want.update((k, p, s, len(ids[s : s + 2048]), zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes())) for p, s in enumerate(range(0, len(ids), 2048)))
    out = STAGE["best-fit packing"](spark, clash(table(spark, rows)), "").collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for held in by.values():
        held.sort()
        assert [o for o, _ in held] == [sum(n for _, n in held[:i]) for i in range(len(held))] and sum(n for _, n in held) <= 2048


def test_pipeline_runs_end_to_end(spark, small_dir):
    out = corpus_pipeline.run(spark, small_dir)
    docs = spark.read.parquet(f"{small_dir}/documents.parquet")
    assert out.count() > 0
    assert out.select("doc_id").distinct().join(docs, "doc_id", "left_anti").count() == 0
