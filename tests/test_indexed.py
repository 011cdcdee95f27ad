"""Indexes, merged tables, walks, paths and percentiles against plain counterparts, over odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import crawl, duplicates, graph, lookup, monitor, nearest, postings, trigrams
from quern.sources.merged import Merged
from quern.streaming import upsert


# Neighbours ----------------------------------------------------------------------------------------
def cloud(n, groups, width=16, seed=0):
    rng = np.random.default_rng(seed)
    at = rng.standard_normal((groups, width))
    return at[rng.integers(0, groups, n)] + 0.2 * rng.standard_normal((n, width))


def points_of(spark, x, odd=True):
    rows = [(k, [float(c) for c in v], k % 5) for k, v in enumerate(x)]
    if odd:
        width = len(x[0])
        rows += [(10_000, None, 1), (10_001, [0.0] * width, 1), (10_002, [float("nan")] * width, 2), (10_003, [None] * width, 2), (10_004, [], 3), (10_005, [1.0], 3), (10_006, rows[3][1], None)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")


def asked_of(points, every=20):
    return nearest.unbound(points.where(f"vec_id % {every} = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("qvec")))


def plain_neighbours(points, asked, k, inside=lambda q, label: True):
    unit = lambda v: np.array(v) / np.linalg.norm(v)
    usable = lambda v, w: v and len(v) == w and None not in v and np.isfinite(v).all() and any(v)
    width = Counter(len(r.embedding) for r in points if r.embedding).most_common(1)[0][0]
    able = [(r.vec_id, unit(r.embedding), r.label) for r in points if usable(r.embedding, width)]
    out = set()
    for q in asked:
        if usable(q.qvec, width):
            v = unit(q.qvec)
            best = sorted((-round(float(v @ u), 6), i) for i, u, label in able if inside(q, label))[:k]
            out |= {(q.qid, i, n + 1) for n, (_, i) in enumerate(best)}
    return out


def test_index_finds_what_a_scan_finds(spark):
    points = points_of(spark, cloud(1500, 12))
    index, asked = nearest.built(points), asked_of(points)
    assert index.rows.count() == points.count() and index.rows.where("list < 0").count() >= 5
    exact = {(r.qid, r.vec_id, r["rank"]) for r in nearest.search(asked, index, 6, len(index.centroids)).collect()}
    assert exact == plain_neighbours(points.collect(), asked.collect(), 6)
    found = {(r.qid, r.vec_id) for r in nearest.search(asked, index, 6).collect()}
    assert len(found & {x[:2] for x in exact}) >= 0.9 * len(exact)


def test_lists_that_are_visited_grow_slower_than_the_rows(spark):
    seen = {}
    for n in (600, 5400):
        points = points_of(spark, cloud(n, 30, seed=2), odd=False)
        index, asked = nearest.built(points), asked_of(points)
        probes = nearest.tuned(asked, index, 5)
        sizes = {r["list"]: r["n"] for r in index.rows.groupBy("list").agg(F.count("*").alias("n")).collect()}
        lists = nearest.assigned(asked, index.centroids, "qvec", probes).select("list").collect()
        seen[n] = sum(sizes[r["list"]] for r in lists)
    # nine times the rows, and as many more queries: below the square (measured: a power of 1.7)
    assert seen[5400] < 9**1.85 * seen[600]


def test_bands_and_full_lists(spark, monkeypatch):
    # one list holds nearly all; parts and blocks are small
    monkeypatch.setattr(nearest, "PART", 50)
    monkeypatch.setattr(nearest, "BLOCK", 7)
    x = np.concatenate([np.ones((400, 8)) + 1e-3 * cloud(400, 1, 8, 4), cloud(60, 4, 8, 5)])
    points = points_of(spark, x)
    asked = points.where("vec_id % 9 = 0 and label is not null").selectExpr("vec_id as qid", "embedding as qvec", "label as low", "label + 1 as high")
    index = nearest.built(points, 6)
    got = {(r.qid, r.vec_id, r["rank"]) for r in nearest.search(asked, index, 4, 6).collect()}
    assert got == plain_neighbours(points.collect(), asked.collect(), 4, lambda q, label: label is not None and q.low <= label <= q.high)
    # few visited lists: queries that find too little are asked again over all
    few = {(r.qid, r.vec_id) for r in nearest.search(asked.withColumn("low", F.lit(4)).withColumn("high", F.lit(4)), index, 4, 1).collect()}
    assert Counter(q for q, _ in few) == Counter({r.qid: 4 for r in asked.collect() if r.qid < 10_000})


def test_index_without_rows(spark):
    points = points_of(spark, cloud(30, 2), odd=False)
    assert nearest.search(asked_of(points), nearest.built(points.limit(0)), 3).count() == 0
    assert nearest.search(asked_of(points).limit(0), nearest.built(points), 3).count() == 0


# Words ---------------------------------------------------------------------------------------------
def plain_all_words(rows, asked, k):
    tf = Counter(rows)
    by = {}
    for (i, w), n in tf.items():
        if i is not None and w is not None:
            by.setdefault(i, {})[w] = n
    out = set()
    for q in {q for q, w in asked}:
        need = {w for p, w in asked if p == q and w is not None}
        hits = sorted((-round(sum(1 + math.log(x[w]) for w in need), 6), i) for i, x in by.items() if need and need <= set(x))[:k]
        out |= {(q, i, n + 1) for n, (_, i) in enumerate(hits)}
    return out


def built_of(spark, rows, bucket):
    texts = spark.createDataFrame(rows, "id long, w string").groupBy("id").agg(F.array_join(F.collect_list("w"), " ").alias("t"))
    more = spark.createDataFrame([(7000, None), (7001, "")], "id long, t string")
    return postings.built(texts.unionByName(more), lambda c: F.split(c, " "), bucket)


@pytest.mark.parametrize("bucket", [1, 20, 4096])
def test_all_words(spark, bucket):
    pick = random.Random(bucket)
    vocab = [f"w{k}" for k in range(12)]
    rows = [(i, pick.choice(vocab)) for i in range(300) for _ in range(pick.randrange(14))] + [(i, "all") for i in range(300)] * 2 + [(None, "w1"), (5, None)]
    asked = [(q, pick.choice([*vocab, "all", "all", "nowhere"][: 14 + (q % 9 == 0)])) for q in range(40) for _ in range(1 + q % 4)] + [(99, None), (7, "w1"), (7, "w1")]
    index = built_of(spark, rows, bucket)
    got = postings.all_words(spark.createDataFrame(asked, "qid long, w string"), index, 5)
    assert {(r.qid, r.id, r["rank"]) for r in got.collect()} == plain_all_words(rows, asked, 5)


def test_blocks_below_the_bound_stay_closed(spark, monkeypatch):
    rows = [(i, w) for i in range(400) for w in ("a", "b") for _ in range(9 if i < 20 else 1)]
    index = built_of(spark, rows, 4)
    opened, real = [], postings.opened
    monkeypatch.setattr(postings, "opened", lambda asked, index, cells: opened.append(cells.count()) or real(asked, index, cells))
    got = postings.all_words(spark.createDataFrame([(1, "a"), (1, "b")], "qid long, w string"), index, 3).collect()
    assert [r.id for r in sorted(got, key=lambda r: r["rank"])] == [0, 1, 2]
    assert opened[0] == postings.FIRST and sum(opened) < 40 < index.select("bucket").distinct().count()


# Names ---------------------------------------------------------------------------------------------
def fits(name, title):
    if name is None or title is None:
        return False
    pattern = "".join(".*" if c == "%" else "." if c == "_" else re.escape(c) for c in name.lower())
    return re.search(f"(?s){pattern}", title.lower()) is not None


def test_names_by_trigrams(spark, monkeypatch):
    titles = ["Tấm Cám", "tấm cám và sọt cá", "Nhớ rừng", None, "", "ab", "100% thật", "a_b_c", "The River Between", "RIVER", "riverriver bank", "x" * 3000 + "needle", "riv"] + ["common title"] * 300
    names = ["tấm", "TẤM%CÁ", "riv_r", "r%r", "", None, "needle", "zzz", "common", "t_e r", "iver%ban", "%", "nhớ rừng", "common", "100"]
    works = spark.createDataFrame([(k, t, k % 9) for k, t in enumerate(titles)], "id long, title string, grade int")
    asked = spark.createDataFrame([(k, n) for k, n in enumerate(names)], "qid long, name string")
    want = {(q, i) for q, n in enumerate(names) for i, t in enumerate(titles) if fits(n, t)}
    for part in (50_000, 40):
        monkeypatch.setattr(trigrams, "PART", part)
        got = lookup.named(works, asked).select("qid", "id").collect()
        assert {tuple(r) for r in got} == want and len(got) == len(want)
    long = lookup.named(works, asked.where("name in ('needle', 'common', 'nhớ rừng')"))
    assert "NestedLoop" not in long._jdf.queryExecution().executedPlan().toString()
    assert lookup.named(works.limit(0), asked).count() == 0 and lookup.named(works, asked.limit(0)).count() == 0


# Duplicates ----------------------------------------------------------------------------------------
@pytest.mark.parametrize("block", [2048, 16])
def test_duplicates(spark, monkeypatch, block):
    monkeypatch.setattr(duplicates, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((80, 12))
    x = np.concatenate([base, base[:30] + 0.08 * rng.standard_normal((30, 12)), np.repeat(base[:1], 150, axis=0), base[:1] + 0.02 * rng.standard_normal((100, 12)), -base[:5]])
    x = x[rng.permutation(len(x))]
    points = points_of(spark, x)
    got = {r.vec_id: r.duplicate_of_id for r in duplicates.duplicates(points).collect()}
    able = [(r.vec_id, np.array(r.embedding) / np.linalg.norm(r.embedding)) for r in points.orderBy("vec_id").collect() if r.vec_id < 10_000 or r.vec_id == 10_006]
    want = dict.fromkeys(got)
    for k, (i, u) in enumerate(able):
        want[i] = next((j for j, v in able[:k] if u @ v > 0.9 + 1e-12 or np.array_equal(u, v)), None)
    assert got == want and len(got) == points.count() and sum(v is not None for v in want.values()) > 250


def test_bands_follow_from_what_may_be_missed():
    for n, least, miss in ((10**4, 0.9, 1e-6), (10**9, 0.95, 1e-4)):
        bits, bands = duplicates.shape(n, least, miss)
        assert (1 - (1 - math.acos(least) / math.pi) ** bits) ** bands <= miss and n / 2**bits <= 2 * duplicates.BUCKET


# Merged tables -------------------------------------------------------------------------------------
def rows_of(table, spark):
    return sorted((tuple(r) for r in table.read(spark).collect()), key=repr)


def test_merges_count_once_and_touch_only_their_buckets(spark, tmp_path):
    table = Merged(str(tmp_path / "t"), "url", "at", ("html",), ("hash",), buckets=8)
    batch = lambda rows: spark.createDataFrame(rows, "url string, at long, html string, hash string")
    assert table.read(spark) is None
    one = batch([("a", 1, "A1", "h1"), ("b", 2, "B2", "h2"), ("a", 3, "A3", "h3"), (None, 4, "N", "hn")])
    assert table.merge(one, "s", 0)
    first = rows_of(table, spark)
    assert first == sorted([("a", 2, "A1", "h3"), ("b", 1, "B2", "h2"), (None, 1, "N", "hn")], key=repr)
    # a batch that runs again changes nothing, whatever it holds
    before = table.manifest(spark)
    assert not table.merge(one, "s", 0) and table.manifest(spark) == before
    # late rows are older than what is there: the first value goes back, the last stays
    assert table.merge(batch([("a", 0, "A0", "h0"), ("c", 9, "C", "hc")]), "s", 1)
    assert rows_of(table, spark) == sorted([("a", 3, "A0", "h3"), ("b", 1, "B2", "h2"), ("c", 1, "C", "hc"), (None, 1, "N", "hn")], key=repr)
    after = table.manifest(spark)
    touched = {k for k in after["buckets"] if after["buckets"][k] != before["buckets"].get(k)}
    assert 1 <= len(touched) <= 2 and len(after["buckets"]) >= len(before["buckets"])
    # another source has batch numbers of its own; an empty batch is a version without changes
    assert table.merge(one.limit(0), "other", 0) and rows_of(table, spark)[0][1] == 3
    with pytest.raises(RuntimeError):
        table.publish(spark, after)


def test_a_stream_that_starts_again_merges_each_batch_once(spark, tmp_path):
    schema = "url string, at long, html string, hash string"
    for k in range(3):
        spark.createDataFrame([("a", k, f"A{k}", f"h{k}"), (f"u{k}", k, "x", "y")], schema).coalesce(1).write.parquet(str(tmp_path / f"in/{k}"))
    table = Merged(str(tmp_path / "t"), "url", "at", ("html",), ("hash",))
    stream = lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
    upsert.merge_batches(stream(), table, str(tmp_path / "log")).awaitTermination()
    want = [("a", 3, "A0", "h2"), ("u0", 1, "x", "y"), ("u1", 1, "x", "y"), ("u2", 1, "x", "y")]
    assert rows_of(table, spark) == want
    # the log is lost: all batches come again with their numbers
    upsert.merge_batches(stream(), table, str(tmp_path / "log2")).awaitTermination()
    assert rows_of(table, spark) == want


def test_points_are_sent_in_batches(spark, tmp_path):
    out = tmp_path / "sent"
    out.mkdir()

    def flush(value, rows):
        (out / f"{value}-{min(r.id for r in rows)}-{len(rows)}").write_text("\n".join(str(r.id) for r in rows))

    points = spark.range(0, 230, 1, 1).selectExpr("id", "case when id % 10 = 0 then 'small' else 'big' end as base")
    upsert.send(points, "base", 50, flush)
    sizes = sorted((p.name.split("-")[0], int(p.name.split("-")[2])) for p in out.iterdir())
    assert sizes == [("big", 7), ("big", 50), ("big", 50), ("big", 50), ("big", 50), ("small", 23)]
    assert sorted(int(x) for p in out.iterdir() for x in p.read_text().split()) == list(range(230))


# Walks ---------------------------------------------------------------------------------------------
def test_chains_of_any_length_and_circles(spark):
    edges = [(k, k + 1) for k in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (2002, 2100), (3000, 3000), (4000, 4002), (4001, 4002), (9999, 5000)]
    pages = [*range(1001), 2000, 2001, 2002, 2100, 3000, 4000, 4001, 4002, 5000, 5000]
    got = {r.page: (r.first, r.place) for r in crawl.chains(spark.createDataFrame([(p,) for p in pages], "page long"), spark.createDataFrame(edges, "src long, dst long")).collect()}
    want = {k: (0, k) for k in range(1001)} | dict.fromkeys((2000, 2001, 2002, 2100), (None, None)) | {3000: (3000, 0), 4000: (4000, 0), 4001: (4001, 0), 4002: (4000, 1), 5000: (5000, 0)}
    assert got == want
    none = spark.createDataFrame([], "page long")
    assert crawl.chains(none, spark.createDataFrame(edges, "src long, dst long")).count() == 0


def test_walks_end_where_nothing_is_new(spark):
    links = [(k, k + 1, 0, True) for k in range(40)] + [(40, 0, 0, True), (7, 7, 1, True), (3, 500, 0, False), (40, 501, 0, False), (90, 502, 0, False)]
    df = spark.createDataFrame(links, "src long, dst long, k long, sub boolean")
    start = spark.createDataFrame([(0,), (0,)], "page long")
    got = {(r.page, r.depth, r.article) for r in crawl.walk(start, df, None, None).collect()}
    assert got == {(k, k, False) for k in range(41)} | {(500, 4, True), (501, 41, True)}
    two = {(r.page, r.depth) for r in crawl.walk(start, df, 2, 20).collect()}
    assert two == {(0, 0), (1, 1), (2, 2)}


# Graph ---------------------------------------------------------------------------------------------
def test_series_go_down_three_relations(spark):
    edges = spark.createDataFrame([("l1", "EXTRACTED_TO", "k1"), ("k1", "HAS_DOCUMENT", "d1"), ("d1", "HAS_SECTION", "s1"), ("l2", "EXTRACTED_TO", "k1"), ("l1", "OTHER", "k2"), ("k2", "HAS_DOCUMENT", "d2"), ("l3", "EXTRACTED_TO", "k3"), ("k3", "HAS_DOCUMENT", "d3")], "src string, rel string, dst string")
    lessons = spark.createDataFrame([("l1", "KNTT"), ("l2", "CD"), ("l3", None)], "node_id string, series string")
    docs = spark.createDataFrame([("d1", "LEGACY"), ("d2", None), ("d3", None), ("d4", "CTST")], "node_id string, series string")
    path = ["EXTRACTED_TO", "HAS_DOCUMENT"]
    given = graph.inherit(docs, lessons, edges, path, "series", ["LEGACY"])
    assert {tuple(r) for r in given.select("node_id", "series").collect()} == {("d1", "CD"), ("d2", None), ("d3", None), ("d4", "CTST")}
    sections = spark.createDataFrame([("s1", None)], "node_id string, series string")
    assert graph.inherit(sections, given, edges, ["HAS_SECTION"], "series", []).first()["series"] == "CD"
    assert {(r.node_id, r.end) for r in graph.along(lessons, edges, [*path, "HAS_SECTION"]).collect()} == {("l1", "s1"), ("l2", "s1")}


def test_works_without_a_unit_get_one(spark):
    works = spark.createDataFrame([(1, "u1", "A", "KNTT"), (2, "u2", "B", "KNTT"), (3, "u3", "B", "KNTT"), (4, "u4", None, None), (5, "u5", "C", "XX"), (6, None, "A", "KNTT")], "id long, url string, title string, series string")
    units = spark.createDataFrame([("U1", "A", "KNTT")], "unit_id string, name string, series string")
    lessons = spark.createDataFrame([("U1", "u1"), ("U1", "u1")], "unit_id string, url string")
    made, ties, tied = graph.adopt(works, units, lessons, spark.createDataFrame([("KNTT",)], "code string"), "LEGACY")
    assert {tuple(r) for r in made.collect()} == {("U1", "A", "KNTT", False), ("new|B|KNTT", "B", "KNTT", True), ("new|u4|LEGACY", "u4", "LEGACY", True), ("new|C|XX", "C", "XX", True)}
    assert {tuple(r) for r in ties.collect()} == {("U1", 1), ("U1", 6), ("new|B|KNTT", 2), ("new|B|KNTT", 3), ("new|u4|LEGACY", 4), ("new|C|XX", 5)}
    assert {tuple(r) for r in tied.collect()} == {("KNTT", "U1"), ("KNTT", "new|B|KNTT")}


# Monitoring ----------------------------------------------------------------------------------------
def test_percentiles_are_within_their_error_and_merge(spark):
    pick = random.Random(8)
    rows = [(f"2024-01-0{1 + k % 3} {k % 24:02d}:10:00", pick.choice("ab"), pick.choice([0.0, -1.0, 10 ** pick.uniform(-3, 5)])) for k in range(4000)] + [(None, "a", 1.0), ("2024-01-01 00:00:00", "a", None)]
    events = spark.createDataFrame(rows, "t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    kept = monitor.hours(events)
    got = monitor.percentiles(kept, ["event_type"], [0.5, 0.95, 0.99]).collect()
    for r in got:
        v = sorted(x for t, e, x in rows if e == r.event_type and t and x is not None)
        assert r.n == len(v)
        for p, found in ((0.5, r.p50), (0.95, r.p95), (0.99, r.p99)):
            true = v[math.ceil(p * len(v)) - 1]
            assert abs(found - max(true, 0)) <= 1.01 * monitor.ERROR * abs(true) + 1e-6
    # hours that are kept in two parts give the same days
    halves = monitor.hours(events.where("value < 5")).unionByName(monitor.hours(events.where("value >= 5")))
    assert sorted(map(tuple, monitor.percentiles(halves, ["event_type"], [0.5, 0.95, 0.99]).collect())) == sorted(map(tuple, got))


def test_hours_of_a_stream(spark, tmp_path):
    schema = "event_type string, ts timestamp, value double"
    rows = spark.range(300).selectExpr("'a' as event_type", "timestamp_seconds(1704067200 + id * 60) as ts", "cast(id as double) as value")
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = monitor.hours(spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("ts", "1 hour"))
    stream.writeStream.format("memory").queryName("kept_hours").outputMode("complete").option("checkpointLocation", str(tmp_path / "log")).trigger(availableNow=True).start().awaitTermination()
    assert sorted(map(tuple, spark.table("kept_hours").collect()), key=repr) == sorted(map(tuple, monitor.hours(rows).collect()), key=repr)
