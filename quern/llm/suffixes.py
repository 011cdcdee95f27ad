"""Suffix-array dedup: bytes covered by a string of n bytes that starts anywhere else too.

Every n-byte string has an anchor, the window of GRAM bytes with the smallest hash inside it:
equal strings have equal anchors at equal places. Strings that follow each other mostly share
their anchor, and all that share it lie in one context of the text. An anchor that stands in one
place only repeats nothing and is left out. Contexts with equal hashes are counted before the
shuffle: two of them go on, are sorted and compared as all others are, and what is found for them
holds for the rest, which are told from them by two hashes of 64 bits and never compared.
Sampled splitters range-partition the anchored suffixes by their leading bytes; each bucket
sorts them by multikey quicksort, and what stands before the anchors, read backwards, too.
Neighbours in both orders, compared byte by byte, are the matches: the string that begins d
bytes before its anchor is repeated where d bytes before and n - d after are shared. All
suffixes of an anchor lie in one bucket, so no match crosses a boundary; anchors with more
contexts than HOT are not gathered but settled by counts of hashes of their strings.

Cases. Null text: empty. Texts shorter than n bytes, and empty tables, lose nothing. Matches
never cross texts. Repeated rows are texts of their own, and so remove each other. A null
doc_id is kept. Other columns are ignored by `marked` and kept by `remove_repeats`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrays import U, Prefix, groups, lean, mix, raw, runs, slices, words
from .common import chosen, discard, stowed, unstowed, written

LENGTH = 400
GRAM = 64
#: Strings that make up a passage, and the words of the shortest passage that is told of.
PASSAGE, PASSAGE_GRAM, PASSAGE_WORDS = 200, 48, 50
#: Contexts of one anchor that a task gathers; more are settled by counts.
HOT = 4000


def anchors(data: np.ndarray, off: np.ndarray, n: int, gram: int, keep: Prefix | None = None) -> tuple[np.ndarray, ...]:
    """(row, anchor, first and last start of the n-byte strings that share it), in places of data."""
    size = np.diff(off)
    if not (size >= n).any():
        return (np.zeros(0, np.int64),) * 4
    w = n - gram + 1
    key = (mix((keep or Prefix(data)).windows(gram)) & ~U(0xFFFFFFFF)) | np.arange(len(data) - gram + 1, dtype=U)
    pad = np.full(-(-len(key) // w) * w, ~U(0))
    pad[: len(key)] = key
    ahead = np.minimum.accumulate(pad.reshape(-1, w), axis=1).ravel()
    behind = np.minimum.accumulate(pad.reshape(-1, w)[:, ::-1], axis=1)[:, ::-1].ravel()
    total = len(data) - n + 1
    low = (np.minimum(behind[:total], ahead[w - 1 : w - 1 + total]) & U(0xFFFFFFFF)).astype(np.int64)
    long = np.flatnonzero(size >= n)
    count = size[long] - n + 1
    at = np.repeat(off[:-1][long] - np.append(0, np.cumsum(count)[:-1]), count) + np.arange(count.sum())
    low = low[at]
    first = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    row = np.repeat(long, count)[first]
    return row, low[first], at[first], at[np.append(first[1:], len(at)) - 1]


def contexts(docs: DataFrame, n: int, gram: int) -> DataFrame:
    """id, t1 (the text), place (of the anchor, the context's reach before it, and its number of
    strings - 1, in one number), and hashes of the anchor and of the context."""
    names = ["id", "t1", "place", "h", "ctx"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, _, data, off in slices(b.column(2)):
                hashes = Prefix(data) if len(data) >= n else None
                row, a, p, q = anchors(data, off, n, gram, hashes)
                if not len(row):
                    continue
                h = mix(hashes.span(a, a + gram))
                ctx = mix(mix(hashes.span(p, q + n)) + (a - p).astype(U) * U(0x9E3779B97F4A7C15) + (q - p).astype(U))
                place = (a - off[row]) << 32 | (a - p) << 16 | (q - p)
                take = pa.array(i + row)
                yield pa.RecordBatch.from_arrays([b.column(0).take(take), b.column(1).take(take), pa.array(place), pa.array(h.view(np.int64)), pa.array(ctx.view(np.int64))], names)

    return docs.select("id", "t1", "text").mapInArrow(lean(run), "id long, t1 long, place long, h long, ctx long")


def unpacked(place: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An anchor's place in its text, the context's reach before it, its strings - 1."""
    return place >> 32, place >> 16 & 0xFFFF, place & 0xFFFF


def extract(batches: Iterator[pa.RecordBatch], n: int, gram: int) -> Iterator[pa.RecordBatch]:
    """The wanted contexts of texts: (h, ctx, hot, copies, lead, reach, more, bytes)."""
    for b in batches:
        data, off = raw(b.column(b.schema.get_field_index("text")))
        wanted = b.column(b.schema.get_field_index("wanted"))
        owner = np.repeat(np.arange(b.num_rows), np.diff(wanted.offsets.to_numpy()))
        flat = wanted.flatten()
        cols = {f.name: flat.field(k) for k, f in enumerate(flat.type)}
        pos, reach, more = unpacked(cols["place"].to_numpy())
        begin = off[:-1][owner] + pos - reach
        end = begin + more + n
        for s in range(0, len(owner), 5000):
            part = slice(s, min(s + 5000, len(owner)))
            body = [data[x:y].tobytes() for x, y in zip(begin[part].tolist(), end[part].tolist(), strict=True)]
            lead = pa.array([x[r : r + min(16, gram)] for x, r in zip(body, reach[part].tolist(), strict=True)], pa.binary())
            get = lambda c: cols[c].slice(part.start, part.stop - part.start)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([get("h"), get("ctx"), get("hot"), get("copies"), lead, pa.array(reach[part].astype(np.int32)), pa.array(more[part].astype(np.int32)), pa.array(body, pa.binary())], ["h", "ctx", "hot", "copies", "lead", "reach", "more", "body"])


def multikey(gid: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of rows by (gid, bytes of text), and the length of the common start of each with
    the one before it (0 at a new gid). Rows are split by one word of eight bytes after the
    other, and only those that are still equal go on to the next."""
    n, words = len(gid), np.ascontiguousarray(text).view(">u8").astype(U)
    order = np.argsort(gid, kind="stable")
    group = np.cumsum(np.append(0, gid[order][1:] != gid[order][:-1]))
    common = np.where(np.append(True, group[1:] != group[:-1]), 0, -1)
    live = np.flatnonzero(common < 0)
    live = np.union1d(live, live - 1)
    for depth in range(words.shape[1]):
        if not len(live):
            break
        w = words[order[live], depth]
        inner = np.lexsort((w, group[live]))
        order[live] = order[live][inner]
        w, g = w[inner], group[live]
        cut = np.flatnonzero((g[1:] == g[:-1]) & (w[1:] != w[:-1])) + 1
        x = (w[cut] ^ w[cut - 1]).astype(U)
        zeros = np.zeros(len(x), np.int64)
        for k in range(7, 0, -1):
            zeros += (x >> U(8 * (8 - k))) == 0
        common[live[cut]] = 8 * depth + zeros
        step = np.zeros(n, np.int64)
        step[live[cut]] = 1
        group = np.cumsum(np.append(0, (group[1:] != group[:-1]) | (step[1:] > 0)))
        keep = np.zeros(n, bool)
        open_ = np.flatnonzero(common < 0)
        keep[open_] = True
        keep[open_ - 1] = True
        live = np.flatnonzero(keep)
    common[common < 0] = text.shape[1]
    return order, common


def padded(bodies: list[bytes], width: int) -> np.ndarray:
    """Rows of bytes of one width, cut or filled with zeros."""
    out = np.zeros((len(bodies), -(-width // 8) * 8), np.uint8)
    for k, x in enumerate(bodies):
        out[k, : min(width, len(x))] = np.frombuffer(x, np.uint8)[:width]
    return out


def repeated(h: np.ndarray, reach: np.ndarray, more: np.ndarray, body: list[bytes], n: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first and last distance before the anchor) of runs of strings that stand in two
    rows; rows with equal h stand together.

    Two sorts: of the suffixes that begin at the anchors, and of what stands before them, read
    backwards. A string that begins d bytes before its anchor stands in two rows if these share
    d bytes before it and n - d after: two neighbourhoods in the two orders.
    """
    count, far = len(h), n - gram
    where = reach.tolist()
    order, common = multikey(h, padded([x[r : r + n] for x, r in zip(body, where, strict=True)], n))
    back, before = multikey(h, padded([x[:r][::-1] for x, r in zip(body, where, strict=True)], far))
    after, left = np.zeros(count, np.int64), np.zeros(count, np.int64)
    least = reach - more
    found = np.zeros((far + 1, count), bool)
    for d in range(far + 1):
        rows = np.flatnonzero((least <= d) & (d <= reach))
        if len(rows) < 2:
            continue
        # n - d is over 0, so rows of two anchors never are of one class
        after[order] = np.cumsum(common < n - d)
        left[back] = np.cumsum(before < d)
        key = left[rows] * (count + 1) + after[rows]
        by = np.argsort(key, kind="stable")
        same = key[by][1:] == key[by][:-1]
        found[d, rows[by[1:][same]]] = True
        found[d, rows[by[:-1][same]]] = True
    found = found.T
    edge = np.diff(np.pad(found, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    _, last = np.nonzero(edge == -1)
    return row, first, last - 1


def marked(docs: DataFrame, n: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, t1 (a text, see `keyed`) and spans, the merged [start, end) byte ranges to remove from
    it, for the texts of docs (doc_id, text) that have any. Join it with `keyed` texts."""
    if not gram < n < 1 << 16:
        raise ValueError("a string has more bytes than its anchor, and less than 65,536")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = keyed(chosen(docs, doc_id="long", text="string")).select("id", "t1", "text").where(F.octet_length("text") >= n)
    every = written(contexts(keys, n, gram), "contexts")
    # Alike contexts are counted first, and one goes on for all: a hot passage is a few rows.
    counted = every.groupBy("h", "ctx").agg(F.count("*").alias("copies"))
    several = counted.groupBy("h").agg(F.count("*").alias("n"), F.max("copies").alias("most")).where("n > 1 or most > 1")
    known = counted.join(several.select("h", (F.col("n") > HOT).alias("hot")).hint("shuffle_hash"), "h").select("h", "ctx", "hot")
    members = written(every.join(known.hint("shuffle_hash"), ["h", "ctx"]), "repeated-contexts")
    discard(spark, every)
    at = ("id", "t1", "place")
    one = members.groupBy("h", "ctx").agg(F.count("*").alias("n"), F.first("hot").alias("hot"), *(F.first(c).alias(c) for c in at), *(F.last(c).alias(f"{c}2") for c in at))
    # Rows of one id and text meet each other's wanted places in any case.
    alike = (F.col("n") > 1) & ~((F.col("id") == F.col("id2")) & (F.col("t1") == F.col("t12")) & (F.col("place") == F.col("place2")))
    two = F.when(alike, F.array(F.struct((F.col("n") - 1).alias("copies"), *at), F.struct(F.lit(1).cast("long").alias("copies"), *(F.col(f"{c}2").alias(c) for c in at)))).otherwise(F.array(F.struct(F.col("n").alias("copies"), *at)))
    both = one.select("h", "ctx", "hot", F.inline(two))
    by_text = written(both.groupBy("id", "t1").agg(F.collect_list(F.struct("h", "ctx", "hot", "copies", "place")).alias("wanted")), "wanted")
    discard(spark)
    # Texts meet what concerns them in a shuffle, however little that is: plans don't change with size.
    # Stored, since the range sort's sample, the sort and the hot anchors read it: texts are shuffled once.
    parts_of = written(keys.join(by_text.hint("merge"), ["id", "t1"]).select("text", "wanted").mapInArrow(lean(lambda it: extract(it, n, gram)), "h long, ctx long, hot boolean, copies long, lead binary, reach int, more int, body binary"), "parts")
    discard(spark, by_text)
    any_hot = parts_of.where("hot").limit(1).count() > 0

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in groups(batches, ["h"]):
            at, s = runs(t, ["h"]), 0
            while s < len(at) - 1:  # whole anchors, of some thousand rows at once
                e = max(s + 1, int(np.searchsorted(at, at[s] + HOT, "right")) - 1)
                g = t.slice(at[s], at[e] - at[s])
                h, ctx, reach, more = (g.column(c).to_numpy() for c in ("h", "ctx", "reach", "more"))
                row, first, last = repeated(h, reach, more, g.column("body").to_pylist(), n, gram)
                if len(row):
                    # both rows of a context tell the same
                    kind = np.cumsum(np.append(True, (h[1:] != h[:-1]) | (ctx[1:] != ctx[:-1])))[row]
                    _, once = np.unique((kind * n + first) * n + last, return_index=True)
                    row, first, last = row[once], first[once], last[once]
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([*(g.column(c).combine_chunks().take(take) for c in ("h", "ctx")), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["h", "ctx", "first", "last"])
                s = e

    def strings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            reach, more = (b.column(b.schema.get_field_index(c)).to_numpy() for c in ("reach", "more"))
            data, off = raw(b.column(b.schema.get_field_index("body")))
            for k in range(b.num_rows):
                p = Prefix(data[off[k] : off[k + 1]])
                at = np.arange(more[k] + 1)
                one = mix(p.span(at, at + n) + (reach[k] - at).astype(U))
                take = pa.array(np.full(len(at), k))
                yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)).take(take) for c in ("h", "ctx", "copies")), pa.array((reach[k] - at).astype(np.int32)), pa.array(one.view(np.int64))], ["h", "ctx", "copies", "d", "f"])

    normal = parts_of.where("not hot").repartitionByRange(parts, "lead", "h").sortWithinPartitions("h", "ctx")
    kind = "h long, ctx long, first int, last int"
    found = normal.mapInArrow(lean(compare), kind)
    if any_hot:
        each = written(parts_of.where("hot").mapInArrow(lean(strings), "h long, ctx long, copies long, d int, f long"), "hot-strings")
        twice = each.groupBy("h", "f").agg(F.sum("copies").alias("n")).where("n > 1")
        found = found.unionByName(each.join(twice, ["h", "f"], "left_semi").select("h", "ctx", F.col("d").alias("first"), F.col("d").alias("last")))
    found = written(found, "matches")
    discard(spark, parts_of, *([each] if any_hot else []))
    # What holds for a context holds wherever it stands.
    spans = members.join(found.hint("shuffle_hash"), ["h", "ctx"]).select("id", "t1", (F.shiftright("place", 32) - F.col("last")).cast("int").alias("s"), (F.shiftright("place", 32) - F.col("first") + n).cast("int").alias("e"))
    spans = spans.groupBy("id", "t1").agg(F.array_sort(F.collect_set(F.struct("s", "e"))).alias("spans"))
    spans = written(spans.mapInArrow(lean(join_spans), "id long, t1 long, spans array<struct<s:int,e:int>>"), "spans")
    discard(spark, members, found)
    return spans


def keyed(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) with text (null: empty) and what a text is known by: t1, a hash of it,
    and id, its doc_id or for lack of it another hash."""
    docs = docs.withColumn("text", F.coalesce(F.col("text").cast("string"), F.lit("")))
    return docs.withColumn("t1", F.xxhash64("text")).withColumn("id", F.coalesce("doc_id", F.xxhash64(F.lit(7), "text")))


def merged(spans) -> list[tuple[int, int]]:
    """Sorted (start, end) ranges, those that touch joined."""
    out: list[list[int]] = []
    for s, e in spans:
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def join_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """id, t1 and sorted spans, with spans that overlap or touch made one."""
    for b in batches:
        at, first, last = _ranges(b, 2)
        rows = [merged(zip(first[s:e].tolist(), last[s:e].tolist(), strict=True)) for s, e in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
        off = np.append(0, np.cumsum([len(r) for r in rows])).astype(np.int32)
        flat = pa.StructArray.from_arrays([pa.array([r[k] for row in rows for r in row], pa.int32()) for k in (0, 1)], ["s", "e"])
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.ListArray.from_arrays(pa.array(off), flat)], ["id", "t1", "spans"])


def with_spans(docs: DataFrame, **kinds: tuple[int, int]) -> DataFrame:
    """docs (doc_id, text and others), with text (null: empty) and, for each name in kinds (length
    and gram), null or the sorted ranges to remove from it. All ranges come in one join."""
    spans = None
    for name, (n, gram) in kinds.items():
        own = marked(docs.select("doc_id", "text"), n, gram).withColumnRenamed("spans", name)
        spans = own if spans is None else spans.join(own, ["id", "t1"], "full")
    return keyed(docs).join(spans.hint("merge"), ["id", "t1"], "left").drop("id", "t1")


def _ranges(b: pa.RecordBatch, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    spans = b.column(k)
    if spans.null_count == len(spans):
        return np.zeros(len(spans) + 1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    size = np.array([0 if x is None else x for x in pa.compute.list_value_length(spans).to_pylist()])
    flat = spans.flatten()
    return np.append(0, np.cumsum(size)), flat.field(0).to_numpy(), flat.field(1).to_numpy()


def long_passages(data: np.ndarray, off: np.ndarray, at: np.ndarray, first: np.ndarray, last: np.ndarray, least: int) -> np.ndarray:
    """For each row the number of its ranges that hold at least so many words."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(at))
    start, end, _ = words(data, off)
    begin = off[:-1][row]
    held = np.searchsorted(end, begin + last, "right") - np.searchsorted(start, begin + first, "left")
    return np.bincount(row[held >= least], minlength=len(off) - 1)


def digest_repeats(docs: DataFrame, n: int = LENGTH, gram: int = GRAM, passage: int = PASSAGE, passage_gram: int = PASSAGE_GRAM, least_words: int = PASSAGE_WORDS) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every text of docs, and n_passages: how
    many of its runs of repeated strings of `passage` bytes hold at least least_words words. A
    passage of fifty short words may have fewer than n bytes; it is told of, not removed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(1))
            at, first, last = _ranges(b, 2)
            gone, count, sha = [], [], []
            for k in range(b.num_rows):
                text = memoryview(data[off[k] : off[k + 1]])
                cut = merged(zip(first[at[k] : at[k + 1]].tolist(), last[at[k] : at[k + 1]].tolist(), strict=True))
                h, place = hashlib.sha256(), 0
                for s, e in cut:
                    h.update(text[place:s])
                    place = e
                h.update(text[place:])
                gone.append(sum(e - s for s, e in cut))
                count.append(len(cut))
                sha.append(h.hexdigest())
            told = [long_passages(part, o, x[i : j + 1] - x[i], f[x[i] : x[j]], l[x[i] : x[j]], least_words) for x, f, l in (_ranges(b, 3),) for i, j, part, o in slices(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(off)), pa.array(gone, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array(np.concatenate([np.zeros(0, np.int64), *told]))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "n_passages"])

    rows = chosen(docs, doc_id="long", text="string")
    rows = with_spans(rows, removed=(n, gram), spans=(passage, passage_gram)).select("doc_id", "text", "removed", "spans")
    return rows.mapInArrow(lean(run), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, n_passages long")


def remove_repeats(docs: DataFrame, n: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """docs with the repeated bytes cut out of text; cut characters go as a whole. Rows keep
    their columns; a null text stays null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(0))
            at, first, last = _ranges(b, 1)
            null = b.column(2).to_numpy(zero_copy_only=False)
            for i in range(0, b.num_rows, 1000):
                j, out = min(b.num_rows, i + 1000), []
                for k in range(i, j):
                    text, kept, place = data[off[k] : off[k + 1]], [], 0
                    if null[k]:
                        out.append(None)
                        continue
                    for s, e in zip(first[at[k] : at[k + 1]].tolist(), last[at[k] : at[k + 1]].tolist(), strict=True):
                        kept.append(text[place:s].tobytes())
                        place = e
                    out.append(b"".join([*kept, text[place:].tobytes()]).decode("utf-8", "ignore"))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string()), *(c.slice(i, j - i) for c in b.columns[3:])], ["text", *b.schema.names[3:]])

    rows = stowed(docs, without="text", doc_id="long", text="string").withColumn("_null", F.col("text").isNull())
    rows = with_spans(rows, spans=(n, gram)).select("text", "spans", "_null", "_row")
    schema = T.StructType([T.StructField("text", T.StringType()), T.StructField("_row", rows.schema["_row"].dataType)])
    return unstowed(rows.mapInArrow(lean(run), schema), docs.columns, text="text")
