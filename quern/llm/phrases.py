"""Phrase collocation mining: phrases of two words or more that stand together more often than
their parts would let expect, for each language.

Each shard (a run of about CHUNK_BYTES of text of one task) numbers its words, sorts its suffixes by
prefix doubling in numpy (ranks by one word give ranks by two, these by four) and compares
neighbours for the length of their common prefix. Suffixes that share n words or more lie in one
interval; its length is the n-gram's count in the shard. Counts are merged by key over all shards.

Three passes over the texts keep the merge small without losing a count: words, pairs, phrases. A
pair can only be frequent if both words are, and a phrase if every pair in it is; all others are left
out before the merge. What is frequent goes to the tasks as a map of MAP_BITS bits of hashes: its
size is fixed, and hashes that share a bit only let more through. Pairs are merged by hash, for the
map alone; the counts of words and phrases are exact, by the words themselves.

Score: a phrase cut in two has its count over the sum of its parts' counts, and the lowest-scoring
cut counts. A phrase inside a longer one that has nearly its count is dropped.

Cases. A-Z are lowered; words are parted by blank and tab, pieces by `.,;:!?` and line ends, and no
phrase goes over a piece's end. Null or empty texts have no words; a null language is `und`. Repeated
rows count each time. Very long texts are shards of their own. Empty tables give no rows. Ties go by
the phrase in the order of its UTF-8 bytes. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .arrays import LOWER, U, Prefix, from_bytes, lean, mix, raw, words
from .common import chosen, discard, small, written

#: Bytes of text of a shard; a task holds one with its suffixes (about forty times as much).
CHUNK_BYTES = 4 << 20
MAP_BITS = 1 << 26
#: Rows that a task gives out at once.
BATCH = 1 << 15
LONGEST = 4
CUT = np.zeros(256, bool)
CUT[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
APART = CUT.copy()
APART[[0x20, 0x09]] = True


class Shard:
    """The words of some texts, their suffixes in order, and how much neighbours share."""

    def __init__(self, data: np.ndarray, off: np.ndarray, langs: pa.Array):
        data = LOWER[data]
        start, end, at = words(data, off, APART)
        row = np.repeat(np.arange(len(off) - 1), np.diff(at))
        spelled = from_bytes(data[~APART[data]], end - start, pa.string()).dictionary_encode()
        lang = langs.dictionary_encode()
        self.words, self.langs = spelled.dictionary, lang.dictionary
        # a token is a word in a language, numbered from 1; 0 is the end of a piece
        key = lang.indices.to_numpy().astype(np.int64)[row] * len(self.words) + spelled.indices.to_numpy()
        self.keys, token = np.unique(key, return_inverse=True)
        cuts = np.append(0, np.cumsum(CUT[data]))
        new = np.ones(len(start), bool)
        new[1:] = (cuts[start[1:]] != cuts[end[:-1]]) | (row[1:] != row[:-1])
        place = np.arange(len(start)) + np.cumsum(new) - 1
        self.t = np.zeros((place[-1] + 1 if len(place) else 0) + LONGEST, np.int64)
        self.t[place] = token + 1

    def sort(self) -> None:
        """The suffixes in order, how many words each has left in its piece, and how many it
        shares with the one before it."""
        n = len(self.t) - LONGEST
        if not n:
            self.order, self.shared, self.left = np.zeros((3, 0), np.int64)
            return
        two = self.double(self.t[:n], self.t[1 : n + 1])
        order = self.double(two, np.append(two[2:], [0, 0])[:n], rank=False)
        self.order = order[self.t[order] > 0]
        whole = self.t != 0
        self.left, self.shared = np.zeros((2, len(self.order)), np.int64)
        inside, alike = np.ones((2, len(self.order)), bool)
        for k in range(LONGEST):
            here = self.order + k
            inside &= whole[here]
            self.left += inside
            alike[1:] &= inside[1:] & (self.t[here[1:]] == self.t[here[:-1]])
            alike[:1] = False
            self.shared += alike

    @staticmethod
    def double(first: np.ndarray, then: np.ndarray, rank: bool = True) -> np.ndarray:
        """Suffixes by twice as many words: their ranks from 1, or their order."""
        key = first * (int(then.max()) + 1) + then
        order = np.argsort(key)
        if not rank:
            return order
        key = key[order]
        out = np.empty(len(key), np.int64)
        out[order] = np.cumsum(np.append(True, key[1:] != key[:-1]))
        return out

    def intervals(self, n: int, keep: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of each different n-gram; of those of `keep` (by suffix) only."""
        own = self.left >= n
        where, shared = self.order[own], self.shared[own]
        first = np.flatnonzero(shared < n)
        count = np.diff(np.append(first, len(where)))
        at = where[first]
        if keep is not None:
            held = keep[at]
            at, count = at[held], count[held]
        return at, count

    def spell(self, at: np.ndarray, n: int) -> tuple[pa.Array, pa.Array]:
        """Languages and phrases of the n words from each place."""
        lang = self.keys[self.t[at] - 1] // max(1, len(self.words))
        parts = [self.words.take(pa.array(self.keys[self.t[at + k] - 1] % max(1, len(self.words)))) for k in range(n)]
        return self.langs.take(pa.array(lang)), parts[0] if n == 1 else pc.binary_join_element_wise(*parts, " ")

    def word_hashes(self) -> np.ndarray:
        """Of each token, in its language."""
        size = max(1, len(self.words))
        return mixed(hashes(self.words)[self.keys % size], hashes(self.langs)[self.keys // size])

    def pair_hashes(self, at: np.ndarray) -> np.ndarray:
        """Of the two tokens from each place."""
        h = self.word_hashes()
        return mixed(h[self.t[at] - 1], h[self.t[at + 1] - 1])

    def singles(self) -> tuple[np.ndarray, np.ndarray]:
        """A place and the count of each token."""
        at = np.zeros(len(self.keys) + 1, np.int64)
        at[self.t] = np.arange(len(self.t))
        return at[1:], np.bincount(self.t, minlength=len(self.keys) + 1)[1:]


def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
    """Shards of rows (text, lang), in runs of whole texts."""
    held, size = [], 0

    def made() -> Shard:
        t = pa.Table.from_batches(held).combine_chunks()
        data, off = raw(t.column("text"))
        return Shard(data[off[0] : off[-1]], off - off[0], t.column("lang").chunk(0))

    for batch in batches:
        for k in range(0, batch.num_rows, 64):
            part = batch.slice(k, 64)
            n = pc.sum(pc.binary_length(part.column(0))).as_py() or 0
            if held and size + n > CHUNK_BYTES:
                yield made()
                held, size = [], 0
            held.append(part)
            size += n
    if held:
        yield made()


def hashes(values: pa.Array) -> np.ndarray:
    """Of strings, by their bytes and lengths."""
    data, off = raw(values)
    return mix(Prefix(data[off[0] : off[-1]]).span(off[:-1] - off[0], off[1:] - off[0]) + np.diff(off).astype(U)) if len(values) else np.zeros(0, U)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * U(0x9E3779B97F4A7C15) + b)


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word, f."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches):
            at, count = s.singles()
            lang, word = s.spell(at, 1)
            yield pa.RecordBatch.from_arrays([lang, word, pa.array(count)], ["lang", "word", "c"])

    return docs.mapInArrow(lean(run), "lang string, word string, c long").groupBy("lang", "word").agg(F.sum("c").alias("f"))


def pair_counts(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """h, f: hashes of the pairs of words that may both be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches):
            s.sort()
            known = np.append(False, held(shared.value, s.word_hashes()))
            at, count = s.intervals(2, known[s.t[:-1]] & known[s.t[1:]])
            h = s.pair_hashes(at).view(np.int64)
            for k in range(0, len(h), BATCH):
                yield pa.RecordBatch.from_arrays([pa.array(h[k : k + BATCH]), pa.array(count[k : k + BATCH])], ["h", "c"])

    return docs.mapInArrow(lean(run), "h long, c long").groupBy("h").agg(F.sum("c").alias("f"))


def held(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Whether a map of bits has each of the hashes."""
    slot = h.view(np.int64) % (len(bits) << 3)
    return (bits[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1 == 1


def frequent_map(pairs: DataFrame, bits: int) -> np.ndarray:
    """A bit for each of the hashes h, `bits` in all: the only thing that goes to the driver."""
    slot = F.pmod(F.col("h"), F.lit(bits)) + 1  # buckets of bits are numbered from 1
    # written: the shuffles of a step that ended in a table can go
    maps = written(pairs.select(slot.alias("s")).groupBy(F.bitmap_bucket_number("s").alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("s")).alias("m")), "map")
    out = np.zeros(max(bits >> 3, 4096), np.uint8)
    for r in maps.collect():
        at = (r["k"] - 1) * 4096
        out[at : at + 4096] = np.frombuffer(r["m"], np.uint8)
    return out


def phrase_counts(docs: DataFrame, frequent: np.ndarray, longest: int) -> DataFrame:
    """lang, phrase, words, f: the phrases of two words or more whose pairs may all be frequent."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for s in shards(batches):
            s.sort()
            keep = np.zeros(len(s.t), bool)
            # of each pair one place is looked up; all places of its interval share the answer
            at, count = s.intervals(2)
            keep[s.order[s.left >= 2]] = np.repeat(held(shared.value, s.pair_hashes(at)), count)
            pair, left = keep.copy(), len(keep)
            for n in range(2, longest + 1):
                if n > 2:
                    keep[: left - n + 2] &= pair[n - 2 :]
                at, count = s.intervals(n, keep)
                for k in range(0, len(at), BATCH):
                    lang, phrase = s.spell(at[k : k + BATCH], n)
                    yield pa.RecordBatch.from_arrays([lang, phrase, pa.array(np.full(len(lang), n, np.int32)), pa.array(count[k : k + BATCH])], ["lang", "phrase", "words", "c"])

    found = docs.mapInArrow(lean(run), "lang string, phrase string, words int, c long")
    return found.groupBy("lang", "phrase", "words").agg(F.sum("c").alias("f"))


def counts(docs: DataFrame, least: int, longest: int = LONGEST, bits: int = MAP_BITS) -> tuple[DataFrame, DataFrame]:
    """(lang, n: all words; lang, phrase, words, f: phrases of 1 to longest words with f >= least)."""
    docs = chosen(docs, text="string", lang="string").withColumn("lang", F.coalesce("lang", F.lit("und")))
    often = F.col("f") >= least
    # rare words are only needed for their languages' totals
    ones = written(word_counts(docs).groupBy("lang", F.when(often, F.col("word")).alias("phrase")).agg(F.sum("f").alias("f")), "words")
    totals = ones.groupBy("lang").agg(F.sum("f").alias("n"))
    ones = ones.where("phrase is not null").select("lang", "phrase", F.lit(1).alias("words"), "f")
    # what a pass has shuffled is not needed by the next
    discard(docs.sparkSession)
    words_map = frequent_map(hashed_words(ones), bits)
    pairs = frequent_map(pair_counts(docs, words_map).where(often).select("h"), bits)
    discard(docs.sparkSession)
    more = written(phrase_counts(docs, pairs, longest).where(often), "phrases")
    discard(docs.sparkSession)
    return totals, ones.unionByName(more)


def hashed_words(ones: DataFrame) -> DataFrame:
    """h of each lang and phrase of one word, as shards make them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(mixed(hashes(b.column(1)), hashes(b.column(0))).view(np.int64))], ["h"])

    return ones.select("lang", "phrase").mapInArrow(run, "h long")


def collocations(docs: DataFrame, least: int = 30, longest: int = LONGEST, scale: int = 2_000_000, percent: int = 80, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the first `top` phrases of each language."""
    totals, found = counts(docs, least, longest)
    n_found = found.count()
    parts = small(found.select("lang", F.col("phrase").alias("part"), "f"), n_found, 200_000)
    phrases = found.where("words > 1").select("lang", "phrase", "words", F.col("f").alias("a"))
    piece = lambda w, a, n: F.array_join(F.slice(w, a, n), " ")
    w = F.split("phrase", " ")
    cuts = phrases.select("*", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k")).select("lang", "phrase", "a", "k", piece(w, F.lit(1), F.col("k")).alias("first"), piece(w, F.col("k") + 1, F.col("words") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "f": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"part": "rest", "f": "r"}), ["lang", "rest"])
    wide = lambda c: F.col(c).cast("decimal(19,0)")
    score = F.expr(f"(cast(a as decimal(19,0)) * cast({scale} as decimal(9,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("x"))
    # each phrase inside a longer one, with the highest count among those that hold it
    spans = F.explode(F.filter(F.flatten(F.transform(F.sequence(F.lit(2), F.col("words") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("words") - n + 1), lambda i: piece(w, i, n)))), lambda p: p != ""))
    inside = phrases.where("words > 2").select("lang", "a", spans.alias("phrase")).groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(small(inside, n_found * 3, 200_000), ["lang", "phrase"], "left").where(F.col("longer").isNull() | (100 * wide("longer") < percent * wide("a")))
    order = W.partitionBy("lang").orderBy(F.desc("x.score"), F.desc("a"), "phrase")
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("x.l").alias("l"), F.col("x.r").alias("r"), "n", F.col("x.score").alias("score"))
