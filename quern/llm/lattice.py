"""LM scoring: the marginal probability of a text over all its segmentations into subwords.

The pieces come from an existing vocabulary. A word's lattice has an arc for each piece that
stands in it (its first piece begins with the word mark) and, if training texts hold the word,
one arc over the whole of it. A forward recursion in log space adds up all paths; since no piece
crosses a word's edge, a text's marginal is the product of those of its words and its end. Piece
probabilities begin at the vocabulary's own scores (ranks) and are re-estimated by expected counts
(EM) over all distinct training words; whole-word arcs have absolutely discounted training counts,
and what the discount frees weights the piece arcs. Pieces and words are weighted for each class
of training texts (their declared language: the CLASSES most frequent, all others one class); a
text's probability is the sum over the classes, whatever it declares itself.

Words are runs without white space, A-Z in lower case; the end of a text is one more token.
Counts are of all training texts, words are never cut from the vocabulary.

Cases. Null or empty text: the end only. Very long words go through the same recursion. Repeated
rows are texts of their own. A null doc_id counts as held out (no remainder). A null language is
a class like others; without such a column there is one class. Empty tables give no rows. Other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import LOWER, U, Prefix, lean, mix, raw, slices, words
from .common import chosen, discard, relieve, written

#: Bytes of text of a chunk; a task holds one with its words.
CHUNK_BYTES = 24 << 20
EM_ROUNDS = 2
#: Classes of training texts at most; beyond, the rarer languages share the last.
CLASSES = 6
FLOOR = 0.01
MARK = 1  # the byte that stands for a word's beginning
_MARK_PIECE = "▁"
END = b""  # the end token as a word; no word is empty


def vocabulary(path: str) -> list[bytes]:
    """The pieces of a SentencePiece model in the order of their scores, the mark as one byte,
    and all single bytes."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    pieces.sort(key=lambda i: (-model.get_score(i), i))
    found = {}
    for i in pieces:
        p = model.id_to_piece(i)
        if _MARK_PIECE not in p[1:]:
            found.setdefault(bytes([MARK]) * (p[0] == _MARK_PIECE) + p.lstrip(_MARK_PIECE).encode(), None)
    for b in [bytes([MARK]), *(bytes([b]) for b in range(256))]:
        found.setdefault(b, None)
    return list(found)


class Pieces:
    """Pieces with log probabilities, and sums over the lattices of many words at once."""

    def __init__(self, pieces: list[bytes], weight: np.ndarray):
        """weight: of each piece and last of a word's end, in any scale."""
        self.pieces = pieces
        self.first = np.array([p[0] == MARK for p in pieces])
        data = np.frombuffer(b"".join(pieces), np.uint8)
        size = np.array([len(p) for p in pieces])
        start = np.append(0, np.cumsum(size)[:-1])
        key = mix(Prefix(data).span(start, start + size) + size.astype(U))
        self.order = np.argsort(key)
        self.keys, self.longest = key[self.order], int(size.max())
        self.lengths = np.unique(size)
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> U(44)] = True
        self.set(weight)

    def set(self, weight: np.ndarray) -> None:
        w = weight + FLOOR
        self.logp = np.empty(len(w))
        inner = np.append(~self.first, True)
        self.logp[~inner] = np.log(w[~inner] / w[~inner].sum())
        self.logp[inner] = np.log(w[inner] / w[inner].sum())

    def spans(self, m: np.ndarray) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
        """(rows, pieces) that stand on each span (from, to) of words of equal length."""
        n, size = m.shape
        p = Prefix(np.ascontiguousarray(m).ravel())
        sums, inv = p.sums[:-1].reshape(n, size), p.inv[:-1].reshape(n, size)
        last = p.sums[size::size]
        out = {}
        for i in range(size):
            for k in self.lengths.tolist():
                j = i + k
                if j > size:
                    break
                h = mix(((last if j == size else sums[:, j]) - sums[:, i]) * inv[:, i] + U(k))
                rows = np.flatnonzero(self.seen[h >> U(44)])
                if not len(rows):
                    continue
                h = h[rows]
                at = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
                hit = self.keys[at] == h
                if hit.any():
                    out[i, j] = rows[hit], self.order[at[hit]]
        return out

    def forward(self, m: np.ndarray, spans) -> np.ndarray:
        """Log sums over all ways to reach each place of each word, the mark at place 0."""
        n, size = m.shape
        a = np.full((size + 1, n), -np.inf)
        a[0] = 0
        for (i, j), (rows, piece) in sorted(spans.items(), key=lambda x: x[0][1]):
            a[j, rows] = np.logaddexp(a[j, rows], a[i, rows] + self.logp[piece])
        return a

    def score(self, m: np.ndarray) -> np.ndarray:
        """Log marginal of each row of m, words of equal length that begin with the mark."""
        return self.forward(m, self.spans(m))[-1] + self.logp[-1]

    def expect(self, m: np.ndarray) -> np.ndarray:
        """Expected counts of pieces and of ends over the rows of m, each row once."""
        spans = self.spans(m)
        a = self.forward(m, spans)
        n, size = m.shape
        z = np.full((size + 1, n), -np.inf)
        z[size] = 0
        count = np.zeros(len(self.logp))
        for (i, j), (rows, piece) in sorted(spans.items(), key=lambda x: -x[0][0]):
            path = self.logp[piece] + z[j, rows]
            z[i, rows] = np.logaddexp(z[i, rows], path)
            # the total of a row is a[size]; what passes this arc is a[i] + path
            count += np.bincount(piece, np.exp(a[i, rows] + path - a[size, rows]), len(count))
        count[-1] = n
        return count


def by_length(data: np.ndarray, off: np.ndarray, most: int = 1 << 18) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of values of equal length, the mark before each; few bytes at once."""
    size = np.diff(off)
    for k in np.unique(size):
        rows = np.flatnonzero(size == k)
        step = max(1, most // int(k + 1))
        for s in range(0, len(rows), step):
            part = rows[s : s + step]
            m = np.empty((len(part), k + 1), np.uint8)
            m[:, 0] = MARK
            m[:, 1:] = data[off[:-1][part][:, None] + np.arange(k)]
            yield part, m


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    """Batches of words, some joined to one: work on equal lengths gains from many rows."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        held.append(b)
        if sum(x.num_rows for x in held) >= rows:
            yield from pa.Table.from_batches(held).combine_chunks().to_batches()
            held = []
    if held:
        yield from pa.Table.from_batches(held).combine_chunks().to_batches()


def tokens(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased bytes, word starts and ends, two hashes of each word, rows' places."""
    low = LOWER[data]
    start, end, at = words(low, off)
    h1, h2 = word_keys(Prefix(low).span(start, end) if len(start) else np.zeros(0, U), end - start)
    return low, start, end, h1, h2, at


def word_keys(h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of words by their rolling hashes and sizes; both are 0 for the end."""
    n = size.astype(U)
    return mix(h + n), np.where(size > 0, mix((h ^ U(0xA5A5A5A5A5A5A5A5)) * U(0x9FB21C651E98DF25) + n), U(0))


def distinct(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First places of the distinct values of h, and each value's number."""
    _, first, back = np.unique(h, return_index=True, return_inverse=True)
    return first, back


def classes(docs: DataFrame, most: int = CLASSES) -> tuple[DataFrame, list[float]]:
    """docs (doc_id, text, lang) with train and cls, and the log10 share of each class."""
    rest = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    docs = docs.withColumn("train", F.coalesce(rest != 1, F.lit(False)))
    by = docs.where("train").groupBy("lang").agg(F.count("*").alias("n"))
    total = by.agg(F.sum("n")).first()[0] or 0
    first = by.orderBy(F.desc("n"), "lang").limit(most + 1).collect()
    own = first if len(first) <= most else first[: most - 1]
    sizes = [r["n"] for r in own] + [total - sum(r["n"] for r in own)] * (len(first) > most) or [0]
    cls = F.lit(len(sizes) - 1)
    for k, r in enumerate(own):
        cls = F.when(F.col("lang").eqNullSafe(F.lit(r["lang"])), F.lit(k)).otherwise(cls)
    return docs.select("doc_id", "text", "train", cls.alias("cls")), [math.log10((n + 1) / (total + len(sizes))) for n in sizes]


def train_counts(docs: DataFrame, k: int) -> DataFrame:
    """word (binary, the end as empty) and c0 .., its counts by class, of the rows of docs (text,
    train boolean, cls); words of texts that aren't trained on are counted 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def rows():
            body = list(held.values())
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in body], pa.binary()), pa.array([x[1] for x in body], pa.int32()), pa.array([x[2] for x in body], pa.int64())], ["word", "cls", "c"])
            held.clear()
            return out

        ends = np.zeros(k, np.int64)
        for b in gathered(batches, 4_000):
            train, cls = b.column(1).to_numpy(zero_copy_only=False).astype(bool), b.column(2).to_numpy()
            for i, j, data, off in slices(b.column(0)):
                low, start, end, h1, _, at = tokens(data, off)
                own = train[i:j]
                ends += np.bincount(cls[i:j], own, k).astype(np.int64)
                times = np.diff(at)
                of = np.where(own, cls[i:j], 0)
                key = h1 + np.repeat(of, times).astype(U) * U(0xD1B54A32D192ED03)
                first, back = distinct(key)
                c = np.bincount(back, np.repeat(own, times), len(first)).astype(np.int64)
                for x, kind, p, q, n in zip(key[first].tolist(), np.repeat(of, times)[first].tolist(), start[first].tolist(), end[first].tolist(), c.tolist(), strict=True):
                    got = held.get(x)
                    if got is None:
                        held[x] = [low[p:q].tobytes(), kind, n]
                    else:
                        got[2] += n
                if len(held) > 300_000:
                    yield rows()
        if held:
            yield rows()
        yield pa.RecordBatch.from_arrays([pa.array([END] * k, pa.binary()), pa.array(np.arange(k, dtype=np.int32)), pa.array(ends)], ["word", "cls", "c"])

    counted = docs.select("text", "train", "cls").mapInArrow(lean(run), "word binary, cls int, c long")
    return counted.groupBy("word").agg(*(F.sum(F.when(F.col("cls") == i, F.col("c")).otherwise(F.lit(0))).alias(f"c{i}") for i in range(k)))


def train_pieces(counts: DataFrame, pieces: list[bytes], k: int, rounds: int = EM_ROUNDS) -> np.ndarray:
    """Weights of pieces and of the end by class (rows): each round sums expected counts over all
    distinct training words of a class (counts: word, c0 ..)."""
    weight = np.tile(np.append(1e6 / (np.arange(len(pieces)) + 100.0), 1e6 / 100), (k, 1))

    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], now: np.ndarray = weight) -> Iterator[pa.RecordBatch]:
            model, total = Pieces(pieces, now[0]), np.zeros((k, len(pieces) + 1))
            for b in gathered(batches):
                for i in range(k):
                    model.set(now[i])
                    data, off = raw(b.filter(pa.compute.greater(b.column(1 + i), 0)).column(0))
                    for _, m in by_length(data, off):
                        if m.shape[1] > 1:
                            total[i] += model.expect(m)
            cls, on = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(cls.astype(np.int32)), pa.array(on.astype(np.int32)), pa.array(total[cls, on])], ["cls", "piece", "n"])

        # one row for each piece and class: as many as the vocabulary has, however large the corpus
        got = counts.where(F.greatest(*(F.col(f"c{i}") for i in range(k)), F.lit(0)) > 0).mapInArrow(lean(run), "cls int, piece int, n double").groupBy("cls", "piece").agg(F.sum(F.round("n", 6).cast("decimal(30,6)")).cast("double").alias("n")).toArrow()
        weight = np.zeros((k, len(pieces) + 1))
        weight[got.column("cls").to_numpy(), got.column("piece").to_numpy()] = got.column("n").to_numpy()
    return weight


def lm_score(docs: DataFrame, path: str, chunk_bytes: int = CHUNK_BYTES, rounds: int = EM_ROUNDS, declared: str = "lang") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10)."""
    kinds = {"doc_id": "long", "text": "string"} | ({declared: "string"} if declared in docs.columns else {})
    relieve(docs.sparkSession)
    docs = chosen(docs, **kinds).withColumnsRenamed({declared: "lang"})
    docs, priors = classes(docs if "lang" in docs.columns else docs.withColumn("lang", F.lit(None).cast("string")))
    k, pieces = len(priors), vocabulary(path)
    counts = written(train_counts(docs, k), "words")
    each = [F.col(f"c{i}") for i in range(k)]
    every = sum(each[1:], each[0])
    t = counts.agg(F.sum(every), F.count_if(every > 0), *(x for c in each for x in (F.sum(c), F.count_if(c > 0), F.count_if(c == 1), F.count_if(c == 2)))).first()
    total, types, *own = (int(x or 0) for x in t)
    totals, kinds_of, ones, twos = (own[i::4] for i in range(4))
    discard(docs.sparkSession)
    weight = train_pieces(counts, pieces, k, rounds)
    discard(docs.sparkSession)
    discount = [min(0.95, max(0.05, a / (a + 2 * b))) if a + b else 0.5 for a, b in zip(ones, twos, strict=True)]
    share = [d * v / n if n else 1.0 for d, v, n in zip(discount, kinds_of, totals, strict=True)]

    def prices(model: Pieces, data: np.ndarray, off: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """log10 of each word by the base, and by each class: c are its counts by class (rows)."""
        spelled = np.zeros((k, len(off) - 1))
        for rows, m in by_length(data, off):
            spans = model.spans(m)
            for i in range(k):
                model.set(weight[i])
                spelled[i, rows] = model.forward(m, spans)[-1] + model.logp[-1]
        # the arc over the whole word, and all paths of pieces; an empty corpus has pieces only
        with np.errstate(divide="ignore"):
            own = [np.logaddexp(np.log(np.maximum(c[i] - discount[i], 0) / max(totals[i], 1)), math.log(share[i]) + spelled[i]) / math.log(10) for i in range(k)]
        return np.log10((c.sum(0) + 0.5) / (total + 0.5 * (types + 1))), own

    def price(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Pieces(pieces, weight[0])
        for b in gathered(batches):
            data, off = raw(b.column(0))
            size = np.diff(off)
            h1, h2 = word_keys(Prefix(data).span(off[:-1], off[1:]) if len(data) else np.zeros(len(size), U), size)
            c = np.stack([x.to_numpy() for x in b.columns[1:]])
            base, own = prices(model, data, off, c)
            yield pa.RecordBatch.from_arrays([pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)), pa.array(c.sum(0)), pa.array(base), *(pa.array(x.astype(np.float32)) for x in own)], ["h1", "h2", "c", "base", *names])

    names = [f"own{i}" for i in range(k)]
    priced = counts.mapInArrow(lean(price), "h1 long, h2 long, c long, base double, " + ", ".join(f"{n} float" for n in names))
    last = counts.where(F.length("word") == 0).first()
    c = np.array([[last[f"c{i}"] if last else 0] for i in range(k)])
    base, own = prices(Pieces(pieces, weight[0]), np.zeros(0, np.uint8), np.zeros(2, np.int64), c)
    end = int(c.sum()), float(base[0]), [float(x[0]) for x in own]

    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, math.ceil(size / chunk_bytes))
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int").alias("chunk"), "doc_id", "text", "train").repartition(chunks, "chunk")

    def own_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[np.ndarray]] = {}
        for b in batches:
            chunk = b.column(0).to_numpy()
            for x in np.unique(chunk):
                mine = b.filter(pa.array(chunk == x))
                for _, _, data, off in slices(mine.column(2)):
                    _, _, _, h1, h2, _ = tokens(data, off)
                    first, _ = distinct(h1)
                    held.setdefault(int(x), []).append(np.stack([h1[first], h2[first]]))
        for x, parts in held.items():
            both = np.concatenate(parts, axis=1)
            both = both[:, distinct(both[0])[0]].view(np.int64)
            for s in range(0, both.shape[1], 50_000):
                part = both[:, s : s + 50_000]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(part.shape[1], x, np.int32)), pa.array(part[0]), pa.array(part[1])], ["chunk", "h1", "h2"])

    needed = dealt.mapInArrow(lean(own_words), "chunk int, h1 long, h2 long").join(priced, ["h1", "h2"]).select("chunk", "h1", "c", "base", *names)

    def score(texts: pa.Table, known: pa.Table) -> pa.Table:
        h = known.column("h1").to_numpy().view(U)
        order = np.argsort(h)
        h = h[order]
        columns = [known.column(x).to_numpy()[order] for x in ("c", "base", *names)]
        out = []
        for _, _, data, off in slices(texts.column("text")):
            _, _, _, h1, _, at = tokens(data, off)
            x = np.searchsorted(h, h1)
            sums = [np.append(0, np.cumsum((v[x] > 0) if i == 0 else v[x].astype(np.float64)))[at] for i, v in enumerate(columns)] if len(h1) else [np.zeros(len(at))] * len(columns)
            known_n, b, *own = (np.diff(v) for v in sums)
            logs = np.stack([p + v + e for p, v, e in zip(priors, own, end[2], strict=True)])
            top = logs.max(0)
            out.append((np.diff(at) + 1, known_n.astype(np.int64) + (end[0] > 0), b + end[1], top + np.log10((10 ** (logs - top)).sum(0))))
        n, kn, b, s = (np.concatenate(x) for x in zip(*out, strict=True)) if out else [np.zeros(0)] * 4
        return pa.table({"doc_id": texts.column("doc_id"), "held_out": pa.compute.invert(texts.column("train")), "n_tokens": pa.array(n, pa.int64()), "n_known": pa.array(kn, pa.int64()), "train_tokens": pa.array(np.full(len(n), total), pa.int64()), "base_score": pa.array(b, pa.float64()), "score": pa.array(s, pa.float64())})

    return dealt.groupBy("chunk").cogroup(needed.groupBy("chunk")).applyInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
