"""Best-fit packing: whole texts become token pieces, pieces become full training sequences.

Bounded-space online best-fit. A task holds a fixed number of open sequences in a bitset keyed
by free space. A piece goes to the open sequence with the least free space that holds it; if
none does and all places are taken, the fullest closes and a new one opens.

Cases. Null or empty text: one piece with the end id only. Texts of any length are cut only
every max_tokens. Repeated rows are packed as often as they stand there. A null doc_id is kept
and packed. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import lean, raw
from .common import chosen

MAX_TOKENS = 2048
OPEN_BINS = 2048
#: Bytes of text whose pieces one packing task gets; what stays open at its end is a few
#: sequences against some thousand full ones.
TASK_BYTES = 64 << 20
PIECE_BYTES = 64
#: Pieces of text whose ids a worker remembers at once.
CACHE = 400_000

# Texts of these characters only are cut into words here: lower-casing and the tokenizer's
# normal form are the same letter by letter for them. All others go to the tokenizer whole.
_OTHER = re.compile("[^\t\n\r -~À-įÀ-ÖØ-öø-į]|<\\|")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-į]+|[0-9]|[^\\s0-9a-zß-öø-į]+")
_known: dict[str, "Ids"] = {}


class Ids:
    """Texts to token ids (little-endian unsigned 32-bit), remembering the words it has seen."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for w, i in vocabulary.items() if w.endswith("</w>")]] = True
        self.cache: dict[str, bytes] = {}

    def plain(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, words: list[str]) -> None:
        for k in range(0, len(words), 1000):
            part = words[k : k + 1000]
            ids = np.array(self.tokenizer.encode_batch_fast([" ".join(part)], add_special_tokens=False)[0].ids, "<u4")
            stop = np.flatnonzero(self.ends[ids]) + 1
            if len(stop) == len(part):
                data, at = ids.tobytes(), 0
                for w, e in zip(part, (stop * 4).tolist(), strict=True):
                    self.cache[w] = data[at:e]
                    at = e
            else:
                self.cache.update((w, self.plain(w)) for w in part)

    def encode(self, texts: list[str]) -> list[bytes]:
        cut = [None if _OTHER.search(t) else _PIECE.findall(t.lower()) for t in texts]
        new = set().union(*(c for c in cut if c)) - self.cache.keys()
        if len(self.cache) + len(new) > CACHE:
            self.cache.clear()
            new = set().union(*(c for c in cut if c))
        self.learn(list(new))
        get = self.cache.__getitem__
        return [self.plain(t) if c is None else b"".join(map(get, c)) for t, c in zip(texts, cut, strict=True)]


def tokenizer(path: str) -> Ids:
    if path not in _known:
        _known[path] = Ids(path)
    return _known[path]


def pieces(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every text's tokens and end_id, cut every
    max_tokens; with keep_ids also ids (binary)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokenizer(path), np.array([end_id], "<u4").tobytes()
        for b in batches:
            data, off = raw(b.column(1))
            first = 0
            while first < b.num_rows:
                last = max(first + 1, int(np.searchsorted(off, off[first] + (2 << 20), "right")) - 1)
                docs_at, piece, start, length, crc, ids = [], [], [], [], [], []
                for k, got in enumerate(coder.encode([bytes(data[off[i] : off[i + 1]]).decode("utf-8") for i in range(first, last)])):
                    got += end
                    for p, at in enumerate(range(0, len(got), 4 * max_tokens)):
                        part = got[at : at + 4 * max_tokens]
                        docs_at.append(first + k)
                        piece.append(p)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if keep_ids:
                            ids.append(part)
                out = [b.column(0).take(pa.array(docs_at, pa.int32())).cast(pa.int64()), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                yield pa.RecordBatch.from_arrays(out + [pa.array(ids, pa.binary())] * keep_ids, names + ["ids"] * keep_ids)
                first = last

    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    return chosen(docs, doc_id="long", text="string").mapInArrow(lean(run), kind)


def best_fit(lengths: list[int], size: int, open_bins: int) -> tuple[list[int], list[int]]:
    """The bin (from 0) and the place in it of each length, in the order given."""
    bits, at, bins, places, used = 0, [[] for _ in range(size + 1)], [], [], 0
    n_open = 0
    for need in lengths:
        if fits := bits >> need:
            free = need + (fits & -fits).bit_length() - 1
            b = at[free].pop()
            if not at[free]:
                bits ^= 1 << free
        else:
            if n_open == open_bins:
                fullest = (bits & -bits).bit_length() - 1
                at[fullest].pop()
                if not at[fullest]:
                    bits ^= 1 << fullest
                n_open -= 1
            b, free = used, size
            used += 1
            n_open += 1
        bins.append(b)
        places.append(size - free)
        if left := free - need:
            at[left].append(b)
            bits |= 1 << left
        else:
            n_open -= 1
    return bins, places


def pack(items: DataFrame, tasks: int, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS) -> DataFrame:
    """items (with doc_id, piece, length) and their sequence_id and offset.

    Pieces are dealt to tasks by a hash of the piece and its row and taken in its order, so that
    long and short ones come mixed, pieces of one source, document or id spread out, and a lost
    task repeats alike.
    """
    schema = items.schema
    columns = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        rows = list(batches)  # of TASK_BYTES of text, without the text
        if not rows:
            return
        table = pa.Table.from_batches(rows)
        bins, places = best_fit(table.column("length").to_pylist(), max_tokens, open_bins)
        table = table.append_column("sequence_id", pa.array(np.array(bins, np.int64) + base)).append_column("offset", pa.array(places, pa.int64()))
        yield from table.to_batches(max_chunksize=10_000)

    dealt = items.withColumn("_h", F.xxhash64("doc_id", "piece", "start", "ids_crc32", F.monotonically_increasing_id())).repartition(tasks, "_h").sortWithinPartitions("_h", "doc_id", "piece", "ids_crc32").select(*columns)
    out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schema.fields)
    return dealt.mapInArrow(lean(run), out + ", sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, max_tokens: int = MAX_TOKENS, open_bins: int = OPEN_BINS, task_bytes: int = TASK_BYTES) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of all texts of docs."""
    # a piece takes room of its own, however short
    size = chosen(docs, text="string").agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + PIECE_BYTES)).first()[0] or 0
    return pack(pieces(docs, path, max_tokens), max(1, round(size / task_bytes)), max_tokens, open_bins)
