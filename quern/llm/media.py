"""Media columns: bytes as 8-bit sound in Matroska, and Matroska as packet tables.

parse() reads variable-length EBML elements (also of unknown size), clusters, simple and grouped
blocks, the four kinds of lacing, and cues. A packet has its track, time, byte range and flag.

Cases. A null or empty text stores 64 zero bytes. Texts of any length are stored whole, in as
many clusters as they need; one row is held at a time. Equal texts give equal bytes: nothing in
a file depends on time or place. Media that are null or end early give the packets before the
fault, and the fault in `error`. A null doc_id is kept. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .arrays import lean, raw
from .common import chosen

ALIGN = 64
RATE = 8000
FRAME = 512
LACE = 8
CLUSTER_BLOCKS = 8

# Element ids of the format.
EBML, VERSION, READ_VERSION, MAX_ID, MAX_SIZE, DOC_TYPE, DOC_VERSION, DOC_READ_VERSION = 0x1A45DFA3, 0x4286, 0x42F7, 0x42F2, 0x42F3, 0x4282, 0x4287, 0x4285
SEGMENT, INFO, SCALE, DURATION, MUXING_APP, WRITING_APP = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x4D80, 0x5741
TRACKS, TRACK_ENTRY, TRACK_NUMBER, TRACK_UID, TRACK_TYPE, FLAG_LACING, DEFAULT_DURATION, CODEC, AUDIO, SAMPLING, CHANNELS, BIT_DEPTH = 0x1654AE6B, 0xAE, 0xD7, 0x73C5, 0x83, 0x9C, 0x23E383, 0x86, 0xE1, 0xB5, 0x9F, 0x6264
CLUSTER, TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, BLOCK_DURATION, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0x9B, 0xFB
CUES, CUE_POINT, CUE_TIME, CUE_TRACK_POSITIONS, CUE_TRACK, CUE_CLUSTER_POSITION = 0x1C53BB6B, 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
MASTERS = {SEGMENT, INFO, TRACKS, TRACK_ENTRY, AUDIO, CLUSTER, BLOCK_GROUP, CUES, CUE_POINT, CUE_TRACK_POSITIONS}
#: Elements that end a cluster or segment of unknown size.
TOP = {EBML, SEGMENT, INFO, TRACKS, CLUSTER, CUES}


@dataclass
class Media:
    tracks: dict[int, dict] = field(default_factory=dict)
    #: (track, time in ns, start, length, keyframe, cluster, lacing)
    packets: list[tuple[int, int, int, int, bool, int, int]] = field(default_factory=list)
    #: (time in ns, track, byte position of the cluster)
    cues: list[tuple[int, int, int]] = field(default_factory=list)
    clusters: int = 0
    scale: int = 1_000_000
    error: str | None = None


def vint(n: int, width: int = 0) -> bytes:
    """n as an element size, in the least number of bytes or in width."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def element(code: int, body: bytes) -> bytes:
    return code.to_bytes((code.bit_length() + 7) // 8, "big") + vint(len(body)) + body


def number(code: int, n: int) -> bytes:
    return element(code, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


def read_vint(data, at: int, end: int, keep: bool = False) -> tuple[int, int]:
    """(value, next place) of a size, or with keep of an id; -1 is the unknown size."""
    if at >= end:
        raise ValueError("end of data in a number")
    first = data[at]
    if not first:
        raise ValueError("a number of more than 8 bytes")
    width = 9 - first.bit_length()
    if at + width > end:
        raise ValueError("end of data in a number")
    value = int.from_bytes(data[at : at + width], "big")
    if keep:
        return value, at + width
    value &= (1 << 7 * width) - 1
    return -1 if value == (1 << 7 * width) - 1 else value, at + width


def lace_sizes(data, at: int, end: int, kind: int) -> tuple[list[int], int]:
    """(frame sizes, place of the first frame) behind a block's flags."""
    if kind == 0:
        return [end - at], at
    if at >= end:
        raise ValueError("end of data in a lace")
    n, at = data[at] + 1, at + 1
    sizes: list[int] = []
    if kind == 1:
        for _ in range(n - 1):
            size = 0
            while True:
                if at >= end:
                    raise ValueError("end of data in a lace")
                size, at = size + data[at], at + 1
                if data[at - 1] != 255:
                    break
            sizes.append(size)
    elif kind == 3:
        for k in range(n - 1):
            before = at
            value, at = read_vint(data, at, end)
            width = at - before
            sizes.append(value if k == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
    else:
        if (end - at) % n:
            raise ValueError("a fixed lace that doesn't divide")
        return [(end - at) // n] * n, at
    sizes.append(end - at - sum(sizes))
    if min(sizes) < 0:
        raise ValueError("a lace beyond its block")
    return sizes, at


def lace(frames: list[bytes], kind: int) -> bytes:
    """Frames behind the flags of a block with that kind of lacing."""
    if kind == 0:
        return frames[0]
    head = bytearray([len(frames) - 1])
    if kind == 1:
        for f in frames[:-1]:
            head += b"\xff" * (len(f) // 255) + bytes([len(f) % 255])
    elif kind == 3:
        head += vint(len(frames[0]))
        for a, b in zip(frames, frames[1:-1]):
            step = len(b) - len(a)
            width = next(w for w in range(1, 9) if abs(step) < (1 << 7 * w - 1) - 1)
            head += vint(step + (1 << 7 * width - 1) - 1, width)
    return bytes(head) + b"".join(frames)


def block(track: int, relative: int, frames: list[bytes], kind: int, key: bool = True) -> bytes:
    return vint(track) + struct.pack(">hB", relative, key << 7 | kind << 1) + lace(frames, kind)


_HEADER = element(EBML, number(VERSION, 1) + number(READ_VERSION, 1) + number(MAX_ID, 4) + number(MAX_SIZE, 8) + element(DOC_TYPE, b"matroska") + number(DOC_VERSION, 4) + number(DOC_READ_VERSION, 2))
_TRACKS = element(TRACKS, element(TRACK_ENTRY, number(TRACK_NUMBER, 1) + number(TRACK_UID, 1) + number(TRACK_TYPE, 2) + number(FLAG_LACING, 1) + number(DEFAULT_DURATION, FRAME * 10**9 // RATE) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(BIT_DEPTH, 8))))


def mux(payload: bytes) -> bytes:
    """A Matroska file with payload as 8-bit samples: clusters of laced blocks, then cues."""
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", len(payload) * 1000 / RATE)) + element(MUXING_APP, b"quern") + element(WRITING_APP, b"quern"))
    parts, place, cues = [info, _TRACKS], len(info) + len(_TRACKS), []
    step = FRAME * LACE * CLUSTER_BLOCKS
    for start in range(0, len(payload), step):
        time = start * 1000 // RATE
        body = [number(TIMESTAMP, time)]
        for at in range(start, min(start + step, len(payload)), FRAME * LACE):
            piece = payload[at : min(at + FRAME * LACE, start + step)]
            frames = [piece[i : i + FRAME] for i in range(0, len(piece), FRAME)]
            kind = 0 if len(frames) == 1 else 2 if len(piece) == FRAME * len(frames) else 3
            body.append(element(SIMPLE_BLOCK, block(1, at * 1000 // RATE - time, frames, kind)))
        cues.append(element(CUE_POINT, number(CUE_TIME, time) + element(CUE_TRACK_POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER_POSITION, place))))
        parts.append(element(CLUSTER, b"".join(body)))
        place += len(parts[-1])
    return _HEADER + element(SEGMENT, b"".join([*parts, element(CUES, b"".join(cues))]))


def parse(data: bytes) -> Media:
    """Tracks, packets and cues of a Matroska file; what follows a fault is left out."""
    out = Media()
    state = {"segment": 0, "time": 0}

    def uint(a: int, b: int) -> int:
        return int.from_bytes(data[a:b], "big")

    def blocks(at: int, end: int, key: bool | None) -> None:
        track, at = read_vint(data, at, end)
        if at + 3 > end:
            raise ValueError("end of data in a block")
        relative, flags = struct.unpack_from(">hB", data, at)
        kind = flags >> 1 & 3
        sizes, place = lace_sizes(data, at + 3, end, kind)
        time, every = (state["time"] + relative) * out.scale, out.tracks.get(track, {}).get("frame_ns", 0)
        for k, size in enumerate(sizes):
            out.packets.append((track, time + k * every, place, size, bool(flags & 0x80) if key is None else key, out.clusters, kind))
            place += size

    def walk(at: int, end: int, parent: int, into: dict) -> int:
        while at < end:
            begin = at
            code, at = read_vint(data, at, end, keep=True)
            if parent == CLUSTER and into.get("open") and code in TOP:
                return begin
            size, at = read_vint(data, at, end)
            stop = end if size < 0 else at + size
            if stop > end:
                raise ValueError(f"element {code:x} goes beyond its parent")
            if code == SEGMENT:
                state["segment"] = at
            if code == CLUSTER:
                out.clusters += 1
                state["time"] = 0
            if code == SIMPLE_BLOCK:
                blocks(at, stop, None)
            elif code == BLOCK_GROUP:
                group: dict = {}
                walk(at, stop, code, group)
                if "block" in group:
                    blocks(*group["block"], REFERENCE not in group)
            elif code in MASTERS:
                inner = into if code in (AUDIO, CUE_TRACK_POSITIONS) else {"open": size < 0}
                stop = walk(at, stop, code, inner)
                if code == TRACK_ENTRY:
                    out.tracks[inner.get(TRACK_NUMBER, 0)] = {"codec": inner.get(CODEC), "type": inner.get(TRACK_TYPE), "frame_ns": inner.get(DEFAULT_DURATION, 0), "rate": inner.get(SAMPLING), "channels": inner.get(CHANNELS), "bits": inner.get(BIT_DEPTH)}
                elif code == CUE_POINT:
                    out.cues.append((inner.get(CUE_TIME, 0) * out.scale, inner.get(CUE_TRACK, 0), state["segment"] + inner.get(CUE_CLUSTER_POSITION, 0)))
            elif code == TIMESTAMP:
                state["time"] = uint(at, stop)
            elif code == SCALE:
                out.scale = uint(at, stop)
            elif code == BLOCK:
                into["block"] = (at, stop)
            elif code == CODEC:
                into[code] = data[at:stop].decode("ascii", "replace")
            elif code == SAMPLING:
                into[code] = struct.unpack(">d" if stop - at == 8 else ">f", data[at:stop])[0]
            elif code in (TRACK_NUMBER, TRACK_TYPE, DEFAULT_DURATION, CHANNELS, BIT_DEPTH, CUE_TIME, CUE_TRACK, CUE_CLUSTER_POSITION, REFERENCE):
                into[code] = uint(at, stop)
            at = stop
        return at

    try:
        walk(0, len(data), 0, {})
    except (ValueError, struct.error) as e:
        out.error = str(e)
    return out


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary): every whole text as a Matroska file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(1))
            for i in range(0, b.num_rows, 500):
                j = min(b.num_rows, i + 500)
                n = np.diff(off[i : j + 1])
                media = [mux(t + bytes(max(ALIGN, -(-len(t) // ALIGN) * ALIGN) - len(t))) for t in (data[off[k] : off[k + 1]].tobytes() for k in range(i, j))]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return chosen(docs, doc_id="long", text="string").mapInArrow(lean(run), "doc_id long, n_bytes long, media binary")


def packet_table(media: DataFrame) -> DataFrame:
    """A row for every packet of every file of media (doc_id, media)."""
    names = ["doc_id", "packet", "track", "timestamp_ns", "start", "length", "keyframe", "cluster", "lacing"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(1))
            for k in range(b.num_rows):
                found = parse(data[off[k] : off[k + 1]].tobytes()).packets
                for i in range(0, len(found), 10_000):
                    part = found[i : i + 10_000]
                    own = b.column(0).slice(k, 1).take(pa.array(np.zeros(len(part), np.int32)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(range(i, i + len(part)), pa.int32()), *(pa.array([p[c] for p in part], kind) for c, kind in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.int32())))], names)

    return chosen(media, doc_id="long", media="binary").mapInArrow(lean(run), "doc_id long, packet int, track int, timestamp_ns long, start long, length long, keyframe boolean, cluster int, lacing int")


def digests(media: DataFrame) -> DataFrame:
    """What each file of media (doc_id, n_bytes, media) holds, from its parsed packets."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = raw(b.column(2))
            rows = []
            for k in range(b.num_rows):
                file = data[off[k] : off[k + 1]].tobytes()
                m = parse(file)
                payload = b"".join(file[p[2] : p[2] + p[3]] for p in m.packets)
                x = np.frombuffer(payload, np.uint8)
                feature = f"packets={len(m.packets)} clusters={m.clusters} cues={len(m.cues)} end_ns={m.packets[-1][1] if m.packets else 0} mean={x.mean() if len(x) else 0:.4f} peak={x.max() if len(x) else 0} distinct={np.count_nonzero(np.bincount(x, minlength=256))}"
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ALIGN:]), len(file), hashlib.sha256(file).hexdigest(), feature, m.error))
            cols = [pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cols], names)

    return chosen(media, doc_id="long", n_bytes="long", media="binary").mapInArrow(lean(run), "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
