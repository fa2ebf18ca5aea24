"""Media columns: payload bytes as 8-bit audio in Matroska, written, parsed and read back.

The parser walks variable-length EBML elements (unknown sizes too), clusters, simple blocks and
block groups, all four kinds of lacing, and cues, into a packet table with track, timestamp and byte
range of every frame. Files from elsewhere are accepted; a broken element ends its parent's parse.

Defined results: a null text is the empty text; an empty payload is padded to 64 bytes; packets()
of null or malformed content gives no rows for what cannot be read; an empty table gives an empty
table; other columns are never read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_by_bytes, keyed

#: Padding unit of payloads.
UNIT = 64
#: Samples a second, of one byte each; one timestamp tick is one sample.
RATE, SCALE_NS = 8000, 125_000
#: Bytes of a frame, frames laced in a block, blocks of a cluster (its ticks fit 16 signed bits).
FRAME, LACE, CLUSTER_BLOCKS = 512, 8, 7

#: Fixed values of the format: element ids, and the containers a parser descends into.
EBML, SEGMENT, INFO, TRACKS, TRACK, CLUSTER, CUES, CUE = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0x1F43B675, 0x1C53BB6B, 0xBB
TIMESTAMP, SIMPLE_BLOCK, BLOCK_GROUP, BLOCK, TIMESTAMP_SCALE, TRACK_NUMBER, CODEC = 0xE7, 0xA3, 0xA0, 0xA1, 0x2AD7B1, 0xD7, 0x86
CUE_TIME, CUE_POSITIONS, CUE_TRACK, CUE_CLUSTER, REFERENCE = 0xB3, 0xB7, 0xF7, 0xF1, 0xFB
NO_LACING, XIPH, FIXED, EBML_LACING = 0, 1, 2, 3


def _uint(n: int) -> bytes:
    return n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big")


def _vint(n: int, width: int = 0) -> bytes:
    """A size: a marker bit after width-1 zero bits; all ones is kept for unknown sizes."""
    width = width or next(w for w in range(1, 9) if n < (1 << 7 * w) - 1)
    return (n | 1 << 7 * width).to_bytes(width, "big")


def _element(ident: int, body: bytes) -> bytes:
    return _uint(ident) + _vint(len(body)) + body


_HEAD = _element(EBML, b"".join((_element(0x4286, b"\x01"), _element(0x42F7, b"\x01"), _element(0x42F2, b"\x04"), _element(0x42F3, b"\x08"), _element(0x4282, b"matroska"), _element(0x4287, b"\x04"), _element(0x4285, b"\x02"))))
_INFO = _element(INFO, _element(TIMESTAMP_SCALE, _uint(SCALE_NS)) + _element(0x4D80, b"folioframe") + _element(0x5741, b"folioframe"))
_AUDIO = _element(0xE1, _element(0xB5, np.array([RATE], ">f8").tobytes()) + _element(0x9F, b"\x01") + _element(0x6264, b"\x08"))
_TRACKS = _element(TRACKS, _element(TRACK, _element(TRACK_NUMBER, b"\x01") + _element(0x73C5, b"\x01") + _element(0x83, b"\x02") + _element(CODEC, b"A_PCM/INT/LIT") + _AUDIO))


def _block(frames: list[bytes], ticks: int) -> bytes:
    """A simple block of track 1: equal frames with fixed lacing, others with EBML lacing."""
    sizes = [len(f) for f in frames]
    lacing = NO_LACING if len(frames) == 1 else FIXED if len(set(sizes)) == 1 else EBML_LACING
    laces = b"" if lacing == NO_LACING else bytes([len(frames) - 1])
    if lacing == EBML_LACING:
        laces += _vint(sizes[0])
        for a, b in zip(sizes[:-2], sizes[1:-1], strict=True):
            width = next(w for w in range(1, 9) if abs(b - a) < (1 << 7 * w - 1) - 1)
            laces += _vint(b - a + (1 << 7 * width - 1) - 1, width)
    return _element(SIMPLE_BLOCK, b"\x81" + ticks.to_bytes(2, "big", signed=True) + bytes([0x80 | lacing << 1]) + laces + b"".join(frames))


def mux(payload: bytes) -> bytes:
    """A Matroska file with the payload as samples of one audio track; lossless."""
    body, cues = [_INFO, _TRACKS], []
    at, step = len(_INFO) + len(_TRACKS), FRAME * LACE
    for start in range(0, len(payload), step * CLUSTER_BLOCKS):
        part = payload[start : start + step * CLUSTER_BLOCKS]
        blocks = [_block([part[j : j + FRAME] for j in range(i, min(i + step, len(part)), FRAME)], i) for i in range(0, len(part), step)]
        cluster = _element(CLUSTER, _element(TIMESTAMP, _uint(start)) + b"".join(blocks))
        cues.append(_element(CUE, _element(CUE_TIME, _uint(start)) + _element(CUE_POSITIONS, _element(CUE_TRACK, b"\x01") + _element(CUE_CLUSTER, _uint(at)))))
        body.append(cluster)
        at += len(cluster)
    body.append(_element(CUES, b"".join(cues)))
    return _HEAD + _element(SEGMENT, b"".join(body))


def _header(data: bytes, at: int, end: int) -> tuple[int, int, int] | None:
    """(id, start of the body, its end) of the element at `at`; None where none can be read."""
    if at >= end or not data[at]:
        return None
    width = 9 - data[at].bit_length()
    ident = int.from_bytes(data[at : at + width], "big")
    at += width
    if at >= end or not data[at]:
        return None
    width = 9 - data[at].bit_length()
    if at + width > end:
        return None
    size = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
    at += width
    if size == (1 << 7 * width) - 1:
        return ident, at, -1
    return (ident, at, at + size) if at + size <= end else None


def elements(data: bytes, at: int, end: int, stops: frozenset[int] = frozenset()) -> Iterator[tuple[int, int, int, int]]:
    """(id, start, body start, end) of the children; one of unknown size ends before an id of `stops`."""
    while head := _header(data, at, end):
        ident, body, stop = head
        if stop < 0 and ident == SEGMENT:
            stop = end
        elif stop < 0:
            stop = body
            while (inner := _header(data, stop, end)) and inner[0] not in stops and inner[2] >= 0:
                stop = inner[2]
        yield ident, at, body, stop
        at = stop


def _laces(data: bytes, at: int, end: int, lacing: int) -> tuple[int, list[int]]:
    """(where the frames start, their sizes)."""
    if lacing == NO_LACING:
        return at, [end - at]
    n, sizes = data[at] + 1, []
    at += 1
    if lacing == FIXED:
        return at, [(end - at) // n] * n
    for i in range(n - 1):
        if lacing == XIPH:
            size = 0
            while data[at] == 255:
                size += 255
                at += 1
            sizes.append(size + data[at])
            at += 1
        else:
            width = 9 - data[at].bit_length()
            value = int.from_bytes(data[at : at + width], "big") & (1 << 7 * width) - 1
            sizes.append(value if i == 0 else sizes[-1] + value - ((1 << 7 * width - 1) - 1))
            at += width
    return at, [*sizes, end - at - sum(sizes)]


def packets(data: bytes) -> tuple[list[tuple[int, int, int, int, int, int, bool]], list[tuple[int, int, int]]]:
    """((cluster, track, timestamp_ns, lace, start, size, keyframe) of the frames, (time_ns, track, cluster start) of the cues)."""
    out: list = []
    cues: list = []
    top = frozenset((CLUSTER, CUES, INFO, TRACKS, EBML, SEGMENT))
    try:
        for ident, _, seg, seg_end in elements(data, 0, len(data), frozenset((EBML, SEGMENT))):
            if ident != SEGMENT:
                continue
            scale, cluster = 1_000_000, -1
            for ident, _, body, end in elements(data, seg, seg_end, top):
                if ident == INFO:
                    scale = next((int.from_bytes(data[b:e], "big") for i, _, b, e in elements(data, body, end) if i == TIMESTAMP_SCALE), scale)
                elif ident == CLUSTER:
                    cluster, base = cluster + 1, 0
                    for kind, _, b, e in elements(data, body, end):
                        if kind == TIMESTAMP:
                            base = int.from_bytes(data[b:e], "big")
                            continue
                        key = None
                        if kind == BLOCK_GROUP:
                            inner = {i: (x, y) for i, _, x, y in elements(data, b, e)}
                            if BLOCK not in inner:
                                continue
                            key, (b, e) = REFERENCE not in inner, inner[BLOCK]
                        elif kind != SIMPLE_BLOCK:
                            continue
                        width = 9 - data[b].bit_length()
                        track = int.from_bytes(data[b : b + width], "big") & (1 << 7 * width) - 1
                        ticks, flags = int.from_bytes(data[b + width : b + width + 2], "big", signed=True), data[b + width + 2]
                        at, sizes = _laces(data, b + width + 3, e, flags >> 1 & 3)
                        if sizes[-1] < 0:
                            continue
                        for lace, size in enumerate(sizes):
                            out.append((cluster, track, (base + ticks) * scale, lace, at, size, bool(flags & 0x80) if key is None else key))
                            at += size
                elif ident == CUES:
                    for i, _, b, e in elements(data, body, end):
                        if i != CUE:
                            continue
                        time, where = 0, []
                        for i, _, x, y in elements(data, b, e):
                            if i == CUE_TIME:
                                time = int.from_bytes(data[x:y], "big") * scale
                            elif i == CUE_POSITIONS:
                                where.append({j: int.from_bytes(data[u:v], "big") for j, _, u, v in elements(data, x, y)})
                        cues += [(time, w.get(CUE_TRACK, 0), seg + w.get(CUE_CLUSTER, 0)) for w in where]
    except IndexError:  # data ends within an element: what was read so far counts
        pass
    return out, cues


def demux(data: bytes, track: int = 1) -> bytes:
    """The bytes of one track's frames, in file order."""
    return b"".join([data[at : at + size] for _, t, _, _, at, size, _ in packets(data)[0] if t == track])


def pad(payload: bytes) -> bytes:
    """With bytes 0 up to a positive multiple of UNIT."""
    return payload + bytes(-len(payload) % UNIT or (0 if payload else UNIT))


def feature(samples: bytes, n_packets: int) -> str:
    """Mean, RMS about 128, peak and crossings of 128 of unsigned 8-bit samples, and the packet count."""
    x = np.frombuffer(samples, np.uint8).astype(np.int64) - 128
    crossings = int(np.count_nonzero((x[1:] >= 0) != (x[:-1] >= 0)))
    return f"n={len(x)};mean={x.mean():.4f};rms={np.sqrt((x * x).mean()):.4f};peak={int(np.abs(x).max())};crossings={crossings};packets={n_packets}"


def media_column(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, media: the text of each row as a Matroska file."""

    def write(it):
        for b in batches_by_bytes(it, "text", 8 << 20):
            media = [mux(pad(t.as_py().encode())) for t in b.column("text")]
            yield pa.record_batch([b.column("doc_id"), pa.array(media, pa.binary())], ["doc_id", "media"])

    return keyed(docs, id_col, text_col).mapInArrow(write, "doc_id long, media binary")


def packet_table(media: DataFrame, id_col: str = "doc_id", media_col: str = "media") -> DataFrame:
    """One row per frame: doc_id, packet, cluster, track, timestamp_ns, lace, start, size, keyframe, cued."""

    def read(it):
        for b in batches_by_bytes(it, "media", 8 << 20):
            rows = []
            for i, m in zip(b.column("doc_id").to_pylist(), b.column("media").to_pylist(), strict=True):
                frames, cues = packets(m or b"")
                times = {(t, track) for t, track, _ in cues}
                rows += [(i, n, *f, (f[2], f[1]) in times) for n, f in enumerate(frames)]
            if rows:
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], _PACKETS)

    own = media.select(media[id_col].cast("long").alias("doc_id"), media[media_col].alias("media"))
    return own.mapInArrow(read, "doc_id long, packet long, cluster int, track long, timestamp_ns long, lace int, start long, size long, keyframe boolean, cued boolean")


_PACKETS = ["doc_id", "packet", "cluster", "track", "timestamp_ns", "lace", "start", "size", "keyframe", "cued"]


def media_digest(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Store every text as media, read the stored bytes back and describe both."""

    def run(it):
        for b in batches_by_bytes(it, "text", 8 << 20):
            rows = []
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                raw = t.encode()
                stored = mux(pad(raw))
                frames, cues = packets(stored)
                back = b"".join([stored[f[4] : f[4] + f[5]] for f in frames])
                rows.append((i, len(raw), len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-UNIT:]), len(stored), hashlib.sha256(stored).hexdigest(), feature(back, len(frames)), len(cues)))
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.record_batch([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "n_clusters"]
    return keyed(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, n_clusters long")
