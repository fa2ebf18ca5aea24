"""Repeated substrings: bytes covered by a 100-byte string that also starts earlier are removed.

Every 100-byte window has a least hash among its 32-byte grams, its anchor; runs of windows with the
same leftmost anchor form segments. Equal windows lie in segments of the same hash, two windows of one
segment are never equal. Hashes met once (counted in quotient filters) cannot repeat. Of the other
segments, those of the same bytes (a 128-bit BLAKE2b digest of them) are one class, whose later
occurrences go whole. The distinct segments of a hash, in bounded blocks, meet in shards. There,
windows whose 83 bytes about the anchor nobody shares are left out, and the rest are sorted as
suffixes by induced sorting; neighbours whose permuted common prefix reaches 100 bytes are the same
window, and all but its first are removed. Hashes with more segments than a block holds compare
their blocks' windows by the digest too; nothing is dropped at any size.

Order: smaller id first (a null id before all), then, for rows of equal id, a hash of the text; of
rows equal in both, all but one count as later. Defined results: a null text is the empty text; a
text under 100 bytes is kept whole; a text of any length is read in pieces of PIECE bytes and cut in
pages of PAGE bytes; an empty table gives an empty table; only id and text are read.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import batches_by_bytes, bytes_of, join_hot, keyed, stored
from .exact_dedup import holds, repeated_bitmap, repeated_fingerprints
from .suffixes import permuted_common_prefixes, suffix_array

#: Bytes of a window and of a gram; grams in a window; most bytes of a segment.
WINDOW, GRAM = 100, 32
GRAMS = WINDOW - GRAM + 1
REACH = WINDOW + GRAMS - 1
#: Distinct segments of a hash in one block; bytes of a shard, about; text hashed at a time; bytes of a page.
BLOCK, SHARD_BYTES, PIECE, PAGE = 1 << 13, 1 << 20, 1 << 17, 1 << 16
#: Texts that a task remembers to spot repeats.
SEEN = 1 << 18
#: A window with its anchor at a place from the first to the last of a pair shares the bytes common to all such windows.
PLACES = ((0, 16), (17, 33), (34, 50), (51, GRAMS - 1))

_U = np.uint64


def gram_hashes(data: np.ndarray) -> np.ndarray:
    """A hash of the GRAM bytes from each byte on; zeros follow the end."""
    n = len(data)
    padded = np.zeros(n + GRAM, np.uint8)
    padded[:n] = data
    eight = np.ndarray(n + GRAM - 7, "<u8", padded, strides=(1,)) * _U(0xBF58476D1CE4E5B9)
    eight ^= eight >> _U(31)
    eight *= _U(0x94D049BB133111EB)
    two = eight[:-8] * _U(0x9E3779B97F4A7C15)
    two += eight[8:]
    four = two[: n + 1] * _U(0xC2B2AE3D27D4EB4F)
    four += two[16 : n + 17]
    four ^= four >> _U(32)
    return four[:n]


def segments(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, text index, start, windows) of the segments of joined texts."""
    n = len(data)
    sizes = np.diff(offsets)
    if n < WINDOW or sizes.max() < WINDOW:
        return tuple(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64, np.int64))
    h = gram_hashes(data)
    least, span = h, 1
    while span * 2 <= GRAMS:
        least, span = np.minimum(least[:-span], least[span:]), span * 2
    n_windows = n - WINDOW + 1
    least = np.minimum(least[:n_windows], least[GRAMS - span : GRAMS - span + n_windows])
    long = np.flatnonzero(sizes >= WINDOW)
    ends = offsets[1:] - WINDOW + 1  # of the windows' starts
    edge = np.zeros(n + 1, np.int8)
    edge[offsets[long]] = 1
    first = edge[:n_windows].astype(bool)
    edge[ends[long]] = -1
    new = first.copy()
    # the least gram changes, or its leftmost occurrence has just been left behind
    new[1:] |= (least[1:] != least[:-1]) | (h[: n_windows - 1] == least[:-1])
    new &= np.cumsum(edge[:n_windows], dtype=np.int8).view(bool)
    start = np.flatnonzero(new)
    text = np.searchsorted(offsets, start, side="right") - 1
    windows = np.minimum(np.r_[start[1:], n], ends[text]) - start
    found = least[start] * _U(0x9E3779B97F4A7C15)  # least hashes crowd the low end; their ranges must not
    found ^= found >> _U(29)
    return found, text, start - offsets[text], windows


def _pieces(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(batch, bytes, offsets, row, base): rows of about PIECE bytes, or a piece of one row that starts at its byte `base`."""
    for b in batches_by_bytes(it, "text", PIECE):
        data, offsets = bytes_of(b.column("text"))
        if len(data) <= PIECE:
            yield b, data, offsets, None, 0
            continue
        row, at = b.num_rows - 1, offsets[-2]  # a longer row ends its batch, only empty ones before it
        for base in range(0, len(data) - at - WINDOW + 1, PIECE):
            part = data[at + base : at + base + PIECE + WINDOW - 1]
            yield b, part, np.array([0, len(part)]), row, base


def _digest(content: bytes) -> bytes:
    return hashlib.blake2b(content, digest_size=16).digest()


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    own = keyed(docs, id_col, text_col)
    return own.select("doc_id", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("did"), F.xxhash64("text").alias("th"), "text")


def _segment_hashes(rows: DataFrame) -> DataFrame:
    def run(it):
        for _, data, offsets, _, _ in _pieces(it):
            yield pa.record_batch([pa.array(segments(data, offsets)[0].view(np.int64))], ["fp"])

    return rows.select("text").mapInArrow(run, "fp long")


def _repeated_segments(rows: DataFrame, shared) -> DataFrame:
    """m, h1, h2 (digest of the bytes), did, th, start, windows of the segments whose hash the filter holds."""

    def run(it):
        for b, data, offsets, row, base in _pieces(it):
            m, text, start, windows = segments(data, offsets)
            keep = holds(shared.value, m)
            m, text, start, windows = m[keep], text[keep], start[keep], windows[keep]
            at, raw = start + offsets[text], data.tobytes()
            digests = b"".join([_digest(raw[i:j]) for i, j in zip(at.tolist(), (at + windows + WINDOW - 1).tolist(), strict=True)])
            h = np.frombuffer(digests, np.int64).reshape(-1, 2)
            where = text if row is None else np.full(len(text), row)
            did, th = (b.column(c).to_numpy()[where] for c in ("did", "th"))
            cols = (m.view(np.int64), np.ascontiguousarray(h[:, 0]), np.ascontiguousarray(h[:, 1]), did, th, start + base, windows)
            yield pa.record_batch([pa.array(c) for c in cols], ["m", "h1", "h2", "did", "th", "start", "windows"])

    return rows.select("did", "th", "text").mapInArrow(run, "m long, h1 long, h2 long, did long, th long, start long, windows long")


def repeated_windows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffix-sort the texts; (text, offset, class) of every window that occurs at least twice."""
    if not texts:
        return tuple(np.zeros(0, np.int64) for _ in range(3))
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.r_[0, np.cumsum(sizes + 1)]
    raw = np.frombuffer(b"\x00".join(texts) + b"\x00", np.uint8)
    ends = starts[1:] - 1
    s = np.empty(len(raw) + 1, np.int64)
    s[:-1] = raw.astype(np.int64) + 2
    s[ends] = 1  # a separator below all bytes
    s[-1] = 0
    sa = suffix_array(s)
    common = permuted_common_prefixes(np.r_[raw, np.uint8(0)], sa, WINDOW)
    text = np.repeat(np.arange(len(texts)), sizes + 1)
    inside = np.zeros(len(s), bool)
    inside[:-1] = np.arange(len(raw)) + WINDOW <= ends[text]
    cls = np.cumsum(common[sa] < WINDOW)
    valid = inside[sa]
    at, cls = sa[valid], cls[valid]
    _, dense, counts = np.unique(cls, return_inverse=True, return_counts=True)
    twice = counts[dense] > 1
    at, dense = at[twice], dense[twice]
    return text[at], at - starts[text[at]], dense


def anchors(blobs: list[bytes]) -> np.ndarray:
    """The place of the anchor in each segment: its leftmost least gram."""
    sizes = np.array([len(b) for b in blobs], np.int64)
    starts = np.cumsum(sizes) - sizes
    h = gram_hashes(np.frombuffer(b"".join(blobs), np.uint8))
    text = np.repeat(np.arange(len(blobs)), sizes)
    inside = np.arange(len(h)) - starts[text] <= sizes[text] - GRAM
    h = np.where(inside, h, _U(0xFFFFFFFFFFFFFFFF))
    at = np.flatnonzero(inside & (h == np.minimum.reduceat(h, starts)[text]))
    return at[np.unique(text[at], return_index=True)[1]] - starts


def _shared_parts(m: list[int], blobs: list[bytes], whole: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(segment, first window, bytes): parts of the segments whose windows may be met again.

    Equal windows have their anchor at the same place, so they share the bytes that all windows with
    an anchor about there have in common. Segments marked `whole` meet others elsewhere, and stay.
    """
    place, keys = anchors(blobs).tolist(), []
    for x, b, p in zip(m, blobs, place, strict=True):
        last, mine = len(b) - WINDOW, []
        for q, (least, most) in enumerate(PLACES):
            lo, hi = max(0, p - most), min(last, p - least)
            mine.append((lo, hi, (x, q, b[p - least : p + WINDOW - most])) if lo <= hi else None)
        keys.append(mine)
    seen = Counter(k[2] for mine in keys for k in mine if k)
    segment, first, parts = [], [], []

    def add(i: int, lo: int, hi: int) -> None:
        segment.append(i)
        first.append(lo)
        parts.append(blobs[i][lo : hi + WINDOW])

    for i, mine in enumerate(keys):
        if whole[i]:
            add(i, 0, len(blobs[i]) - WINDOW)
            continue
        run = None
        for k in reversed(mine):  # an anchor further on in the window is a window further in front
            if not k:
                continue
            if seen[k[2]] > 1:
                run = (k[0] if run is None else run[0], k[1])
            elif run:
                add(i, *run)
                run = None
        if run:
            add(i, *run)
    return np.array(segment, np.int64), np.array(first, np.int64), parts


def _sort_shard(t: pa.Table) -> pa.Table:
    """Segments of some hashes' blocks -> runs of windows that occur earlier, and the windows of split hashes."""
    keys = np.stack([t.column(c).to_numpy() for c in ("m", "did", "th", "start")], 1)
    t = t.take(pa.array(np.sort(np.unique(keys, axis=0, return_index=True)[1])))  # equal rows cut the same segments
    blobs = t.column("bytes").to_pylist()
    did, th, start, n_blocks = (t.column(c).to_numpy() for c in ("did", "th", "start", "n_blocks"))
    order = np.lexsort((start, th, did))
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    segment, first, parts = _shared_parts(t.column("m").to_pylist(), blobs, n_blocks > 1)
    part, off, cls = repeated_windows(parts)
    seg, off = segment[part], off + first[part]
    key = rank[seg] << 32 | off
    by = np.lexsort((key, cls))
    again = by[1:][cls[by][1:] == cls[by][:-1]]  # all but the first of a class
    seg_r, off_r = seg[again], off[again]
    o = np.lexsort((off_r, seg_r))
    seg_r, off_r = seg_r[o], off_r[o]
    cut = np.flatnonzero(np.r_[True, (seg_r[1:] != seg_r[:-1]) | (off_r[1:] != off_r[:-1] + 1)]) if len(o) else np.zeros(0, np.int64)
    last = np.r_[cut[1:], len(o)] - 1 if len(o) else cut
    a, b = start[seg_r[cut]] + off_r[cut], start[seg_r[cut]] + off_r[last] + WINDOW
    cols = {"did": did[seg_r[cut]], "th": th[seg_r[cut]], "a": a, "b": b, "w1": np.zeros(len(a), np.int64), "w2": np.zeros(len(a), np.int64), "split": np.zeros(len(a), bool)}
    split = np.flatnonzero(n_blocks > 1)
    if len(split):  # the windows of these that are not already removed meet those of other blocks
        gone = set(zip(seg_r.tolist(), off_r.tolist(), strict=True))
        more = [(i, j) for i in split.tolist() for j in range(len(blobs[i]) - WINDOW + 1) if (i, j) not in gone]
        if more:
            i, j = np.array(more).T
            w = np.frombuffer(b"".join([_digest(blobs[x][y : y + WINDOW]) for x, y in more]), np.int64).reshape(-1, 2)
            extra = {"did": did[i], "th": th[i], "a": start[i] + j, "b": start[i] + j + WINDOW, "w1": w[:, 0], "w2": w[:, 1], "split": np.ones(len(i), bool)}
            cols = {k: np.concatenate([v, extra[k]]) for k, v in cols.items()}
    return pa.table({k: pa.array(v, pa.bool_() if k == "split" else pa.int64()) for k, v in cols.items()})


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """did, th, a, b: byte spans to remove of each text; they may overlap."""
    rows = _rows(docs, id_col, text_col)
    bytes_total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    repeated = stored(repeated_fingerprints(_segment_hashes(rows), int(bytes_total // 35) + 1))
    shared = docs.sparkSession.sparkContext.broadcast(repeated_bitmap(repeated, repeated.count()))
    found = stored(_repeated_segments(rows, shared))
    n_found = found.count()
    same = ["m", "h1", "h2"]
    classes = found.groupBy(*same).agg(F.min(F.struct("did", "th", "start")).alias("first"), F.max("windows").alias("windows"), F.count(F.lit(1)).alias("n"))
    classes = stored(classes.select(*same, "first.did", "first.th", "first.start", "windows", "n"))
    per_hash = classes.groupBy("m").agg(F.count(F.lit(1)).alias("k")).filter("k > 1")
    per_hash = per_hash.select("m", "k", F.ceil(F.col("k") / BLOCK).cast("long").alias("n_blocks"))
    to_sort = join_hot(classes.select("m", "h1", "did", "th", "start", "windows"), per_hash, ["m"], F.col("k"), n_found)
    to_sort = stored(to_sort.select("m", "did", "th", "start", "windows", "n_blocks", F.pmod("h1", "n_blocks").alias("block")))
    sort_bytes = to_sort.agg(F.sum(F.col("windows") + WINDOW)).first()[0] or 0
    n_shards = sort_bytes // SHARD_BYTES + 1
    # the segments' bytes, from the pages of their texts
    wanted = to_sort.withColumn("page", F.expr(f"start div {PAGE}")).groupBy("did", "th", "page").agg(F.collect_list(F.struct("m", "start", "windows", "n_blocks", "block")).alias("want"))
    wanted = wanted.select(F.col("did").alias("wd"), F.col("th").alias("wt"), F.col("page").alias("wp"), "want")
    joined = _paged(rows).join(wanted, (F.col("did") == F.col("wd")) & (F.col("th") == F.col("wt")) & (F.col("page") == F.col("wp"))).select("did", "th", "page", "z", "want")

    def cut(it):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in it:
            want = b.column("want")
            n = np.diff(np.asarray(want.offsets))
            cols = {f.name: c for f, c in zip(want.type.value_type, want.flatten().flatten(), strict=True)}
            did, th, page = (b.column(c).to_numpy().repeat(n) for c in ("did", "th", "page"))
            at = cols["start"].to_numpy() - page * PAGE
            spans = zip(np.arange(b.num_rows).repeat(n).tolist(), at.tolist(), (at + cols["windows"].to_numpy() + WINDOW - 1).tolist(), strict=True)
            raw = [unpack(z) for z in b.column("z").to_pylist()]
            bytes_ = pa.array([raw[i][x:y] for i, x, y in spans], pa.binary())
            yield pa.record_batch([cols["m"], pa.array(did), pa.array(th), cols["start"], cols["n_blocks"], cols["block"], bytes_], ["m", "did", "th", "start", "n_blocks", "block", "bytes"])

    cuts = joined.mapInArrow(cut, "m long, did long, th long, start long, n_blocks long, block long, bytes binary")
    cuts = cuts.withColumn("shard", F.pmod(F.xxhash64("m", "block"), F.lit(n_shards)))
    sorted_ = stored(cuts.groupBy("shard").applyInArrow(_sort_shard, "did long, th long, a long, b long, w1 long, w2 long, split boolean"))
    inner = sorted_.filter(~F.col("split")).select("did", "th", "a", "b")
    split = sorted_.filter("split").select("did", "th", "a", "b", "w1", "w2")
    earliest = split.groupBy("w1", "w2").agg(F.min(F.struct("did", "th", "a")).alias("e"), F.count(F.lit(1)).alias("k")).filter("k > 1")
    late = join_hot(split, earliest, ["w1", "w2"], F.col("k"), n_found).filter(F.struct("did", "th", "a") > F.col("e")).select("did", "th", "a", "b")
    again = classes.filter("n > 1").select(*same, F.struct("did", "th", "start").alias("first"), "n")
    copies = join_hot(found, again, same, F.col("n"), n_found).filter(F.struct("did", "th", "start") > F.col("first"))
    copies = copies.select("did", "th", F.col("start").alias("a"), (F.col("start") + F.col("windows") + WINDOW - 1).alias("b"))
    return inner.unionByName(late).unionByName(copies)


class _Seen:
    """Which (id, hash of the text) a task has met; forgets all when it holds too many."""

    def __init__(self):
        self.keys: set = set()

    def again(self, key: tuple) -> bool:
        if key in self.keys:
            return True
        if len(self.keys) >= SEEN:
            self.keys.clear()
        self.keys.add(key)
        return False


def _paged(rows: DataFrame) -> DataFrame:
    """did, th, page, z: the pages of the texts, compressed, each with what a segment may reach of the next; equal rows of a task once."""

    def run(it):
        pack, seen = zstandard.ZstdCompressor(level=1).compress, _Seen()
        for b in batches_by_bytes(it, "text", 1 << 20):
            out = []
            for did, th, t in zip(*(b.column(c).to_pylist() for c in ("did", "th", "text")), strict=True):
                raw = t.encode()
                if len(raw) >= WINDOW and not seen.again((did, th)):
                    out += [(did, th, i // PAGE, pack(raw[i : i + PAGE + REACH])) for i in range(0, len(raw) - WINDOW + 1, PAGE)]
            if out:
                cols = list(zip(*out, strict=True))
                yield pa.record_batch([pa.array(c, pa.int64()) for c in cols[:3]] + [pa.array(cols[3], pa.binary())], ["did", "th", "page", "z"])

    return rows.select("did", "th", "text").mapInArrow(run, "did long, th long, page long, z binary")


def _packed(rows: DataFrame) -> DataFrame:
    """doc_id, did, th, again, z: the text's bytes compressed. Of equal rows of a task, those marked `again` get a hash of their own."""

    def run(it):
        pack, seen, nth = zstandard.ZstdCompressor(level=1).compress, _Seen(), 0
        for b in batches_by_bytes(it, "text", 1 << 20):
            z = [pack(t.encode()) for t in b.column("text").to_pylist()]
            did, th = (b.column(c).to_pylist() for c in ("did", "th"))
            again = [seen.again(k) for k in zip(did, th, strict=True)]
            for i in [i for i, x in enumerate(again) if x]:
                nth += 1
                th[i] = (th[i] ^ nth * 0x9E3779B97F4A7C15) % (1 << 63)
            yield pa.record_batch([b.column("doc_id"), b.column("did"), pa.array(th, pa.int64()), pa.array(again), pa.array(z, pa.binary())], ["doc_id", "did", "th", "again", "z"])

    return rows.mapInArrow(run, "doc_id long, did long, th long, again boolean, z binary")


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, kept: the bytes that stay of every row's text."""
    spans = removed_spans(docs, id_col, text_col)
    per_text = spans.groupBy("did", "th").agg(F.collect_list(F.struct("a", "b")).alias("spans")).select(F.col("did").alias("sd"), F.col("th").alias("st"), F.lit(False).alias("sa"), "spans")
    texts = _packed(_rows(docs, id_col, text_col))
    joined = texts.join(per_text, (F.col("did") == F.col("sd")) & (F.col("th") == F.col("st")) & (F.col("again") == F.col("sa")), "left")
    joined = joined.withColumn("nth", F.row_number().over(W.partitionBy("did", "th", "again").orderBy("doc_id")))

    def run(it):
        unpack = zstandard.ZstdDecompressor().decompress
        for b in it:
            rows, spans = [], b.column("spans")
            ends, flat = np.asarray(spans.offsets), spans.values
            lo, hi = (flat.field(c).to_numpy() for c in ("a", "b"))
            for i, (doc_id, z, again, nth) in enumerate(zip(*(b.column(c).to_pylist() for c in ("doc_id", "z", "again", "nth")), strict=True)):
                raw = unpack(z)
                if again or nth > 1:
                    edges = [0, 0, len(raw), len(raw)] if len(raw) >= WINDOW else [0, len(raw)]
                else:
                    x, y = lo[ends[i] : ends[i + 1]], hi[ends[i] : ends[i + 1]]
                    by = np.argsort(x, kind="stable")
                    x, y = x[by], np.maximum.accumulate(y[by])
                    new = np.flatnonzero(np.r_[len(x) > 0, x[1:] > y[:-1]][: len(x)])  # touching spans are one run
                    edges = [0, *np.stack([x[new], y[np.r_[new[1:], len(x)][: len(new)] - 1]], 1).ravel().tolist(), len(raw)]
                kept = b"".join([raw[x:y] for x, y in zip(edges[::2], edges[1::2], strict=True)])
                rows.append((doc_id, len(raw), len(raw) - len(kept), len(edges) // 2 - 1, hashlib.sha256(kept).hexdigest(), kept))
            if rows:
                kinds = [pa.int64()] * 4 + [pa.string(), pa.binary()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return joined.select("doc_id", "z", "spans", "again", "nth").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
