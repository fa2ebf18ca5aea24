"""Language-model scoring by logistic mixing of hashed-context bit predictors.

A text is the sequence of its words (A-Z lower-cased), each with a blank behind it, and an end. Each
byte is coded as binary decisions on the path of a Huffman tree chosen by the byte before it. A
decision has one predictor per context: the last three and the last five bytes of the word, all of
the word so far, and the last three bytes with the class of the text, which is a hash of its last
short word (these tell languages apart). A predictor holds the counts of both outcomes in a hashed
slot; what is seen is kept whole, so counts grow with the corpus, and a predictor's table has two
slots or more for each context and node of a tree that was met. The predictors' logits are mixed by
weights that a gate selects, learnt online on a held-back share of the training rows against the
merged counts of the others and averaged over all decisions on the way; an adaptive map refines the
mixture by what came true at that estimate behind the byte before. Scoring uses the counts of all
training rows. Total bits give the log probability; bits per byte are those of the words, blanks and
ends.

A word's probability depends on the word and the class only, so every batch codes each of its
distinct words once, heads that neighbours in order share once too; what the class changes is coded
once for each class in which such a head occurs. Counts are gathered from merged counts of pairs of
class and word.

Beside the mixture each text gets its unigram base score; the FREQUENT most frequent words go to the
tasks, the others are joined.

Defined results: a null text is the empty text, one end token; a null id has the fold of the empty
string; repeated rows are scored alike; a text of any length is read in pieces of PIECE bytes that
end at a blank, the class carried on, and a word over LONGEST bytes is coded in parts; without
training rows N and V are 0 and the mixture knows nothing (each decision a half); an empty table
gives an empty table; only id and text are read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches_by_bytes, bytes_of, durable, fold, give_back, keyed, offsets_of, stored

#: Slots per predictor (bits, at least), predictors (the last with the class), gates, buckets of the adaptive map, logits' scale.
SLOT_BITS, CONTEXTS, GATES, BUCKETS, SCALE = 21, 4, 16, 33, 16
#: Bytes read at a time, bytes of words coded at a time, decisions of a learning step, its rate, words that go to the tasks.
PIECE, CODED, STEP, RATE, FREQUENT = 4 << 20, 1 << 15, 1 << 14, 1.5, 1 << 18
#: Classes, bytes of a short word at most, bytes of a word coded in one part.
CLASSES, SHORT, LONGEST = 64, 3, 1 << 12
#: Training bytes of a range when counts are merged, ranges (bits, at least); symbols sorted at a time, symbols held by a counter.
RANGE, RANGE_BITS, SORTED, HELD = 1 << 25, 4, 1 << 20, 1 << 19
#: One training row in so many is held back to learn weights; its bytes for a task that learns.
SHARE, LEARN = 8, 1 << 22
#: Keys that are told apart by marks in a table at most; more are sorted.
MARKED = 1 << 24
END, PAD = 10, 5

_U = np.uint64
_WORD = 0x9E3779B97F4A7C15
_PADDING = bytes([END] * PAD)
_MIXED = np.arange(256, dtype=np.uint64) * _U(0xC2B2AE3D27D4EB4F) + _U(0x165667B19E3779F9)
_BLANK = re.compile(rb"[\x20\x09-\x0D]")
_known_powers: list[np.ndarray] = [np.zeros(0, np.uint64), np.zeros(0, np.uint64)]


def _powers(n: int) -> list[np.ndarray]:
    """Powers of the hash base and of its inverse, n of each at least."""
    if len(_known_powers[0]) < n:
        _known_powers[:] = [np.cumprod(np.full(2 * n, _U(x))) for x in (_WORD, pow(_WORD, -1, 1 << 64))]
    return _known_powers


def words_of(text: str | bytes) -> list[bytes]:
    """bytes.lower touches A-Z only, bytes.split cuts at 0x20 and 0x09-0x0D."""
    return (text.encode() if isinstance(text, str) else text).lower().split()


def code_trees(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(code, length) by byte before and byte, from counts of byte pairs; every byte has a code."""
    codes, lengths = np.zeros((256, 256), np.uint32), np.zeros((256, 256), np.uint8)
    for p in range(256):
        total = max(1, int(pairs[p].sum()))
        nodes = [(max(1, (int(c) << 16) // total), i, i) for i, c in enumerate(pairs[p])]
        heapify(nodes)
        serial = 256
        while len(nodes) > 1:
            (a, _, x), (b, _, y) = heappop(nodes), heappop(nodes)
            heappush(nodes, (a + b, serial, (x, y)))
            serial += 1
        stack = [(nodes[0][2], 0, 0)]
        while stack:
            node, code, length = stack.pop()
            if isinstance(node, tuple):
                stack += [(node[0], code << 1, length + 1), (node[1], code << 1 | 1, length + 1)]
            else:
                codes[p, node], lengths[p, node] = code, length
    return codes, lengths


class Coder:
    """The decisions of words with their slots."""

    def __init__(self, codes: np.ndarray, lengths: np.ndarray, range_slots: tuple[int, ...] = ((1 << SLOT_BITS) >> RANGE_BITS,) * CONTEXTS, range_bits: int = RANGE_BITS):
        """range_slots: slots of a range by context."""
        self.codes, self.lengths, self.range_slots, self.range_bits = codes, lengths, range_slots, range_bits

    def symbols(self, units: list[bytes], classes: np.ndarray | None = None, own: Iterable[int] = range(CONTEXTS)) -> tuple[np.ndarray, list, np.ndarray]:
        """(byte before and byte, hashes by context, unit) of every byte of the units; contexts end at a unit's start; of contexts not in own the hash is None."""
        return self._hashed(units, classes, False, own)[:3]

    def edges(self, units: list[bytes], classes: np.ndarray | None, own: Iterable[int] = range(CONTEXTS)) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
        """(byte before and byte, hashes by context) of edges, and (unit, edge) of every byte.

        A byte has the edge of the unit before if both have the same class and bytes up to there; so
        units in order are coded as the paths of a tree. If the last context is not in own, its
        place has the last three bytes, for with_class.
        """
        return self._hashed(units, classes, True, own)

    @staticmethod
    def _mixed(c: np.ndarray, k: int) -> np.ndarray:
        h = (c + _U(k + 1)) * _U(0xBF58476D1CE4E5B9)
        h ^= h >> _U(29)
        h *= _U(0x94D049BB133111EB)
        return (h >> _U(32)).astype(np.uint32)

    @classmethod
    def with_class(cls, three: np.ndarray, kind: np.ndarray) -> np.ndarray:
        """The last context's hashes: of the last three bytes and the class."""
        return cls._mixed(three | (kind + _U(1)) << _U(24), CONTEXTS - 1)

    def _hashed(self, units: list[bytes], classes: np.ndarray | None, shared: bool, own: Iterable[int]) -> tuple[np.ndarray, list, np.ndarray, np.ndarray]:
        data = np.frombuffer(_PADDING + _PADDING.join(units), np.uint8)
        sizes = np.array([len(t) for t in units]) + PAD
        n = len(data)
        begins = np.cumsum(sizes) - sizes
        q1 = data.astype(np.uint64)
        q2 = q1.copy()
        q2[1:] |= q1[:-1] << _U(8)
        three, five = np.zeros(n, np.uint64), np.zeros(n if 1 in own else 0, np.uint64)
        three[3:] = q2[2:-1] | q1[:-3] << _U(16)
        if 1 in own:
            five[5:] = three[5:] | q2[1:-4] << _U(24)
        unit = np.repeat(np.arange(len(units)), sizes)
        start = (begins + PAD)[unit]
        coded = np.flatnonzero(np.arange(n) >= start)
        start, unit = start[coded], unit[coded]
        kind = np.zeros(len(units), np.uint64) if classes is None else classes.astype(np.uint64)
        of_byte, edge = unit, np.arange(len(coded))
        if shared:
            depth = coded - start
            before = np.maximum(unit - 1, 0)
            same = (unit > 0) & (kind[unit] == kind[before]) & (depth < (sizes - PAD)[before])
            same[same] = data[coded[same]] == data[(coded - sizes[before])[same]]
            # the first byte in which a unit differs from the one before
            apart = np.minimum.reduceat(np.where(same, LONGEST, depth), np.flatnonzero(depth == 0))
            new = depth >= apart[unit]
            # by depth, units in order: a byte that is not new has the last new one before it
            order = np.argsort(depth.astype(np.uint16), kind="stable")
            new = new[order]
            edge[order] = np.cumsum(new) - 1
            first = order[new]
            coded, start, unit = coded[first], start[first], unit[first]
        three = three[coded]
        pair = data[coded - 1].astype(np.int32) << 8 | data[coded]
        hashes = []
        for k in range(CONTEXTS):
            if k not in own:
                hashes.append(three if k == CONTEXTS - 1 else None)
            elif k == CONTEXTS - 1:
                hashes.append(self.with_class(three, kind[unit]))
            else:
                hashes.append(self._mixed(three if k == 0 else five[coded] if k == 1 else self._so_far(data, coded, start), k))
        return pair, hashes, of_byte, edge

    @staticmethod
    def _so_far(data: np.ndarray, coded: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Hash of the unit so far: a difference of prefix sums, freed of its place."""
        powers, inverse = _powers(len(data))
        sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_MIXED[data] * powers[: len(data)], out=sums[1:])
        return (sums[coded] - sums[start]) * inverse[start]

    def paths(self, pair: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(symbol, bit, node's hash) of every decision on the paths of symbols."""
        wide = self.lengths.ravel()[pair].astype(np.int32)
        ends = np.cumsum(wide, dtype=np.int64)
        pos = np.repeat(np.arange(len(pair)), wide)
        depth = (np.arange(len(pos)) - (ends - wide)[pos]).astype(np.uint32)
        path = self.codes.ravel()[pair][pos]
        path >>= (wide - 1)[pos].astype(np.uint32) - depth
        bits = (path & np.uint32(1)).astype(np.uint8)
        return pos, bits, (path >> np.uint32(1) | np.uint32(1) << depth) * np.uint32(0x9E3779B1)

    def slots(self, k: int, hashes: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Slots of context k: a context's hash names a range of slots, the node a place in it."""
        n = self.range_slots[k]
        at = hashes ^ node
        at *= np.uint32(0x85EBCA6B)
        inside = at.astype(np.uint64)
        inside *= _U(n)
        inside >>= _U(32)
        inside += (hashes >> np.uint32(32 - self.range_bits)).astype(np.uint64) * _U(n)
        return inside.view(np.int64)

    def decisions(self, units: list[bytes], classes: np.ndarray | None = None) -> tuple[np.ndarray, list[np.ndarray], np.ndarray, np.ndarray]:
        """(bits, slots by context, byte before, decisions of each unit)."""
        pair, hashes, unit = self.symbols(units, classes)
        pos, bits, node = self.paths(pair)
        per_unit = np.bincount(unit[pos], minlength=len(units))
        return bits, [self.slots(k, h[pos], node) for k, h in enumerate(hashes)], (pair >> 8).astype(np.uint8)[pos], per_unit


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def logits_of(counts: np.ndarray) -> np.ndarray:
    """int8 logits (times SCALE) of slots' counts; counts: (slots, 2)."""
    x = np.log((counts[:, 1] + np.float32(0.4)) / (counts[:, 0] + np.float32(0.4)))
    return np.clip(np.rint(x * SCALE), -127, 127).astype(np.int8)


_SURE = np.searchsorted([1, 16, 44], np.abs(np.arange(256).astype(np.uint8).view(np.int8).astype(int)), side="right").astype(np.uint8)


class Mixer:
    """Logits per slot, gated weights and the adaptive map."""

    def __init__(self, logits: list[np.ndarray], weights: np.ndarray, hits: np.ndarray):
        self.logits, self.weights, self.hits = logits, weights, hits

    def inputs(self, slots: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
        """(logits, gate); the contexts may be the first ones only."""
        raw = [t[s] for t, s in zip(self.logits, slots, strict=False)]
        # how sure the long context and the word are: unseen, unsure, likely, nearly certain
        gate = (_SURE[raw[1].view(np.uint8)] * np.uint8(4) + _SURE[raw[2].view(np.uint8)]).astype(np.intp)
        return [r.astype(np.float32) * np.float32(1 / SCALE) for r in raw], gate

    def mix(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        return np.clip(self._sum(x, gate), -12, 12)

    def _sum(self, x: list[np.ndarray], gate: np.ndarray) -> np.ndarray:
        w = self.weights.astype(np.float32)
        z = w[CONTEXTS][gate]
        for k, v in enumerate(x):
            z += w[k][gate] * v
        return z

    @staticmethod
    def bucket(z: np.ndarray, before: np.ndarray) -> np.ndarray:
        return before.astype(np.int32) * BUCKETS + np.rint((np.clip(z, -8, 8) + np.float32(8)) * np.float32((BUCKETS - 1) / 16)).astype(np.int32)

    def refine(self, z: np.ndarray, before: np.ndarray) -> np.ndarray:
        """The mean of the mixture's probability and the adaptive map's."""
        rates = (self.hits[1] + 0.5) / (self.hits.sum(0) + 1.0)
        # buckets that saw little keep the mixture's estimate
        trust = (self.hits.sum(0) / (self.hits.sum(0) + 32.0) * 0.5).astype(np.float32)
        at = self.bucket(z, before)
        p = squash(z)
        return np.clip(p + trust[at] * (rates.astype(np.float32)[at] - p), 1e-6, 1 - 1e-6)

    def nats(self, coder: Coder, pair: np.ndarray, hashes: list[np.ndarray], edge: np.ndarray | None = None) -> np.ndarray:
        """The log probability of every symbol; edge: the last context's hashes are of results, each of which has that edge's pair and other hashes.

        So all but the last context are looked up and mixed once an edge.
        """
        pos, bits, node = coder.paths(pair)
        *first, last = hashes
        x, gate = self.inputs([coder.slots(k, h[pos], node) for k, h in enumerate(first)])
        mixed, weight, before = self._sum(x, gate), self.weights[CONTEXTS - 1].astype(np.float32)[gate], (pair >> 8).astype(np.uint8)[pos]
        if edge is not None:
            wide = np.bincount(pos, minlength=len(pair))
            begins = np.cumsum(wide) - wide
            # the decisions of each result, out of those of its edge
            wide = wide.take(edge)
            pos = np.repeat(np.arange(len(edge)), wide)
            at = np.arange(len(pos))
            at += (begins.take(edge) - np.cumsum(wide) + wide).take(pos)
            mixed, weight, before, bits, node = (v.take(at) for v in (mixed, weight, before, bits, node))
        x = self.logits[CONTEXTS - 1].take(coder.slots(CONTEXTS - 1, last.take(pos), node)).astype(np.float32)
        x *= np.float32(1 / SCALE)
        x *= weight
        x += mixed
        q = self.refine(np.clip(x, -12, 12, out=x), before)
        return np.bincount(pos, weights=np.log(np.where(bits == 1, q, 1 - q)), minlength=len(last))


def split_words(texts: pa.Array) -> pa.ListArray:
    """What words_of says, as an Arrow list for each text; empty strings beside a blank at a text's edge are no words."""
    return pc.ascii_split_whitespace(pc.ascii_lower(texts))


def _texts(it: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, list[list[bytes]] | pa.ListArray, bool]]:
    """(batch, first row, words of that and the following rows as Pairs takes them, whether the last row ends here).

    A row of more than PIECE bytes is alone, its words in pieces that end at a blank.
    """
    for b in batches_by_bytes(it, "text", PIECE):
        if np.diff(offsets_of(b.column("text"))).max() <= PIECE:
            yield b, 0, split_words(b.column("text")), True
            continue
        texts = b.column("text").to_pylist()
        short: list[list[bytes]] = []
        for i, t in enumerate(texts):
            raw = t.encode()
            if len(raw) <= PIECE:
                short.append(words_of(raw))
                continue
            if short:
                yield b, i - len(short), short, True
                short = []
            at = 0
            while at < len(raw):
                cut = _BLANK.search(raw, min(at + PIECE, len(raw)))
                end = cut.end() if cut else len(raw)
                words = words_of(raw[at:end])
                if words or end == len(raw):
                    yield b, i, [words], end == len(raw)
                at = end
        if short:
            yield b, len(texts) - len(short), short, True


def distinct(keys: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct keys in order, and the place of each key among them; keys are below n."""
    if n > MARKED:
        return np.unique(keys, return_inverse=True)
    seen = np.zeros((n + 63) // 64 * 64, bool)
    seen[keys] = True
    # a key's place: the marks in the 64s before its own, and those before it in its own
    bits = np.packbits(seen, bitorder="little").view("<u8")
    marks = np.bitwise_count(bits)
    at = keys >> 6
    below = bits.take(at)
    below &= (_U(1) << (keys & 63).astype(np.uint64)) - _U(1)
    return np.flatnonzero(seen), (np.cumsum(marks, dtype=np.int64) - marks).take(at) + np.bitwise_count(below)


class Pairs:
    """The distinct pairs of class and word in some texts; an end is the empty word."""

    def __init__(self, texts: list[list[bytes]] | pa.ListArray, ended: bool, first_class: int = 0):
        """texts: lists of words, or what split_words makes of them."""
        if isinstance(texts, list):
            texts = pa.array(texts, pa.list_(pa.binary()))
        coded = texts.flatten().cast(pa.binary()).dictionary_encode()
        # words in order, so that those with the same head are side by side; the empty word is first
        order = pc.sort_indices(coded.dictionary)
        self.named = coded.dictionary.take(order)
        lacks_end = len(self.named) == 0 or self.named[0].as_py() != b""
        if lacks_end:
            self.named = pa.concat_arrays([pa.array([b""], pa.binary()), self.named])
        rank = np.empty(len(order), np.int64)
        rank[order.to_numpy()] = np.arange(len(order)) + lacks_end
        ids = rank[coded.indices.to_numpy()]
        text = np.repeat(np.arange(len(texts)), texts.value_lengths().to_numpy())[ids > 0]
        self.sizes = np.bincount(text, minlength=len(texts)) + 1
        # a text's words stand behind the ends of the texts before it
        self.ids = np.zeros(len(text) + len(texts), np.int64)
        self.ids[np.arange(len(text)) + text] = ids[ids > 0]
        if not ended:
            self.ids, self.sizes[-1] = self.ids[:-1], self.sizes[-1] - 1
        ids = self.ids
        raw, at = bytes_of(self.named)
        self.lengths, at, raw = np.diff(at), at.tolist(), raw.tobytes()
        self.words = [raw[i:j] for i, j in zip(at, at[1:], strict=False)]
        kind = np.zeros(len(self.words), np.int64)
        short = np.flatnonzero((self.lengths > 0) & (self.lengths <= SHORT))
        kind[short] = [1 + zlib.crc32(self.words[i]) % (CLASSES - 1) for i in short.tolist()]
        # the class of a token: that of the last short word before it in its text
        start = np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        last = np.maximum.accumulate(np.where(kind[ids] > 0, np.arange(1, len(ids) + 1), 0))
        before = np.r_[0, last[:-1]][: len(ids)]
        classes = np.where(before > start, kind[ids[before - 1]], 0)
        if first_class:
            classes = np.where((before <= start) & (start == 0), first_class, classes)
        self.last_class = int(kind[ids[last[-1] - 1]]) if len(ids) and last[-1] else first_class
        pairs, self.of_token = distinct(ids * CLASSES + classes, len(self.words) * CLASSES)
        self.counts = np.bincount(self.of_token, minlength=len(pairs))
        self.word, self.classes = pairs // CLASSES, pairs % CLASSES

    def nats(self, coder: Coder, mixer: Mixer) -> np.ndarray:
        """The log probability of every pair."""
        nats = np.zeros(len(self.word))
        for units, owner in units_of(self.words):
            pair, hashes, unit, edge = coder.edges(units, None, range(CONTEXTS - 1))
            # the bytes of a word are side by side, so are the pairs with it, and the pairs of these words
            first, n = owner[0], owner[-1] + 1 - owner[0]
            size = np.bincount(owner[unit] - first, minlength=n)
            i, j = np.searchsorted(self.word, [first, first + n])
            word, kind = self.word[i:j] - first, self.classes[i:j]
            wide = size[word]
            of = np.repeat(np.arange(j - i), wide)
            key = edge[np.arange(len(of)) + ((np.cumsum(size) - size)[word] - np.cumsum(wide) + wide)[of]] * CLASSES + kind[of]
            met, place = distinct(key, len(pair) * CLASSES)
            met, kind = met // CLASSES, (met % CLASSES).astype(np.uint64)
            hashes[-1] = coder.with_class(hashes[-1][met], kind)
            cost = mixer.nats(coder, pair, hashes, met)
            nats[i:j] = np.bincount(of, weights=cost[place], minlength=j - i)
        return nats


def units_of(words: list[bytes]) -> Iterator[tuple[list[bytes], np.ndarray]]:
    """(units that code some of the words, word of each unit), about CODED bytes at a time; long words in parts."""
    coded = [w + b" " if w else b"\n" for w in words]
    sizes = np.fromiter(map(len, coded), np.int64, len(coded))
    if len(coded) and sizes.max() <= LONGEST:
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // CODED)) + 1
        for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), len(coded)], strict=True):
            yield coded[i:j], np.arange(i, j)
        return
    units, owner, size = [], [], 0
    for i, w in enumerate(coded):
        for k in range(0, len(w), LONGEST):
            units.append(w[k : k + LONGEST])
            owner.append(i)
        size += len(w)
        if size >= CODED:
            yield units, np.array(owner)
            units, owner, size = [], [], 0
    if units:
        yield units, np.array(owner)


def _count_corpus(training: DataFrame) -> DataFrame:
    """(class, word, n, late): how often each word follows in each class, and that in the rows held back; the end is the empty word."""

    def run(it):
        carried = 0
        for b, row, texts, ended in _texts(it):
            late = b.column("late").to_numpy(zero_copy_only=False)[row : row + len(texts)]
            p = Pairs(texts, ended, carried)
            carried = 0 if ended else p.last_class
            held_back = np.bincount(p.of_token, weights=np.repeat(late, p.sizes), minlength=len(p.counts)).astype(np.int64)
            yield pa.record_batch([pa.array(p.classes, pa.int32()), p.named.take(pa.array(p.word)), pa.array(p.counts), pa.array(held_back)], ["class", "word", "n", "late"])

    rows = training.withColumn("late", _late()).select("text", "late")
    return rows.mapInArrow(run, "class int, word binary, n long, late long").groupBy("class", "word").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


def _late():
    """Whether a training row is held back to learn weights."""
    return F.pmod(F.xxhash64("doc_id"), F.lit(SHARE)) == 0


def _byte_pairs(words: DataFrame) -> np.ndarray:
    """Counts of (byte before, byte) in all coded words."""

    def run(it):
        total = np.zeros(65536, np.int64)
        plain = Coder(np.zeros((256, 256), np.uint32), np.zeros((256, 256), np.uint8))
        for b in it:
            n = b.column("n").to_numpy()
            for units, owner in units_of(b.column("word").to_pylist()):
                pair, _, unit = plain.symbols(units, own=())
                total += np.bincount(pair, weights=n[owner][unit], minlength=65536).astype(np.int64)
        at = np.flatnonzero(total)
        yield pa.record_batch([pa.array(at, pa.int32()), pa.array(total[at])], ["pair", "n"])

    out = np.zeros(65536, np.int64)
    for r in words.select("word", "n").mapInArrow(run, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n")).collect():  # 65536 rows at most
        out[r.pair] = r.n
    return out.reshape(256, 256)


def _planes(x: np.ndarray) -> bytes:
    """All first bytes, all second bytes and so on, compressed."""
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes())


def _of_planes(blob: bytes, width: int) -> np.ndarray:
    """Rows of `width` bytes."""
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8).reshape(width, -1).T)


def _pack(run: np.ndarray) -> bytes:
    """Rows (symbol, count in early rows, count in every row), sorted by symbol, which are written as steps."""
    out = run.copy()
    out[1:, 0] -= run[:-1, 0]
    return _planes(out)


def _unpack(blob: bytes) -> np.ndarray:
    run = _of_planes(blob, 24).view(np.uint64)
    run[:, 0] = np.cumsum(run[:, 0], dtype=np.uint64)
    return run


def _merged(runs: list) -> np.ndarray:
    """Rows (symbol, early, every) with each symbol once, sorted; runs: each the three columns of such rows."""
    if not runs:
        return np.zeros((0, 3), np.uint64)
    columns = [np.concatenate([run[j] for run in runs]) for j in range(3)]
    # equal symbols are many: they are summed in a hash table, and only the distinct ones sorted
    x = pa.table(columns, ["symbol", "early", "every"]).group_by("symbol", use_threads=False).aggregate([("early", "sum"), ("every", "sum")])
    del columns
    order = np.argsort(x.column("symbol").to_numpy())
    out = np.empty((len(x), 3), np.uint64)
    for j, c in enumerate(("symbol", "early_sum", "every_sum")):
        out[:, j] = x.column(c).to_numpy()[order]
    del x
    pa.default_memory_pool().release_unused()
    return out


def _count_symbols(counted: DataFrame, words: DataFrame, coder: Coder) -> DataFrame:
    """(part, keys, blob): merged counts of (context, byte before and byte) by context's number and range; keys counts contexts and nodes.

    Only the last context needs the pairs of class and word; the others are counted from words.
    """
    range_bits = coder.range_bits
    bounds = np.arange(1, 1 << range_bits, dtype=np.uint64) << _U(48 - range_bits)

    def run(it, own):
        raw, size = [[] for _ in range(CONTEXTS)], 0
        held = [np.zeros((0, 3), np.uint64) for _ in range(CONTEXTS)]

        def emit(k):
            parts = [(i, x) for i, x in enumerate(np.split(held[k], np.searchsorted(held[k][:, 0], bounds))) if len(x)]
            held[k] = held[k][:0]
            return pa.record_batch([pa.array([k << range_bits | i for i, _ in parts], pa.int32()), pa.array([_pack(x) for _, x in parts], pa.binary())], ["part", "blob"])

        for b in it:
            classes, n, late = (b.column(c).to_numpy() for c in ("class", "n", "late"))
            for units, owner in units_of(b.column("word").to_pylist()):
                pair, hashes, unit = coder.symbols(units, classes[owner], own)
                every = n[owner][unit].astype(np.uint64)
                early = every - late[owner][unit].astype(np.uint64)
                for k in own:
                    raw[k].append((hashes[k].astype(np.uint64) << _U(16) | pair.astype(np.uint64), early, every))
                size += len(pair)
                if size >= SORTED:
                    size = 0
                    for k in own:
                        held[k] = _merged([held[k].T, *raw[k]])
                        raw[k].clear()
                        if len(held[k]) > HELD:
                            yield emit(k)
        for k in own:
            held[k] = _merged([held[k].T, *raw[k]])
            if len(held[k]):
                yield emit(k)

    def merge(t: pa.Table) -> pa.Table:
        x = _merged([_unpack(b.as_py()).T for b in t.column("blob")])
        keys = 0
        cuts = [0, *np.searchsorted(x[:, 0], x[1 << 18 :: 1 << 18, 0] >> _U(16) << _U(16)).tolist(), len(x)]  # contexts stay together
        for y in (x[i:j, 0] for i, j in zip(cuts, cuts[1:], strict=False)):
            pos, _, node = coder.paths((y & _U(0xFFFF)).astype(np.int32))
            keys += len(np.unique((y >> _U(16) << _U(32))[pos] | node))
        return pa.table({"part": pa.array([t.column("part")[0].as_py()], pa.int32()), "keys": pa.array([keys], pa.int64()), "blob": pa.array([_pack(x)], pa.binary())})

    kinds = "part int, blob binary"
    by_word = words.select(F.lit(0).alias("class"), "word", "n", "late").mapInArrow(lambda it: run(it, range(CONTEXTS - 1)), kinds)
    by_pair = counted.select("class", "word", "n", "late").mapInArrow(lambda it: run(it, [CONTEXTS - 1]), kinds)
    return by_word.unionByName(by_pair).groupBy("part").applyInArrow(merge, "part int, keys long, blob binary")


def _logits(merged: DataFrame, coder: Coder) -> DataFrame:
    """(part, early, every): the logits of a range of slots, from the counts of early rows and of every row."""

    def run(it):
        for b in it:
            for part, blob in zip(*(b.column(c).to_pylist() for c in ("part", "blob")), strict=True):
                k = part >> coder.range_bits
                size, first = coder.range_slots[k], (part & (1 << coder.range_bits) - 1) * coder.range_slots[k]
                x = _unpack(blob)
                both = np.zeros((2, 2 * size))
                for i in range(0, len(x), 1 << 20):
                    y = x[i : i + (1 << 20)]
                    pos, bits, node = coder.paths((y[:, 0] & _U(0xFFFF)).astype(np.int32))
                    at = (coder.slots(k, (y[:, 0] >> _U(16)).astype(np.uint32)[pos], node) - first) << 1 | bits
                    for j in (0, 1):
                        both[j] += np.bincount(at, weights=y[:, 1 + j].astype(np.float64)[pos], minlength=2 * size)
                early, every = (pa.array([logits_of(n.reshape(size, 2)).tobytes()], pa.binary()) for n in both)
                yield pa.record_batch([pa.array([part], pa.int32()), early, every], ["part", "early", "every"])

    return stored(merged.select("part", "blob").mapInArrow(run, "part int, early binary, every binary"))


def _tables(logits: DataFrame, coder: Coder, column: str) -> list[np.ndarray]:
    """A column of the logits by context."""
    out = [np.zeros(n << coder.range_bits, np.int8) for n in coder.range_slots]
    for row in logits.select("part", F.col(column).alias("blob")).toLocalIterator():
        k, i = row.part >> coder.range_bits, row.part & (1 << coder.range_bits) - 1
        size = coder.range_slots[k]
        out[k][i * size : (i + 1) * size] = np.frombuffer(row.blob, np.int8)
    return out


def _new_mixer(logits: list[np.ndarray]) -> Mixer:
    weights = np.full((CONTEXTS + 1, GATES), 0.35)
    weights[CONTEXTS] = 0
    return Mixer(logits, weights, np.zeros((2, 256 * BUCKETS)))


def _learn_weights(late: DataFrame, coder: Coder, logits: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Weights, averaged over all decisions on the way, and the adaptive map, from rows that the logits have not seen."""
    shared = late.sparkSession.sparkContext.broadcast((coder, logits))

    def run(it):
        give_back()
        coder, logits = shared.value
        mixer, total, carried = _new_mixer(logits), 0.0, 0
        path = np.zeros_like(mixer.weights)  # the sum of the weights of all steps, by decisions
        for _, _, texts, ended in _texts(it):
            pairs = Pairs(texts, ended, carried)
            carried = 0 if ended else pairs.last_class
            # frequent words come first in a batch: a fixed shuffle lets every step see some of all
            order = np.argsort(pairs.classes.astype(np.uint8), kind="stable")[np.random.default_rng(len(pairs.counts)).permutation(len(pairs.counts))]
            counts, classes = pairs.counts[order], pairs.classes[order]
            for units, owner in units_of([pairs.words[w] for w in pairs.word[order].tolist()]):
                bits, at, before, per_unit = coder.decisions(units, classes[owner])
                times = np.repeat(counts[owner], per_unit).astype(np.float32)
                x, gate = mixer.inputs(at)
                for i in range(0, len(bits), STEP):
                    part = slice(i, i + STEP)
                    g, y, xs, m = gate[part], bits[part], [v[part] for v in x], times[part]
                    z = mixer.mix(xs, g)
                    error = (y.astype(np.float32) - squash(z)) * m
                    n = np.bincount(g, weights=m, minlength=GATES) + 64.0
                    for k in range(CONTEXTS):
                        mixer.weights[k] += RATE * np.bincount(g, weights=error * xs[k], minlength=GATES) / n
                    mixer.weights[CONTEXTS] += RATE * np.bincount(g, weights=error, minlength=GATES) / n
                    spot = Mixer.bucket(z, before[part])
                    mixer.hits[1] += np.bincount(spot, weights=y * m, minlength=256 * BUCKETS)
                    mixer.hits[0] += np.bincount(spot, weights=(1 - y) * m, minlength=256 * BUCKETS)
                    seen = float(m.sum(dtype=np.float64))
                    path += mixer.weights * seen
                    total += seen
        if total:
            tail = np.concatenate([[total], path.ravel(), mixer.hits.ravel()])
            yield pa.record_batch([pa.array([zstandard.ZstdCompressor(level=1).compress(tail.tobytes())], pa.binary())], ["blob"])

    mixer, x = _new_mixer(logits), 0
    for row in durable(late.select("text").mapInArrow(run, "blob binary")).toLocalIterator():
        x = x + np.frombuffer(zstandard.ZstdDecompressor().decompress(row.blob), np.float64)
    shared.destroy()
    if isinstance(x, int):
        return mixer.weights, mixer.hits
    return x[1 : 1 + mixer.weights.size].reshape(mixer.weights.shape) / x[0], x[1 + mixer.weights.size :].reshape(mixer.hits.shape)


def word_counts(counted: DataFrame) -> DataFrame:
    """(word, n, late) over all classes."""
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("late").alias("late"))


def learn(training: DataFrame, counted: DataFrame, words: DataFrame) -> tuple[Coder, Mixer]:
    """The coder and mixer of the training texts (doc_id, text), their counted pairs and words. The logits that reach the driver grow with the corpus."""
    pairs = _byte_pairs(words)
    trees, n_bytes = code_trees(pairs), int(pairs.sum())
    range_bits = max(RANGE_BITS, (n_bytes // RANGE).bit_length())
    merged = durable(_count_symbols(counted, words, Coder(*trees, range_bits=range_bits)))
    keys = {r.k: r.n for r in merged.groupBy(F.expr(f"shiftright(part, {range_bits})").alias("k")).agg(F.sum("keys").alias("n")).collect()}
    # two slots a key at least
    range_slots = tuple(max((1 << SLOT_BITS) >> range_bits, (2 * keys.get(k, 0) >> range_bits) + 1) for k in range(CONTEXTS))
    coder = Coder(*trees, range_slots, range_bits)
    logits = _logits(merged, coder)
    late = training.filter(_late()).repartition(max(1, n_bytes // SHARE // LEARN))
    weights, hits = _learn_weights(late, coder, _tables(logits, coder, "early"))
    return coder, Mixer(_tables(logits, coder, "every"), weights, hits)


def _most_frequent(words: DataFrame) -> tuple[pa.Array, np.ndarray]:
    """The words (word, n) that are more frequent than any count that over FREQUENT words reach, and the end; and their n."""
    least, held = 1, 0
    for r in words.groupBy("n").agg(F.count(F.lit(1)).alias("k")).orderBy(F.desc("n")).toLocalIterator():  # distinct counts are few: about the root of twice the tokens
        held += r.k
        if held > FREQUENT:
            least = r.n + 1
            break
    chosen = words.filter((F.col("n") >= least) | (F.octet_length("word") == 0)).select("word", "n").toArrow()
    word, n = (c.combine_chunks() for c in chosen.columns)
    return word.cast(pa.binary()), n.to_numpy()


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", mod: int = 7, held: int = 2) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bits, bits_per_byte (of the words, blanks and ends)."""
    rows = keyed(docs, id_col, text_col).withColumn("held_out", fold(F.col("doc_id"), mod) == held)
    training = rows.filter(~F.col("held_out"))
    counted = stored(_count_corpus(training))
    words = stored(word_counts(counted))
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    coder, mixer = learn(training, counted, words)
    shared = docs.sparkSession.sparkContext.broadcast((coder, mixer, _most_frequent(words)))
    floor = math.log10(n + v + 1)

    def run(it):
        give_back()
        coder, mixer, (common, n_common) = shared.value
        n_common = np.r_[n_common, -1]  # of words that are not among them
        ends_known = pc.index(common, b"").as_py() >= 0
        carried, parts = 0, []
        for b, row, texts, ended in _texts(it):
            p = Pairs(texts, ended, carried)
            del texts
            carried = 0 if ended else p.last_class
            nats = p.nats(coder, mixer)
            count = n_common[pc.index_in(p.named, common).fill_null(-1).to_numpy()]
            logs = np.where(count >= 0, np.log10(np.maximum(count, 0) + 1.0) - floor, 0.0)
            byte = p.lengths + 1
            begins = np.cumsum(p.sizes) - p.sizes
            rare = count[p.ids] < 0
            if not ends_known:
                rare &= p.ids > 0  # without training rows ends are unknown, not rare
            per_text = lambda x: np.add.reduceat(x, begins)  # noqa: E731, B023
            stats = [per_text(x) for x in (nats[p.of_token], np.where(p.ids == 0, logs[0] if ends_known else -floor, logs[p.ids]), (count[p.ids] > 0).astype(np.int64), byte[p.ids], rare.astype(np.int64))]
            got = [*stats, p.sizes, p.named.take(pa.array(p.ids[rare]))]
            if not ended:
                parts.append(got)
                continue
            if parts:  # the end of a long row, alone in its batch part
                every = [*parts, got]
                got = [*(sum(g[j] for g in every) for j in range(6)), pa.concat_arrays([g[6] for g in every])]
                parts = []
            nat, base, known, size, few, tokens, names = got
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(few)], pa.int32()), names)
            own = b.slice(row, len(tokens))
            cols = [own.column("doc_id"), own.column("held_out"), pa.array(tokens), pa.array(known), pa.array(base), pa.array(nat / math.log(10)), pa.array(-nat / math.log(2)), pa.array(-nat / math.log(2) / size), lists]
            yield pa.record_batch(cols, ["doc_id", "held_out", "n_tokens", "known", "base", "score", "n_bits", "bits_per_byte", "rare"])

    schema = "doc_id long, held_out boolean, n_tokens long, known long, base double, score double, n_bits double, bits_per_byte double, rare array<binary>"
    scored = stored(rows.select("doc_id", "held_out", "text").mapInArrow(run, schema).withColumn("row", F.monotonically_increasing_id()))
    shared.destroy()  # the scores are stored, and the model would stay in workers and block stores
    rare = scored.select("row", F.explode("rare").alias("w")).groupBy("row", "w").agg(F.count(F.lit(1)).alias("m"))
    found = rare.join(words.select("word", F.col("n").alias("c")), F.col("w") == F.col("word"), "left")
    logs = F.col("m") * (F.log10(F.coalesce("c", F.lit(0)) + F.lit(1.0)) - F.lit(floor))
    per_row = found.groupBy(F.col("row").alias("r_row")).agg(F.sum(logs).alias("more"), F.sum(F.when(F.col("c") > 0, F.col("m")).otherwise(0)).alias("k"))
    return scored.drop("rare").join(per_row, F.col("row") == F.col("r_row"), "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("k", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score", "n_bits", "bits_per_byte",
    )
