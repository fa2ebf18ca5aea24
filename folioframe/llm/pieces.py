"""SentencePiece encoding and decoding for merge-type vocabularies.

Encoding keeps an agenda of adjacent symbol pairs, best score first and leftmost among equals; the
best pair that is still whole is merged and its new neighbours join the agenda; the agendas of many
short strings advance together, a round taking the top of each. No symbol can grow
over two characters that no piece holds side by side, so texts are cut there and each distinct cut
is merged once and kept in bounded caches. In every Arrow batch the newly met cuts are checked, ids
and decoded text, against the sentencepiece library; a difference raises.

Defined results: a null text is the empty text, which has no ids and decodes to the empty text; any
length works, a cut of n characters takes n log n steps; an empty table gives an empty table; other
columns are never read.
"""

from __future__ import annotations

import gc
import hashlib
import re
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import CACHES, batches_by_bytes, keyed, tokenizer_path, trim

SPACE = "▁"
#: Entries of one generation of a cache, and the longest string that is kept.
KEPT, KEPT_CHARS = 150_000, 48


class _Kept(dict):
    """Two generations: what was not met during a whole generation is dropped."""

    def __init__(self):
        super().__init__()
        self.old: dict = {}

    def turn(self) -> None:
        if len(self) >= KEPT:
            self.old = dict(self)
            self.clear()


class PieceModel:
    """The pieces, scores and bytes of a vocabulary, and the agenda over them."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
        self.names = [sp.id_to_piece(i) for i in range(n)]
        self.ids = {p: i for i, p in enumerate(self.names) if not special[i] and not sp.is_unused(i)}
        self.costs = {p: -sp.get_score(i) for p, i in self.ids.items()}
        self.byte_ids = {int(self.names[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = {i: bytes([b]) for b, i in self.byte_ids.items()}
        if len(self.byte_ids) != 256:
            raise ValueError("the vocabulary has no byte fallback")
        self.beside = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        inner = {c for pair in self.beside for c in pair}
        if any(pair[1] == SPACE and pair[0] != SPACE for pair in self.beside):
            raise ValueError("pieces run over a word's start")
        self.beside_keys = np.array(sorted(ord(p[0]) << 32 | ord(p[1]) for p in self.beside), np.int64)
        # symbols: the pieces, then characters that are no piece but part of one
        self.n_pieces, self.symbols = n, dict(self.ids)
        for c in sorted(inner - self.ids.keys()):
            self.symbols[c] = n + len(self.symbols) - len(self.ids)
        self.spell = {i: [self.byte_ids[b] for b in c.encode()] for c, i in self.symbols.items() if i >= n}
        self.symbol_costs = np.full(max(self.symbols.values()) + 1, np.inf)
        self.symbol_costs[list(self.ids.values())] = list(self.costs.values())
        table = {self.symbols[p[:i]] << 32 | self.symbols[p[i:]]: k for p, k in self.ids.items() for i in range(1, len(p)) if p[:i] in self.symbols and p[i:] in self.symbols}
        self.pair_keys = np.array(sorted(table), np.int64)
        self.pair_piece = np.array([table[k] for k in self.pair_keys.tolist()], np.int64)
        self.guard = next(c for c in "\n\t\r\x00" if c not in inner)
        self.guard_ids = sp.encode(self.guard)
        self.cuts, self.units = _Kept(), _Kept()

    def merge(self, cut: str) -> list[int]:
        """The ids of a cut by the agenda."""
        n, costs = len(cut), self.costs
        sym = list(cut)
        if n > 1:
            left, right = list(range(-1, n - 1)), list(range(1, n + 1))
            agenda = [(costs[p], i, i + 1, p) for i in range(n - 1) if (p := cut[i : i + 2]) in costs]
            heapify(agenda)
            while agenda:
                _, i, j, whole = heappop(agenda)
                if not sym[i] or not sym[j] or len(sym[i]) + len(sym[j]) != len(whole):
                    continue
                sym[i], sym[j] = whole, ""
                k = right[i] = right[j]
                if k < n:
                    left[k] = i
                    if (p := whole + sym[k]) in costs:
                        heappush(agenda, (costs[p], i, k, p))
                h = left[i]
                if h >= 0 and (p := sym[h] + whole) in costs:
                    heappush(agenda, (costs[p], h, i, p))
        out, ids = [], self.ids
        for s in sym:
            if s:
                if s in ids:
                    out.append(ids[s])
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return out

    def decode(self, ids: list[int]) -> str:
        """Text of the ids, spaces in place; runs of byte pieces are read as UTF-8."""
        raw = b"".join([self.bytes[i] if i in self.bytes else self.names[i].encode() for i in ids])
        return raw.decode(errors="replace").replace(SPACE, " ")

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece that each pair of symbols makes, -1 for none."""
        key = a.astype(np.int64) << 32 | b.astype(np.int64)
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((self.pair_keys[at] == key) & (a >= 0) & (b >= 0), self.pair_piece[at], -1)

    def merge_all(self, cuts: list[str]) -> list[list[int]]:
        """merge() of many cuts: each round takes the top of every cut's agenda, the leftmost best pair."""
        out: list = [None] * len(cuts)
        lengths = np.array([len(c) for c in cuts], np.int64)
        for lo, hi in ((1, 4), (4, 8), (8, 12), (12, 16), (16, 24), (24, 32), (32, KEPT_CHARS)):
            rows = np.flatnonzero((lengths > lo) & (lengths <= hi)) if lo > 1 else np.flatnonzero((lengths >= lo) & (lengths <= hi))
            if len(rows):
                self._merge_rows([cuts[i] for i in rows], rows, lengths[rows], hi, out)
        for i in np.flatnonzero(lengths > KEPT_CHARS):
            out[i] = self.merge(cuts[i])
        return out

    def _merge_rows(self, cuts: list[str], rows: np.ndarray, lengths: np.ndarray, width: int, out: list) -> None:
        chars, inverse = np.unique(np.frombuffer("".join(cuts).encode("utf-32-le"), np.uint32), return_inverse=True)
        known = [self.symbols.get(chr(c), -1) for c in chars]
        fresh = len(self.symbol_costs)
        ids = np.array([k if k >= 0 else fresh + i for i, k in enumerate(known)], np.int64)
        spelled = {fresh + i: [self.byte_ids[b] for b in chr(c).encode()] for i, c in enumerate(chars)}
        s = np.full((len(cuts), width + 1), -1, np.int64)
        s[np.arange(width + 1) < lengths[:, None]] = ids[inverse]
        m = np.full((len(cuts), width + 1), -1, np.int64)
        m[:, :-1] = self._pairs(s[:, :-1], s[:, 1:])
        cost = np.where(m >= 0, self.symbol_costs[m], np.inf)
        cols = np.arange(width + 1)
        while len(rows):
            j = cost.argmin(1)
            r = np.arange(len(rows))
            open_ = np.isfinite(cost[r, j])
            if not open_.all():
                done = np.flatnonzero(~open_)
                for i, ids_, n in zip(rows[done].tolist(), s[done].tolist(), (s[done] >= 0).sum(1).tolist(), strict=True):
                    ids_ = ids_[:n]
                    if max(ids_) >= self.n_pieces:  # characters without a piece go out as bytes
                        ids_ = [x for y in ids_ for x in ([y] if y < self.n_pieces else spelled.get(y) or self.spell[y])]
                    out[i] = ids_
                rows, s, m, cost, j = rows[open_], s[open_], m[open_], cost[open_], j[open_]
                r = np.arange(len(rows))
                if not len(rows):
                    break
            s[r, j] = m[r, j]
            src = np.minimum(cols + (cols > j[:, None]), width)
            s, m = np.take_along_axis(s, src, 1), np.take_along_axis(m, src, 1)
            m[r, j] = self._pairs(s[r, j], s[r, np.minimum(j + 1, width)])
            h = r[j > 0]
            m[h, j[h] - 1] = self._pairs(s[h, j[h] - 1], s[h, j[h]])
            s[:, width] = m[:, width] = -1
            cost = np.where(m >= 0, self.symbol_costs[m], np.inf)

    def split(self, units: list[str]) -> tuple[list[str], np.ndarray]:
        """(the cuts of all units in turn, how many each unit has)."""
        text = "".join([SPACE + u for u in units])
        cps = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        ends = np.cumsum([len(u) + 1 for u in units])
        key = cps[:-1] << 32 | cps[1:]
        at = np.minimum(np.searchsorted(self.beside_keys, key), len(self.beside_keys) - 1)
        start = np.ones(len(cps), bool)
        start[1:] = self.beside_keys[at] != key
        start[ends[:-1]] = True
        cut_at = np.flatnonzero(start).tolist()
        counts = np.diff(np.searchsorted(cut_at, np.r_[0, ends]))
        return [text[a:b] for a, b in zip(cut_at, [*cut_at[1:], len(text)], strict=True)], counts

    def learn(self, units: list[str]) -> dict[str, tuple[str, str]]:
        """(ids joined by commas, text) of units that the cache lacks, checked against the library."""
        if not units:
            return {}
        parts, counts = self.split(units)
        cuts = self.cuts
        distinct = set(parts)
        missing = distinct - cuts.keys()
        got = {c: cuts[c] for c in distinct - missing}
        old = {c: cuts.old[c] for c in missing if c in cuts.old}
        fresh = list(missing - old.keys())
        ids = self.merge_all(fresh)
        texts = [self.decode(i) for i in ids]
        self.check(fresh, ids, texts)
        new = old | {c: (",".join(map(str, i)), t) for c, i, t in zip(fresh, ids, texts, strict=True)}
        cuts.update({c: v for c, v in new.items() if len(c) <= KEPT_CHARS})
        got |= new
        pairs = [got[c] for c in parts]
        out, at = {}, 0
        for u, n in zip(units, counts.tolist(), strict=True):
            if n == 1:
                out[u] = pairs[at]
            else:
                mine = pairs[at : at + n]
                out[u] = (",".join([g[0] for g in mine]), "".join([g[1] for g in mine]))
            at += n
        cuts.turn()
        return out

    def check(self, cuts: list[str], ids: list[list[int]], texts: list[str]) -> None:
        """Compare with the library, behind a character that merges with nothing."""
        if not cuts:
            return
        head, n = self.guard_ids, len(self.guard_ids)
        theirs = self.library.encode([self.guard + c for c in cuts], num_threads=1)
        if [t[n:] for t in theirs] != ids or any(t[:n] != head for t in theirs):
            raise AssertionError(f"the agenda and the library differ on {next(c for c, a, b in zip(cuts, theirs, ids, strict=True) if a != head + b)!r}")
        if self.library.decode(theirs) != [self.guard + t for t in texts]:
            raise AssertionError("decoding differs from the library")

    def encode_texts(self, texts: list[str]) -> list[tuple[str, str]]:
        """(ids joined by commas, decoded text) of every text."""
        known = self.units
        split = []
        for t in texts:
            if not t:
                split.append([])
                continue
            units = t.replace(" ", SPACE).split(SPACE)
            if "" in units:  # runs of spaces stay with the word behind them
                units = [u[1:] for u in re.findall(f"{SPACE}+[^{SPACE}]*", SPACE + t.replace(" ", SPACE))]
            split.append(units)
        missing = set().union(*split) - known.keys()
        extra: dict[str, tuple[str, str]] = {}
        if missing:
            old = known.old
            extra = {u: old[u] for u in missing if u in old}
            extra |= self.learn(list(missing - extra.keys()))
            known.update({u: v for u, v in extra.items() if len(u) <= KEPT_CHARS})
        out = []
        for units in split:
            got = [known[u] if u in known else extra[u] for u in units] if extra else [known[u] for u in units]
            text = "".join([g[1] for g in got])
            out.append((",".join([g[0] for g in got]), text[1:] if text[:1] == " " else text))
        known.turn()
        return out


@cache
def model(path: str) -> PieceModel:
    return PieceModel(path)


CACHES.append(model.cache_clear)


def encode_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, keep: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256; with keep also ids array<int> and decoded."""
    path = path or tokenizer_path("piece_bpe_32k.model")

    def run(it):
        trim()
        collecting = gc.isenabled()
        gc.disable()  # the caches hold millions of tuples and no cycles; walking them costs a third of the time
        try:
            yield from encoded(it)
        finally:
            if collecting:  # the worker serves other operators later
                gc.enable()
            trim()

    def encoded(it):
        m = model(path)
        for b in batches_by_bytes(it, "text", 2 << 20):
            got = m.encode_texts(b.column("text").to_pylist())
            cols = [
                b.column("doc_id"),
                pa.array([i.count(",") + 1 if i else 0 for i, _ in got], pa.int64()),
                pa.array([hashlib.sha256(i.encode()).hexdigest() for i, _ in got], pa.string()),
                pa.array([hashlib.sha256(d.encode()).hexdigest() for _, d in got], pa.string()),
            ]
            if keep:
                cols += [pa.array([[int(x) for x in i.split(",")] if i else [] for i, _ in got], pa.list_(pa.int32())), pa.array([d for _, d in got], pa.string())]
            yield pa.record_batch(cols, names)

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * keep
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep
    return keyed(docs, id_col, text_col).mapInArrow(run, schema)
