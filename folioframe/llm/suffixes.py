"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def _types(s: np.ndarray) -> np.ndarray:
    """True where the suffix is smaller than the next one; the last is."""
    n = len(s)
    rise = np.zeros(n, np.int8)
    rise[:-1] = np.sign(s[1:].astype(np.int64) - s[:-1])
    rise[-1] = 1
    # a run of equal symbols has the type of the change behind it
    at = np.where(rise != 0, np.arange(n), n)
    return rise[np.minimum.accumulate(at[::-1])[::-1]] > 0


def _induce_by_bucket(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """Induce all suffixes from the leftmost-smaller ones, a bucket at a time.

    Inside a bucket, suffixes induced by the bucket itself come in waves, one for each repetition of
    its symbol, so a wave is one vector step. The order is that of the usual scan.
    """
    small_s = s.astype(np.uint16)
    by_symbol = lms[np.argsort(small_s[lms], kind="stable")]
    seeds = np.searchsorted(s[by_symbol], np.arange(k + 1))
    queue: list[list[np.ndarray]] = [[] for _ in range(k)]

    def deal(j: np.ndarray, c: int) -> np.ndarray:
        """Send suffixes to their buckets' queues; returns those of bucket c."""
        ch = small_s[j]
        order = np.argsort(ch, kind="stable")  # of 16-bit symbols: a radix sort
        j, ch = j[order], ch[order]
        cuts = np.flatnonzero(np.r_[True, ch[1:] != ch[:-1], True]) if len(j) else []
        own = j[:0]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if ch[a] == c:
                own = j[a:b]
            else:
                queue[ch[a]].append(j[a:b])
        return own

    large: list[np.ndarray] = []
    none = np.zeros(0, np.int64)
    for c in range(k):
        done, wave = [], np.concatenate(queue[c]) if queue[c] else none
        queue[c] = []
        while len(wave):
            done.append(wave)
            j = wave[wave > 0] - 1
            wave = deal(j[~small[j]], c)
        large.append(np.concatenate(done) if done else none)
        j = by_symbol[seeds[c] : seeds[c + 1]]
        deal(j[j > 0] - 1, -1)
    out: list[np.ndarray] = []
    for c in range(k - 1, -1, -1):
        done, wave = [], np.concatenate(queue[c]) if queue[c] else none
        queue[c] = []
        while len(wave):
            done.append(wave)
            j = wave[wave > 0] - 1
            wave = deal(j[small[j]], c)
        tail = np.concatenate(done)[::-1] if done else none
        j = large[c][::-1]
        j = j[j > 0] - 1
        deal(j[small[j]], -1)
        if c == 0:
            tail = np.array([len(s) - 1])
        out += [tail, large[c]]
    return np.concatenate(out[::-1])


def _induce_in_order(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same by the usual scan, for alphabets about as large as the text."""
    n = len(s)
    counts = np.bincount(s, minlength=k)
    tails = np.cumsum(counts)
    heads = (tails - counts).tolist()
    # the symbol before a suffix if that suffix is induced in this direction, else -1; n stands for an empty place
    before = np.r_[-1, s[:-1], -1]
    rising = np.r_[False, small[:-1], False]
    large_before, small_before = np.where(rising, -1, before).tolist(), np.where(rising, before, -1).tolist()
    sa = [n] * n
    ends = tails.copy()
    # seeds fill their buckets from the back, in the order given
    symbol = s[lms]
    by = np.argsort(symbol, kind="stable")
    sorted_symbols = symbol[by]
    after = np.searchsorted(sorted_symbols, sorted_symbols, side="right") - np.arange(len(by))
    for at, j in zip((ends[sorted_symbols] - after).tolist(), lms[by].tolist(), strict=True):
        sa[at] = j
    for j in sa:  # places ahead are filled while the scan goes on
        c = large_before[j]
        if c >= 0:
            at = heads[c]
            sa[at] = j - 1
            heads[c] = at + 1
    ends = tails.tolist()
    sa.reverse()
    ends = [n - e for e in ends]
    for j in sa:
        c = small_before[j]
        if c >= 0:
            at = ends[c]
            sa[at] = j - 1
            ends[c] = at + 1
    sa.reverse()
    sa[0] = n - 1
    return np.array(sa, np.int64)


def _longest_run(s: np.ndarray) -> int:
    cuts = np.flatnonzero(np.r_[True, s[1:] != s[:-1], True])
    return int(np.diff(cuts).max())


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of s in order; s: integers from 0, its last symbol the only 0."""
    n, k = len(s), int(s.max()) + 1
    if n <= 2:
        return np.arange(n - 1, -1, -1)
    small = _types(s)
    at = np.flatnonzero(small[1:] & ~small[:-1]) + 1  # leftmost smaller
    induce = _induce_by_bucket if k <= 300 and _longest_run(s) <= 4096 else _induce_in_order
    if len(at) <= 1:
        return induce(s, small, at, k)
    sa = induce(s, small, at, k)
    is_lms = np.zeros(n, bool)
    is_lms[at] = True
    order = sa[is_lms[sa]]
    # names: equal neighbours, compared symbol by symbol up to the next leftmost smaller one
    nxt = np.full(n, n - 1)
    nxt[at[:-1]] = at[1:]
    a, b = order[:-1], order[1:]
    length = nxt[a] - a
    same = length == nxt[b] - b
    same[0] = False  # the last symbol is alone
    live, depth = np.flatnonzero(same), 0
    while len(live):
        unequal = s[a[live] + depth] != s[b[live] + depth]
        same[live[unequal]] = False
        live = live[~unequal]
        depth += 1
        live = live[length[live] >= depth]
    names = np.r_[0, np.cumsum(~same)]
    if names[-1] + 1 < len(at):
        name_at = np.zeros(n, np.int64)
        name_at[order] = names
        order = at[suffix_array(name_at[at])]
    return induce(s, small, order, k)


def permuted_common_prefixes(text: np.ndarray, sa: np.ndarray, cap: int) -> np.ndarray:
    """At each position, the length (cap at most) that its suffix shares with the one before it in order.

    text: bytes as uint8, of the length of sa; computed in text order, eight bytes a step.
    """
    n = len(sa)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    w = np.zeros(n + 8 * (cap // 8 + 2), np.uint64)
    w[:n] = text
    for shift in (1, 2, 4):
        w[:-shift] |= w[shift:] << np.uint64(8 * shift)
    out = np.zeros(n, np.int64)
    live = np.flatnonzero(before >= 0)
    other = before[live]
    for step in range((cap + 7) // 8):
        x = w[live + 8 * step] ^ w[other + 8 * step]
        equal = x == 0
        out[live[equal]] += 8
        rest = x[~equal]
        out[live[~equal]] += (np.bitwise_count((rest & -rest) - np.uint64(1)) // 8).astype(np.int64)
        live, other = live[equal], other[equal]
    return np.minimum(out, cap)
