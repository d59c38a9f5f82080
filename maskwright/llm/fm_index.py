"""A compressed FM-index over words, as numpy arrays: many patterns are searched in step."""

from __future__ import annotations

import numpy as np


class WaveletMatrix:
    """Symbols as one bit vector per bit, 64 to a word, with running counts: rank of a symbol in as many lookups."""

    def __init__(self, symbols: np.ndarray, size: int):
        self.levels = max(1, int(size - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            packed = np.packbits(padded, bitorder="little").view(np.uint64)
            self.bits.append(packed)
            self.counts.append(np.concatenate([[0], np.cumsum(np.bitwise_count(packed), dtype=np.int32)[:-1]]).astype(np.int32))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])
        every = np.arange(size)
        self.base = self._walk(every, np.zeros(size, np.int64))

    def _walk(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        for k in range(self.levels):
            word = at >> 6
            below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
            ones = self.counts[k][word] + np.bitwise_count(self.bits[k][word] & below)
            at = np.where((symbol >> (self.levels - 1 - k)) & 1, self.zeros[k] + ones, at - ones)
        return at

    def rank(self, symbol: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs before each place."""
        return self._walk(symbol, at) - self.base[symbol]


def suffix_order(symbols: np.ndarray, depth: int) -> np.ndarray:
    """Suffixes in the order of their first ``depth`` symbols, by doubling."""
    n, have = len(symbols), 1
    rank = np.unique(symbols, return_inverse=True)[1].astype(np.int64)
    order = np.argsort(rank, kind="stable")
    while have < depth:
        key = rank * (n + 1)
        key[: n - have] += rank[have:] + 1
        order = np.argsort(key, kind="stable")
        ranked = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        if rank[order[-1]] == n - 1:
            break
        have *= 2
    return order


class RangeMinimum:
    def __init__(self, values: np.ndarray):
        self.rows = [values]
        while 2 * (step := 1 << (len(self.rows) - 1)) <= len(values):
            last = self.rows[-1]
            self.rows.append(np.minimum(last[:-step], last[step:]))
        self.table = np.full((len(self.rows), len(values)), np.iinfo(values.dtype).max, values.dtype)
        for k, row in enumerate(self.rows):
            self.table[k, : len(row)] = row
        del self.rows

    def __call__(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The least value in each non-empty [low, high)."""
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        return np.minimum(self.table[k, low], self.table[k, high - (1 << k)])


class Index:
    """FM-index of several word sequences, each with an owner; 0 parts them."""

    def __init__(self, symbols: np.ndarray, owners: np.ndarray, size: int, depth: int):
        order = suffix_order(symbols, depth)
        self.length = len(symbols)
        self.matrix = WaveletMatrix(symbols[order - 1], size)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=size))])
        self.owner = RangeMinimum(owners[order])

    def extend(self, symbol: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows whose suffixes start with the symbol, then what [low, high) start with: a backward step."""
        n = len(symbol)
        rank = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([low, high]))
        return self.first[symbol] + rank[:n], self.first[symbol] + rank[n:]


def earlier_matches(index: Index, text: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal parts of ``width`` words or more of each text[begin:end] that the index has from a smaller owner.

    Returns (query, from, to). All queries go backwards in step. Where a match can't grow over place f, every
    longer match that holds f ends earlier; how far the words from f on match is found by halving, and the search
    goes on from there, so what has matched is never searched word by word again. Texts full of near matches would
    take many such turns; what is open after 4 * ``width`` steps is searched window by window, all at once."""
    n, whole = len(begin), index.length
    left, right = end.copy(), end.copy()
    low, high = np.zeros(n, np.int64), np.full(n, whole)
    halving = np.zeros(n, bool)
    stop, sure, failed = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    sure_low, sure_high = np.zeros(n, np.int64), np.zeros(n, np.int64)
    out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    live = np.flatnonzero(end - begin >= width)

    def report(q: np.ndarray) -> None:
        q = q[right[q] - left[q] >= width]
        if len(q):
            out.append((q, left[q], right[q]))

    for _ in range(4 * width):
        if not len(live):
            break
        q = live
        # a symbol that the index lacks is past its alphabet and fails
        symbol = text[left[q] - 1]
        new_low, new_high = index.extend(symbol, low[q], high[q])
        ok = new_high > new_low
        ok[ok] = index.owner(new_low[ok], new_high[ok]) < owner[q[ok]]
        grown = q[ok]
        left[grown] -= 1
        low[grown], high[grown] = new_low[ok], new_high[ok]
        finished = grown[~halving[grown] & (left[grown] == begin[grown])]
        report(finished)

        lost = q[~ok]
        broke = lost[~halving[lost]]
        report(broke)
        stop[broke] = left[broke] - 1
        sure[broke], failed[broke] = stop[broke], right[broke]
        sure_low[broke], sure_high[broke] = 0, whole
        half = lost[halving[lost]]
        failed[half] = right[half]
        reached = grown[halving[grown] & (left[grown] == stop[grown])]
        sure[reached], sure_low[reached], sure_high[reached] = right[reached], low[reached], high[reached]

        turn = np.concatenate([broke, half, reached])
        done = failed[turn] - sure[turn] <= 1
        found, more = turn[done], turn[~done]
        halving[more] = True
        right[more] = left[more] = (sure[more] + failed[more]) // 2
        low[more], high[more] = 0, whole
        halving[found] = False
        right[found], left[found] = sure[found], stop[found]
        low[found], high[found] = sure_low[found], sure_high[found]
        at_begin = found[left[found] == begin[found]]
        report(at_begin)
        short = found[right[found] - begin[found] < width]
        over = np.zeros(n, bool)
        over[finished] = over[at_begin] = over[short] = True
        live = live[~over[live]]
    if len(live):
        out.append(_window_matches(index, text, live, begin[live], np.where(halving, failed, right)[live], owner[live], width))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64),) * 3


def _window_matches(index: Index, text: np.ndarray, query: np.ndarray, begin: np.ndarray, end: np.ndarray, owner: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The windows of each text[begin:end] that the index has from a smaller owner, a step of all at a time."""
    count = np.maximum(end - begin - width + 1, 0)
    of = np.repeat(np.arange(len(query)), count)
    start = begin[of] + np.arange(len(of)) - np.repeat(np.cumsum(count) - count, count)
    low, high = np.zeros(len(of), np.int64), np.full(len(of), index.length)
    for back in range(width - 1, -1, -1):
        low, high = index.extend(text[start + back], low, high)
        ok = high > low
        ok[ok] = index.owner(low[ok], high[ok]) < owner[of[ok]]
        of, start, low, high = of[ok], start[ok], low[ok], high[ok]
    return query[of], start, start + width
