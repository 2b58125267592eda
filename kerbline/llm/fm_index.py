"""Operator 2: substring dedup over words with one compressed FM-index per shard.

A shard is a bucket of the exchange in `repeats`: the distinct super-windows that share anchors.  Its index is a
wavelet matrix over the Burrows-Wheeler transform of their words, and one bit a row that says where the first `width`
words differ from those of the row before: (log2(distinct words) + 1) bits a word and half as much for counts.  The
order of the suffixes is only needed to make these and is not kept.

The super-windows then stream through backward search, all abreast: each step takes the next word on the left and
yields the interval of the longest match, cut at `width` words (its matching statistic).  A match of width + 1 words
widens to the interval of its first `width`, whose ends the bits give; intervals that reach the threshold with more than
one row are repeated windows, and the number of the interval names them.

Suffixes are sorted to a depth of at least width + 1 words, which backward search up to that length needs.

Edge cases: null and empty texts have no words and keep the empty string; a null id comes before every id
and is returned as null; among rows that share an id an equal start is not earlier, so neither is removed;
an empty table gives an empty result; other columns of the input are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import distinct, ids_back, ids_of, span_keys, text_array, word_spans
from .repeats import Supers, Units, repeated

#: Words of the grams that choose anchors.
GRAM_WORDS = 8


class BitVector:
    """Bits with rank and select, and a count before every 64 of them."""

    def __init__(self, bits: np.ndarray):
        padded = np.zeros(len(bits) + 64 - len(bits) % 64, np.uint8)
        padded[: len(bits)] = bits
        self.words = np.packbits(padded, bitorder="little").view("<u8")
        ones = np.bitwise_count(self.words).astype(np.int32)
        self.before = (np.cumsum(ones, dtype=np.int32) - ones).astype(np.int32)
        self.size, self.ones = len(bits), int(ones.sum())

    def rank(self, at: np.ndarray) -> np.ndarray:
        """Ones before each place."""
        word = at >> 6
        mask = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[word] + np.bitwise_count(self.words[word] & mask).astype(np.int64)

    def select(self, k: np.ndarray) -> np.ndarray:
        """The place of the k-th one, counted from 0; the size for as many as there are."""
        word = np.maximum(np.searchsorted(self.before, k, "right") - 1, 0)
        bits, left, place = self.words[word], k - self.before[word], np.zeros(len(k), np.int64)
        for half in (32, 16, 8, 4, 2, 1):
            low = bits & np.uint64((1 << half) - 1)
            ones = np.bitwise_count(low).astype(np.int64)
            up = left >= ones
            left, place = np.where(up, left - ones, left), np.where(up, place + half, place)
            bits = np.where(up, bits >> np.uint64(half), low)
        return np.where(k < self.ones, 64 * word + place, self.size)


class WaveletMatrix:
    """rank(symbol, position) over a sequence of symbols: one bit vector per level."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.planes, self.zeros = [], []
        for level in range(self.levels - 1, -1, -1):
            bit = (symbols >> level) & 1
            self.planes.append(BitVector(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def rank(self, symbol: np.ndarray, at: np.ndarray, start: np.ndarray) -> np.ndarray:
        """Occurrences of symbol before `at`; start: the place of the symbol's first occurrence in the last level."""
        for k, level in enumerate(range(self.levels - 1, -1, -1)):
            ones = self.planes[k].rank(at)
            at = np.where((symbol >> level) & 1 == 1, self.zeros[k] + ones, at - ones)
        return at - start


class FMIndex:
    def __init__(self, symbols: np.ndarray, sigma: int, depth: int, window: int = 0):
        """symbols: texts that each end with a 0.  depth: what a searched pattern has at most.  window: length to which matches are widened."""
        n = len(symbols)
        rank, have = symbols.astype(np.int64), 1
        order = np.argsort(rank, kind="stable")
        while have < depth:
            after = np.zeros(n, np.int64)
            after[: n - have] = rank[have:] + 1 if have < n else 0
            order = np.argsort(rank * (int(rank.max()) + 3) + after, kind="stable")
            both = rank[order], after[order]
            new = np.ones(n, bool)
            new[1:] = (both[0][1:] != both[0][:-1]) | (both[1][1:] != both[1][:-1])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new) - 1
            have *= 2
        self.size = n
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=sigma))])
        self.matrix = WaveletMatrix(symbols[order - 1], sigma)
        every = np.arange(sigma)
        self.start = self.matrix.rank(every, np.zeros(sigma, np.int64), np.zeros(sigma, np.int64))
        # a common prefix of the rows before and at each place that is shorter than the window
        border = np.zeros(n, bool)
        border[0] = True
        for j in range(window):
            border[1:] |= symbols[np.minimum(order[1:] + j, n - 1)] != symbols[np.minimum(order[:-1] + j, n - 1)]
        self.borders = BitVector(border)

    def step(self, symbol: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The interval of symbol followed by what [lo, hi) matches."""
        both = self.matrix.rank(np.concatenate([symbol, symbol]), np.concatenate([lo, hi]), np.concatenate([self.start[symbol]] * 2))
        return self.first[symbol] + both[: len(symbol)], self.first[symbol] + both[len(symbol) :]

    def widened(self, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(number, lo, hi) of the interval of all rows that share their first `window` symbols with row lo."""
        number = self.borders.rank(lo + 1) - 1
        return number, self.borders.select(number), self.borders.select(number + 1)


def fm_groups(body: np.ndarray, off: np.ndarray, counts: np.ndarray, width: int) -> np.ndarray:
    """Group number of every window by backward search; -1 where a window occurs once."""
    starts, ends, cuts = word_spans(body, off)
    _, word = distinct(span_keys(body, starts, ends))
    sizes = np.diff(cuts)
    symbols = np.zeros(len(word) + len(sizes), np.int64)
    at = np.arange(len(word)) + np.repeat(np.arange(len(sizes)), sizes)
    symbols[at] = word + 1
    sigma = int(symbols.max()) + 1
    index = FMIndex(symbols, sigma, width + 2, width)
    n = len(symbols)
    # all texts stream abreast, from their last word to their first
    last = cuts[1:] + np.arange(len(sizes)) - 1
    by = np.argsort(-sizes, kind="stable")
    lo, hi = np.zeros(len(by), np.int64), np.full(len(by), n, np.int64)
    base = np.cumsum(counts) - counts
    group = np.full(int(counts.sum()), -1, np.int64)
    alive = sizes[by]
    for t in range(int(sizes.max(initial=0))):
        m = int(np.searchsorted(-alive, -t, "left"))  # texts with more than t words
        lanes = by[:m]
        lo, hi = index.step(symbols[last[lanes] - t], lo[:m], hi[:m])
        if t + 1 >= width:
            g, lo, hi = index.widened(lo)
            many = hi - lo > 1
            group[(base[lanes] + counts[lanes] - 1 - (t + 1 - width))[many]] = g[many]
    return group


def dedup_word_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """Remove every word that a window of `width` words covers which starts earlier too: in a smaller id, or further up the same document.

    Returns doc_id, n_words, removed (array of word positions, start and end, maximal runs) and kept (the remaining words joined by one space).
    """
    units = Units(width, min(GRAM_WORDS, max(1, width // 2)), True, True)

    def finish(table: pa.Table, s: Supers, gone: np.ndarray) -> pa.Table:
        from .repeats import run_spans

        ids, cuts = ids_of(table["doc_id"]), s.cuts
        lo, hi = run_spans(gone, cuts)
        owner = np.searchsorted(cuts, lo, "right") - 1
        spans = np.searchsorted(lo, cuts)
        stay = np.flatnonzero(~gone)
        # each word that stays, followed by a space unless it is its document's last
        kept_words = np.concatenate([[0], np.cumsum(~gone)])[cuts]
        a, b = s.starts[stay], s.ends[stay]
        size = b - a + 1
        size[kept_words[1:][np.diff(kept_words) > 0] - 1] -= 1
        to = np.concatenate([[0], np.cumsum(size)])
        out = np.full(int(to[-1]), 0x20, np.uint8)
        lens = b - a
        within = np.arange(int(lens.sum())) - np.repeat(np.cumsum(lens) - lens, lens)
        out[np.repeat(to[:-1], lens) + within] = s.data[np.repeat(a, lens) + within]
        pairs = pa.StructArray.from_arrays([pa.array(lo - cuts[owner]), pa.array(hi - cuts[owner])], ["start", "end"])
        return pa.table(
            {
                "doc_id": ids_back(ids),
                "n_words": pa.array(np.diff(cuts), pa.int64()),
                "removed": pa.ListArray.from_arrays(pa.array(spans, pa.int32()), pairs),
                "kept": text_array(out, to[kept_words], pa.string()),
            }
        )

    schema = T._parse_datatype_string("doc_id long, n_words long, removed array<struct<start:long,end:long>>, kept string")
    return repeated(docs, id_col, text_col, units, fm_groups, finish, schema)
