"""Operator 13: periodic runs of words, found through the runs theorem.

Every maximal run has a Lyndon root that is the longest Lyndon word starting at its place under one of two orders
of the alphabet.  The longest Lyndon word at a place ends where the next suffix that is smaller (larger, for the
other order) begins, so both follow from the inverse suffix array.  A root is extended to the right by the longest
common prefix of the suffixes at its start and its end, a range minimum over the LCP array, and to the left by the
same over the words in reverse.

Texts reach Python in pieces of about one megabyte, no row is shuffled.  All documents of a piece are worked on
abreast with numpy: suffixes are ordered document by document, by prefix doubling in which only suffixes that are
not yet told apart are sorted again, so ordinary prose takes a few rounds.  Neighbours, range minima and extensions
are binary descents, O(n log n) a piece, also where a whole text is one run.

Edge cases: null and empty texts and texts of separators alone have no words and no runs; an empty table gives an
empty table; rows that share an id or have none, and repeated rows, are worked on by themselves; other columns are
not read.  A text is held whole by its task, with about 25 bytes of memory a byte of text.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, buffers, claim, distinct, gather, heads_of, ids_back, ids_of, small_batches, span_keys, text_array, word_spans

RUN = "struct<start: long, length: long, period: long>"


@dataclass
class Suffixes:
    """The suffixes of all texts of a piece, ordered text by text; place[k] is the k-th, rank its inverse, ties[j] the ranks by the first 2^j words."""

    place: np.ndarray
    rank: np.ndarray
    ties: list[np.ndarray]


def order_suffixes(words: np.ndarray, text: np.ndarray, ends: np.ndarray) -> Suffixes:
    """words: numbers from 0; text: the number of the text each word is of, ascending; ends: where that text ends."""
    n = len(words)
    key = text * (int(words.max(initial=0)) + 1) + words
    place = np.argsort(key, kind="stable")
    heads = heads_of(key[place])
    rank = np.empty(n, np.int64)
    rank[place] = np.repeat(heads, np.diff(np.append(heads, n)))
    ties, width = [rank], 1
    size = np.diff(np.append(heads, n))
    slots = np.flatnonzero(np.repeat(size > 1, size))
    while len(slots):
        at = place[slots]
        beyond = at + width
        follows = np.where(beyond < ends[at], rank[np.minimum(beyond, n - 1)] + 1, 0)
        key = rank[at] * (n + 1) + follows
        by = np.argsort(key, kind="stable")
        at, key = at[by], key[by]
        place[slots] = at
        heads = heads_of(key)
        size = np.diff(np.append(heads, len(key)))
        rank = rank.copy()
        rank[at] = np.repeat(slots[heads], size)
        ties.append(rank)
        slots = slots[np.repeat(size > 1, size)]
        width *= 2
    return Suffixes(place, rank, ties)


def range_minima(values: np.ndarray, most: int) -> list[np.ndarray]:
    """Sparse table: minima of values[i : i + 2^j], for ranges of up to `most` values."""
    table, width = [values], 1
    while 2 * width <= min(most, len(values)):
        below = table[-1]
        table.append(np.minimum(below[:-width], below[width:]))
        width *= 2
    return table


def next_smaller(values: np.ndarray, ends: np.ndarray, table: list[np.ndarray]) -> np.ndarray:
    """The first place after i, before ends[i], whose value is below that at i; else ends[i]."""
    n = len(values)
    at = np.arange(1, n + 1)
    live, found = np.arange(n), at.copy()
    step = np.zeros(n, np.int64)
    # up: ever longer ranges without a smaller value are skipped; most searches end within a few places
    level = 0
    while len(live):
        fits = found[live] + (1 << level) <= ends[live] if level < len(table) else np.zeros(len(live), bool)
        clear = np.zeros(len(live), bool)
        inside = live[fits]
        clear[fits] = table[level][found[inside]] > values[inside] if level < len(table) else False
        step[live[~clear]] = level
        live = live[clear]
        found[live] += 1 << level
        level += 1
    # down: the range that holds it is halved
    for level in range(int(step.max(initial=0)) - 1, -1, -1):
        live = np.flatnonzero((step > level) & (found + (1 << level) <= ends))
        live = live[table[level][found[live]] > values[live]]
        found[live] += 1 << level
    return np.minimum(found, ends)


def common_prefixes(suffixes: Suffixes, text: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """LCP array: words that the suffix at a slot shares with the one before it; 0 at slots that are not asked for and where a text begins."""
    n = len(text)
    lcp = np.zeros(n, np.int64)
    slots = slots[slots > 0]
    slots = slots[text[suffixes.place[slots]] == text[suffixes.place[slots - 1]]]
    a, b = suffixes.place[slots - 1].copy(), suffixes.place[slots].copy()
    for level in range(len(suffixes.ties) - 1, -1, -1):
        ties = suffixes.ties[level]
        inside = np.flatnonzero(np.maximum(a, b) < n)
        same = inside[ties[a[inside]] == ties[b[inside]]]
        a[same] += 1 << level
        b[same] += 1 << level
        lcp[slots[same]] += 1 << level
    return lcp


class Extension:
    """Longest common prefixes of any two suffixes of one text."""

    def __init__(self, suffixes: Suffixes, text: np.ndarray, slots: np.ndarray, most: int):
        self.rank = suffixes.rank
        self.table = range_minima(common_prefixes(suffixes, text, slots), most)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        low, high = np.minimum(self.rank[a], self.rank[b]) + 1, np.maximum(self.rank[a], self.rank[b]) + 1
        level = np.frexp((high - low).astype(float))[1] - 1
        out = np.zeros(len(a), np.int64)
        for j in np.unique(level).tolist():
            of = np.flatnonzero(level == j)
            out[of] = np.minimum(self.table[j][low[of]], self.table[j][high[of] - (1 << j)])
        return out


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    before = np.cumsum(sizes) - sizes
    return np.arange(int(sizes.sum())) + np.repeat(starts - before, sizes)


def find_runs(words: np.ndarray, cuts: np.ndarray, min_length: int, min_exponent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, lengths, periods) of the maximal runs of all texts, by start and then period; text k has words[cuts[k] : cuts[k + 1]].

    A run that is kept has min_exponent periods and min_length words at least, min_exponent being 2 or more.
    """
    n, none = len(words), np.zeros(0, np.int64)
    if not n:
        return none, none, none
    sizes = np.diff(cuts)
    text = np.repeat(np.arange(len(sizes)), sizes)
    ends = cuts[1:][text]
    longest = int(sizes.max())
    suffixes = order_suffixes(words, text, ends)
    roots, periods = [], []
    for rank in (suffixes.rank, -suffixes.rank):
        period = next_smaller(rank, ends, range_minima(rank, longest)) - np.arange(n)
        # the first root of a run that is kept repeats for this many words at least; equal ranks say that it may
        least = np.maximum(min_length, min_exponent * period) - 2 * period + 1
        at = np.flatnonzero((np.arange(n) + period + np.maximum(least, 1) <= ends) & (least > 0))
        level = np.frexp(least[at].astype(float))[1] - 1
        keep = np.zeros(len(at), bool)
        for j in np.unique(level[level < len(suffixes.ties)]).tolist():
            of = np.flatnonzero(level == j)
            keep[of] = suffixes.ties[j][at[of]] == suffixes.ties[j][at[of] + period[at[of]]]
        roots.append(at[keep])
        periods.append(period[at[keep]])
    root, period = np.concatenate(roots), np.concatenate(periods)
    if not len(root):
        return none, none, none
    # only texts with such roots are looked at further; their suffixes stand together in the order
    some = np.unique(text[root])
    right = Extension(suffixes, text, _ranges(cuts[some], sizes[some]), longest)(root, root + period)
    own = _ranges(cuts[some], sizes[some])
    back = np.zeros(len(sizes) + 1, np.int64)
    sub = np.zeros(len(sizes), np.int64)
    sub[some] = sizes[some]
    np.cumsum(sub, out=back[1:])
    mirror = _ranges(cuts[some], sizes[some])[::-1]
    flipped_text = (len(sizes) - 1 - text[own])[::-1]
    total = len(mirror)
    bounds = total - back[:-1][text[own]][::-1]
    reverse = order_suffixes(words[mirror], flipped_text, bounds)
    place = np.full(n, -1)
    place[mirror] = np.arange(total)
    leftwards = Extension(reverse, flipped_text, np.arange(total), longest)
    left = np.zeros(len(root), np.int64)
    inner = np.flatnonzero(root > cuts[:-1][text[root]])
    left[inner] = leftwards(place[root[inner] - 1], place[root[inner] + period[inner] - 1])
    start, length = root - left, left + period + right
    keep = length >= np.maximum(min_length, min_exponent * period)
    found = np.unique(np.stack([start[keep], period[keep], length[keep]], axis=1), axis=0)
    return found[:, 0], found[:, 2], found[:, 1]


def _strongest(start: np.ndarray, length: np.ndarray, period: np.ndarray) -> int:
    """The run with the greatest exact exponent; ties: smallest start, then period."""
    return min(range(len(start)), key=lambda i: (-Fraction(int(length[i]), int(period[i])), int(start[i]), int(period[i])))


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_length: int = 6, min_exponent: int = 4) -> DataFrame:
    """doc_id, n_words, runs (start, length, period in words; by start, then period), strongest (one of runs, null if there is none), collapsed.

    `collapsed` is the text's words, joined by one space, without those that a run contains after its first period.
    The strongest run has the greatest length / period; ties go to the smallest start, then period.
    """
    if min_exponent < 2:
        raise ValueError("a run has two periods at least")
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))

    def work(stream):
        claim("periodic_runs")
        for piece in batches(stream, "text"):
            data, off = buffers(piece["text"])
            first, last, cuts = word_spans(data, off)
            _, words = distinct(span_keys(data, first, last))
            start, length, period = find_runs(words, cuts, min_length, min_exponent)
            edge = np.searchsorted(start, cuts)
            gone = np.zeros(len(first) + 1, np.int64)
            np.add.at(gone, start + period, 1)
            np.add.at(gone, start + length, -1)
            keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
            owner = np.searchsorted(cuts, keep, side="right") - 1
            local = start - cuts[:-1][np.searchsorted(cuts, start, side="right") - 1]
            best = [None if a == b else a + _strongest(local[a:b], length[a:b], period[a:b]) for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
            run = pa.StructArray.from_arrays([pa.array(local), pa.array(length), pa.array(period)], ["start", "length", "period"])
            runs = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), run)
            strongest = run.take(pa.array(best, pa.int64()))
            text, text_off = _joined(data, first[keep], last[keep], owner, piece.num_rows)
            yield pa.RecordBatch.from_arrays(
                [ids_back(ids_of(piece["doc_id"])), pa.array(np.diff(cuts)), runs, strongest, text_array(text, text_off, pa.string())],
                ["doc_id", "n_words", "runs", "strongest", "collapsed"],
            )

    return own.mapInArrow(work, f"doc_id long, n_words long, runs array<{RUN}>, strongest {RUN}, collapsed string")


def _joined(data: np.ndarray, first: np.ndarray, last: np.ndarray, owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """The words of each text with one space between, as bytes and offsets; owner: the text of each word, ascending."""
    spaced = np.append(data, np.uint8(0x20))
    place = np.empty(2 * len(first), np.int64)
    stop = np.empty(2 * len(first), np.int64)
    place[0::2], stop[0::2] = first, last
    # a space after each word but the last of its text
    final = np.ones(len(first), bool)
    final[:-1] = owner[1:] != owner[:-1]
    place[1::2] = len(data)
    stop[1::2] = len(data) + ~final
    out, off = gather(spaced, place, stop)
    at = np.searchsorted(owner, np.arange(texts + 1))
    return out, off[2 * at]
