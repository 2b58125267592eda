"""Operator 10: byte-level BPE by backtracking, and decoding by an offset table.

An Aho-Corasick automaton over the vocabulary gives the tokens that match at each byte.  The encoder takes
the longest; if its pair with the token before it is not compatible (merging the two texts in rank order
would give other tokens) it tries the next shorter one, and goes back a token when none is left.  The
sequence it ends with is the one that merging in rank order gives, found without merging.

Splits before the merges depend on little context: a word and the space before it, or a run of white space.
So each distinct (space, word) is encoded once per worker; texts with white space outside ASCII beside a
word, or with a special token, before which the text ends, are split as a whole, as that doesn't hold there.

Edge cases: null and empty texts have no ids and decode to the empty string; rows that share an id are
encoded one by one; a null id is returned as null; empty tables give empty results; other columns of the
input are not read.
"""

from __future__ import annotations

import json
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, buffers, claim, distinct, ids_back, ids_of, small_batches, span_keys, text_array, word_spans
from .packing import _byte_letters, tokenizer_file

#: Distinct words whose ids a worker keeps.
MEMO_WORDS = 200_000
#: Fixed value: the published pattern that splits text before the merges, with white space as Unicode defines it.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Fixed value: white space that doesn't end a word here but does for the pattern, and signs that only some engines take for it.
ODD_SPACE = "[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"


class ByteEncoder:
    def __init__(self, name: str):
        import ahocorasick
        import regex

        with open(tokenizer_file(name), encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        byte_of = {c: b for b, c in _byte_letters().items()}
        specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        vocab = {bytes(byte_of[c] for c in t).decode("latin-1"): i for t, i in model["vocab"].items() if t not in specials}
        self.vocab = vocab
        self.text = {i: t for t, i in vocab.items()}
        # the two parts and the rank of each token
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            x, y, z = (vocab[bytes(byte_of[c] for c in t).decode("latin-1")] for t in (a, b, a + b))
            self.parts.setdefault(z, (x, y))
            self.rank.setdefault(z, n)
            self.merged.setdefault((x, y), z)
        self.automaton = ahocorasick.Automaton()
        for t, i in vocab.items():
            self.automaton.add_word(t, i)
        self.automaton.make_automaton()
        top = max([*vocab.values(), *specials.values()]) + 1
        if top > 1 << 16:
            raise ValueError("ids are kept in 16 bits: the vocabulary is too large")
        self.size, self.shorter = [0] * top, [-1] * top  # the longest token that is a proper prefix of each
        for t, i in vocab.items():
            self.size[i] = len(t)
            self.shorter[i] = next((vocab[t[:k]] for k in range(len(t) - 1, 0, -1) if t[:k] in vocab), -1)
        # offset table for decoding
        every = [b""] * top
        for t, i in vocab.items():
            every[i] = t.encode("latin-1")
        for t, i in specials.items():
            every[i] = t.encode()
        self.bytes = np.frombuffer(b"".join(every), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(x) for x in every])])
        self.specials = specials
        self.special = regex.compile("|".join(map(regex.escape, sorted(specials, key=len, reverse=True)))) if specials else None
        self.split = regex.compile(PATTERN).findall
        self.odd = regex.compile(ODD_SPACE).search
        self.known: dict[int, bool] = {}
        self.pieces: dict[str, list[int]] = {}

    def not_local(self, text: str) -> bool:
        """Has the text what the splits at words and gaps don't take into account?"""
        return self.odd(text) is not None or (self.special is not None and self.special.search(text) is not None)

    # ------------------------------------------------------------- backtracking
    def compatible(self, left: int, right: int) -> bool:
        """Would merging the two texts side by side leave exactly these two tokens?"""
        key = left << 32 | right
        got = self.known.get(key)
        if got is None:
            if len(self.known) > 2_000_000:
                self.known.clear()
            got = self.known[key] = self._compatible(left, right)
        return got

    def _compatible(self, left: int, right: int) -> bool:
        # undo merges along the seam, the latest first: a pair across the seam that is merged earlier than both breaks the two tokens
        limit = 1 << 60
        merged, rank, parts = self.merged, self.rank, self.parts
        while True:
            z = merged.get((left, right))
            if z is not None and rank[z] < limit:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                limit = a
                left = parts[left][1]
            else:
                # on the right token the seam merge must come no later than the one undone
                limit = b + 1
                right = parts[right][0]

    def encode_piece(self, text: str) -> list[int]:
        """Ids of one piece, given as Latin-1 text of its bytes."""
        n = len(text)
        if n == 1:
            return [self.vocab[text]]
        size, shorter, known, compatible = self.size, self.shorter, self.known, self.compatible
        best = [0] * n  # the longest token at each byte: matches arrive by their end, so longer ones later
        for end, i in self.automaton.iter(text):
            best[end - size[i] + 1] = i
        out: list[int] = []
        dead = set()  # places from which no way leads to the end; a prefix has one valid sequence only, so none leads there later either
        p, i, last = 0, best[0], -1
        while True:
            while i >= 0:
                q = p + size[i]
                if q not in dead and (last < 0 or (known[key] if (key := last << 32 | i) in known else compatible(last, i))):
                    break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                if q == n:
                    return out
                p, last, i = q, i, best[q]
            else:
                dead.add(p)
                i = out.pop()
                p -= size[i]
                last = out[-1] if out else -1
                i = shorter[i]

    def _pieces(self, text: str) -> list[int]:
        out: list[int] = []
        pieces = self.pieces
        for part in self.split(text):
            got = pieces.get(part)
            if got is None:
                if len(pieces) > MEMO_WORDS:
                    pieces.clear()
                got = pieces[part] = self.encode_piece(part.encode().decode("latin-1"))
            out += got
        return out

    def encode(self, text: str) -> list[int]:
        if self.special is None:
            return self._pieces(text)
        out, at = [], 0
        for m in self.special.finditer(text):
            out += self._pieces(text[at : m.start()])
            out.append(self.specials[m.group()])
            at = m.end()
        return out + self._pieces(text[at:]) if at else self._pieces(text)

    def words(self, spaced: bool):
        """compute() for Memo: 16-bit ids of words, with a space before them or not."""

        first = " " if spaced else ""

        def run(words: list[bytes]) -> list[bytes]:
            out, pieces, encode = [], self.pieces, self.encode_piece
            for w in words:
                text = w.decode()
                if text.isalpha():  # letters alone are one piece
                    part = first + text
                    ids = pieces.get(part)
                    if ids is None:
                        if len(pieces) > MEMO_WORDS:
                            pieces.clear()
                        ids = pieces[part] = encode(first + w.decode("latin-1"))
                else:
                    ids = self._pieces(first + text)
                out.append(array("H", ids).tobytes())
            return out

        return run

    # ------------------------------------------------------------- whole columns
    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of each row of ids, through the offset table."""
        size = np.diff(self.offsets)[ids]
        to = np.concatenate([[0], np.cumsum(size)])
        within = np.arange(int(to[-1])) - np.repeat(to[:-1], size)
        return self.bytes[np.repeat(self.offsets[:-1][ids], size) + within], to[off]


_encoders: dict[str, tuple[ByteEncoder, Memo, Memo]] = {}


def _encoder(name: str) -> tuple[ByteEncoder, Memo, Memo]:
    claim("byte_bpe", _encoders.clear)
    if name not in _encoders:
        _encoders[name] = ByteEncoder(name), Memo(MEMO_WORDS), Memo(MEMO_WORDS)
    return _encoders[name]


def encode_texts(column: pa.Array, name: str) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets)."""
    encoder, plain, spaced = _encoder(name)
    data, off = buffers(column)
    starts, ends, cuts = word_spans(data, off)
    keys = span_keys(data, starts, ends)
    n = len(starts)
    doc = np.searchsorted(cuts, np.arange(n), "right") - 1
    gap_from = np.where(np.arange(n) == cuts[doc], off[doc], np.concatenate([[0], ends[:-1]])[:n])
    gap = starts - gap_from
    space = (gap > 0) & (data[np.maximum(starts - 1, 0)] == 0x20) if n else np.zeros(0, bool)
    values: list[bytes] = []
    number = np.zeros(n, np.int64)
    for memo, flag in ((plain, False), (spaced, True)):
        which = np.flatnonzero(space == flag)
        one, inverse = distinct((keys[0][which], keys[1][which]))
        number[which] = inverse + len(values)
        values += memo.rows(data, starts[which][one], ends[which][one], encoder.words(flag))
    # white space between words: what is not the one space that the word takes
    extra = gap - space
    odd_gap = np.flatnonzero(extra > 0)
    gap_value: dict[bytes, int] = {}
    raw = data.tobytes()

    def gap_ids(part: bytes, last: bool) -> list[int]:
        # a run before a word: all but its last sign form one piece, the last, if the word didn't take it, another
        text = part.decode("latin-1")
        return (encoder.encode_piece(text[:-1]) if len(text) > 1 else []) + encoder.encode_piece(text[-1]) if last else encoder.encode_piece(text)

    pieces_of = np.full(2 * n + len(off) - 1, -1, np.int64)  # per word: gap, word; per document: what follows its last word
    slot = 2 * np.arange(n) + doc
    pieces_of[slot + 1] = number
    for i in odd_gap.tolist():
        part = raw[gap_from[i] : gap_from[i] + extra[i]]
        key = (b"w" if not space[i] else b"s") + part
        if key not in gap_value:
            gap_value[key] = len(values)
            values.append(np.asarray(gap_ids(part, not space[i]), "=u2").tobytes())
        pieces_of[slot[i]] = gap_value[key]
    tail_from = np.where(cuts[1:] > cuts[:-1], np.concatenate([ends, [0]])[np.maximum(cuts[1:] - 1, 0)], off[:-1])
    for d in np.flatnonzero(off[1:] > tail_from).tolist():
        key = b"s" + raw[tail_from[d] : off[d + 1]]
        if key not in gap_value:
            gap_value[key] = len(values)
            values.append(np.asarray(gap_ids(key[1:], False), "=u2").tobytes())
        pieces_of[2 * cuts[d + 1] + d] = gap_value[key]
    # texts in which the split is not local are encoded as a whole
    whole = {}
    if encoder.not_local(raw.decode()):
        for d in range(len(off) - 1):
            text = raw[off[d] : off[d + 1]].decode()
            if encoder.not_local(text):
                whole[d] = len(values)
                values.append(np.asarray(encoder.encode(text), "=u2").tobytes())
    bounds = 2 * cuts + np.arange(len(off))
    for d, v in whole.items():
        pieces_of[bounds[d] : bounds[d + 1]] = -1
        pieces_of[bounds[d]] = v
    flat = np.frombuffer(b"".join(values), "=u2")
    sizes = np.append(np.fromiter(map(len, values), np.int64, len(values)) // 2, 0)
    first = np.cumsum(sizes) - sizes
    m = sizes[pieces_of]
    to = np.concatenate([[0], np.cumsum(m)])
    within = np.arange(int(to[-1])) - np.repeat(to[:-1], m)
    return flat[np.repeat(first[pieces_of], m) + within].astype(np.int64), to[bounds]


def _run(name: str):
    def run(stream):
        for table in batches(stream, "text"):
            ids, off = encode_texts(table["text"], name)
            data, text_off = _encoder(name)[0].decode(ids, off)
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": ids_back(ids_of(table["doc_id"])),
                    "ids": pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(ids, pa.int32())),
                    "decoded": text_array(data, text_off, pa.string()),
                }
            )

    return run


def encode_and_decode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json") -> DataFrame:
    """doc_id, ids (array of int) and decoded (the text that the ids stand for), for every document."""
    small_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return own.mapInArrow(_run(tokenizer), "doc_id long, ids array<int>, decoded string")
