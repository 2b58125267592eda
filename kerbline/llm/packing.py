"""Operator 8: packing by concatenate and cut.

First pass: every partition tokenises its documents and notes how many tokens come before each of its
chunks.  A prefix sum over the partitions' totals (one number each) turns that into places in the
concatenation of the corpus.  Second pass: fixed windows are cut; a document that crosses a boundary gives
one record on each side.  Only the last sequence of the whole table is short, so padding is at most one
sequence.

Tokens are taken word by word: white space always ends a token, so each distinct word is encoded once and
the ids of a text are put together from those of its words.

Edge cases: null and empty texts are the end id alone; rows that share an id are packed separately; a null
id is returned as null; an empty table gives no pieces; other columns of the input are not read.
"""

from __future__ import annotations

import itertools
import json
import os
import re

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Memo, batches, buffers, claim, cut, distinct, ids_back, ids_of, small_batches, span_keys, text_array, word_spans

#: Distinct words whose ids a worker keeps.
MEMO_WORDS = 100_000
#: Partitions up to which their places, two numbers each, are sent to every task; more of them are joined.
BROADCAST_PARTS = 1_000_000
_END = b"\xff"


def tokenizer_file(name: str) -> str:
    if os.path.isabs(name):
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Ids of single words, as the tokenizers library gives them for the vocabulary file.

    Words of plain Latin letters, digits and ASCII signs go through a rank-ordered merge core in which the
    word end is a byte of its own that joins the last byte first; all others go to the library itself.
    """

    def __init__(self, name: str):
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        path = tokenizer_file(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if max(model["vocab"].values()) >= 1 << 16:
            raise ValueError("ids are kept in 16 bits: the vocabulary is too large")
        suffix = model["end_of_word_suffix"]
        byte_of = {c: bytes([b]) for b, c in _byte_letters().items()}

        def raw(token: str) -> bytes:
            ends = token.endswith(suffix) and len(token) > len(suffix)
            return b"".join(byte_of[c] for c in (token[: -len(suffix)] if ends else token)) + (_END if ends else b"")

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b]) + _END: 256 + b for b in range(256)}
        ids = np.zeros(512 + len(model["merges"]), np.uint32)
        for c, b in byte_of.items():
            ids[b[0]] = model["vocab"].get(c, 0)
            ids[256 + b[0]] = model["vocab"].get(c + suffix, 0)
        for i, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            ranks[raw(a) + raw(b) if not a.endswith(suffix) else raw(a + b)] = 512 + i
            ids[512 + i] = model["vocab"][a + b]
        self.ids = ids
        self.core = tiktoken.Encoding("words", pat_str=r"\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.parts: dict[str, list[int]] = {}
        self.plain = re.compile("[\x21-\x7eÀ-ÖØ-öø-İĲ-ňŊ-ž]+").fullmatch
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+").findall

    def __call__(self, words: list[bytes]) -> list[bytes]:
        """Little-endian 16-bit ids of each word."""
        ranks: list[int] = []
        sizes, other = [], []
        if len(self.parts) > MEMO_WORDS:
            self.parts.clear()
        parts = self.parts
        plain, split, piece = self.plain, self.split, self.core.encode_single_piece
        for i, w in enumerate(words):
            text = w.decode("utf-8", "replace")
            if not plain(text) or "<|" in text or "İ" in text:
                other.append((i, text))
                sizes.append(0)
                continue
            text, before = text.lower(), len(ranks)
            if text.isalpha():
                found = (text,)
            elif text[-1] in ".,;:!?" and text[:-1].isalpha():
                found = (text[:-1], text[-1])
            else:
                found = split(text)
            for part in found:
                got = parts.get(part)
                if got is None:
                    got = parts[part] = piece(part.encode() + _END)
                ranks += got
            sizes.append(len(ranks) - before)
        flat = self.ids[ranks].astype("<u2").tobytes() if ranks else b""
        ends = list(itertools.accumulate(sizes, initial=0))
        out = [flat[2 * a : 2 * b] for a, b in itertools.pairwise(ends)]
        if other:
            for (i, _), e in zip(other, self.library.encode_batch([t for _, t in other], add_special_tokens=False), strict=True):
                out[i] = np.asarray(e.ids, "<u2").tobytes()
        return out


def _byte_letters() -> dict[int, str]:
    """Printable stand-ins for bytes in byte-level vocabularies: printable Latin-1 bytes stand for themselves, the rest follow from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_encoders: dict[str, tuple[WordEncoder, Memo]] = {}


def encode_texts(column: pa.Array, name: str, end: int | None) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts, offsets): each text's ids, then the end id if there is one."""
    claim("packing", _encoders.clear)
    if name not in _encoders:
        _encoders[name] = WordEncoder(name), Memo(MEMO_WORDS)
    encoder, memo = _encoders[name]
    data, off = buffers(column)
    starts, ends, cuts = word_spans(data, off)
    one, inverse = distinct(span_keys(data, starts, ends))
    values = memo.rows(data, starts[one], ends[one], encoder)
    flat = np.frombuffer(b"".join(values), "<u2")
    sizes = np.fromiter(map(len, values), np.int64, len(values)) // 2
    tail = int(end is not None)
    first = np.cumsum(sizes) - sizes
    n = sizes[inverse]
    before = np.concatenate([[0], np.cumsum(n)])
    doc_off = before[cuts] + tail * np.arange(len(off))
    # where each word's ids go: after all ids before it and the end ids of the texts before its own
    shift = tail * (np.searchsorted(cuts, np.arange(len(n)), "right") - 1)
    to = before[:-1] + shift
    out = np.full(int(doc_off[-1]), end or 0, np.uint16)
    within = np.arange(int(before[-1])) - np.repeat(before[:-1], n)
    out[np.repeat(to, n) + within] = flat[np.repeat(first[inverse], n) + within]
    return out, doc_off


def _tokenise(name: str, end: int):
    def run(stream):
        part, done, chunk = TaskContext.get().partitionId(), 0, 0
        press = zstandard.ZstdCompressor(level=1)
        for table in batches(stream, "text"):
            ids, off = encode_texts(table["text"], name, end)
            yield pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int64()),
                    "chunk": pa.array([chunk], pa.int64()),
                    "before": pa.array([done], pa.int64()),
                    "total": pa.array([len(ids)], pa.int64()),
                    "docs": pa.array([press.compress(ids_of(table["doc_id"]).astype("<i8").tobytes())], pa.binary()),
                    "sizes": pa.array([press.compress(np.diff(off).astype("<i8").tobytes())], pa.binary()),
                    "ids": pa.array([press.compress(ids.astype("<u2").tobytes())], pa.binary()),
                }
            )
            done += len(ids)
            chunk += 1

    return run


def _cut(length: int):
    def run(stream):
        open_ = zstandard.ZstdDecompressor()
        for batch in stream:
            for row in batch.to_pylist():
                docs, sizes = np.frombuffer(open_.decompress(row["docs"]), "<i8"), np.frombuffer(open_.decompress(row["sizes"]), "<i8")
                ids = np.frombuffer(open_.decompress(row["ids"]), "<u2")
                local = np.concatenate([[0], np.cumsum(sizes)])
                place = local + row["before"] + row["base"]
                first, last = place[:-1] // length, (place[1:] - 1) // length
                n = last - first + 1
                doc = np.repeat(np.arange(len(docs)), n)
                sequence = first[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                lo, hi = np.maximum(place[doc], sequence * length), np.minimum(place[doc + 1], (sequence + 1) * length)
                edges = np.append(lo, hi[-1:]) - place[0]
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": ids_back(docs[doc]),
                        "start": pa.array(lo - place[doc], pa.int64()),
                        "length": pa.array(hi - lo, pa.int64()),
                        "ids": text_array(ids.astype("<u4").view(np.uint8), 4 * edges, pa.binary()),
                        "doc_tokens": pa.array(sizes[doc], pa.int64()),
                        "sequence_id": pa.array(sequence, pa.int64()),
                        "offset": pa.array(lo - sequence * length, pa.int64()),
                    }
                )

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "word_bpe_49k.json", end: int = 1, length: int = 2048) -> DataFrame:
    """Cut the concatenation of all documents' ids into sequences of `length`.

    Returns one row per piece: doc_id, start and length within the document's ids, ids (little-endian
    unsigned 32-bit), doc_tokens, sequence_id and offset in it.
    """
    spark = docs.sparkSession
    small_batches(spark)
    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    chunks = cut(own.mapInArrow(_tokenise(tokenizer, end), "part long, chunk long, before long, total long, docs binary, sizes binary, ids binary"))
    # one number per partition of the first pass, whatever the size of the corpus
    totals = chunks.groupBy("part").agg(F.max(F.col("before") + F.col("total")).alias("total")).orderBy("part").collect()
    base, at = [], 0
    for row in totals:
        base.append((row.part, at))
        at += row.total
    places = spark.createDataFrame(base, "part long, base long")
    if len(base) <= BROADCAST_PARTS:  # the bodies then stay where they are
        places = F.broadcast(places)
    return chunks.join(places, "part").mapInArrow(_cut(length), "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
