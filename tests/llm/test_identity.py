"""Words, texts and sets are told apart by what they hold: long words on which polynomial hashes collide."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F


def thue_morse(n, a, b):
    return "".join(b if i.bit_count() % 2 else a for i in range(n))


@pytest.fixture(scope="module")
def pairs():
    out = []
    for n in (512, 1024, 2048, 4096, 8192):
        out += [thue_morse(n, "a", "b"), thue_morse(n, "b", "a")]
    return out


def test_keys_differ(pairs):
    from kerbline.llm.common import distinct, span_keys

    data = np.frombuffer(" ".join([*pairs, *pairs]).encode(), np.uint8)
    size = np.array([len(x) + 1 for x in [*pairs, *pairs]])
    starts = np.cumsum(size) - size
    one, inverse = distinct(span_keys(data, starts, starts + size - 1))
    assert len(one) == len(pairs) and inverse[: len(pairs)].tolist() == inverse[len(pairs) :].tolist()


def test_tokenizers(pairs):
    from kerbline.llm import byte_bpe, packing

    texts = [*pairs, " ".join(pairs[:4])]
    for module, name in ((byte_bpe, "byte_bpe_50k.json"), (packing, "word_bpe_49k.json")):
        from tokenizers import Tokenizer

        want = [e.ids for e in Tokenizer.from_file(packing.tokenizer_file(name)).encode_batch(texts, add_special_tokens=False)]
        ids, off = module.encode_texts(pa.array(texts), name) if module is byte_bpe else module.encode_texts(pa.array(texts), name, None)
        assert [ids[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)] == want


def test_windows_sets_and_counts(spark, pairs):
    from kerbline.llm.fm_index import dedup_word_windows
    from kerbline.llm.hidden_markov import score
    from kerbline.llm.near_dedup import near_duplicates

    tail = " ".join(f"w{i}" for i in range(19))
    rows = [(i, f"{w} {tail}") for i, w in enumerate(pairs)] + [(100 + i, w) for i, w in enumerate(pairs)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    assert {r.doc_id: r.kept for r in dedup_word_windows(docs, width=20).collect()} == dict(rows)
    single = {r.doc_id: r.component_id for r in near_duplicates(docs.where("doc_id >= 100")).collect()}
    assert single == {d: d for d, _ in rows if d >= 100}
    found = score(docs.where("doc_id >= 100"), F.col("doc_id") == 102).collect()
    for r in found:  # one word and the end in training, two kinds
        assert r.n_known == 1 + (r.doc_id == 102)
        assert r.base_score == pytest.approx(math.log10(2 / 5) + math.log10((2 if r.doc_id == 102 else 1) / 5))


def test_packing_digests(spark, sf_dir):
    import zlib

    from tokenizers import Tokenizer

    from kerbline.llm.packing import tokenizer_file
    from kerbline.llm.queries import op8_packing

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    t = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    ids = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in texts.items()}
    filled = {}
    for r in op8_packing(spark, sf_dir).collect():
        part = ids[r.doc_id][r.start : r.start + r.length]
        assert len(part) == r.length and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.asarray(part, "<u4").tobytes())
        filled.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(filled) == list(range(len(filled)))
    for places in filled.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:k]) for k in range(len(places))]
    assert sum(n for places in filled.values() for _, n in places) == sum(map(len, ids.values()))


def test_window_digests(spark, sf_dir):
    import re

    from kerbline.llm.queries import op2_fm_index_dedup, op5_near_dedup

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    word = {d: re.findall("[^\x20\x09-\x0d]+", x or "") for d, x in texts.items()}
    first, kept = {}, {}
    for d in sorted(word):
        w, gone = word[d], [False] * len(word[d])
        for i in range(len(w) - 19):
            key = hashlib.blake2b(" ".join(w[i : i + 20]).encode()).digest()
            if first.setdefault(key, (d, i)) != (d, i):
                gone[i : i + 20] = [True] * 20
        kept[d] = [x for x, g in zip(w, gone, strict=True) if not g]
    for r in op2_fm_index_dedup(spark, sf_dir).collect():
        assert (r.n_words, r.n_removed) == (len(word[r.doc_id]), len(word[r.doc_id]) - len(kept[r.doc_id]))
        assert r.kept_sha256 == hashlib.sha256(" ".join(kept[r.doc_id]).encode()).hexdigest()
    sets = {}
    for d, x in texts.items():
        w = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), x or ""))
        sets[d] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    top = {d: d for d in sets}

    def root(d):
        while top[d] != d:
            d = top[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                x, y = sorted((root(a), root(b)))
                top[y] = x
    for r in op5_near_dedup(spark, sf_dir).collect():
        assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), root(r.doc_id), root(r.doc_id) == r.doc_id)


def test_bits_rank_and_select():
    from kerbline.llm.fm_index import BitVector

    rng = np.random.default_rng(5)
    for n, share in ((1, 1.0), (64, 0.5), (1000, 0.03), (1000, 0.97), (130, 0.0)):
        bits = rng.random(n) < share
        v, ones = BitVector(bits), np.flatnonzero(bits)
        at = np.arange(n + 1)
        assert v.rank(at).tolist() == [int(bits[:k].sum()) for k in at]
        assert v.select(np.arange(len(ones) + 1)).tolist() == [*ones.tolist(), n]


def test_training_stops_when_the_likelihood_hardly_rises(spark, monkeypatch):
    from kerbline.llm import hidden_markov as hmm

    docs = spark.createDataFrame([(i, f"a b a b c{i % 3} " * 20) for i in range(30)], "doc_id long, text string")
    rounds = []
    real = hmm._split
    monkeypatch.setattr(hmm, "_split", lambda sums: rounds.append(sums[-2] / sums[-1]) or real(sums))
    hmm.train(docs, most_rounds=9, tolerance=0.0005)
    assert 2 <= len(rounds) < 9 and rounds[-1] >= rounds[0] - 1e-3
    rounds.clear()
    hmm.train(docs, most_rounds=1)
    assert len(rounds) == 1
