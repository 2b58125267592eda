"""Training-data operators against plain versions of themselves on small tables, edge cases included."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORDS = "[^\x20\x09-\x0d]+"
#: Columns that clash with names the operators use inside.
CLASH = "doc_id long, text string, block long, bucket long, rest string, part int"


def words(text):
    return re.findall(WORDS, text or "")


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


@pytest.fixture(scope="module")
def rows():
    """Prose with copies, near copies, shared passages, periodic and very long texts, null, empty, odd white space and ties."""
    rng = random.Random(4)
    vocab = ["".join(rng.choice("abdeinorst") for _ in range(rng.randint(1, 7))) for _ in range(400)] + ["é", "日本", "naïve,", "x.", "'s", "42"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(45)
    lines = "\n".join(text(9) for _ in range(6))
    base = text(300).split(" ")
    out = [(1, text(80)), (2, None), (3, ""), (4, "\t \n"), (5, passage), (6, text(30) + " " + passage + " " + text(10)), (7, passage + "  " + passage), (8, "ab " * 400), (9, "ab " * 90), (10, "one")]
    out += [(11, "ONE"), (12, text(6000)), (13, lines), (14, text(12) + "\n" + lines + "\n\n" + text(4)), (15, lines + "\n" + lines), (16, " a 　b\x85 c\x1cd"), (17, "日本 " * 40), (18, "<|endoftext|> a<|endoftext|>")]
    for i in range(6):
        other = list(base)
        for _ in range(i):
            other[rng.randrange(300)] = "changed"
        out.append((20 + i, " ".join(other)))
    out += [(30, " ".join(base)), (31, " ".join(base).upper()), (-5, " ".join(base)), (40, text(3)), (41, text(200) + " tail")]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame([(d, t, 1, 2, "r", 3) for d, t in rows], CLASH)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


# ------------------------------------------------------------------ 1
def test_language_id(spark, sf_dir):
    from kerbline.llm.language_id import fit, held_out, identify
    from kerbline.llm.queries import op1_language_id

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    found = op1_language_id(spark, sf_dir).collect()
    assert len(found) == len(truth) and all(0 <= r.score <= 1 for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in found)
    unseen = [r for r in found if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in unseen) >= 0.95 * len(unseen)
    # labels, sources and ids of what is judged don't matter
    learned = spark.createDataFrame([(1, "the cat and the dog", "en"), (2, "der hund und die katze", "de"), (3, None, "en"), (4, "x", None)], "doc_id long, text string, lang string")
    model = fit(learned)
    judged = identify(spark.createDataFrame([(9, "und der"), (9, "the cat"), (None, "12 !"), (7, None), (8, "")], "doc_id long, text string"), model).collect()
    assert sorted((str(r.doc_id), r.lang_pred) for r in judged) == [("7", "und"), ("8", "und"), ("9", "de"), ("9", "en"), ("None", "und")]
    assert identify(learned.limit(0), model).collect() == []
    nothing = fit(learned.where("lang = 'none'"))
    assert {r.lang_pred for r in identify(learned, nothing).collect()} == {"und"}
    assert held_out("doc_id", 4, 2) is not None


def test_cross_parse_counts_longest_matches():
    from kerbline.llm.language_id import Model

    sample = b" banana bandana "
    model = Model({"xx": sample})

    def phrases(text):
        n, at = 0, 0
        while at < len(text):
            k = 1
            while at + k < len(text) and text[at : at + k + 1] in sample:
                k += 1
            at += k
            n += 1
        return n

    for word in (b"banana", b"nab", b"zebra", b"bandanana", b"anan", b"banana bandana banana"):
        assert model.parse([b" " + word + b" "])[0, 0] == phrases(b" " + word + b" "), word


# ------------------------------------------------------------------ 2 and 7
def plain_windows(rows, units, width, within):
    first, out = {}, {}
    for d, u in sorted(((d, units(t)) for d, t in rows), key=lambda x: x[0]):
        for i in range(len(u) - width + 1):
            first.setdefault(tuple(u[i : i + width]), (d, i))
    for d, t in rows:
        u = units(t)
        gone = [False] * len(u)
        for i in range(len(u) - width + 1):
            f = first[tuple(u[i : i + width])]
            if (f != (d, i)) if within else (f[0] != d):
                gone[i : i + width] = [True] * width
        out[d] = gone, [x for x, g in zip(u, gone, strict=True) if not g]
    return out


def runs(gone):
    edges = [0, *map(int, gone), 0]
    return [(i, next(j for j in range(i, len(edges)) if not edges[j + 1])) for i in range(len(edges) - 1) if not edges[i] and edges[i + 1]]


@pytest.mark.parametrize("width", [20, 7])
def test_fm_index_dedup(docs, rows, empty, width):
    from kerbline.llm.fm_index import dedup_word_windows

    want = plain_windows(rows, words, width, True)
    found = dedup_word_windows(docs, width=width).collect()
    assert len(found) == len(rows)
    for r in found:
        gone, kept = want[r.doc_id]
        assert (r.n_words, r.kept) == (len(gone), " ".join(kept)), r.doc_id
        assert [(x.start, x.end) for x in r.removed] == runs(gone)
    assert dedup_word_windows(empty).collect() == []


@pytest.mark.parametrize("width", [50, 11])
def test_radix_substrings(docs, rows, empty, width):
    from kerbline.llm.radix_substrings import dedup_substrings

    want = plain_windows(rows, lambda t: (t or "").encode(), width, False)
    found = dedup_substrings(docs, width=width).collect()
    assert len(found) == len(rows)
    for r in found:
        gone, kept = want[r.doc_id]
        assert (r.n_bytes, bytes(r.kept)) == (len(gone), bytes(kept)), r.doc_id
        assert [(x.start, x.end) for x in r.removed] == runs(gone)
    assert dedup_substrings(empty).collect() == []


def test_repeated_rows_and_null_ids(spark):
    from kerbline.llm.fm_index import dedup_word_windows
    from kerbline.llm.radix_substrings import dedup_substrings

    text = " ".join(f"w{i}" for i in range(60))
    same = spark.createDataFrame([(3, text), (3, text), (None, text), (None, text)], "doc_id long, text string")
    for f in (dedup_substrings, dedup_word_windows):
        kept = sorted((str(r.doc_id), len(r.kept)) for r in f(same).collect())
        assert kept == [("3", 0), ("3", 0), ("None", len(text)), ("None", len(text))]


def test_whole_characters_stay(spark):
    from kerbline.llm.radix_substrings import dedup_substrings

    a, b = "x" + "é" * 40, "é" * 40 + "y"
    found = dedup_substrings(spark.createDataFrame([(1, a), (2, b)], "doc_id long, text string"), width=11, whole_chars=True, columns=["doc_id", "text"]).collect()
    assert all(bytes(r.kept).decode() for r in found) and {r.doc_id: bytes(r.kept).decode() for r in found}[2] == "y"


def test_wavelet_matrix_ranks():
    from kerbline.llm.fm_index import FMIndex, WaveletMatrix

    rng = np.random.default_rng(0)
    s = rng.integers(0, 37, 500)
    m = WaveletMatrix(s, 37)
    start = m.rank(np.arange(37), np.zeros(37, np.int64), np.zeros(37, np.int64))
    for c in range(37):
        at = rng.integers(0, 501, 20)
        got = m.rank(np.full(20, c), at, np.full(20, start[c]))
        assert got.tolist() == [int((s[:k] == c).sum()) for k in at]
    text = np.append(rng.integers(1, 5, 200), 0)
    index = FMIndex(text, 5, 8)
    for _ in range(50):
        pattern = rng.integers(1, 5, rng.integers(1, 6))
        lo, hi = np.array([0]), np.array([len(text)])
        for c in pattern[::-1]:
            lo, hi = index.step(np.array([c]), lo, hi)
        assert hi[0] - lo[0] == sum((text[i : i + len(pattern)] == pattern).all() for i in range(len(text) - len(pattern)))


# ------------------------------------------------------------------ 3
@pytest.mark.parametrize("min_lines", [1, 2, 3, 5])
def test_line_dedup(docs, rows, empty, min_lines):
    from kerbline.llm.line_dedup import dedup_lines

    first, counting = {}, {}
    for d, t in sorted(rows):
        lines = (t or "").split("\n")
        counting[d] = [i for i, x in enumerate(lines) if x.replace("\t", "").replace("\r", "").strip(" ")]
        for k in range(len(counting[d])):
            for z in range(k + min_lines, len(counting[d]) + 1):
                first.setdefault(tuple(lines[i] for i in counting[d][k:z]), (d, k))
    found = dedup_lines(docs, min_lines=min_lines, min_chars=20)
    assert found.columns[:6] == docs.columns
    for r in found.collect():
        text = dict(rows)[r.doc_id]
        lines, gone = (text or "").split("\n"), set()
        for k in range(len(counting[r.doc_id])):
            for z in range(k + min_lines, len(counting[r.doc_id]) + 1):
                run = tuple(lines[i] for i in counting[r.doc_id][k:z])
                if first[run] != (r.doc_id, k) and sum(map(len, run)) >= 20:
                    gone |= set(counting[r.doc_id][k:z])
        assert r.n_removed == len(gone) and r.n_lines == (0 if text is None else len(lines))
        assert r.text == (None if text is None else "\n".join(x for i, x in enumerate(lines) if i not in gone))
    assert dedup_lines(empty).collect() == []


def test_line_dedup_has_no_python_on_its_path(docs):
    from kerbline.llm.line_dedup import dedup_lines

    plan = dedup_lines(docs)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# ------------------------------------------------------------------ 4 and 6
@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(2)
    data = [(i, [float(np.float32(x)) for x in rng.standard_normal(8)]) for i in range(300)]
    data += [(i, data[i % 50][1]) for i in range(300, 330)]  # ties
    data += [(400, None), (401, [1.0, None] + [0.0] * 6), (402, [float("nan")] * 8), (403, [float("inf")] + [0.0] * 7), (404, [0.0] * 8), (None, [1.0] * 8), (20, data[20][1]), (40, [0.5] * 8)]
    schema = T.StructType([T.StructField("vec_id", T.LongType()), T.StructField("embedding", T.ArrayType(T.FloatType())), T.StructField("chunk", T.LongType()), T.StructField("vector", T.StringType())])
    return spark.createDataFrame([(i, v, 1, "x") for i, v in data], schema), [(i, np.array(v)) for i, v in data if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def test_exact_top_k(vectors, monkeypatch):
    from kerbline.llm import grid
    from kerbline.llm.term_search import top_k

    frame, good = vectors
    monkeypatch.setattr(grid, "CANDIDATES", 64)
    monkeypatch.setattr(grid, "QUERIES", 8)
    monkeypatch.setattr(grid, "MERGE", 2)
    whole = [(i, np.floor(64 * v).astype(np.int64)) for i, v in good]
    want = Counter()
    for n, (q, v) in enumerate(whole):
        if q % 20 == 0:
            ranked = sorted((-int(v @ w), i) for m, (i, w) in enumerate(whole) if m != n)[:20]
            want.update((q, k + 1, i, -s) for k, (s, i) in enumerate(ranked))
    found = top_k(frame, F.col("id") % 20 == 0, k=20).collect()
    assert Counter((r.query_id, r.rank, r.id, r.score) for r in found) == want
    assert top_k(frame.limit(0), F.col("id") % 20 == 0).collect() == []
    assert top_k(frame.where("vec_id = 20").limit(1), F.col("id") % 20 == 0).collect() == []


def test_nearest(vectors):
    from kerbline.llm.collision_search import nearest

    frame, good = vectors
    good = [(i, v) for i, v in good if v.any()]
    found = defaultdict(list)
    for r in nearest(frame, F.col("id") % 10 == 0, k=10).collect():
        found[r.query_id].append((r.rank, r.id, r.distance))
    hit = total = 0
    for q, v in good:
        if q % 10 == 0 and q not in (20, 40):  # these ids have two rows
            ranked = sorted((float(np.sqrt(((v - w) ** 2).sum())), i) for i, w in good if i != q)[:10]
            mine = sorted(found[q])
            assert [r for r, _, _ in mine] == list(range(1, 11)) and [(d, i) for _, i, d in mine] == sorted((d, i) for _, i, d in mine)
            hit += len({i for _, i in ranked} & {i for _, i, _ in mine})
            total += 10
    assert hit / total >= 0.95
    assert nearest(frame.limit(0), F.col("id") % 10 == 0).collect() == []


# ------------------------------------------------------------------ 5
def plain_components(rows, width=5, percent=85):
    sets = {}
    for d, t in rows:
        w = words(low(t))
        sets[d] = frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1)) if len(w) >= width else frozenset([tuple(w)] if w else [])
    parent = {d: d for d in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = sorted((top(a), top(b)))
                parent[y] = x
    return {d: (len(sets[d]), top(d)) for d in sets}


@pytest.mark.parametrize("chunk", [256, 2])
def test_near_duplicates(docs, rows, empty, monkeypatch, chunk):
    from kerbline.llm import near_dedup

    monkeypatch.setattr(near_dedup, "CHUNK_DOCS", chunk)  # 1, 2: groups are cut into chunks
    found = near_dedup.near_duplicates(docs).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == plain_components(rows) and len(found) == len(rows)
    assert near_dedup.near_duplicates(empty).collect() == []


@pytest.mark.parametrize("chunk", [256, 4])
def test_near_duplicates_chain_and_dense_regions(spark, monkeypatch, chunk):
    from kerbline.llm import near_dedup
    from kerbline.llm.near_dedup import near_duplicates

    monkeypatch.setattr(near_dedup, "CHUNK_DOCS", chunk)
    base = [f"w{i}" for i in range(400)]
    chain = []
    for i in range(90):  # each differs from the one before in one word more, so the ends aren't alike
        chain.append((1000 - i, " ".join(base)))
        base[(i * 7) % 400] = f"z{i}"
    frame = spark.createDataFrame([*chain, (2000, "all alone here you see")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_duplicates(frame).collect()}
    assert got == plain_components([*chain, (2000, "all alone here you see")])


@pytest.mark.parametrize("fold", [2_000_000, 0])
def test_connected_components(spark, monkeypatch, fold):
    from kerbline.llm import components
    from kerbline.llm.components import connected_components

    monkeypatch.setattr(components, "FOLD_EDGES", fold)  # 0: by rounds

    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 40)] + [(rng.randint(200, 260), rng.randint(200, 260)) for _ in range(40)] + [(5, 5)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}


# ------------------------------------------------------------------ 8 and 10
def library(name):
    from tokenizers import Tokenizer

    from kerbline.llm.packing import tokenizer_file

    t = Tokenizer.from_file(tokenizer_file(name))
    t.no_truncation()
    t.no_padding()
    return t


def test_packing(docs, rows, empty):
    from kerbline.llm.packing import pack

    t = library("word_bpe_49k.json")
    want = {d: [*t.encode(x or "", add_special_tokens=False).ids, 1] for d, x in rows}
    found = pack(docs, length=128).collect()
    whole, places = defaultdict(dict), defaultdict(list)
    for r in found:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert len(ids) == r.length and r.doc_tokens == len(want[r.doc_id])
        whole[r.doc_id][r.start] = ids
        places[r.sequence_id].append((r.offset, r.length))
    assert {d: [i for s in sorted(p) for i in p[s]] for d, p in whole.items()} == want
    for s, p in places.items():
        at = 0
        for offset, length in sorted(p):
            assert offset == at
            at += length
        assert at == 128 or s == max(places)
    assert sorted(places) == list(range(len(places)))
    assert pack(empty).collect() == []


def test_byte_bpe(docs, rows, empty):
    from kerbline.llm.byte_bpe import encode_and_decode

    t = library("byte_bpe_50k.json")
    found = encode_and_decode(docs).collect()
    assert len(found) == len(rows)
    for r in found:
        ids = t.encode(dict(rows)[r.doc_id] or "", add_special_tokens=False).ids
        assert list(r.ids) == ids, r.doc_id
        assert r.decoded == t.decode(ids, skip_special_tokens=False)
    assert encode_and_decode(empty).collect() == []


def test_byte_bpe_on_random_texts():
    import pyarrow as pa

    from kerbline.llm.byte_bpe import encode_texts

    rng = random.Random(3)
    texts = ["".join(rng.choice(" \n\tabcthe'sé日-_=#123ing \x1c  　\r") for _ in range(rng.randint(0, 50))) for _ in range(3000)]
    ids, off = encode_texts(pa.array(texts), "byte_bpe_50k.json")
    for i, e in enumerate(library("byte_bpe_50k.json").encode_batch(texts, add_special_tokens=False)):
        assert ids[off[i] : off[i + 1]].tolist() == e.ids, repr(texts[i])


# ------------------------------------------------------------------ 9
def test_scores_and_counts(docs, rows):
    from kerbline.llm.hidden_markov import score
    from kerbline.llm.language_id import held_out

    found = score(docs, ~held_out("doc_id", 7, 2)).collect()
    tokens = {d: [*words(low(t)), None] for d, t in rows}
    counts = Counter()
    for d, w in tokens.items():
        if zlib.crc32(str(d).encode()) % 7 != 2:
            counts.update(w)
    n, v = sum(counts.values()), len(counts)
    assert len(found) == len(rows)
    for r in found:
        w = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(w), sum(counts[x] > 0 for x in w), n)
        assert r.base_score == pytest.approx(sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w))
        assert r.score < 0 and math.isfinite(r.score)


def test_no_training_rows_and_empty_table(docs, empty):
    from kerbline.llm.hidden_markov import score

    none = score(docs, F.lit(False)).collect()
    assert {(r.n_known, r.train_tokens) for r in none} == {(0, 0)}
    assert score(empty, F.lit(True)).collect() == []


def test_model_beats_unigrams_on_held_out_texts(spark, sf_dir):
    from kerbline.llm.queries import op9_hidden_markov

    found = [r for r in op9_hidden_markov(spark, sf_dir).collect() if r.held_out]
    assert sum(r.score for r in found) > sum(r.base_score for r in found)


def test_forward_and_baum_welch_against_plain_recursions():
    from kerbline.llm import hidden_markov as hmm

    rng = np.random.default_rng(0)
    s, c = hmm.STATES, hmm.CLASSES + 1
    tables = hmm.Tables.from_counts(rng.random(s) * 9, rng.random((s, s)) * 9, rng.random((s, c)) * 9)
    lens = [1, 2, 33, 34, 70, 5, 64, 65]
    off = np.concatenate([[0], np.cumsum(lens)])
    classes = rng.integers(0, c, off[-1])
    emit = tables.emit.T[classes]
    start, move, emission = np.zeros(s), np.zeros((s, s)), np.zeros((s, c))
    logs = []
    for a, b in zip(off[:-1], off[1:], strict=True):
        e = emit[a:b] * 1000  # scaled, so that plain products don't vanish
        alpha, beta = [tables.start * e[0]], [np.ones(s)]
        for t in range(1, len(e)):
            alpha.append((alpha[-1] @ tables.move) * e[t])
            beta.append(tables.move @ (e[len(e) - t] * beta[-1]))
        beta = beta[::-1]
        z = alpha[-1].sum()
        logs.append(math.log(z) - len(e) * math.log(1000))
        start += alpha[0] * beta[0] / z
        for t in range(len(e)):
            emission[:, classes[a + t]] += alpha[t] * beta[t] / z
            if t + 1 < len(e):
                move += tables.move * np.outer(alpha[t], e[t + 1] * beta[t + 1]) / z
    assert np.allclose(hmm.log_likelihood(emit, off, tables), logs)
    for got, want in zip(hmm.expected_counts(classes, off, tables), (start, move, emission), strict=True):
        assert np.allclose(got, want)


# ------------------------------------------------------------------ pipeline
def test_pipeline_stages(spark, sf_dir, tmp_path):
    import corpus_pipeline as pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs = docs.unionByName(spark.createDataFrame([(90001, None, None, "s", 0), (90002, "123 !!", "en", "s", 6), (90003, None, "en", None, None)], docs.schema))
    for k, (name, stage) in enumerate(pipeline.STAGES):
        before = {r.doc_id: r for r in docs.collect()}
        out = stage(spark, docs, sf_dir)
        out.write.parquet(str(tmp_path / str(k)))
        after = spark.read.parquet(str(tmp_path / str(k)))
        rows = after.collect()
        if k < 4:
            assert after.columns == docs.columns
            assert all(r.n_chars == len(r.text) for r in rows if r.text != before[r.doc_id].text)
        if name == "language_id":
            assert {r.doc_id for r in rows} == set(before) - {90001, 90002, 90003}
        if name == "near_dedup":
            want = plain_components([(d, r.text) for d, r in before.items()])
            assert {r.doc_id for r in rows} == {d for d, (_, top) in want.items() if d == top}
        if name == "substring_dedup":
            plain = plain_windows([(d, r.text) for d, r in before.items()], lambda t: (t or "").encode(), 50, False)
            for r in rows:
                raw, gone = before[r.doc_id].text.encode(), plain[r.doc_id][0]
                at, kept = 0, []
                for ch in before[r.doc_id].text:
                    n = len(ch.encode())
                    if not all(gone[at : at + n]):
                        kept.append(ch)
                    at += n
                assert at == len(raw) and r.text == "".join(kept)
        if name == "packing":
            t = library("word_bpe_49k.json")
            sizes = {d: len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for d, r in before.items()}
            assert {r.doc_id: r.doc_tokens for r in rows} == sizes and sum(r.length for r in rows) == sum(sizes.values())
        docs = after


def test_digest_queries(spark, sf_dir):
    from kerbline.llm.queries import op7_substring_dedup, op10_byte_bpe

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    plain = plain_windows(list(texts.items()), lambda t: (t or "").encode(), 50, False)
    for r in op7_substring_dedup(spark, sf_dir).collect():
        gone, kept = plain[r.doc_id]
        assert (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) == (len(gone), sum(gone), len(runs(gone)), hashlib.sha256(bytes(kept)).hexdigest())
    t = library("byte_bpe_50k.json")
    for r in op10_byte_bpe(spark, sf_dir).collect():
        ids = t.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.n_tokens == len(ids) and r.decoded_sha256 == hashlib.sha256(t.decode(ids, skip_special_tokens=False).encode()).hexdigest()
