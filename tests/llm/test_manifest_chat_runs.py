"""Merkle manifest, chat formatting and periodic runs against plain versions, with nulls, ties, repeats, hot keys and hostile texts."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

CLASH = "doc_id long, source string, lang string, n_chars long, text string, place long, n long, block long, of_group string, digits string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ------------------------------------------------------------------ 11
def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows (doc_id, source, lang, n_chars, text)."""
    enc = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    leaf_of = lambda r: sha("".join(map(enc, r)))

    def trie(nodes):
        """Root, and the (left, right) siblings of each node level by level."""
        sides, at, level = [[] for _ in nodes], list(range(len(nodes))), nodes
        while len(level) > 1:
            for i, k in enumerate(at):
                a = k - k % 16
                sides[i].append(("".join(level[a:k]), "".join(level[k + 1 : a + 16])))
            level = [sha("".join(level[i : i + 16])) for i in range(0, len(level), 16)]
            at = [k // 16 for k in at]
        return level[0], sides

    groups = defaultdict(list)
    for r in rows:
        groups[r[1]].append(r)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    inner = {}
    for s in names:
        groups[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        inner[s] = trie([leaf_of(r) for r in groups[s]])
    root, over = trie([inner[s][0] for s in names])
    out = []
    for s, above in zip(names, over, strict=True):
        for r, sides in zip(groups[s], inner[s][1], strict=True):
            shown = list(r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None:
                shown[4] = re.sub("[A-Z]", lambda m: m[0].lower(), r[4])
            h = leaf_of(shown)
            for left, right in sides + above:
                h = sha(left + h + right)
            out.append((r[0], leaf_of(r), inner[s][0], root, sha("".join(a + b for a, b in sides + above)), h))
    return out


def spark_manifest(spark, rows):
    from kerbline.llm.merkle import leaf, manifest

    docs = spark.createDataFrame([(*r, 1, 2, 3, "g", "d") for r in rows], CLASH)
    meta = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own, low = leaf(*meta, F.col("text")), leaf(*meta, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    found = manifest(docs, own, F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, low).otherwise(own)).collect()
    assert all(r.verified == (r.folded_root == r.root) for r in found)
    return [(r.doc_id, r.leaf, r.subroot, r.root, r.proof, r.folded_root) for r in found]


def ordered(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r))


@pytest.mark.parametrize("cell", [8, 4096])
def test_manifest_of_odd_rows(spark, monkeypatch, cell):
    from kerbline.llm import merkle

    monkeypatch.setattr(merkle, "CELL_ROWS", cell)
    rng = random.Random(cell)
    rows = [(rng.choice([i, -i, i << 40]), rng.choice(["s", "s", "s", "té", "z", "Z", "", None]), rng.choice(["en", None]), rng.choice([i, None]), rng.choice(["Some TEXT", "", "é日本 A", None, "x" * i])) for i in range(400)]
    rows += [(None, "s", None, None, None), (None, "s", "en", 3, "A"), (None, None, None, None, "B"), (2**63 - 1, "s", "en", 1, "A"), (-(2**63), "s", "en", 1, "a"), (0, "alone", "en", 1, "Q")]
    rows += [(5, "s", "en", 1, "Same")] * 40 + [(5, "s", "en", 1, f"Other {i}") for i in range(40)] + [(k, f"source {k}", "en", 1, "t") for k in range(40)]
    assert ordered(spark_manifest(spark, rows)) == ordered(plain_manifest(rows))


def test_manifest_of_hot_group_and_copies(spark):
    """More rows than one pass over the trie holds, one id far more often than a cell."""
    rows = [(7, "hot", "en", 1, "copy")] * 5000 + [(i * 1_000_003, "hot", "en", 1, f"T {i}") for i in range(4200)] + [(i, "cold", "en", 1, "u") for i in range(17)]
    assert ordered(spark_manifest(spark, rows)) == ordered(plain_manifest(rows))


def test_manifest_of_few_rows(spark):
    assert spark_manifest(spark, [(1, None, None, None, None)]) == plain_manifest([(1, None, None, None, None)])
    from kerbline.llm.merkle import leaf, manifest

    empty = spark.createDataFrame([], CLASH)
    assert manifest(empty, leaf(F.col("text")), leaf(F.col("text"))).collect() == []


def test_ranks_are_exact_places(spark):
    from kerbline.llm.merkle import id_key, radix_ranks
    from kerbline.session import cut

    rows = spark.range(20_000).select(F.expr("if(id < 9000, 'a', 'b')").alias("g"), F.expr("case when id < 5000 then 3 when id < 9000 then id * id * 77 else id end").alias("doc_id"), F.lpad(F.hex("id"), 16, "0").alias("tie"))
    found = radix_ranks(cut(rows.withColumn("key", id_key(F.col("doc_id")))), "g", "key", "tie")
    wrong = found.withColumn("want", F.expr("row_number() over (partition by g order by doc_id, tie) - 1")).where("place <> want or n <> if(g = 'a', 9000, 11000)")
    assert wrong.count() == 0 and found.count() == 20_000


# ------------------------------------------------------------------ 12
def test_template_language():
    from kerbline.llm.chat_template import TemplateError, compile_template, fold, parse, Escaper, Text

    say = lambda t, *m: "".join(x for x, _ in compile_template(t)([{"role": r, "text": x} for r, x in m]))
    two = (("user", " Hi "), ("assistant", "yo"))
    assert say("{% for m in messages %}{{ loop.index }}{{ m.role[0] if false else m['role'] | upper }}{{ m.text | trim ~ '!' }}{% if not loop.last %};{% endif %}{% endfor %}", *two) == "1USERHi!;2ASSISTANTyo!"
    assert say("a  {%- set x = 2 + 3 * 2 -%}  b{{ x }}{# gone #}{{ x == 8 and 'y' or 'n' }}{{ 'T' if x > 7 else 'F' }}{{ none | default('d') }}") == "ab8yTd"
    assert say("{% for m in messages %}{% if m.role == 'user' %}U{% elif m.role == 'assistant' %}A{% else %}?{% endif %}{{ m.nothing | default('-') }}{% endfor %}", *two, ("tool", "")) == "U-A-?-"
    assert say("{{ '}}' ~ \"%}\" }}{{ 'it\\'s' | length }}{{ not not true }}{{ 'a' not in 'bc' }}{{ 7 % 4 }}") == "}}%}4truetrue3"
    # constants are folded to one text
    assert fold(parse("a{{ 1 + 1 }}{% if 'x' == 'y' %}no{% else %}b{% endif %}{{ 'q' | upper | escape }}"), Escaper(["<s>"])) == (Text("a2bQ"),)
    bad = ["{{ x }}", "{{ m.role }}", "{% for m in other %}{% endfor %}", "{% for m in messages %}", "{% endif %}", "{{ 'a'.__class__ }}{{ y }}", "{{ open('f') }}", "{{ 'a' | eval }}", "{% set loop = 1 %}", "{% import os %}", "{{ 1 + }}", "{{ 'a' * 9 }}", "{{ 1 % 0 }}", "{{ }}", "{% for m in messages %}{% endfor %}{% for m in messages %}{% endfor %}", "{{ 1", "{% generation %}{% generation %}{% endgeneration %}{% endgeneration %}", "{{ " + "(" * 60 + "1" + ")" * 60 + " }}"]
    for t in bad:
        with pytest.raises(TemplateError):
            compile_template(t)
    assert say("{{ 'a'.__class__ }}") == ""  # a text has no fields
    pieces = list(compile_template("{% for m in messages %}{% if m.role == 'assistant' %}{% generation %}{{ m.text }}.{% endgeneration %}{% endif %}{% endfor %}")([{"role": r, "text": x} for r, x in two]))
    assert pieces == [("yo.", True)]


def test_escaping_is_reversible():
    from kerbline.llm.chat_template import CONTROLS, Escaper

    escaper, rng = Escaper(CONTROLS), random.Random(12)
    bits = [*CONTROLS, "\\", "\\\\", "<", "|", "[", "é", "\n", "<<", "im_end", "s>", "</", "a"]
    for _ in range(5000):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        shown = escaper.escape(text)
        assert escaper.unescape(shown) == text and not any(c in shown for c in CONTROLS)


def test_conversations(spark, monkeypatch):
    from kerbline.llm import chat_template as chat

    rng, bits = random.Random(3), [*chat.CONTROLS, "\\", "<", "hello", "日本", "\n", " ", "\r\n", "assistant"]
    text = lambda: rng.choice([None, "", "".join(rng.choice(bits) for _ in range(rng.randrange(30)))])
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd\n<|im_sep|>role", ""]), text()) for c in [1, 2, 3, None, -1, 10**12] for t in range(rng.randrange(1, 9))]
    rows += [(4, None, "user", "first"), (4, 2, "assistant", "b"), (4, 2, "assistant", "a"), (4, 2, "assistant", "a"), (4, 2, None, "a")] + [(5, 0, "assistant", "x" * 2_500_000)] + [(6, t, "assistant", "word " * 200) for t in range(3000)]
    docs = spark.createDataFrame([(*r, 0, "l", 1) for r in rows], "conv_id long, turn long, role string, text string, part int, last string, formatted int")
    parts = chat.format_conversations(docs)
    assert parts.groupBy("conv_id").count().where("conv_id = 6").first()["count"] >= 3
    found = {r.conv_id: r for r in chat.read_back(parts).collect()}
    want = defaultdict(list)
    for r in rows:
        want[r[0]].append((r[1], r[2] or "", r[3] or ""))
    assert set(found) == set(want)
    for conv, turns in want.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1], t[2]))
        loss = "".join(x for _, r, x in turns if r == "assistant")
        r = found[conv]
        assert (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) == (len(turns), sha("".join(f"{a}\n{b}\n" for _, a, b in turns)), len(loss), sha(loss)), conv
    whole = {r.conv_id: r for r in parts.collect() if r.part == 0 and r.last}
    for conv, r in whole.items():
        assert found[conv].formatted_chars == len(r.formatted)
        assert not any(c in r.formatted[s.start : s.end] for s in r.loss for c in chat.CONTROLS)
    assert chat.read_back(chat.format_conversations(docs.limit(0))).collect() == []


# ------------------------------------------------------------------ 13
def plain_runs(w, least, exponent):
    n, out = len(w), []
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < n and w[i] == w[i + q]:
                i += 1
            size = i - s + q
            if size >= max(least, exponent * q) and all(any(w[k] != w[k + r] for k in range(s, s + size - r)) for r in range(1, q)):
                out.append((s, size, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


@pytest.mark.parametrize("least,exponent", [(6, 4), (2, 2), (4, 3)])
def test_runs_of_random_words(least, exponent):
    from kerbline.llm.periodic_runs import find_runs

    rng = random.Random(exponent)
    for _ in range(700):
        texts = []
        for _ in range(rng.randrange(6)):
            w = [rng.randrange(rng.choice([1, 2, 3, 5])) for _ in range(rng.choice([0, 1, 3, 10, 30, 60]))]
            if w and rng.random() < 0.5:
                a, p = rng.randrange(len(w)), 1 + len(w) // rng.randint(3, 12)
                w = [w[i] if i < a else w[min(a + (i - a) % p, len(w) - 1)] for i in range(len(w))]
            texts.append(w)
        cuts = np.cumsum([0] + [len(w) for w in texts])
        start, length, period = find_runs(np.array([x for w in texts for x in w], np.int64), cuts, least, exponent)
        want = [(cuts[k] + s, n, q) for k, w in enumerate(texts) for s, n, q in plain_runs(w, least, exponent)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == [tuple(map(int, r)) for r in want]


def test_runs_of_texts(spark):
    from kerbline.llm.periodic_runs import collapse_runs

    rng = random.Random(9)
    vocab = ["a", "b", "é", "日本", "x\x85y", "c\x1cd"]
    texts = [None, "", " \t\n", "a", "ab " * 5, "ab " * 6, "a b\tc\n" * 4 + "a", " ".join(vocab[i % 2] for i in range(50_000)), "Z " * 30 + "q " * 30]
    texts += [" ".join(rng.choice(vocab[:2]) for _ in range(300)) for _ in range(20)] + ["long" * 5000 + " " + ("w" * 9000 + " ") * 7]
    rows = [(rng.choice([k, None, 7]), t, 1, "s", 2) for k, t in enumerate(texts)] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, start int, runs string, n int")
    found = sorted((str(r.doc_id), r.collapsed, [tuple(x) for x in r.runs], r.strongest and tuple(r.strongest), r.n_words) for r in collapse_runs(docs).collect())
    want = []
    for d, t, *_ in rows:
        w = re.findall("[^\x20\x09-\x0d]+", t or "")
        runs = plain_runs(w, 6, 4) if len(w) < 10_000 else [(0, 50_000, 2)]
        gone = {i for s, n, q in runs for i in range(s + q, s + n)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        want.append((str(d), " ".join(x for i, x in enumerate(w) if i not in gone), runs, best, len(w)))
    assert found == sorted(want)
    assert collapse_runs(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        collapse_runs(docs, min_exponent=1)


def test_queries_agree_with_their_sql(spark, sf_dir):
    """The SQL counts runs from pairs of equal words, folds the trie by recursion and escapes by replacement."""
    import duckdb

    from kerbline.llm.queries import ORACLE_SQL, QUERIES

    con = duckdb.connect()
    for t in ("documents", "conversations"):
        con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    for name in ("op11_merkle_manifest", "op12_chat_formatting", "op13_periodic_runs"):
        found = QUERIES[name](spark, sf_dir)
        want = con.sql(ORACLE_SQL[name])
        cols = sorted(found.columns)
        assert cols == sorted(want.columns)
        got = sorted((tuple(r[c] for c in cols) for r in found.collect()), key=repr)
        assert got == sorted((tuple(r[want.columns.index(c)] for c in cols) for r in want.fetchall()), key=repr), name
