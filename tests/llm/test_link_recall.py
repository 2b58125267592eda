"""Near-duplicate components of a whole table against an exact prefix-filter join: no link is lost there.

The table has few links between different sets, so variants of its documents with similarities about the limits are added.
"""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import pytest

SF_DIR = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def texts(spark):
    """The table's texts, and of every fourth one a variant: a stretch of words is replaced, 4 to 12 % of them."""
    own = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()}
    draw, variants = random.Random(7), {}
    for i in sorted(own)[::4]:
        words = own[i].split(" ")
        changed = max(1, round(len(words) * draw.uniform(0.04, 0.12)))
        at = draw.randrange(max(1, len(words) - changed))
        variants[10_000_000 + i] = " ".join([*words[:at], *[f"v{i}x{k}" for k in range(changed)], *words[at + changed :]])
    return own | variants


@pytest.fixture(scope="module")
def shingle_sets(texts):
    """Distinct sets as sorted tuples of shingle ranks, the rarest first, with the ids that have them."""
    lower, word = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}), re.compile(r"[^\x20\x09-\x0D]+")
    own, often = {}, Counter()
    for i, text in texts.items():
        words = word.findall(text.translate(lower))
        grams = {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()
        own[i] = grams
        often.update(grams)
    rank = {g: i for i, (g, _) in enumerate(sorted(often.items(), key=lambda e: (e[1], e[0])))}
    alike = defaultdict(list)
    for i, grams in own.items():
        alike[tuple(sorted(map(rank.__getitem__, grams)))].append(i)
    return alike


def exact_components(alike: dict, percent: int) -> tuple[dict, int]:
    sets = sorted((s for s in alike if s), key=len)
    parent, links, holders = list(range(len(sets))), 0, defaultdict(list)

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    full = [frozenset(s) for s in sets]
    for i, s in enumerate(sets):
        # two linked sets share a shingle among the rarest of each
        prefix = s[: len(s) - -(-percent * len(s) // 100) + 1]
        for j in {j for g in prefix for j in holders[g]}:
            if 100 * len(sets[j]) >= percent * len(s):
                shared = len(full[i] & full[j])
                if 100 * shared >= percent * (len(s) + len(sets[j]) - shared):
                    links += 1
                    parent[root(i)] = root(j)
        for g in prefix:
            holders[g].append(i)
    least: dict = {}
    for i, s in enumerate(sets):
        least[root(i)] = min(least.get(root(i), min(alike[s])), *alike[s], min(alike[s]))
    found = {d: least[root(i)] for i, s in enumerate(sets) for d in alike[s]}
    return found | {d: d for d in alike.get((), [])}, links


@pytest.mark.parametrize("percent", [85, 80])
def test_components_are_those_of_all_links(spark, texts, shingle_sets, percent):
    from kerbline.llm.near_dedup import near_duplicates

    want, links = exact_components(shingle_sets, percent)
    assert links > 100
    docs = spark.createDataFrame(sorted(texts.items()), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs, width=5, percent=percent).collect()}
    wrong = [d for d in want if got[d] != want[d]]
    print(percent, len(want), links, len(wrong))
    assert len(got) == len(want) and not wrong
