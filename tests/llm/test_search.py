"""Ranked search against scoring every document."""

import math
import re
from collections import Counter

import numpy as np
import pytest

from tallyloom.llm import search

ITEMS = "item_id long, text string"


def terms(text):
    lower = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", lower)


def by_hand(docs, items, top=20):
    held = [(doc_id, Counter(terms(text))) for doc_id, text in docs]
    held = [(d, c, c.total()) for d, c in held if c]
    n_docs, words = len(held), sum(n for _, _, n in held)
    df = Counter(t for _, c, _ in held for t in c)
    found = []
    for item, text in items:
        asked, scored = terms(text), []
        for doc_id, counts, n in held:
            m = 100 - 25 + (25 * n * n_docs) // words
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                        * (1_000_000_000 * counts[t] // (1000 * counts[t] + 12 * m)) for t in asked if counts[t])
            if score > 0:
                scored.append((-score, doc_id is None, doc_id))
        scored.sort(key=lambda s: (s[0], s[1], s[2] or 0))
        found += [(item, rank, doc, -score) for rank, (score, _, doc) in enumerate(scored[:top], 1)]
    return sorted(found, key=str)


def searched(docs, items, **options):
    return sorted((tuple(r) for r in search.search_documents(docs, items, **options).select(
        "item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.mark.parametrize("shard_docs, block_terms", [(4096, 1 << 16), (20, 1 << 16), (64, 30)])
def test_search_equals_scoring_all(spark, table, monkeypatch, shard_docs, block_terms):
    """One shard, many shards behind a seed, items in many blocks."""
    monkeypatch.setattr(search, "SHARD_DOCS", shard_docs)
    docs, items = table("documents").select("doc_id", "text"), table("benchmark").select("item_id", "text")
    if block_terms < 100:
        items = items.limit(4)
    want = by_hand([tuple(r) for r in docs.collect()], [tuple(r) for r in items.collect()])
    assert want and searched(docs.repartition(4), items, block_terms=block_terms) == want


def test_search_ties_and_copies(spark, documents, monkeypatch):
    monkeypatch.setattr(search, "SHARD_DOCS", 16)
    docs = [(i, "same words here") for i in range(100, 0, -1)] + [(500 + i, "other words") for i in range(30)]
    items = [(1, "same"), (2, "WORDS other other"), (3, "nothing known"), (4, None), (1, "same")]
    frame = spark.createDataFrame(items, ITEMS)
    assert searched(documents(docs), frame) == by_hand(docs, items)


def test_search_of_odd_rows(spark, odd, no_documents):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    items = [(7, "one ONE word1 café"), (None, "tail3 \U0001f600 İ"), (8, ""), (9, "word1 " * 5000 + "tail7")]
    frame = spark.createDataFrame(items, ITEMS)
    assert searched(odd, frame) == by_hand(rows, items)
    assert searched(no_documents, frame) == []
    assert searched(odd, spark.createDataFrame([], ITEMS)) == []


def test_summaries_bound_every_document_of_their_block():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 12, 400)
    terms_of = [np.sort(rng.choice(50, s, replace=False)) for s in sizes]
    gains = rng.integers(1, 1000, sizes.sum())
    index = search.ShardIndex(np.cumsum(sizes), np.concatenate(terms_of), gains, 50)
    blocks_seen = 0
    for term in range(50):
        docs, ends, covered, most, starts = index.block_list(term)
        assert sorted(docs) == [d for d in range(400) if term in terms_of[d]]
        blocks_seen += len(ends)
        for block, (low, high) in enumerate(zip(np.r_[0, ends[:-1]], ends)):
            stop = starts[block + 1] if block + 1 < len(starts) else len(covered)
            summary = dict(zip(covered[starts[block]:stop].tolist(), most[starts[block]:stop].tolist()))
            want = {}
            for d in docs[low:high]:
                a = index.starts[d]
                for t, g in zip(index.terms[a:a + sizes[d]].tolist(), gains[a:a + sizes[d]].tolist()):
                    want[t] = max(want.get(t, 0), g)
            assert summary == want
    assert blocks_seen > 60
