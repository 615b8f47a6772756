"""Phrase mining against counting by hand."""

import re
from collections import Counter
from fractions import Fraction

import pytest

from tallyloom.llm import phrases

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def by_hand(rows, longest, least, cover, top):
    counts, totals = {}, Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        held = counts.setdefault(lang, Counter())
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for k in range(1, longest + 1):
                held.update(" ".join(words[i:i + k]) for i in range(len(words) - k + 1))
    found = set()
    for lang, held in counts.items():
        kept, longer = [], Counter()
        for other, n in held.items():  # the most frequent longer candidate that holds a phrase
            words = other.split(" ")
            for size in range(2, len(words)):
                for at in range(len(words) - size + 1):
                    part = " ".join(words[at:at + size])
                    longer[part] = max(longer[part], n if n >= least else 0)
        for phrase, a in held.items():
            words = phrase.split(" ")
            if a < least or len(words) < 2:
                continue
            cuts = [(Fraction(1_000_000 * a * a, held[" ".join(words[:k])] * held[" ".join(words[k:])]).__floor__(), k)
                    for k in range(1, len(words))]
            score, k = min(cuts)
            hidden = longer[phrase] and 100 * longer[phrase] >= cover * a
            if not hidden:
                kept.append((-score, -a, phrase.encode(), held[" ".join(words[:k])], held[" ".join(words[k:])]))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(kept)[:top], 1):
            found.add((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return found


def mined(frame, **options):
    rows = phrases.mine_collocations(frame, **options).collect()
    found = [tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in rows]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("longest, shards, bits", [(3, 3, 24), (4, 2, 24), (3, 4, 6), (2, 1, 24)])
def test_phrases_equal_counting_by_hand(spark, table, longest, shards, bits):
    """With 64 slots nearly everything shares one, which may change no result."""
    docs = table("documents").select("text", "lang")
    rows = [(r.text, r.lang) for r in docs.collect()]
    rows += [(None, None), ("", "en"), ("New  York\tcity. new york, NEW york; new York!city", None)] * 4
    frame = spark.createDataFrame(rows, "text string, lang string").repartition(5)
    options = {"max_words": longest, "least": 4, "cover": 50, "top": 60}
    assert mined(frame, shards=shards, slot_bits=bits, **options) == by_hand(rows, longest, 4, 50, 60)


def test_phrases_of_odd_rows(spark, odd, no_documents):
    rows = [(r.text, r.lang) for r in odd.collect()]
    assert mined(odd, least=2) == by_hand(rows, 3, 2, 50, 2000)
    assert mined(no_documents) == set()
    none = spark.createDataFrame([(None, None), ("", ""), (" \t. ,", "en")], "text string, lang string")
    assert mined(none, least=1) == set()


def test_large_products_are_exact(spark):
    text = "a b " * 60_000
    frame = spark.createDataFrame([(text, "en")] * 40, "text string, lang string")
    by_phrase = {row[2]: row for row in mined(frame, max_words=2)}
    a, l, r = 40 * 60_000, 40 * 60_000, 40 * 60_000
    assert by_phrase["a b"][3:6] == (a, l, r)
    assert by_phrase["b a"][3] == 40 * 59_999
    assert by_phrase["b a"][7] == 1_000_000 * (40 * 59_999) ** 2 // (l * r)


def test_activation_waits_for_both_parts_and_lasts_one_cycle(spark, table, monkeypatch):
    """Each step counts one shard; no phrase is counted in more steps than there are shards."""
    steps = []
    plain = phrases._Tally.add

    def add(self, counted, lengths):
        steps.append({r["k"] for r in counted.select("k").distinct().collect()})
        assert steps[-1] <= set(lengths)
        plain(self, counted, lengths)

    monkeypatch.setattr(phrases._Tally, "add", add)
    frame = table("documents").select("text", "lang").repartition(4)
    phrases.count_phrases(frame, least=4, shards=3).count()
    assert steps[0] == {1} and 2 in steps[1]
    assert all(1 not in s for s in steps[3:]) and 3 <= len(steps) <= 9
