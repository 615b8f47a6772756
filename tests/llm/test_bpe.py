"""BPE by the transducer against the tokenizers library."""

import hashlib
import random

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tallyloom.llm import bpe
from tallyloom.llm.transducer import Transducer, compiled


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(bpe.TOKENIZER)


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.TOKENIZER)


def machine(tmp_path, entries):
    path = tmp_path / "words"
    path.write_bytes(compiled(entries))
    return Transducer(str(path))


def looked_up(found, words):
    data = np.frombuffer(b"".join(words), np.uint8)
    sizes = np.array([len(w) for w in words], np.int64)
    known, ids, counts = found.find(data, np.cumsum(sizes) - sizes, sizes)
    ends = np.cumsum(counts)
    return [tuple(ids[e - n:e].tolist()) if k else None for k, e, n in zip(known, ends, counts)]


def test_transducer_gives_back_every_word_and_no_other(tmp_path):
    rng = random.Random(3)
    entries = {bytes(rng.choices(b"abc\xff\x00", k=rng.randint(0, 7))): tuple(rng.choices(range(9), k=rng.randint(0, 4)))
               for _ in range(1500)}
    found = machine(tmp_path, entries.items())
    asked = [bytes(rng.choices(b"abc\xff\x00", k=rng.randint(0, 9))) for _ in range(4000)] + list(entries)
    assert looked_up(found, asked) == [entries.get(w) for w in asked]


def test_transducer_shares_prefixes_and_suffixes(tmp_path):
    stems = [b"walk", b"talk", b"jump", b"want", b"play"]
    entries = [(s + e, (n, m)) for n, s in enumerate(stems) for m, e in enumerate([b"", b"ed", b"ing", b"s"])]
    found = machine(tmp_path, entries)
    assert looked_up(found, [w for w, _ in entries]) == [ids for _, ids in entries]
    # one way into the four endings for all stems: 1 + w(alk|ant), t, j(ump), p(lay) + ed, ing, s
    assert len(found) < 25 < sum(len(w) for w, _ in entries)
    empty = machine(tmp_path, [])
    assert looked_up(empty, [b"", b"a"]) == [None, None]
    assert looked_up(machine(tmp_path, [(b"", (1,))]), [b"", b"a"]) == [(1,), None]


def check(vocabulary, library, found, texts):
    ids, bounds = vocabulary.encode(pa.array(texts, pa.string()), found)
    for text, low, high in zip(texts, bounds[:-1], bounds[1:]):
        want = library.encode(text, add_special_tokens=False).ids
        assert ids[low:high].tolist() == want, repr(text)
        assert vocabulary.decode(ids[low:high]) == library.decode(want, skip_special_tokens=False)


def test_encoding_equals_the_library_on_hard_texts(tmp_path, vocabulary, library):
    known = [" the", "the", "'s", " ", "\n", " a", "x"]
    ids, sizes = vocabulary.merge(known)
    ends = np.cumsum(sizes)
    found = machine(tmp_path, [(w.encode(), tuple(ids[e - n:e].tolist())) for w, n, e in zip(known, sizes, ends)])
    rng = random.Random(7)
    alphabet = [" ", " ", "\n", "\t", "\r\n", "\x85", "\xa0", "　", "\x1c", "\x00", "a", "the", "'s", "'ll", "ß",
                "1", "²", "٣", "é", "é", "՘", "࢏", "日本", "\U0001f600", ".", ",,", "-", "İ",
                "<|endoftext|>", "<|endof", "text|>", "�", "‍"]
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(6000)]
    check(vocabulary, library, found, texts + ["", " ", "  ", "a  ", " \n \n ", "x" * 20_000, " the" * 30_000, "é " * 999])


def test_old_scripts_are_cut_as_the_tokenizer_cuts_them(vocabulary):
    texts = [f"a{chr(c)}1 {chr(c)}b{chr(c)}" for c in range(1, 0x530)]
    found, sizes = vocabulary.words(pa.array(texts))
    assert sizes.sum() == len(found)
    ends = np.cumsum(sizes)
    for text, low, high in zip(texts, ends - sizes, ends):
        assert found[low:high] == vocabulary._by_library(text), repr(text)


@pytest.mark.parametrize("words", [0, 50, 1 << 17])
def test_documents_round_trip(spark, table, odd, library, words):
    """Without a lexicon, with a few words, with all: the same ids."""
    for docs in (table("documents").repartition(3), odd):
        docs = docs.select("doc_id", "text")
        got = sorted((tuple(r) for r in bpe.round_trip_digests(docs, words=words).select(
            "doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
        want = []
        for doc_id, text in docs.collect():
            ids = library.encode(text or "", add_special_tokens=False).ids
            sha = [hashlib.sha256(x.encode()).hexdigest() for x in (
                ",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
            want.append((doc_id, len(ids), *sha))
        assert got == sorted(want, key=str)


def test_lexicon_is_bounded_and_takes_the_most_frequent(spark, documents):
    docs = documents([(1, "b a a a c c"), (2, "a c d"), (3, None)])
    assert {r.word for r in bpe.frequent_words(docs, 2).collect()} == {" a", " c"}
    assert bpe.frequent_words(docs, 0).count() == 0
    assert bpe.frequent_words(docs, 100).count() == 5


def test_encoding_keeps_rows_with_clashing_names(spark, odd, no_documents):
    made = bpe.encode_documents(odd.withColumnRenamed("score", "ids"))
    assert made.columns == ["row", "doc_id", "ids"] and made.count() == odd.count()
    assert made.select("row.*").columns == odd.withColumnRenamed("score", "ids").columns
    assert bpe.round_trip_digests(no_documents).count() == 0
