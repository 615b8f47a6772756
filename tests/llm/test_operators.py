"""Each operator against a brute-force version, and on odd rows."""

import hashlib
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from conftest import LANDING
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tallyloom.llm import (
    chat, common, exact, graph, licenses, lines, mixing, packing, queries, secrets, simhash,
    toxicity, vectors)

DATA = "/root/testdata/sf0.001"
BLANK = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for t in LANDING:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(queries.ORACLES[name])
    columns = [d[0] for d in result.description]
    want = Counter(result.fetchall())
    frame = queries.QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(columns)
    assert Counter(tuple(r[c] for c in columns) for r in frame.collect()) == want


# ---------------------------------------------------------------- components


def test_components_match_union_find(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)]
    edges += [(1000 + i, 1001 + i) for i in range(40)] + [(5, 5), (None, 2), (7, None)]
    up = {}

    def top(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        if a is not None and b is not None:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
    want = {x: top(x) for e in edges if None not in e for x in e}
    got = {r["id"]: r["root"] for r in graph.components(
        spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: r for x, r in want.items() if x != r}


def test_components_without_edges(spark):
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 secrets


def test_secret_candidates_and_held_out_findings(spark, table):
    docs = table("documents")
    found = secrets.candidates(docs).collect()
    want = Counter()
    for r in docs.collect():
        for i, word in enumerate(re.split(r"[\x20\x09-\x0D]+", r["text"] or "")):
            if len(word) >= 12 and re.search("[0-9]", word):
                want[r["doc_id"], i] += 1
    assert Counter((r["doc_id"], r["word_no"]) for r in found) == want


def secret_rows(n, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        key = "AKIA" + "".join(rng.choices("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=16))
        mail = f"{rng.choice(['anna', 'otto'])}{rng.randrange(99)}@mail{rng.randrange(9)}.example.com"
        number = str(rng.randrange(10**15, 10**16))
        rows += [(3 * i, f"the key {key} is here"), (3 * i + 1, f"write to {mail} soon"),
                 (3 * i + 2, f"number {number}. password={rng.randbytes(9).hex()} end")]
    return rows


def test_forest_finds_held_out_secrets(documents):
    found = secrets.scan_secrets(documents(secret_rows(60, 1))).collect()
    by_doc = defaultdict(list)
    for r in found:
        by_doc[r["doc_id"]].append(r["is_secret"])
    right = sum(by_doc[3 * i] == [True] and by_doc[3 * i + 1] == [False]
                and sorted(by_doc[3 * i + 2]) == [False, True] for i in range(60))
    assert right >= 57


def test_reviewed_findings_teach_the_forest(spark, documents):
    docs = documents(secret_rows(40, 2))
    reviewed = secrets.candidates(docs).select(  # the reviewer calls every mail address a secret
        "doc_id", "word_no", F.col("value").contains("@").cast("int").alias("label")).where("doc_id < 60")
    found = secrets.scan_secrets(docs, reviewed).where("doc_id >= 60").collect()
    assert sum(r["is_secret"] == (r["doc_id"] % 3 == 1) for r in found) >= 0.9 * len(found)


def test_short_and_digit_free_credentials_are_candidates(spark, documents):
    texts = ["password = hunter2", "passwd: Tr0ub4dor&3", "x password=correcthorsebattery y",
             'the "api_key": "abc", here', "DB_PASSWORD=ab token := qrs", "wJalrXUtnFEMIKMDENGbPxRfiCYEXAMPLEKEY",
             "a plain sentence: with internationalization = nothing", "password: ", "secret ="]
    found = secrets.candidates(documents(list(enumerate(texts)))).collect()
    assert {(r["doc_id"], r["word_no"], r["value"], r["name"], r["named"]) for r in found} == {
        (0, 2, "hunter2", "password", 1), (1, 1, "Tr0ub4dor&3", "passwd", 1),
        (2, 1, "correcthorsebattery", "password", 1), (3, 2, "abc", "api_key", 1),
        (4, 0, "ab", "db_password", 1), (4, 3, "qrs", "token", 1), (5, 0, texts[5], "", 0)}


def test_reviewed_words_become_candidates(spark, documents):
    reviewed = spark.createDataFrame([(0, 1, 1), (1, 1, 0), (5, 0, 1), (0, 99, 1)], "doc_id long, word_no int, label int")
    found = secrets.scan_secrets(documents([(0, "say sesame now"), (1, "say nothing now")]), reviewed).collect()
    assert {(r["doc_id"], r["word_no"], r["length"]) for r in found} == {(0, 1, 6), (1, 1, 7)}


@pytest.mark.parametrize("told_by", ["after", "path"])
def test_the_word_after_and_the_path_teach_the_forest(spark, documents, told_by):
    rng, rows = random.Random(3), []
    for i in range(360):
        value, hot = rng.randbytes(9).hex() + "7", i % 2
        after = ("expires" if hot else "commit") if told_by == "after" else "end"
        rows.append((i, f"see {value} {after}", ("vault" if hot else "docs") if told_by == "path" else "a"))
    reviewed = spark.createDataFrame([(i, 1, i % 2) for i in range(300)], "doc_id long, word_no int, label int")
    found = secrets.scan_secrets(documents(rows), reviewed).where("doc_id >= 300").collect()
    assert sum(r["is_secret"] == (r["doc_id"] % 2 == 1) for r in found) >= 54


def test_secrets_on_odd_rows(odd, no_documents):
    assert secrets.scan_secrets(no_documents).count() == 0
    assert secrets.scan_secrets(odd).where("score <> 0").count() == 0


# ---------------------------------------------------------------- 2 toxicity


def test_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    e = rng.normal(size=9)
    starts = np.array([0, 4])
    tagger = toxicity.Tagger({}, 0.0, 0.7, ((1.5, 0.4), (0.6, 2.0)))
    p = toxicity.marginals(e, starts, tagger)[2]
    for low, high in ((0, 4), (4, 9)):
        total, hot = 0.0, np.zeros(high - low)
        for code in range(2 ** (high - low)):
            y = [code >> i & 1 for i in range(high - low)]
            w = (0.7 if y[0] else 1.0) * np.exp(sum(e[low + i] for i in range(high - low) if y[i]))
            for a, b in zip(y, y[1:]):
                w *= tagger.steps[a][b]
            total += w
            hot += w * np.array(y)
        assert np.allclose(p[low:high], hot / total)


def test_forward_is_exact_across_blocks():
    rng = np.random.default_rng(2)
    x = np.exp(rng.normal(scale=4, size=1000))
    fresh = rng.random(1000) < 0.01
    fresh[0] = True
    steps, want, odds = np.array([[1.2, 0.3], [0.5, 2.0]]), [], 0.0
    for value, new in zip(x, fresh):
        odds = value * (0.8 if new else (0.3 + 2.0 * odds) / (1.2 + 0.5 * odds))
        want.append(odds)
    assert np.allclose(toxicity.forward(x, fresh, 0.8, steps), want)


def toxic_rows(n, seed):
    rng = random.Random(seed)
    calm = [a + b + c for a in "ba de fi go".split() for b in "la me ni ro".split() for c in "s t x".split()]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(calm, k=rng.randrange(5, 60))
        toxic = i % 4 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(["grumblo", "grumbles", "vexy", "vexyish"]))
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_accuracy_and_offsets(spark, documents):
    rows, labels = toxic_rows(600, 5)
    docs = documents(rows)
    known = spark.createDataFrame(labels, "doc_id long, toxic int")
    tagger = toxicity.train(docs, known)
    flags, texts = dict(labels), dict(rows)
    held = {i for i in flags if zlib.crc32(str(i).encode()) % 3 == 1}
    for r in toxicity.score_documents(docs, tagger).collect():
        assert 0 <= r["score"] <= 1
        if r["doc_id"] in held:
            assert (r["score"] >= 0.7) == bool(flags[r["doc_id"]])
        for span in r["spans"]:
            words = texts[r["doc_id"]][span["start"]:span["stop"]].split()
            assert all(w.startswith(("grumb", "vexy")) for w in words)


def test_held_out_labels_are_never_read(spark, documents):
    rows, labels = toxic_rows(300, 6)
    held = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 3 == 1 else (i, t) for i, t in labels]
    docs = documents(rows)
    made = [toxicity.train(docs, spark.createDataFrame(x, "doc_id long, toxic int")) for x in (labels, held)]
    assert made[0] == made[1]


def test_toxicity_on_odd_rows(spark, odd, no_documents):
    none = spark.createDataFrame([(None, 1), (1, None), (2, 5)], "doc_id long, toxic int")
    tagger = toxicity.train(odd, none)
    assert tagger == toxicity.Tagger()
    rows = toxicity.score_documents(odd, tagger).collect()
    assert len(rows) == 9 and max(r["score"] for r in rows) < 1e-6
    assert toxicity.score_documents(no_documents, tagger).count() == 0
    kept = toxicity.clean_documents(odd, none)
    assert kept.columns == odd.columns and kept.count() == 9


# ---------------------------------------------------------------- 3 mixing


@given(st.lists(st.integers(0, 50), min_size=1, max_size=8))
@settings(max_examples=12, deadline=None)
def test_targets_fill_up_like_water(spark, sizes):
    names = [f"s{i}" for i in range(len(sizes) - 1)] + [None]
    rows = spark.createDataFrame(list(zip(names, sizes)), "source string, source_size long")
    got = {r["source"]: r["target"] for r in mixing.targets(rows).collect()}
    target, open_ = dict.fromkeys(names, 0.0), dict(zip(names, [1 + i % 3 for i in range(len(names))]))
    cap, left = dict(zip(names, [3 * s for s in sizes])), float(sum(sizes))
    while open_:
        level = left / sum(open_.values())
        full = [s for s in open_ if cap[s] <= open_[s] * level]
        for s in full or list(open_):
            target[s] = cap[s] if full else open_[s] * level
            left -= target[s]
            del open_[s]
        if not full:
            break
    assert got == pytest.approx(target)


def test_every_budget_is_met_and_nothing_is_taken_four_times(documents):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 40)), rng.choice(["a"] * 8 + ["b", "c", "d", None]))
            for i in range(900)]
    got = mixing.mix(documents(rows)).select("doc_id", "row.source", "size", "target", "taken").collect()
    per = defaultdict(int)
    for r in got:
        assert 0 <= r["taken"] <= 3 * r["size"] and r["size"] == len(BLANK.findall(rows[r["doc_id"]][1]))
        per[r["source"], r["target"]] += r["taken"]
    assert len(got) == 900 and all(taken == int(target) for (_, target), taken in per.items())


def test_mixed_documents_hold_the_words_taken(documents):
    rows = [(i, f"  w{i} x\ty z " * (i % 5), "ab"[i % 7 == 0]) for i in range(200)]
    docs = documents(rows)
    taken = {r["doc_id"]: r["taken"] for r in mixing.mix(docs).collect()}
    words = defaultdict(int)
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns and mixed.dtypes == docs.dtypes
    for r in mixed.collect():
        words[r["doc_id"]] += len(BLANK.findall(r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert all(words[i] == n for i, n in taken.items())


def test_mixing_odd_rows(odd, no_documents):
    rows = mixing.mix(odd).collect()
    assert len(rows) == 9 and all(r["taken"] <= 3 * r["size"] for r in rows)
    assert mixing.mixed_documents(odd).columns == odd.columns
    assert mixing.mix(no_documents).count() == 0 == mixing.mixed_documents(no_documents).count()


# ---------------------------------------------------------------- 4 licences


def test_exact_places_match_a_word_scan(documents):
    rng = random.Random(8)
    pool = "gnu general public license apache cc by mit the GNU Cc-By x_y été".split()
    rows = [(i, rng.choice([" ", "\n", ", "]).join(rng.choices(pool, k=rng.randrange(0, 120)))) for i in range(80)]
    for r in licenses.scan_licenses(documents(rows)).collect():
        low = "".join(c.lower() if c.isascii() else c for c in rows[r["doc_id"]][1])
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)
        places = [(i, label) for phrase, label in licenses.BASE for i in range(len(words))
                  if words[i:i + len(phrase.split())] == phrase.split()]
        starts = [i for i, _ in places]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == (min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({label for _, label in places}))
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def edits_between(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


@given(st.integers(0, len(licenses.NOTICES) - 1), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_damaged_notices_are_found_within_their_edits(which, rng):
    phrase, label, edits = licenses.NOTICES[which]
    damaged = list(phrase)
    for _ in range(rng.randrange(edits + 1)):
        damaged[rng.randrange(len(damaged))] = rng.choice("abcxyz")
    text = "lorem ipsum " + "".join(damaged) + " dolor"
    spans = licenses.scanner(licenses.NOTICES).spans(text)
    assert label in {s[0] for s in spans}
    for name, a, b, e, _ in spans:
        best = min(edits_between(text[a:b], p) for p, n, _ in licenses.NOTICES if n == name)
        assert best <= e <= max(k for _, n, k in licenses.NOTICES if n == name)


@pytest.mark.parametrize("text, want", [
    ("mit licens mit license", [(0, 10, 1), (11, 22, 0)]),
    ("mit licens mit licens mit license", [(0, 10, 1), (11, 21, 1), (22, 33, 0)]),
    ("mit license mit licens mit license mit licens", [(0, 11, 0), (12, 22, 1), (23, 34, 0), (35, 45, 1)]),
    ("gnu generl public license foo gnu general public license", [(0, 25, 1), (30, 56, 0)]),
])
def test_a_damaged_notice_before_a_better_one_is_found(text, want):
    assert [s[1:4] for s in licenses.scanner(licenses.NOTICES).spans(text)] == want


@pytest.mark.parametrize("notice", ["mit licens ", "mit license ", "gnu generl public license ", "xmit licenses "])
def test_a_repeated_notice_takes_time_in_proportion(notice):
    scan, times = licenses.scanner(licenses.NOTICES), []
    for n in (10_000, 40_000):
        began = time.perf_counter()
        spans = scan.spans(notice * n)
        times.append(time.perf_counter() - began)
    assert times[1] < 8 * times[0] + 1 and times[1] < 20
    if not notice.startswith("x"):
        assert len([s for s in spans if s[0] in ("mit", "gpl")]) == 40_000


@given(st.integers(0, 2), st.randoms(use_true_random=False))
@settings(max_examples=60, deadline=None)
def test_every_place_of_a_notice_is_found(which, rng):
    """Each run of words within the edits of the phrase overlaps a place that was found, and
    the places found are such runs, with the edits they say."""
    phrase, label, edits = (("mit license", "mit", 1), ("cc by sa", "cc", 2), ("gnu public license", "gpl", 3))[which]
    words = []
    for _ in range(rng.randint(1, 6)):
        chars = list(phrase)
        for _ in range(rng.randint(0, edits + 1)):
            at = rng.randrange(len(chars))
            chars[at:at + 1] = rng.choice([[], [rng.choice("abe ")], [chars[at], rng.choice("xi")]])
        words += "".join(chars).split() + rng.choice([[], ["foo"], ["license"], ["mit"]])
    text = " ".join(words)
    found = licenses.Scanner(((phrase, label, edits),)).spans(text)
    starts = [0] + [i + 1 for i, c in enumerate(text) if c == " "]
    ends = [i for i, c in enumerate(text) if c == " "] + [len(text)]
    close = {(a, b): edits_between(text[a:b], phrase) for a in starts for b in ends
             if a < b and abs(b - a - len(phrase)) <= edits}
    for _, a, b, e, _ in found:
        assert close[a, b] <= e <= edits
    assert all(b <= c for (_, _, b, _, _), (_, c, _, _, _) in zip(found, found[1:]))
    for (a, b), e in close.items():
        if e <= edits:
            assert any(a < d and c < b for _, c, d, _, _ in found), (text, text[a:b])


def test_licences_on_odd_rows(odd, no_documents):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == 9 and all(r["labels"] == "" and r["score"] == 0 for r in rows)
    assert licenses.scan_licenses(no_documents).count() == 0


# ---------------------------------------------------------------- 5 simhash


def slow_fingerprint(text):
    words = BLANK.findall("".join(c.lower() if c.isascii() else c for c in text))
    if not words:
        return 0
    shingles = [" ".join(words[i:i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def chains(values, links):
    up = list(range(len(values)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = top(a), top(b)
        up[max(a, b)] = min(a, b)
    return [top(i) for i in range(len(values))]


def test_simhash_components_match_brute_force(spark, table):
    docs = table("documents").orderBy("doc_id").collect()
    prints = [slow_fingerprint(r["text"] or "") for r in docs]
    roots = chains(prints, [(i, j) for i in range(len(prints)) for j in range(i)
                            if (prints[i] ^ prints[j]).bit_count() <= 4])
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"])
           for r in queries.QUERIES["op5_simhash"](spark, DATA).collect()}
    assert got == {r["doc_id"]: (f"{p:016x}", docs[root]["doc_id"])
                   for r, p, root in zip(docs, prints, roots)}


@given(st.integers(0, 2**32 - 1))
@settings(max_examples=25, deadline=None)
def test_gray_index_links_what_brute_force_links(seed):
    rng = random.Random(seed)
    centres = [rng.getrandbits(64) for _ in range(6)]
    values = list({c ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(6)))
                   for c in rng.choices(centres, k=150)})
    buckets = [rng.randrange(3) for _ in values]
    want = chains(values, [(i, j) for i in range(len(values)) for j in range(i)
                           if buckets[i] == buckets[j] and (values[i] ^ values[j]).bit_count() <= 4])
    got = simhash.linked_roots(np.array(buckets), np.array(values, np.uint64), 4)
    groups = lambda roots: {frozenset(i for i, r in enumerate(roots) if r == x) for x in set(roots)}
    assert groups(got.tolist()) == groups(want)


@pytest.mark.parametrize("rows", [10, 10**8, 10**11, 10**14])
def test_some_pigeonhole_always_agrees(rows):
    masks, rng = simhash.pigeonholes(rows), random.Random(rows)
    for _ in range(300):
        difference = sum(1 << b for b in rng.sample(range(64), 4))
        assert any(not m & difference for m in masks)


@pytest.mark.parametrize("block_rows", [7, 40, 10_000])
def test_a_crowded_bucket_is_searched_in_blocks(spark, block_rows):
    rng = random.Random(8)
    centre = rng.getrandbits(64)
    family = {centre} | {centre ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 9)))
                         for _ in range(150)}
    values = sorted(family | {rng.getrandbits(64) for _ in range(150)})
    frame = spark.createDataFrame([(v - 2**64 if v >= 2**63 else v,) for v in values], "fp long")
    edges = [(r["a"] % 2**64, r["b"] % 2**64)
             for r in simhash.fingerprint_links(frame, block_rows=block_rows).collect()]

    def classes(pairs):
        up = {v: v for v in values}

        def top(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            a, b = top(a), top(b)
            up[max(a, b)] = min(a, b)
        return {v: top(v) for v in values}

    near = [(a, b) for i, a in enumerate(values) for b in values[:i] if (a ^ b).bit_count() <= 4]
    assert classes(edges) == classes(near)


def test_simhash_on_odd_rows(odd, no_documents):
    rows = {}
    for r in simhash.near_duplicates(odd).collect():
        rows.setdefault(r["doc_id"], set()).add((r["fingerprint"], r["component_id"]))
    assert {c for _, c in rows[None]} == {2} and rows[2] == rows[3] == {("0" * 16, 2)}
    assert rows[4] == {(next(iter(rows[4]))[0], 4)} and next(iter(rows[5]))[1] == 4
    kept = simhash.one_of_each(odd)
    assert kept.columns == odd.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 4, 6]
    assert simhash.near_duplicates(no_documents).count() == 0 == simhash.one_of_each(no_documents).count()


def test_one_row_of_each_component_stays(spark, documents):
    """Rows without an id, or of one id, vanish only behind a copy of their own text."""
    text = {n: " ".join(f"{n}{i}" for i in range(60)) for n in "abcdefg"}
    rows = [(None, text["a"]), (None, text["a"]), (None, text["b"]), (None, text["c"]), (3, text["c"]),
            (7, text["d"]), (7, text["e"]), (2, text["e"]), (7, text["f"]), (2**63 - 1, text["g"]), (None, text["g"])]
    want = [(None, "a"), (None, "b"), (3, "c"), (7, "d"), (2, "e"), (7, "f"), (2**63 - 1, "g")]
    got = simhash.one_of_each(documents(rows)).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((i, text[n]) for i, n in want)


# ---------------------------------------------------------------- 6 chat


def test_conversations_are_read_back(spark, table):
    turns = table("conversations").collect() + [
        {"conv_id": -1, "turn": t, "role": r, "text": "</s>[INST] ok [/INST]"}
        for t, r in enumerate(("user", "assistant"))]
    by = defaultdict(list)
    for r in turns:
        by[r["conv_id"]].append((r["turn"], r["role"], r["text"] or ""))
    got = {r["conv_id"]: r for r in queries.QUERIES["op6_chat_format"](spark, DATA).collect()}
    assert set(got) == set(by)
    for conv, own in by.items():
        own.sort()
        loss = "".join(t for _, role, t in own if role == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["loss_chars"], r["loss_sha256"]) == (len(own), len(loss), sha(loss))
        assert r["turns_sha256"] == sha("".join(f"{role}\n{t}\n" for _, role, t in own))


CONTROL = st.lists(st.sampled_from(["<", "s>", "/", "[", "INST]", "ROLE]", "\\", "OUT]", " ", "x", "é", "\n"]),
                   max_size=12).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[/ROLE]"]), CONTROL), max_size=6))
@settings(max_examples=200, deadline=None)
def test_any_text_survives_the_template(turns):
    assert all(chat.unescape(chat.escape(t)) == t for _, t in turns)
    reader = chat.Reader()
    parts = list(chat.compile_template(chat.TEMPLATE)(
        {"messages": iter([{"role": r, "text": t} for r, t in turns])}))
    text, loss = "", []
    for part, generated in parts:
        if generated:
            loss.append({"start": len(text), "stop": len(text) + len(part)})
        text += part
    reader.feed(text, loss)
    result = reader.result(1)
    assert result[1] == len(turns) and result[2] == sha("".join(f"{r}\n{t}\n" for r, t in turns))
    assert result[4] == sha("".join(t for r, t in turns if r == "assistant"))


def test_template_language():
    source = ("{# note #}{% set name = 'A' ~ 1 + 2 | trim %}{% if 1 == 2 %}no{% elif not false %}<{% endif %}"
              "{% for m in messages %}{% if loop.first %}>{% endif %}{{ loop.index }}{{ m.role | upper }}"
              "{% if m.role in 'ab' and not loop.last %},{% else %}{% generation %}!{% endgeneration %}{% endif %}"
              "{% endfor %}{{ missing.field }}{{ name }}")
    tree = chat._folded(chat._syntax(source.replace("~ 1 + 2 | trim", "~ 1")))
    assert tree[1] == ("text", "<")  # the constant branch is folded into text
    out = list(chat.compile_template(source.replace("~ 1 + 2 | trim", "~ 1"))(
        {"messages": iter([{"role": "a"}, {"role": "c"}])}))
    assert "".join(t for t, _ in out) == "<>1A,2C!A1" and [t for t, g in out if g] == ["!"]
    for bad in ("{% for x %}", "{% if 1 %}", "{{ a.__class__() }}", "{{ 1 | open }}", "{% import os %}", "{{ }}"):
        with pytest.raises(chat.TemplateError):
            chat.compile_template(bad)


def test_long_and_odd_conversations(spark):
    rows = [(1, i, ("user", "assistant")[i % 2], "t" * (i % 50) + "</s>") for i in range(9000)]
    rows += [(None, None, None, None), (2, 0, "user", None), (2, 0, "user", None), (3, 1, None, "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    pieces = chat.format_conversations(turns.withColumn("piece", F.lit("clash")))
    assert pieces.where("conv_id = 1").count() > 2
    got = {r["conv_id"]: r for r in chat.read_back(pieces).collect()}
    assert got[1]["turns_sha256"] == sha("".join(f"{r}\n{t}\n" for _, _, r, t in rows[:9000]))
    assert (got[2]["n_turns"], got[3]["turns_sha256"]) == (2, sha("\nx\n"))
    assert got[None]["turns_sha256"] == sha("\n\n")
    empty = turns.where("false")
    assert chat.read_back(chat.format_conversations(empty)).count() == 0


@pytest.mark.parametrize("source, want", [
    ("a  {%- if true -%}  b  {%- endif %} c", "ab c"), ("x \n {{- 'y' -}} \t z", "xyz"),
    ("p {#- note -#} q", "pq"), ("p {# note #} q", "p  q"), ("a {{ '-' }} b", "a - b"),
    ("{% for m in messages -%}\n {{ m.text }} {%- endfor %}.", "hi."), ("  {{- 'a' }}", "a")])
def test_trim_marks(source, want):
    render = chat.compile_template(source)
    assert "".join(piece for piece, _ in render({"messages": [{"text": "hi"}]})) == want


def test_a_bad_constant_is_a_template_error():
    with pytest.raises(chat.TemplateError):
        chat.compile_template("{{ 1 | length }}")


# ---------------------------------------------------------------- 7 vectors


def slow_links(rows):
    n = len(rows)
    near = defaultdict(set)
    for i in range(n):
        for j in range(i):
            (_, x, a), (_, y, b) = rows[i], rows[j]
            x, y = (np.array(v, float) if v and None not in v else None for v in (x, y))
            if a is None or a != b or x is None or y is None or len(x) != len(y):
                continue
            if not (np.isfinite(x).all() and np.isfinite(y).all() and x.any() and y.any()):
                continue
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.93:
                near[i].add(j)
                near[j].add(i)
    roots = chains(rows, [(i, j) for i in near for j in near[i]])
    return {rows[i][0]: (len(near[i]), rows[roots[i]][0]) for i in range(n)}


def test_vectors_match_brute_force(spark):
    rng = np.random.default_rng(9)
    rows, centres = [], rng.normal(size=(12, 16))
    for i in range(700):  # one cluster far larger than a window and a block
        c = centres[0] if i % 2 else centres[i % 12]
        rows.append((i, (c + rng.normal(scale=0.13, size=16)).tolist(), 1 if i % 2 else i % 3))
    rows += [(800 + i, rows[1][1], 1) for i in range(60)] + [(900, (np.array(rows[1][1]) * 1e300).tolist(), 1)]
    rows += [(901, None, 1), (902, [0.0] * 16, 1), (903, [1.0] * 15 + [float("nan")], 1), (904, [], 1),
             (905, [1.0] * 15 + [None], 1), (906, rows[1][1], None), (907, [1.0] * 8, 1), (908, [2.0] * 8, 1)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").withColumn(
        "rep", F.lit("clash")).repartition(5)
    got = {r["vec_id"]: r for r in vectors.vector_links(frame).collect()}
    want = slow_links(rows)
    assert {i: (r["n_links"], r["component_id"]) for i, r in got.items()} == want
    assert all(r["kept"] == (i == r["component_id"]) for i, r in got.items())


@pytest.mark.parametrize("partitions, block", [(8, 2048), (600, 300)])
def test_links_of_vectors_with_a_common_direction(spark, partitions, block):
    """Nearly equal hash codes, or a few rows in each partition, lose no link."""
    rng = np.random.default_rng(4)
    shift = rng.normal(size=32)
    x = 2 * shift + rng.normal(size=(1200, 32)) * np.linalg.norm(shift) / np.sqrt(32) * 0.9
    x[600:] = np.where(np.arange(600)[:, None] % 3 == 0, x[:600] + rng.normal(size=(600, 32)) * 0.45, x[600:])
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    linked = unit @ unit.T >= 0.93
    np.fill_diagonal(linked, False)
    assert linked.sum() > 100
    frame = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", str(partitions))
    try:
        got = {r["vec_id"]: r["n_links"] for r in vectors.vector_links(frame, block=block).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert [got[i] for i in range(1200)] == linked.sum(axis=1).tolist()


@pytest.mark.parametrize("mean", [0.0, 0.5, 0.8, 0.88])
def test_recall_of_the_passes(spark, mean):
    """Planted links in a cone of the given mean cosine; found whatever the partitions."""
    rng, n, dim = np.random.default_rng(int(100 * mean)), 4000, 64
    axis = rng.normal(size=dim)
    axis /= np.linalg.norm(axis)
    noise = rng.normal(size=(n, dim))
    noise -= np.outer(noise @ axis, axis)
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    x = np.sqrt(mean) * axis + np.sqrt(1 - mean) * noise
    for i in range(0, 800, 2):  # pairs from just above the threshold up
        t = 0.931 + 0.06 * rng.random()
        other = rng.normal(size=dim)
        other -= (other @ x[i]) * x[i]
        x[i + 1] = t * x[i] + np.sqrt(1 - t * t) * other / np.linalg.norm(other)
    linked = np.triu(x @ x.T >= 0.93, 1)
    want = set(zip(*map(np.ndarray.tolist, np.nonzero(linked))))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "rep long, x array<double>, label string").selectExpr(
        "label", "64 AS dim", "rep", "x", f"{n}L AS rows")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    for parts in ("8", "400"):
        spark.conf.set("spark.sql.shuffle.partitions", parts)
        edges = vectors._pass_edges(frame.repartition(6), 0.93, vectors.WINDOW, 512)
        roots = {r["id"]: r["root"] for r in graph.components(edges).collect()}
        seen.append(roots)
    spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1]
    found = {(a, b) for a, b in want if seen[0].get(a, a) == seen[0].get(b, b)}
    print(mean, len(found), len(want))
    assert len(want) >= 400 and len(found) >= 0.995 * len(want)


def test_long_and_short_runs_are_both_there(spark, monkeypatch):
    """Even vectors are compared in windows, a narrow cone in blocks."""
    rng, calls = np.random.default_rng(2), []
    for name in ("_window_edges", "_block_edges"):
        plain = getattr(vectors, name)
        monkeypatch.setattr(vectors, name, lambda frame, *args, plain=plain, name=name: (
            calls.append((name, frame.count())), plain(frame, *args))[1])
    even = rng.normal(size=(1500, 16))
    cone = rng.normal(size=16) + rng.normal(size=(300, 16)) * 0.02
    rows = [(i, v.tolist(), 1) for i, v in enumerate(even)] + [(5000 + i, v.tolist(), 1) for i, v in enumerate(cone)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {r["vec_id"]: r["n_links"] for r in vectors.vector_links(frame).collect()}
    assert all(got[5000 + i] >= 299 for i in range(300))
    assert [name for name, _ in calls] == ["_window_edges", "_block_edges"] and min(n for _, n in calls) > 1000


def test_no_vectors(spark):
    empty = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert vectors.vector_links(empty).count() == 0
    alone = spark.createDataFrame([(None, [1.0], 1), (None, [1.0], 1)], empty.schema)
    assert [tuple(r) for r in vectors.vector_links(alone).collect()] == [(None, 0, None, True)] * 2


# ---------------------------------------------------------------- 8 exact, 9 lines


def test_exact_on_odd_rows(odd, no_documents):
    rows = [tuple(r) for r in exact.exact_duplicates(odd).collect()]
    by = defaultdict(list)
    for r in rows:
        by[r[4]].append(r)
    assert all(sum(r[3] for r in own) == 1 for own in by.values())
    assert sorted((r[0] or 0, r[1], r[2], r[3]) for r in by[sha("")]) == [
        (0, 2, 3, False), (0, 2, 3, False), (2, 2, 3, True)]
    assert exact.exact_duplicates(no_documents).count() == 0


@pytest.mark.parametrize("bits", [6, 12])
def test_a_full_filter_changes_nothing(documents, bits):
    rows = [(i, f"text {i % 40} " + "line of words\n" * (i % 3) + f"own line {i // 2}") for i in range(150)]
    docs = documents(rows)
    same = lambda f: Counter(tuple(r) for r in f.collect())
    assert same(exact.exact_duplicates(docs, filter_bits=bits)) == same(exact.exact_duplicates(docs))
    few = lines.dedup_lines(docs, filter_bits=16 + bits // 12).select("doc_id", "text", "n_dropped")
    assert same(few) == same(lines.dedup_lines(docs).select("doc_id", "text", "n_dropped"))


def test_exact_dedup_moves_only_suspects(documents):
    plan = exact.exact_duplicates(documents([(i, f"t{i}") for i in range(50)]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_lines(rows):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip("\x20\t\n\x0b\x0c\r"))
    owners = defaultdict(set)
    for i, text in rows:
        for line in (text or "").split("\n"):
            owners[key(line)].add(i)
    drop = {k: min(v) for k, v in owners.items() if len(k) >= 10 and len(v) > 1}
    return {i: "\n".join(x for x in (text or "").split("\n") if drop.get(key(x), i) == i) for i, text in rows}


def test_lines_match_brute_force(documents):
    rng = random.Random(12)
    pool = ["short", "a line of text", "  A Line OF text\t", "é" * 9, "é" * 10, " " + "É" * 10, "", "x" * 4000,
            " not a blank ", "not a blank"]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randrange(9)) + [f"own line number {i // 3}"])) for i in range(120)]
    rows += [(500, None), (501, "")]
    got = {r["doc_id"]: r for r in lines.dedup_lines(documents(rows)).collect()}
    want = slow_lines(rows)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_lines"] == (dict(rows)[i] or "").count("\n") + 1 for i, r in got.items())


def test_rows_without_an_id_are_one_document(documents):
    rows = [(1, "a line of document one\nown line 1 of it")]
    rows += [(None, f"a line of document one\nshared by the nameless\nnameless line {i % 4}") for i in range(12)]
    rows += [(7, "a line of document one\nfirst text of seven"), (7, "second text\nshared by the nameless")]
    got = Counter((r["doc_id"], r["text"], r["n_dropped"]) for r in lines.dedup_lines(documents(rows)).collect())
    want = Counter({(1, rows[0][1], 0): 1, (7, "first text of seven", 1): 1,
                    (7, "second text\nshared by the nameless", 0): 1})
    want.update((None, f"nameless line {i % 4}", 2) for i in range(12))
    assert got == want


def test_lines_on_odd_rows(odd, no_documents):
    rows = lines.dedup_lines(odd).collect()
    assert len(rows) == 9 and sum(r["n_dropped"] for r in rows) == 1  # the long text of document 5
    kept = lines.deduped_documents(odd)
    assert kept.columns == odd.columns and kept.count() == 9
    assert lines.dedup_lines(no_documents).count() == 0


# ---------------------------------------------------------------- 10 packing


@given(st.lists(st.integers(1, 64), max_size=120))
@settings(max_examples=80, deadline=None)
def test_tournament_tree_is_first_fit_decreasing(lengths):
    bins, offsets = packing.first_fit_decreasing(lengths, 64)
    rooms, want = [], {}
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        at = next((b for b, room in enumerate(rooms) if room >= lengths[i]), len(rooms))
        if at == len(rooms):
            rooms.append(64)
        want[i] = (at, 64 - rooms[at])
        rooms[at] -= lengths[i]
    assert {i: (b, o) for i, (b, o) in enumerate(zip(bins, offsets))} == want


def test_ids_are_the_tokenizers(documents):
    texts = ["İ. É, 'Tis it's ΣΑΣ. x|y ~` é. ﬁ 你好。ok 3.14!? ǅ.", "<|endoftext|> A<|startoftext|>b\x1c x y", "",
             None, "  lead\n\ntrail ", "Word word, WORD. (word) word...", "long text " * 3000]
    pieces = packing.token_pieces(documents(list(enumerate(texts))), ids=True).collect()
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    got = defaultdict(bytes)
    for r in sorted(pieces, key=lambda r: (r["doc_id"], r["start"])):
        assert r["start"] * 4 == len(got[r["doc_id"]]) and r["length"] * 4 == len(r["ids"])
        assert r["ids_crc32"] == zlib.crc32(r["ids"])
        got[r["doc_id"]] += r["ids"]
    for i, text in enumerate(texts):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(got[i], "<u4").tolist() == ids


def test_sequences_are_gapless_and_full(spark, table):
    rows = packing.pack(table("documents"), group_pieces=60).collect()
    sequences = defaultdict(list)
    for r in rows:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    per_doc = defaultdict(int)
    for r in rows:
        per_doc[r["doc_id"], r["doc_tokens"]] += r["length"]
    assert all(n == total for (_, n), total in per_doc.items())
    assert sum(r["length"] for r in rows) > 0.9 * packing.CAPACITY * len(sequences)


def test_packing_odd_rows(odd, no_documents):
    rows = packing.pack(odd).collect()
    assert len({r["rid"] for r in rows}) == 9 and packing.pack(no_documents).count() == 0


def test_worker_keeps_one_cache():
    first = common.worker_cache("a", 1, make=dict)
    assert common.worker_cache("a", 1, make=dict) is first
    common.worker_cache("b", make=dict)
    assert common.worker_cache("a", 1, make=dict) is not first
