"""Unique keys: the distributed result against a row-by-row replay."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators import claims
from tallyloom.operators.claims import mark_duplicates


def replay(rows, stored):
    """Apply the rows one after the other; a row that fails occupies nothing."""
    held = [set(values) for values in stored]
    verdict = {}
    for request, *keys, eligible in sorted(rows):
        clash = any(k is not None and k in held[i] for i, k in enumerate(keys))
        verdict[request] = clash
        if eligible and not clash:
            for i, k in enumerate(keys):
                if k is not None:
                    held[i].add(k)
    return verdict


@pytest.mark.parametrize("seed", range(4))
def test_two_keys_with_chains(make, seed):
    pick = random.Random(seed)
    rows = [(i, f"u{pick.randint(0, 14)}", f"e{pick.randint(0, 14)}", pick.random() < 0.8)
            for i in range(60)]
    stored = [["u3"], ["e4"]]
    df = make(rows, "request_id BIGINT, username STRING, email STRING, ok BOOLEAN")
    table = make([("u3", "e4")], "username STRING, email STRING")
    got = mark_duplicates(df, ("username", "email"), table, F.col("ok"), "request_id")
    assert {r["request_id"]: r["duplicate"] for r in got.collect()} == replay(rows, stored)


@pytest.mark.parametrize("seed", range(3))
def test_one_key_with_a_hot_value(make, seed):
    pick = random.Random(seed)
    rows = [(i, "hot" if pick.random() < 0.5 else f"k{pick.randint(0, 40)}", pick.random() < 0.7)
            for i in range(400)]
    df = make(rows, "request_id BIGINT, code STRING, ok BOOLEAN")
    got = mark_duplicates(
        df, ("code",), make([("k1",), ("k2",)], "code STRING"), F.col("ok"), "request_id")
    assert {r["request_id"]: r["duplicate"] for r in got.collect()} == replay(
        rows, [["k1", "k2"]])


def test_missing_keys_clash_with_nobody(make):
    rows = [(0, None, "e1", True), (1, None, "e2", True), (2, "u1", None, True),
            (3, "u1", "e3", True), (4, None, "e1", True), (5, None, None, True)]
    df = make(rows, "request_id BIGINT, username STRING, email STRING, ok BOOLEAN")
    table = make([], "username STRING, email STRING")
    got = mark_duplicates(df, ("username", "email"), table, F.col("ok"), "request_id")
    assert {r["request_id"]: r["duplicate"] for r in got.collect()} == replay(rows, [[], []])
    one = mark_duplicates(df, ("username",), table, F.col("ok"), "request_id")
    assert {r["request_id"] for r in one.filter("duplicate").collect()} == {3}


def counted(monkeypatch):
    """The number of frames written, which is that of the rounds and their steps."""
    calls = []
    plain = claims.materialise
    monkeypatch.setattr(claims, "materialise", lambda df, label: calls.append(label) or plain(df, label))
    return calls


@pytest.mark.parametrize("turned", [False, True])
def test_a_long_chain_is_contracted(make, monkeypatch, turned):
    """Each row shares one key with the next: every second row wins, in few rounds. Turned, the
    rows come in the order that makes every second one free."""
    n = 10_000
    rows = [(i * 7919 % n if turned else i, f"u{(i + 1) // 2}", f"e{i // 2}", True) for i in range(n)]
    df = make(rows, "request_id BIGINT, username STRING, email STRING, ok BOOLEAN").repartition(4)
    table = make([], "username STRING, email STRING")
    calls = counted(monkeypatch)
    got = mark_duplicates(df, ("username", "email"), table, F.col("ok"), "request_id")
    assert {r["request_id"]: r["duplicate"] for r in got.collect()} == replay(rows, [[], []])
    assert calls.count("claims-open") + calls.count("claims-links") < 40


@pytest.mark.parametrize("seed", range(4))
def test_three_keys_with_missing_ones(make, seed):
    pick = random.Random(100 + seed)

    def key(mark):
        return None if pick.random() < 0.2 else f"{mark}{pick.randint(0, 40)}"

    rows = [(i * 37 % 300, key("a"), key("b"), key("c"), pick.random() < 0.9) for i in range(300)]
    df = make(rows, "request_id BIGINT, a STRING, b STRING, c STRING, ok BOOLEAN")
    table = make([("a1", "b2", "c3")], "a STRING, b STRING, c STRING")
    got = mark_duplicates(df, ("a", "b", "c"), table, F.col("ok"), "request_id")
    assert {r["request_id"]: r["duplicate"] for r in got.collect()} == replay(
        rows, [["a1"], ["b2"], ["c3"]])


def test_a_crowded_key_in_a_chain(make, monkeypatch):
    """A third of all rows ask for one name, whose first claims hang on a chain."""
    rows = [(i, f"u{(i + 1) // 2}", f"e{i // 2}", True) for i in range(400)]
    rows += [(400 + i, "u200", f"x{i % 90}", True) for i in range(200)]
    df = make(rows, "request_id BIGINT, username STRING, email STRING, ok BOOLEAN")
    table = make([], "username STRING, email STRING")
    calls = counted(monkeypatch)
    got = mark_duplicates(df, ("username", "email"), table, F.col("ok"), "request_id")
    assert {r["request_id"]: r["duplicate"] for r in got.collect()} == replay(rows, [[], []])
    assert calls.count("claims-open") <= 4
