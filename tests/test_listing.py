"""Top-k over a join, key lookups, side-by-side rows."""

import random

import pytest
from pyspark.sql import functions as F

from tallyloom.operators.listing import down, listing, lookup, misplaced, newest_matching, one_row, up


@pytest.mark.parametrize("known", [1.0, 0.5, 0.01, 0.0])
def test_newest_matching_is_exact(make, known):
    """However few rows of the log match."""
    pick = random.Random(5)
    rows = [(i, pick.randint(0, 50), i if pick.random() < known else -1) for i in range(600)]
    log = make(rows, "id BIGINT, at INT, owner BIGINT")
    people = make([(i, f"n{i}") for i in range(600)], "owner BIGINT, name STRING")
    got = newest_matching(log, people, "owner", "at", 4).collect()
    want = sorted(((at, i) for i, at, owner in rows if owner >= 0), reverse=True)[:4]
    assert [(r["at"], r["id"]) for r in got] == want


def test_newest_matching_shuffles_no_wide_row(make, monkeypatch):
    """The winners come from three columns; the wide rows are read by id."""
    rows = [(i, i % 9, i, "wide") for i in range(100)]
    log = make(rows, "id BIGINT, at INT, owner BIGINT, text STRING")
    people = make([(i, f"n{i}") for i in range(0, 100, 3)], "owner BIGINT, name STRING")
    plans, kind = [], type(log)
    collect = kind.collect

    def record(self):
        plans.append(self._jdf.queryExecution().optimizedPlan().toString())
        return collect(self)

    monkeypatch.setattr(kind, "collect", record)
    got = newest_matching(log, people, "owner", "at", 5)
    above = [line for line in plans[0].splitlines() if "LogicalRDD" not in line]
    assert len(plans) == 1 and "text#" not in "".join(above)
    assert any(line.lstrip(" :+-").startswith("LeftSemi") or "Join LeftSemi" in line for line in above)
    assert " IN (" in got._jdf.queryExecution().optimizedPlan().toString()
    assert [r["text"] for r in got.collect()] == ["wide"] * 5


def test_misplaced_sees_values_nulls_and_borders(make):
    keys = [("v", False, False), ("id", True, True)]
    rows = [(9, 1), (3, 1), (8, 2), (2, 2), (5, None), (4, None), (None, None)]

    def faults(rows, order=keys, parts=3):
        frame = make(rows, "id INT, v INT").coalesce(1)
        cut = frame.withColumn("n", F.monotonically_increasing_id()).repartitionByRange(parts, "n")
        return misplaced(cut.sortWithinPartitions("n"), order).count()

    assert faults(rows, [("v", False, False)]) == 0
    assert faults(rows[:6]) == 0
    assert faults(rows) == 1  # the missing id stands before others when descending
    for parts in (1, 2, 6):
        assert faults(rows[::-1], [("v", False, False)], parts) == 2
        assert faults(rows[:6][::-1], keys, parts) == 5
        assert faults([(i, i) for i in range(20)], [("id", False, False)], parts) == 0
        assert faults([(i, i) for i in range(20)], [("id", True, True)], parts) == 19
    assert faults([], parts=2) == 0


def test_null_order(make):
    rows = make([(1, None), (2, 5), (3, 7)], "id INT, v INT")
    assert [r["id"] for r in listing(rows, [up("v"), up("id")]).collect()] == [2, 3, 1]
    assert [r["id"] for r in listing(rows, [down("v"), up("id")]).collect()] == [1, 3, 2]


def test_lookup_takes_repeated_keys_once(make):
    rows = make([(1, "a"), (2, "b"), (2, "c")], "owner BIGINT, v STRING")
    keys = make([(2,), (2,), (9,)], "id BIGINT")
    assert sorted(r["v"] for r in lookup(rows, keys, "owner").collect()) == ["b", "c"]


def test_one_row(spark):
    left = spark.range(3).agg(F.sum("id").alias("a"))
    right = spark.range(4).agg(F.count("*").alias("b"), F.max("id").alias("c"))
    assert [tuple(r) for r in one_row(left, right).collect()] == [(3, 4, 3)]
