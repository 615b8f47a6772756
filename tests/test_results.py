"""Every registered query against its SQL twin, rows, columns and types."""

from collections import Counter

import pytest
from conftest import DATA

import __spark_entry__ as entry_points
from tallyloom.catalogue import QUERIES as REGISTERED

# the queries of the training-data operators have tests of their own
QUERIES = {name: build for name, build in entry_points.queries().items() if name in REGISTERED}
SQL = {name: sql for name, sql in entry_points.oracle_sql().items() if name in REGISTERED}


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], [tuple(row[i] for i in order) for row in rows]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_sql(spark, duck, name):
    frame = QUERIES[name](spark, DATA)
    result = duck.execute(SQL[name])
    want_columns, want = ordered([d[0] for d in result.description], result.fetchall())
    got_columns, got = ordered(frame.columns, [tuple(r) for r in frame.collect()])
    assert got_columns == want_columns
    assert Counter(got) == Counter(want)
    for i, column in enumerate(got_columns):
        kinds = [{type(r[i]) for r in rows if r[i] is not None} for rows in (got, want)]
        assert kinds[0] == kinds[1], column


def test_every_query_has_sql():
    assert set(SQL) == set(QUERIES) == set(REGISTERED)


def test_entry(spark):
    frame = entry_points.entry(spark)
    assert frame.columns == [
        "id", "sku", "name", "total_remaining_quantity", "total_valuation"]
    assert frame.count() == 200


def test_operator_ids_are_covered():
    from tallyloom.catalogue import QUERIES as catalogue

    covered = {i for ids, _ in catalogue.values() for i in ids.split()}

    def numbered(prefix, last):
        return {f"{prefix}-{n}" for n in range(1, last + 1)}

    wanted = (numbered("L", 14) | numbered("P", 7) | numbered("J", 23) | numbered("A", 17)
              | numbered("T", 4) | numbered("N", 4) | numbered("F", 16) | numbered("V", 20)
              | numbered("W", 7) | numbered("R", 3) | numbered("X", 2) | numbered("K", 3)
              | numbered("S", 3) | {f"U-1{c}" for c in "abcdefghijklmn"}
              | {f"U-2{c}" for c in "abcdefg"} | {f"U-3{c}" for c in "abcd"}
              | {f"U-4{c}" for c in "abcd"} | numbered("U", 9) - numbered("U", 4)
              | {f"K-1{c}" for c in "abcd"})
    assert wanted - covered - {"S-1"} == set()
