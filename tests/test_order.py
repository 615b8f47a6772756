"""The order of every listing: against its twin row by row, and proved where it lies."""

import csv
import os
import re
from collections import Counter

import pytest
from conftest import DATA
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
from sqltwins import ORACLES
from sqltwins.orders import HIDDEN, ORDERS, ordered, parts
from tallyloom.catalogue import REPORTS
from tallyloom.operators import listing as module
from tallyloom.plans import bi
from tallyloom.sources import sinks

SORTED = ordered(ORACLES)
QUERIES = entry_points.queries()


@pytest.mark.parametrize("name", sorted(SORTED))
def test_rows_come_in_order(spark, duck, name):
    result = duck.execute(SORTED[name])
    columns = [d[0] for d in result.description]
    want = result.fetchall()
    got = [tuple(row[c] for c in columns) for row in QUERIES[name](spark, DATA).collect()]
    assert Counter(got) == Counter(want)
    if name in ORDERS:  # rows that share all keys may change places
        keys = [columns.index(c) for c, _, _ in parts(ORDERS[name])]
        got, want = ([[row[k] for k in keys] for row in rows] for rows in (got, want))
    assert got == want


@pytest.mark.parametrize("name", sorted(ORDERS))
def test_the_order_is_proved_in_place(spark, name):
    frame = QUERIES[name](spark, DATA)
    order = parts(ORDERS[name])
    assert module.misplaced(frame, order).isEmpty()
    # The proof is worth something: the rows turned round fail it.
    turned = [F.col(c).asc_nulls_last() if down and first else F.col(c).asc_nulls_first() if down
              else F.col(c).desc_nulls_first() for c, down, first in order]
    if frame.select(*[c for c, _, _ in order]).distinct().count() > 1:
        assert not module.misplaced(frame.orderBy(*turned), order).isEmpty()


@pytest.mark.parametrize("kind", ["finance", "hr", "scm", "crm"])
def test_an_export_is_written_in_order(spark, tables, duck, tmp_path, kind):
    """Part files in the order of their names hold the rows in the order of the twin."""
    frame = bi.export(tables, kind)
    path = str(tmp_path / kind)
    sinks.write_csv(frame, path)
    got = []
    for name in sorted(n for n in os.listdir(path) if n.endswith(".csv")):
        with open(f"{path}/{name}", newline="") as file:
            got += list(csv.reader(file))[1:]
    result = duck.execute(SORTED[f"export_{kind}"])
    place = [[d[0] for d in result.description].index(c) for c in frame.columns]
    want = [["" if row[i] is None else str(row[i]).lower() if isinstance(row[i], bool) else str(row[i])
             for i in place] for row in result.fetchall()]
    assert got == want


def test_every_sorted_query_has_a_rule(spark, monkeypatch):
    """Whatever sorts in a report must be named in the rules."""
    sorts = set()
    for name in REPORTS:
        if not name.startswith("csv_"):
            text = QUERIES[name](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
            if re.search(r"^ *(?:[+:]- *)?Sort \[", text, re.M):
                sorts.add(name)
    assert sorts <= {*ORDERS, *HIDDEN}, sorts - {*ORDERS, *HIDDEN}
    assert len(sorts) > 30
