"""Streams end where the batch ends, over several micro-batches and when run again."""

import datetime
import os
import shutil

import pytest
from conftest import DATA
from pyspark.sql import functions as F

from tallyloom.plans import edits, intake
from tallyloom.sources import bodies
from tallyloom.sources.tables import StreamTables
from tallyloom.streaming import edits as edit_stream
from tallyloom.streaming import manifest, movements
from tallyloom.streaming.journal import committed
from tallyloom.streaming.manifest import LostRace, State, read_state

NOW = datetime.datetime(1998, 6, 30)


class Arriving(StreamTables):
    """One file per micro-batch."""

    def landing(self, name):
        if name != "events":
            return super().landing(name)
        from tallyloom.sources import schemas

        return (self.spark.readStream.schema(schemas.LANDING[name])
                .option("maxFilesPerTrigger", 1).parquet(f"{self.root}/events"))


@pytest.fixture
def arriving(spark, tmp_path):
    for name in ("customer", "part", "supplier", "orders"):
        shutil.copy(f"{DATA}/{name}.parquet", tmp_path / f"{name}.parquet")
    spark.read.parquet(f"{DATA}/events.parquet").repartition(3, "event_id").write.parquet(
        str(tmp_path / "events"))
    return Arriving(spark, str(tmp_path))


def same(left, right):
    columns = sorted(left.columns)
    assert columns == sorted(right.columns)
    left, right = left.select(columns), right.select(columns)
    assert left.exceptAll(right).isEmpty() and right.exceptAll(left).isEmpty()


def test_movements(tables, arriving, tmp_path):
    path = str(tmp_path / "out")
    batch = intake.movements(tables, NOW)
    for _ in range(2):
        movements.ingest(tables, arriving.movement_feed, path, NOW)
        same(movements.accepted(tables, path),
             batch.filter("reject_reason IS NULL").drop("reject_reason"))
        same(movements.rejected(tables, path),
             batch.filter("reject_reason IS NOT NULL").select("request_id", "reject_reason"))
        # Draining again finds nothing new and adds nothing.


def test_a_batch_that_is_run_again_replaces_what_it_left(spark, tables, arriving, tmp_path, monkeypatch):
    """The job dies after a batch is written and before the stream has committed it."""
    path, plain = str(tmp_path / "out"), intake.movements
    calls = []

    def dying(t, as_of, feed):
        calls.append(1)
        if len(calls) == 2:
            plain(t, as_of, feed).limit(3).withColumn("outcome", F.lit("accepted")).write.partitionBy(
                "outcome").parquet(f"{path}/data/batch=1")
            raise RuntimeError("lost")
        return plain(t, as_of, feed)

    monkeypatch.setattr(intake, "movements", dying)
    with pytest.raises(Exception, match="lost"):
        movements.ingest(tables, arriving.movement_feed, path, NOW)
    # What the dead batch left is not seen, since nothing has committed it.
    assert committed(spark, path) == 0
    seen = movements.accepted(tables, path).count() + movements.rejected(tables, path).count()
    first = spark.read.parquet(f"{path}/data/batch=0").count()
    assert seen == first > 0
    monkeypatch.setattr(intake, "movements", plain)
    movements.ingest(tables, arriving.movement_feed, path, NOW)
    same(movements.accepted(tables, path),
         plain(tables, NOW).filter("reject_reason IS NULL").drop("reject_reason"))


def test_receipts_and_compaction(spark, tables, arriving, tmp_path):
    path = str(tmp_path / "out")
    edit_stream.log_receipts(tables, arriving.receipt_feed, path)
    batch = edits.receive_stock(tables)
    for _ in range(3):
        same(edit_stream.stocked(tables, path), batch.table)
        same(edit_stream.refused_receipts(tables, path), batch.rejected)
        edit_stream.compact_receipts(tables, path)
    assert read_state(spark, path).version == 3


def test_order_status(tables, arriving, tmp_path):
    path = str(tmp_path / "out")
    edit_stream.log_order_status(tables, arriving.sales_order_status_feed, path)
    batch = edits.status_changes()["sales_order"](tables, NOW)
    same(edit_stream.current_orders(tables, path, NOW), batch.table)
    same(edit_stream.refused_order_status(tables, path), batch.rejected)


def test_nothing_has_arrived(spark, tables, tmp_path):
    path = str(tmp_path / "out")
    assert read_state(spark, path) == State() and committed(spark, path) == -1
    same(edit_stream.stocked(tables, path), tables.products)
    assert edit_stream.refused_receipts(tables, path).isEmpty()
    assert movements.quarantined(tables, path).isEmpty()


def test_a_log_goes_on_after_a_compaction(spark, tables, tmp_path):
    source, path = str(tmp_path / "events"), str(tmp_path / "out")
    parts = spark.read.parquet(f"{DATA}/events.parquet").repartition(3, "event_id")
    parts = [parts.filter(f"event_id % 3 = {n}") for n in range(3)]
    arriving = StreamTables(spark, DATA, source)
    for part in parts:
        part.write.mode("append").parquet(source)
        for _ in range(2):  # the second drain finds nothing new
            edit_stream.log_receipts(tables, arriving.receipt_feed, path)
        edit_stream.compact_receipts(tables, path)
    batch = edits.receive_stock(tables)
    same(edit_stream.stocked(tables, path), batch.table)
    same(edit_stream.refused_receipts(tables, path), batch.rejected)


def test_a_compaction_inside_a_drain(spark, tables, arriving, tmp_path, monkeypatch):
    """The drain begins before the compaction and ends after it: while its second batch is being
    judged, the first is folded into a base, and nothing is lost or counted twice."""
    path, states = str(tmp_path / "out"), []
    plain = edit_stream.judge_targets

    def judge(checked, base, not_found):
        if committed(spark, path) >= 0:
            states.append(edit_stream.compact_receipts(tables, path))
        return plain(checked, base, not_found)

    monkeypatch.setattr(edit_stream, "judge_targets", judge)
    edit_stream.log_receipts(tables, arriving.receipt_feed, path)
    assert [state.through for state in states] == [0, 1] and committed(spark, path) == 2
    same(edit_stream.stocked(tables, path), edits.receive_stock(tables).table)
    assert read_state(spark, path) == states[-1]


def test_a_compaction_that_dies_changes_nothing(spark, tables, arriving, tmp_path, monkeypatch):
    path = str(tmp_path / "out")
    edit_stream.log_receipts(tables, arriving.receipt_feed, path)
    edit_stream.compact_receipts(tables, path)
    before, plain = read_state(spark, path), manifest.commit_state

    def dead(*args):
        raise RuntimeError("lost")

    monkeypatch.setattr(manifest, "commit_state", dead)
    with pytest.raises(RuntimeError, match="lost"):
        edit_stream.compact_receipts(tables, path)
    monkeypatch.setattr(manifest, "commit_state", plain)
    assert read_state(spark, path) == before
    same(edit_stream.stocked(tables, path), edits.receive_stock(tables).table)


def test_one_of_two_compactions_wins(spark, tables, arriving, tmp_path):
    path = str(tmp_path / "out")
    edit_stream.log_receipts(tables, arriving.receipt_feed, path)

    def fold(state, upto):
        if read_state(spark, path).version == 0:
            edit_stream.compact_receipts(tables, path)  # the other one is quicker
        return edit_stream.stocked(tables, path, state, upto)

    with pytest.raises(LostRace):
        manifest.compact(spark, path, fold)
    assert read_state(spark, path).version == 1
    assert [name for name in os.listdir(f"{path}/manifest") if not name.startswith(".")] == ["1"]
    same(edit_stream.stocked(tables, path), edits.receive_stock(tables).table)


def test_json_bodies_as_a_stream(spark, tables, tmp_path):
    source, out = str(tmp_path / "bodies"), str(tmp_path / "out")
    feed = tables.movement_feed
    feed.repartition(2).write.json(source)
    spark.createDataFrame([("{\"request_id\": 1",), ("[1]",), (" ",), ("{\"quantity\": \"1\"}",)],
                          "body STRING").write.mode("append").text(source)
    schema = bodies.body_schema([c for c in feed.columns if c != "request_id"])
    movements.ingest_bodies(tables, bodies.stream_lines(spark, source), schema, out, NOW)
    same(movements.accepted(tables, out),
         intake.movements(tables, NOW).filter("reject_reason IS NULL").drop("reject_reason"))
    assert {tuple(r) for r in movements.quarantined(tables, out).collect()} == {
        ("{\"request_id\": 1", "Malformed JSON body"), ("[1]", "Malformed JSON body"),
        ("{\"quantity\": \"1\"}", "Body has no request_id")}


@pytest.mark.parametrize("body, reason", [
    ('{"request_id": 7, "name": "a"}', None),
    ('  {"name": "\\u0041", "request_id": 7, "other": {"x": [1, {"y": null}]}}  ', None),
    ('{"request_id": 7', "Malformed JSON body"),
    ('{"request_id": 7}}', "Malformed JSON body"),
    ('{"request_id": 7} {"request_id": 8}', "Malformed JSON body"),
    ('{"request_id": 7}, {"request_id": 8}', "Malformed JSON body"),
    ('[{"request_id": 7}]', "Malformed JSON body"),
    ('"request_id"', "Malformed JSON body"),
    ("null", "Malformed JSON body"),
    ("request_id=7", "Malformed JSON body"),
    ('{"request_id": "seven"}', "Body has no request_id"),
    ("{}", "Body has no request_id"),
])
def test_bodies_are_read_or_kept_whole(make, body, reason):
    parsed = bodies.parse_bodies(make([(body,)], "body STRING"), "request_id BIGINT, name STRING")
    good, bad = bodies.readable(parsed).collect(), bodies.unreadable(parsed).collect()
    assert len(good) + len(bad) == 1
    if reason is None:
        assert good[0]["request_id"] == 7 and good[0]["name"] in ("a", "A")
    else:
        assert tuple(bad[0]) == (body, reason)
