import json

import pytest

from millrace.streaming import journal
from millrace.streaming.journal import record

LOG = [
    record(1, "u", 1, "insert", {"a": 1}), record(2, "u", 2, "insert", {"a": 2}), record(3, "u", 1, "update", {"a": 10}), record(4, "u", 2, "delete", {"a": 2}),
    record(3, "u", 1, "update", {"a": 10}), record(5, "v", 1, "insert", {"a": 7}),
]


def test_replay_is_idempotent_and_order_free(spark):
    for log in (LOG, LOG[::-1], LOG + LOG):
        df = spark.createDataFrame(log, journal.RECORD)
        assert [tuple(r) for r in journal.replay(df, "u", "a long").collect()] == [(1, 10)]


def test_empty_log(spark):
    assert journal.replay(spark.createDataFrame([], journal.RECORD), "u", "a long").count() == 0


def test_journal_file(spark, tmp_path):
    lines = [{"op": "insert", "payload": ["u", 0, {"a": 1}]}, {"op": "update", "payload": ["u", 0, {"a": 1}, {"a": 5}]}, {"op": "insert", "payload": ["u", 1, {"a": 2}]}, {"op": "delete", "payload": ["u", 1, {"a": 2}]}]
    (tmp_path / "log").write_text("".join(json.dumps(x) + "\n" for x in lines))
    assert [tuple(r) for r in journal.replay(journal.read_journal(spark, str(tmp_path / "log")), "u", "a long").collect()] == [(0, 5)]


def test_stream_restarts_from_checkpoint(spark, tmp_path):
    live = journal.LiveTable(spark, f"file://{tmp_path}/live")
    assert live.table("u", "a long").count() == 0
    for part in (LOG[:2], LOG[2:]):
        journal.append_log(spark.createDataFrame(part, journal.RECORD), f"{tmp_path}/log")
        live = journal.LiveTable(spark, f"file://{tmp_path}/live")
        live.follow(f"{tmp_path}/log", f"{tmp_path}/check").trigger(availableNow=True).start().awaitTermination()
    assert [tuple(r) for r in live.table("u", "a long").collect()] == [(1, 10)]
    live.apply(spark.createDataFrame(LOG, journal.RECORD), 0)  # a batch that is already in
    assert [tuple(r) for r in live.table("u", "a long").collect()] == [(1, 10)]


def test_journal_files_in_order(spark, tmp_path):
    """The second file is the larger one; Spark deals large files first."""
    (tmp_path / "1.json").write_text(json.dumps({"op": "insert", "payload": ["u", 0, {"a": 1}]}) + "\n")
    more = [{"op": "update", "payload": ["u", 0, {"a": k}, {"a": k + 1}]} for k in range(1, 400)]
    (tmp_path / "2.json").write_text("".join(json.dumps(x) + "\n" for x in more))
    for size in ("128m", "2k"):  # one stretch for each file, and many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        try:
            assert [tuple(r) for r in journal.replay(journal.read_journal(spark, str(tmp_path)), "u", "a long").collect()] == [(0, 400)]
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_batch_that_breaks_off_changes_nothing(spark, tmp_path, monkeypatch):
    live = journal.LiveTable(spark, f"file://{tmp_path}/live")
    live.apply(spark.createDataFrame(LOG[:2], journal.RECORD), 0)
    with monkeypatch.context() as m:
        m.setattr(journal.LiveTable, "_point", lambda *_: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            live.apply(spark.createDataFrame(LOG[2:], journal.RECORD), 1)
    live = journal.LiveTable(spark, f"file://{tmp_path}/live")
    assert sorted(tuple(r) for r in live.table("u", "a long").collect()) == [(1, 1), (2, 2)]
    live.apply(spark.createDataFrame(LOG[2:], journal.RECORD), 1)
    assert [tuple(r) for r in live.table("u", "a long").collect()] == [(1, 10)]
    live.apply(spark.createDataFrame([record(9, "u", 7, "insert", {"a": 3})], journal.RECORD), 2)
    assert len([p for p in (tmp_path / "live" / "v2").iterdir() if p.name.startswith("_part=")]) == 1  # only the part of the row is written
    assert sorted(tuple(r) for r in live.table("u", "a long").collect()) == [(1, 10), (7, 3)]
    assert [tuple(r) for r in live.table("v", "a long").collect()] == [(1, 7)]
