"""Alerts and marks on streams whose rows come late and out of order."""

import datetime as dt

import pytest
from pyspark.sql import Row

from quantspark.streaming import stateful

pytest.importorskip("google.protobuf")

BARS = "ticker string, ts timestamp, close double"
MARKS = "kind string, user_id string, card string, op string, ts timestamp, seq long"


def at(hour, day=1):
    return dt.datetime(2024, 1, day, hour)


class Stream:
    """Lands rows file by file; each file is a batch of its own."""

    def __init__(self, spark, tmp_path, shape, job):
        self.spark, self.path, self.shape, self.job = spark, tmp_path, shape, job
        stateful.use_rocksdb(spark)

    def land(self, *batches):
        for rows in batches:
            self.spark.createDataFrame(rows, self.shape).coalesce(1).write.mode("append").parquet(str(self.path / "in"))
        stream = self.job(self.spark.readStream.schema(self.shape).option("maxFilesPerTrigger", 1).parquet(str(self.path / "in")))
        q = stream.writeStream.format("parquet").option("path", str(self.path / "out")).option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        q.awaitTermination(180)
        assert q.exception() is None
        return self.spark.read.schema(stream.schema).parquet(str(self.path / "out")).collect()


def test_late_bars_are_put_in_order(spark, tmp_path):
    known = spark.createDataFrame([("A", at(0), 100.0), ("A", dt.datetime(2023, 12, 31), 7.0)], BARS)
    stream = Stream(spark, tmp_path, BARS, lambda s: stateful.dip_alerts(s, 0.05, "3 hours", known))
    # 94 and 93 arrive after 80; B has no bar before its first one.
    rows = stream.land([("A", at(3), 80.0), ("B", at(1), 10.0)], [("A", at(1), 94.0), ("A", at(2), 93.0)], [("B", at(9), 9.0)])
    assert sorted((r.ticker, r.ts.hour, round(r.ret, 6)) for r in rows) == [("A", 1, -0.06), ("A", 3, round(80 / 93 - 1, 6))]
    # A later run goes on from the stored state; B's bar of nine is judged against its first one.
    rows = stream.land([("A", at(9), 80.0), ("A", at(20), 1.0)])
    assert sorted((r.ticker, r.ts.hour) for r in rows) == [("A", 1), ("A", 3), ("B", 9)]


def test_marks_keep_the_newest_change_and_forget_unmarked_cards(spark, tmp_path):
    known = spark.createDataFrame([("read", "u", "old", "mark", at(0), 1), ("read", "u", "gone", "mark", at(0), 2), ("read", "u", "gone", "unmark", at(0), 3)], MARKS)
    stream = Stream(spark, tmp_path, MARKS, lambda s: stateful.card_marks(s, "6 hours", known))
    rows = stream.land(
        [("read", "u", "a", "unmark", at(3), 10), ("read", "u", "b", "mark", at(3), 11), ("read", "v", "a", "mark", at(1), 12)],
        [("read", "u", "a", "mark", at(2), 9), ("read", "u", "b", "mark", at(4), 13)],  # the first is older than the unmark
        [("read", "u", "old", "unmark", at(5), 14), ("read", "u", "c", "mark", at(20), 15)],
    )
    assert sorted((r.user_id, r.card, r.op) for r in rows) == [("u", "b", "mark"), ("u", "c", "mark"), ("u", "old", "unmark"), ("v", "a", "mark")]
    state = spark.read.format("statestore").option("stateVarName", "cards").load(str(tmp_path / "state"))
    held = {(r.key.user_id, r.user_map_key.card, r.user_map_value.op) for r in state.collect()}
    assert held == {("u", "b", "mark"), ("u", "c", "mark"), ("v", "a", "mark")}


class Calls:
    """A state variable or handle in memory that counts what it is asked."""

    def __init__(self):
        self.held, self.calls, self.parts = {}, [], {}

    def getMapState(self, name, *_):
        return self.parts.setdefault(name, Calls())

    getValueState = getMapState

    def __getattr__(self, name):
        def call(*args):
            self.calls.append((name, *args))
            if name in ("updateValue", "update"):
                self.held[args[0] if name == "updateValue" else None] = args[-1]
            return self.held.get(args[0]) if name == "getValue" else None

        return call


def test_state_is_asked_once_per_card_and_one_timer_stands_per_user():
    handle, marks = Calls(), stateful.CardMarks()
    marks.init(handle)
    rows = [Row(ts=None, kind="read", user_id="u", card=f"c{i % 3}", op="unmark" if i // 3 % 2 else "mark", us=i * 10_000, seq=i) for i in range(60)]
    flips = list(marks.handleInputRows(("read", "u"), iter(rows[::-1]), None))
    assert [(f.card, f.op, f.seq) for f in flips] == [(r.card, r.op, r.seq) for r in rows]
    cards = [c[0] for c in handle.parts["cards"].calls]
    assert sorted(cards) == ["getValue"] * 3 + ["updateValue"] * 3
    assert handle.parts["cards"].held == {(f"c{i % 3}",): (i * 10_000, i, "unmark") for i in (57, 58, 59)}
    assert [c for c in handle.calls if c[0] == "registerTimer"] == [("registerTimer", 591)]
