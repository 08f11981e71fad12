"""Keyed state that tolerates rows out of order: price alerts and card marks.

Both jobs order rows by event time, not by arrival. A row waits, or a deletion is remembered, until the watermark
has passed it: after that no earlier row can come. Both can start from a batch table. State is bounded by the rows
within the watermark's delay, plus one entry per ticker or marked card.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import batched

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import DoubleType, LongType, StringType, StructField, StructType

#: Changes of one user that are put in order at once.
ROWS = 10_000
ROCKS_DB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _struct(**fields) -> StructType:
    return StructType([StructField(name, kind()) for name, kind in fields.items()])


def _later(us: int, seq: int | None) -> tuple:
    """Sorts changes by time and sequence; no sequence is the largest."""
    return us, seq is None, seq or 0


def _order(row: Row) -> tuple:
    return _later(*row[-2:])


def use_rocksdb(spark) -> None:
    """The state store that keyed maps and timers need; streams started from now on have it."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS_DB)


class DipAlerts(StatefulProcessor):
    """Compares every bar with the one before it in event time, whenever they arrive.

    ``waiting`` holds the bars that the watermark has not passed; ``last`` is the newest bar that has been compared.
    One timer per ticker stands at the earliest waiting bar.
    """

    def __init__(self, drop: float):
        self.drop = drop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", _struct(us=LongType, close=DoubleType))
        self.waiting = handle.getMapState("waiting", _struct(us=LongType), _struct(close=DoubleType))
        self.timer = handle.getValueState("timer", _struct(us=LongType))

    def _wake_at(self, us: int) -> None:
        """A timer just after a bar, unless an earlier one is set."""
        if not self.timer.exists() or us < self.timer.get()[0]:
            self.timer.update((us,))
            self.handle.registerTimer(us // 1000 + 1)

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:
        newest = initialState.loc[initialState["us"].idxmax()]
        self.last.update((int(newest["us"]), float(newest["close"])))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        done = self.last.get()[0] if self.last.exists() else None
        earliest = None
        for frame in rows:
            for us, close in zip(frame["us"].tolist(), frame["close"].tolist(), strict=True):
                if done is None or us > done:
                    self.waiting.updateValue((us,), (close,))
                    earliest = us if earliest is None else min(earliest, us)
        if earliest is not None:
            self._wake_at(earliest)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        bars = sorted((k[0], v[0]) for k, v in self.waiting.iterator())
        due = [b for b in bars if b[0] < passed]
        before = self.last.get()[1] if self.last.exists() else None
        alerts = []
        for us, close in due:
            if before and close / before - 1 <= -self.drop:
                alerts.append((key[0], us, close, close / before - 1))
            before = close
            self.waiting.removeKey((us,))
        if due:
            self.last.update(due[-1])
        self.timer.clear()
        if len(due) < len(bars):
            self._wake_at(bars[len(due)][0])
        if alerts:
            yield pd.DataFrame(alerts, columns=["ticker", "us", "close", "ret"])

    def close(self) -> None:
        pass


def dip_alerts(bars: DataFrame, drop: float = 0.05, late: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """(ticker, ts, close, ret) of bars that closed at least ``drop`` below the ticker's bar before them.

    ``bars`` is (ticker, ts, close), in any order within ``late``; a bar is judged once the watermark has passed it.
    ``known`` is a batch table of earlier bars, of which the newest per ticker is where the comparison starts.
    """
    timed = lambda df: df.select("ticker", "ts", F.unix_micros("ts").alias("us"), "close").filter("close is not null")
    start = None
    if known is not None:
        newest = timed(known).groupBy("ticker").agg(F.max("us").alias("us"), F.max_by("close", "us").alias("close"))
        start = newest.groupBy("ticker")
    alerts = timed(bars).withWatermark("ts", late).groupBy("ticker").transformWithStateInPandas(
        statefulProcessor=DipAlerts(drop), outputStructType=_struct(ticker=StringType, us=LongType, close=DoubleType, ret=DoubleType),
        outputMode="Append", timeMode="EventTime", initialState=start,
    )
    return alerts.select("ticker", F.timestamp_micros("us").alias("ts"), "close", "ret")


class CardMarks(StatefulProcessor):
    """The newest change of every card of a user, by (time, sequence).

    A marked card stays. An unmarked one stays until the watermark has passed its change, so that an earlier mark that
    comes late does not bring it back; the user's timer then deletes its entry. One timer per user stands at the newest
    card that was unmarked when it was set, so a user's cards are gone through once per delay of the watermark, not
    once per unmarked card. The changes of a batch meet in memory: the state is asked and told once per card.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.cards = handle.getMapState("cards", _struct(card=StringType), _struct(us=LongType, seq=LongType, op=StringType))
        self.timer = handle.getValueState("timer", _struct(us=LongType))
        self.started: tuple = None, {}  # the key whose initial state was read last, and its cards

    def _wake_at(self, us: int) -> None:
        """A timer just after a change."""
        self.timer.update((us,))
        self.handle.registerTimer(us // 1000 + 1)

    def handleInitialState(self, key, initialState: Row, timerValues) -> None:
        if self.started[0] != key:
            self.started = key, {}
        change = initialState.us, initialState.seq, initialState.op
        self.started[1][initialState.card] = change
        self.cards.updateValue((initialState.card,), change)
        if initialState.op != "mark" and not self.timer.exists():
            self._wake_at(initialState.us)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        newest = self.started[1] if self.started[0] == key else {}
        self.started = None, {}
        changed = set()
        for part in batched(rows, ROWS):
            for _, kind, user_id, card, op, us, seq in sorted(part, key=_order):
                if card not in newest:
                    newest[card] = self.cards.getValue((card,))
                had = newest[card]
                if had is not None and _later(us, seq) <= _later(had[0], had[1]):
                    continue
                newest[card] = us, seq, op
                changed.add(card)
                if op != ("unmark" if had is None else had[2]):
                    yield Row(kind=kind, user_id=user_id, card=card, op=op, us=us, seq=seq)
        unmarked = []
        for card in changed:
            self.cards.updateValue((card,), newest[card])
            if newest[card][2] != "mark":
                unmarked.append(newest[card][0])
        if unmarked and not self.timer.exists():
            self._wake_at(max(unmarked))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        unmarked = [(k, v[0]) for k, v in self.cards.iterator() if v[2] != "mark"]
        for card, us in unmarked:
            if us < passed:
                self.cards.removeKey(card)
        waiting = [us for _, us in unmarked if us >= passed]
        if waiting:
            self._wake_at(max(waiting))
        else:
            self.timer.clear()
        return iter(())

    def close(self) -> None:
        pass


def card_marks(changes: DataFrame, late: str = "1 day", known: DataFrame | None = None) -> DataFrame:
    """Flips (kind, user_id, card, op, ts, seq) of read and favourite marks; repeated marks are no flips.

    ``changes`` is (kind, user_id, card, op, ts, seq), in any order within ``late``; a refreshed card sends
    ``unmark``. ``known`` holds stored changes to start from. The flip with the largest (ts, seq) of a card is its
    state.
    """
    shape = ["kind", "user_id", "card", "op", "us", "seq"]
    timed = lambda df: df.withColumn("us", F.unix_micros("ts")).withColumn("seq", F.col("seq").cast("long"))
    start = None
    if known is not None:
        newest = timed(known).groupBy("kind", "user_id", "card").agg(F.max_by(F.struct("op", "us", "seq"), F.struct("us", "seq")).alias("n"))
        start = newest.select("kind", "user_id", "card", "n.op", "n.us", "n.seq").groupBy("kind", "user_id")
    flips = timed(changes).select("ts", *shape).withWatermark("ts", late).groupBy("kind", "user_id").transformWithState(
        statefulProcessor=CardMarks(), outputStructType=_struct(kind=StringType, user_id=StringType, card=StringType, op=StringType, us=LongType, seq=LongType),
        outputMode="Append", timeMode="EventTime", initialState=start,
    )
    return flips.select("kind", "user_id", "card", "op", F.timestamp_micros("us").alias("ts"), "seq")
