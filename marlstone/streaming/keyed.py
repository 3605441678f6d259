"""Structured Streaming with keyed state and timers: mappings taken from the stream, drained batches, throttled updates, history merged into live.

Each processor holds the state of one key in the state store, so it survives a restart, and a batch of a key is sorted
once. What a key's batch holds is bounded by what a trigger reads. Timers run on event time: they fire once the
watermark has passed them, which is when no row before them can come any more: one that is later than the delay (or at
the epoch itself) is dropped by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions import clock

MS = 1_000_000
_STORE = "spark.sql.streaming.stateStore.providerClass"


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


def _sorted(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    return pd.concat(list(rows)).sort_values(by, kind="stable")


class Bound(StatefulProcessor):
    """By instrument: bars with the market that the last mapping record before them named; bars before any are dropped.

    Rows (instrument_id, at_ns, seq, symbol, contract, close): a row with a symbol is a mapping record, others are bars.
    """

    OUT = "market string, contract string, instrument_id long, at_ns long, seq long, close double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.binding = handle.getValueState("binding", "market string, contract string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        market, contract = self.binding.get() if self.binding.exists() else (None, None)
        was, out = (market, contract), []
        for r in _sorted(rows, ["at_ns", "seq"]).itertuples(index=False):
            if isinstance(r.symbol, str):
                market, contract = r.symbol, r.contract
            elif market is not None:
                out.append((market, contract, key[0], r.at_ns, r.seq, r.close))
        if (market, contract) != was:
            self.binding.update((market, contract))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


class Status(StatefulProcessor):
    """By market: each bar's close with the change in percent from the market's bar before, whatever instrument that was of."""

    OUT = "market string, contract string, instrument_id long, at_ns long, seq long, last double, change double"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.latest = handle.getValueState("latest", "close double, at_ns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was = self.latest.get()[0] if self.latest.exists() else None
        out, at = [], 0
        for r in _sorted(rows, ["at_ns", "seq"]).itertuples(index=False):
            out.append((key[0], r.contract, r.instrument_id, r.at_ns, r.seq, r.close, None if not was else (r.close / was - 1) * 100))
            was, at = r.close, r.at_ns
        self.latest.update((was, at))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


class Stale(StatefulProcessor):
    """By market: LIVE with the first bar of it, and again after silence; STALE once, by a timer, when none has come for ``age_ns``.

    Rows (at_ns, seq). A change is given out with the time at which it holds and that of the last bar.
    """

    OUT = "market string, state string, at_ns long, last_ns long"

    def __init__(self, age_ns: int):
        self.age_ns = age_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "last_ns long, timer_ms long, stale boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        last, timer, stale = self.seen.get() if self.seen.exists() else (None, -1, True)
        out = []
        for at in _sorted(rows, ["at_ns", "seq"])["at_ns"].tolist():
            if not stale and at - last > self.age_ns:  # silence that ended before its timer fired
                out.append((key[0], "STALE", last + self.age_ns, last))
                stale = True
            if stale:
                out.append((key[0], "LIVE", at, at))
            last, stale = at, False
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = (last + self.age_ns) // MS + 1
        self.handle.registerTimer(timer)
        self.seen.update((last, timer, stale))
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        last, _, _ = self.seen.get()
        self.seen.update((last, -1, True))
        yield _frame([(key[0], "STALE", last + self.age_ns, last)], self.OUT)

    def close(self) -> None:
        pass


class Sessions(StatefulProcessor):
    """By market: one observation a session, given out when the next one begins, or by a timer ``idle_ns`` after its last bar.

    Rows (at_ns, seq, session, price_nano). The state is one session: its first and last price, and how many bars. A
    row of an earlier session than the one that is open is out of order, and an error of the stream.
    """

    OUT = "market string, session long, first_nano long, last_nano long, bars long, previous string"

    def __init__(self, idle_ns: int):
        self.idle_ns = idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "session long, first long, last long, bars long, timer_ms long, previous string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        session, first, last, bars, timer, previous = self.now.get() if self.now.exists() else (None, 0, 0, 0, -1, "NONE")
        out, at = [], 0
        for at, own, price in _sorted(rows, ["at_ns", "seq"])[["at_ns", "session", "price_nano"]].itertuples(index=False, name=None):
            if session is not None and own < session:
                raise ValueError(f"{key[0]}: session {own} after {session}")
            if own != session:
                if bars:
                    out.append((key[0], session, first, last, bars, previous))
                    previous = "UP" if last > first else "DOWN" if last < first else "FLAT"
                session, first, bars = own, price, 0
            last, bars = price, bars + 1
        if timer >= 0:
            self.handle.deleteTimer(timer)
        timer = (at + self.idle_ns) // MS + 1
        self.handle.registerTimer(timer)
        self.now.update((session, first, last, bars, timer, previous))
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        session, first, last, bars, _, previous = self.now.get()
        out = [(key[0], session, first, last, bars, previous)] if bars else []
        direction = "UP" if last > first else "DOWN" if last < first else "FLAT"
        self.now.update((session, first, last, 0, -1, direction if bars else previous))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


class Drain(StatefulProcessor):
    """By market: records held until ``most`` of them are there, or none comes for ``idle_ns``; a batch is given out whole.

    Rows (at_ns, seq). The records stand in list state; one timer a key ends an idle batch.
    """

    OUT = "market string, batch long, seq long, place int, closed string"

    def __init__(self, most: int, idle_ns: int):
        self.most, self.idle_ns = most, idle_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "seq long")
        self.mark = handle.getValueState("mark", "batch long, last_ns long, timer_ms long")

    def _timer(self, was: int, last_ns: int) -> int:
        """One timer, at the first millisecond after the idle time."""
        now = (last_ns + self.idle_ns) // MS + 1 if last_ns >= 0 else -1
        if now != was:
            if was >= 0:
                self.handle.deleteTimer(was)
            if now >= 0:
                self.handle.registerTimer(now)
        return now

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch, last, timer = self.mark.get() if self.mark.exists() else (0, -1, -1)
        held, out = [r[0] for r in self.held.get()], []

        def give(why: str) -> None:
            nonlocal batch, held
            out.extend((key[0], batch, seq, place, why) for place, seq in enumerate(held))
            batch, held = batch + 1, []

        for at, seq in _sorted(rows, ["at_ns", "seq"])[["at_ns", "seq"]].itertuples(index=False, name=None):
            if held and at - last > self.idle_ns:
                give("IDLE")
            held.append(seq)
            last = at
            if len(held) == self.most:
                give("FULL")
        self.held.put([(s,) for s in held]) if held else self.held.clear()
        self.mark.update((batch, last, self._timer(timer, last if held else -1)))
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        batch, last, _ = self.mark.get()
        out = [(key[0], batch, r[0], place, "IDLE") for place, r in enumerate(self.held.get())]
        self.held.clear()
        self.mark.update((batch + bool(out), last, -1))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


class Throttle(StatefulProcessor):
    """By market: of each interval the last update, once, with the number of those that it stands for.

    Rows (at_ns, seq, price_nano). It is given out with the first row of a later interval or by the interval's timer.
    """

    OUT = "market string, slot long, price_nano long, updates long"

    def __init__(self, interval_ns: int):
        self.interval_ns = interval_ns

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.now = handle.getValueState("now", "slot long, price_nano long, updates long")

    def _end(self, slot: int) -> int:
        return -(-(slot + 1) * self.interval_ns // MS)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        slot, price, n = self.now.get() if self.now.exists() else (None, 0, 0)
        was, out = slot, []
        for at, value in _sorted(rows, ["at_ns", "seq"])[["at_ns", "price_nano"]].itertuples(index=False, name=None):
            own = at // self.interval_ns
            if slot is not None and own != slot:
                out.append((key[0], slot, price, n))
                n = 0
            slot, price, n = own, value, n + 1
        self.now.update((slot, price, n))
        if slot != was:
            if was is not None:
                self.handle.deleteTimer(self._end(was))
            self.handle.registerTimer(self._end(slot))
        yield _frame(out, self.OUT)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        out = [(key[0], *self.now.get())] if self.now.exists() else []
        self.now.clear()
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


class Merge(StatefulProcessor):
    """By instrument: bars of history merged into live ones, each change given out once.

    Rows (seq, kind, at_ns, value, until_ns). ``LIVE`` bars are given out unless history has that time; a ``HISTORY``
    bar before its chunk's ``until_ns`` fills a gap or replaces what is there, and the same bar again changes nothing.
    ``COMPLETED`` moves the instrument's watermark to until_ns: what is before it is settled, leaves the state, and
    neither live nor history touches it any more.
    """

    OUT = "instrument long, at_ns long, value long, source string, change string, seq long"

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.bars = handle.getMapState("bars", "at_ns long", "value long, source string")
        self.watermark = handle.getValueState("watermark", "until_ns long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        until = self.watermark.get()[0] if self.watermark.exists() else None
        was, out = until, []
        for r in _sorted(rows, ["seq"]).itertuples(index=False):
            if r.kind == "COMPLETED":
                until = int(r.until_ns) if until is None else max(until, int(r.until_ns))
                for (at,) in [k for k in self.bars.keys() if k[0] < until]:
                    self.bars.removeKey((at,))
                continue
            at, value = int(r.at_ns), int(r.value)
            if (until is not None and at < until) or (r.kind == "HISTORY" and at >= r.until_ns):
                continue
            known = self.bars.getValue((at,))
            if known is not None and (tuple(known) == (value, r.kind) or (known[1] == "HISTORY" and r.kind == "LIVE")):
                continue
            self.bars.updateValue((at,), (value, r.kind))
            out.append((key[0], at, value, r.kind, "NEW" if known is None else "REPLACED", r.seq))
        if until != was:
            self.watermark.update((until,))
        yield _frame(out, self.OUT)

    def close(self) -> None:
        pass


def stateful(stream: DataFrame, key: str, processor: StatefulProcessor, event_time: str | None = None) -> DataFrame:
    """``stream`` through a processor by ``key``; with ``event_time``, a watermarked column, its timers run."""
    return stream.groupBy(key).transformWithStateInPandas(processor, processor.OUT, "append", "EventTime" if event_time else "None")


def overview(stream: DataFrame) -> DataFrame:
    """Status of every market from one stream of mapping records and bars (instrument_id, at_ns, seq, symbol, contract, close)."""
    return stateful(stateful(stream, "instrument_id", Bound()), "market", Status())


def _timed(stream: DataFrame, delay: str) -> DataFrame:
    return stream.withColumn("at", clock.ts("at_ns")).withWatermark("at", delay)


def drained(stream: DataFrame, most: int, idle_ns: int, delay: str = "1 second") -> DataFrame:
    """Records (market, at_ns, seq) in batches of ``most``, or fewer where none came for ``idle_ns``."""
    return stateful(_timed(stream, delay), "market", Drain(most, idle_ns), "at")


def throttled(stream: DataFrame, interval_ns: int, delay: str = "1 second") -> DataFrame:
    """The last of the updates (market, at_ns, seq, price_nano) in each interval."""
    return stateful(_timed(stream, delay), "market", Throttle(interval_ns), "at")


def staleness(stream: DataFrame, age_ns: int, delay: str = "1 second") -> DataFrame:
    """When markets (market, at_ns, seq) went live and stale."""
    return stateful(_timed(stream, delay), "market", Stale(age_ns), "at")


def sessions(stream: DataFrame, idle_ns: int, delay: str = "1 second") -> DataFrame:
    """One observation of each market's session, with the direction of the session before, from (market, at_ns, seq, session, price_nano)."""
    return stateful(_timed(stream, delay), "market", Sessions(idle_ns), "at")


def merged(stream: DataFrame) -> DataFrame:
    """Changes of every instrument's bars from live and history records (instrument, seq, kind, at_ns, value, until_ns)."""
    return stateful(stream, "instrument", Merge())


def run(stream: DataFrame, out: str, checkpoint: str, schema: str) -> DataFrame:
    """Work off all that is there, from where ``checkpoint`` stands, and all that any run wrote to ``out`` so far.

    Each batch is written under its number, so one that is given again replaces itself. The state stands in a store on
    disk that is saved with the checkpoint.
    """
    spark: SparkSession = stream.sparkSession
    spark.createDataFrame([], schema).write.mode("append").parquet(f"{out}/batch_no=-1")  # there may be no batch at all
    was = spark.conf.get(_STORE)
    spark.conf.set(_STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

    def sink(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch_no={number}")

    try:
        stream.writeStream.outputMode("append").foreachBatch(sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_STORE, was)
    return spark.read.schema(f"{schema}, batch_no int").parquet(out).drop("batch_no")
