"""Debounced firings of a stream of events: keyed state and timers."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

_BURST = "first long, last long, n long, fired long, timer long"
_MICROS = 1_000_000


@dataclass(frozen=True)
class Waits:
    """Microseconds: a burst fires once `quiet` has passed without an event, after `most` from its first event at the latest, and not before `least` after the firing before."""

    quiet: int
    most: int
    least: int = 0

    @classmethod
    def seconds(cls, quiet: float, most: float, least: float = 0.0) -> Waits:
        if not (quiet > 0 and most >= quiet and least >= 0):
            raise ValueError("waits are 0 < quiet <= most and least >= 0")
        return cls(*(round(x * _MICROS) for x in (quiet, most, least)))

    def due(self, first: int, last: int, fired: int | None) -> int:
        at = min(last + self.quiet, first + self.most)
        return at if fired is None else max(at, fired + self.least)


def _millis(at: int) -> int:
    """A timer's milliseconds, the next after the moment."""
    return -(-at // 1000)


class Debounce(StatefulProcessor):
    """Of each key the burst that is pending (first and last event, how many), when the one before fired, and the timer that stands at the moment when the burst is due.

    All are one value, read once and written once for a key's events of a batch, however many firings they make.
    """

    def __init__(self, key: str, waits: Waits, by_event_time: bool):
        self.key, self.waits, self.by_event_time = key, waits, by_event_time

    def init(self, handle) -> None:
        self.handle = handle
        self.burst = handle.getValueState("burst", _BURST)

    def _read(self) -> tuple[tuple[int, int, int] | None, int | None, int | None]:
        """The pending burst, the firing before it and the timer's milliseconds."""
        held = self.burst.get()
        if held is None:
            return None, None, None
        return (None if held[0] is None else tuple(held[:3])), held[3], held[4]

    def _firing(self, key, pending: tuple[int, int, int], due: int) -> Row:
        return Row(**{self.key: key[0], "first_us": pending[0], "fired_us": due, "n": pending[2]})

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        """Take in events in order of their time; what was due before the next one fires first."""
        now = None if self.by_event_time else timerValues.getCurrentProcessingTimeInMs() * 1000
        pending, fired, timer = self._read()
        for at in sorted(row["at"] for row in rows) if self.by_event_time else (now for _ in rows):
            if pending is not None and at > (due := self.waits.due(pending[0], pending[1], fired)):
                yield self._firing(key, pending, due)
                pending, fired = None, due
            pending = (at, at, 1) if pending is None else (min(pending[0], at), max(pending[1], at), pending[2] + 1)
        due = _millis(self.waits.due(pending[0], pending[1], fired))
        self.burst.update((*pending, fired, due))
        if due != timer:
            if timer is not None:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(due)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        """Fire what is due; a timer that an event has put off meanwhile has been replaced by a later one."""
        pending, fired, _ = self._read()
        if pending is not None and _millis(due := self.waits.due(pending[0], pending[1], fired)) <= expiredTimerInfo.getExpiryTimeInMs():
            self.burst.update((None, None, None, due, None))
            yield self._firing(key, pending, due)

    def close(self) -> None:
        pass


def debounced(events: DataFrame, key: str, when: str, waits: Waits, late: str | None = None) -> DataFrame:
    """(key, first_us, fired_us, n): for each firing of a key the first event of its burst, when it fires, both in microseconds, and how many events it stands for.

    events is a stream. With `late`, times are those of the events: a burst fires when the watermark, the latest time seen less `late`, has passed the moment; events later than that are left out, and so are
    those without key or time. Each event counts in one firing. Events of a key are taken in order within a batch; over batches, one that is older than a firing opens a burst of its own. Without `late`, times are those of the
    clock at which events are taken in, and `when` isn't read. A task holds the times of one key's events of one batch. The state needs
    Spark's RocksDB provider (`spark.sql.streaming.stateStore.providerClass`).
    """
    given = events.where(F.col(key).isNotNull() & F.col(when).isNotNull()) if late else events.where(F.col(key).isNotNull())
    moment = F.col(when).cast("timestamp") if late else F.current_timestamp()
    rows = given.select(key, moment.alias("_ts"), F.unix_micros(moment).alias("at"))
    rows = rows.withWatermark("_ts", late) if late else rows
    kind = f"{key} {events.schema[key].dataType.simpleString()}, first_us long, fired_us long, n long"
    return rows.groupBy(key).transformWithState(Debounce(key, waits, bool(late)), kind, "Append", "EventTime" if late else "ProcessingTime")
