"""When a task is due: once, on notice, every so often within a part of the day, or at named minutes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from datetime import datetime


@dataclass(frozen=True)
class Schedule:
    """``mode``: 'once', 'notice', 'gap' (every ``every_ms`` from ``start`` to ``stop``, as hhmm; a stop before the
    start lies behind midnight; equal ones are the whole day) or 'plan' (at ``minutes``, as hhmm)."""

    mode: str
    every_ms: int = 0
    start: int = 0
    stop: int = 0
    minutes: Sequence[int] = ()

    def within(self, now: datetime) -> bool:
        at = now.hour * 100 + now.minute
        if self.start == self.stop:
            return True
        return self.start <= at <= self.stop if self.start < self.stop else at >= self.start or at <= self.stop

    def due(self, now: datetime, last: datetime | None = None, notices: int = 0) -> bool:
        """Whether to run now, ``last`` being the run before, with so many notices since."""
        if self.mode == "once":
            return last is None
        if self.mode == "notice":
            return notices > 0
        if self.mode == "gap":
            return self.within(now) and (last is None or (now - last).total_seconds() * 1000 >= self.every_ms)
        if self.mode == "plan":
            at = now.hour * 100 + now.minute
            return at in self.minutes and (last is None or last.replace(second=0, microsecond=0) != now.replace(second=0, microsecond=0))
        raise ValueError(f"no mode {self.mode!r}")


#: What a subscriber is told, in this order; rows come in between, any number of times.
HANDSHAKE = ("start", "keys", "tables", "wait", "rows", "stop")


def handshake(day: int, keys: str, tables: str, rows: Iterator) -> Iterator[tuple]:
    """The messages of one day's subscription, from its start to its stop."""
    yield from (("start", day), ("keys", keys), ("tables", tables), ("wait", day))
    for x in rows:
        yield "rows", x
    yield "stop", day
