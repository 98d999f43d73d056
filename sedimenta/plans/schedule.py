"""Repeated runs: interval and cron triggers, and a blocking scheduler whose failed runs are seen."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime, timedelta

from sedimenta.errors import ScheduledPipelineError

#: The five fields of a cron line and their bounds (day of week: 0 or 7 is Sunday).
CRON_FIELDS = (("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 7))


@dataclass(frozen=True)
class IntervalTrigger:
    seconds: float

    def __post_init__(self):
        if isinstance(self.seconds, bool) or not self.seconds > 0:
            raise ValueError("an interval is a positive number of seconds")

    def after(self, moment: datetime) -> datetime:
        return moment + timedelta(seconds=self.seconds)


class CronTrigger:
    """``minute hour day month weekday`` with ``*``, lists, ranges and steps. If day and weekday are
    both restricted, either may match, as in cron."""

    def __init__(self, line: str):
        fields = line.split()
        if len(fields) != 5:
            raise ValueError("a cron line has five fields")
        self.line = line
        self.allowed = [self._values(text, *bounds) for text, bounds in zip(fields, CRON_FIELDS)]
        self.any_day, self.any_weekday = fields[2] == "*", fields[4] == "*"

    @staticmethod
    def _values(text: str, name: str, low: int, high: int) -> frozenset[int]:
        out: set[int] = set()
        for part in text.split(","):
            span, _, step = part.partition("/")
            first, _, last = span.partition("-")
            try:
                a = low if span == "*" else int(first)
                b = high if span == "*" or (step and not last) else int(last or first)
                jump = int(step or 1)
            except ValueError:
                raise ValueError(f"bad {name} {part!r} in a cron line") from None
            if not (low <= a <= b <= high) or jump < 1:
                raise ValueError(f"{name} {part!r} is out of bounds")
            out.update(range(a, b + 1, jump))
        return frozenset(v % 7 for v in out) if name == "weekday" else frozenset(out)

    def _matches(self, t: datetime) -> bool:
        minute, hour, day, month, weekday = self.allowed
        by_day, by_weekday = t.day in day, t.isoweekday() % 7 in weekday
        fits = by_day and by_weekday if self.any_day or self.any_weekday else by_day or by_weekday
        return t.minute in minute and t.hour in hour and t.month in month and fits

    def after(self, moment: datetime) -> datetime:
        t = moment.replace(second=0, microsecond=0) + timedelta(minutes=1)
        end = t + timedelta(days=366 * 5)
        while t < end:
            if self._matches(t):
                return t
            # skip whole days that cannot match
            t = t + timedelta(minutes=1) if t.month in self.allowed[3] else (t.replace(hour=0, minute=0) + timedelta(days=1))
        raise ValueError(f"cron line {self.line!r} never matches")


class Scheduler:
    """Runs ``job`` at each moment of ``trigger``. A failed run is kept and, after ``stop_after``
    failures in a row, raised, so that what watches the process sees it."""

    def __init__(self, job: Callable[[], object], trigger, stop_after: int = 1, clock: Callable[[], datetime] = datetime.now, sleep: Callable[[float], None] = time.sleep):
        self.job, self.trigger, self.stop_after, self.clock, self.sleep = job, trigger, stop_after, clock, sleep
        self.results: list[object] = []

    def run(self, times: int | None = None) -> list[object]:
        failed = 0
        while times is None or len(self.results) < times:
            now = self.clock()
            self.sleep(max(0.0, (self.trigger.after(now) - now).total_seconds()))
            try:
                self.results.append(self.job())
                failed = 0
            except Exception as e:
                self.results.append(e)
                failed += 1
                if failed >= self.stop_after:
                    raise ScheduledPipelineError(f"{failed} runs in a row failed: {e}") from e
        return self.results
