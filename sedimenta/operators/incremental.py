"""Incremental windows: date extraction, inclusive filters, watermarks and their compare-and-set commit."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, timezone

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedimenta.errors import MissingDateFieldError, MissingStateStoreError
from sedimenta.functions.paths import json_path
from sedimenta.functions.values import parse_date


@dataclass(frozen=True)
class Watermark:
    last_run_at: datetime
    last_data_date: date | None = None
    cursor_value: str | None = None


@dataclass(frozen=True)
class IncrementalWindow:
    """Both ends inclusive; ``start`` None reads from the beginning."""

    start: date | None
    end: date
    watermark_before: Watermark | None = None


def as_date(value: date | str | None) -> date | None:
    if value is None or isinstance(value, date):
        return value
    try:
        return date.fromisoformat(value)
    except ValueError:
        raise ValueError("a date or YYYY-MM-DD is needed") from None


class IncrementalStrategy:
    """Resolves the next window from the stored watermark and moves it after a safe write.

    ``mode``: ``data_date`` continues at the largest date seen, ``ingestion_date`` at the day of
    the last run. The boundary day is read again by design. An empty data_date window moves the
    watermark to the window's end."""

    def __init__(self, store, key: str, mode: str = "data_date", initial_start: date | str | None = None):
        if mode not in ("data_date", "ingestion_date"):
            raise ValueError(f"unknown incremental mode {mode!r}")
        self.store, self.key, self.mode, self.initial_start = store, key, mode, as_date(initial_start)

    def resolve_window(self, end: date | str = "today") -> IncrementalWindow:
        last = date.today() if end == "today" else as_date(end)
        if self.store is None:
            raise MissingStateStoreError(f"the increment of {self.key!r} has no state store: give one, or a destination")
        seen = self.store.get(self.key)
        if seen is None:
            start = self.initial_start
        else:
            start = seen.last_data_date if self.mode == "data_date" else seen.last_run_at.date()
        return IncrementalWindow(start, last, seen)

    def commit(self, window: IncrementalWindow, max_data_date: date | None = None) -> Watermark:
        data = (max_data_date or window.end) if self.mode == "data_date" else None
        new = Watermark(datetime.now(timezone.utc), data)
        self.store.compare_and_set(self.key, window.watermark_before, new)
        return new


class NoIncrementalStrategy(IncrementalStrategy):
    """Always everything; keeps no state."""

    def __init__(self):
        super().__init__(None, "none")

    def resolve_window(self, end: date | str = "today") -> IncrementalWindow:
        return IncrementalWindow(None, date.today() if end == "today" else as_date(end))

    def commit(self, window, max_data_date=None) -> None:
        return None


def date_of(field: str, raw: str | None = None) -> Column:
    """Date at a dotted field: of a JSON text column ``raw``, else of the column itself."""
    if not field:
        raise MissingDateFieldError("a date field is needed")
    return parse_date(json_path(F.col(f"`{raw}`"), tuple(field.split("."))) if raw else F.col(field))


def filter_window(df: DataFrame, day: Column, window: IncrementalWindow, strict: bool = True) -> DataFrame:
    """Rows whose date lies in the window. Without a valid date a row fails the job (strict) or is
    dropped; the predicate is plain, so a date column of a table is pushed to its scan."""
    keep = day <= F.lit(window.end)
    if window.start is not None:
        keep = keep & (day >= F.lit(window.start))
    if strict:
        keep = F.when(day.isNull(), F.raise_error(F.lit("MissingDateFieldError: a record has no valid date")).cast("boolean")).otherwise(keep)
    return df.filter(keep)


def date_progress(df: DataFrame, day: Column) -> DataFrame:
    """One row: the largest date and the records without a valid one."""
    return df.agg(F.max(day).alias("max_data_date"), F.count_if(day.isNull()).alias("invalid_dates"))


#: Words that switch increments off.
NO_INCREMENT = ("none", "off", "false", "no", "")
_INTENT = {"field", "date_field", "mode", "start", "initial_start", "key", "state"}


def incremental_intent(wanted, name: str, date_field=None, state=None) -> tuple[IncrementalStrategy | None, object]:
    """(strategy or None, date field) of the short forms of an incremental wish.

    None, False and words such as "off": none. True: by data date (``date_field`` is needed). A mode
    name: that mode; any other text is the date field of a data_date increment. A mapping takes
    field, mode, start, key and state. A strategy is taken as it is. Without a state store the
    strategy waits for one (``store`` None): the destination the flow ends in gives it."""
    if wanted is None or wanted is False or (isinstance(wanted, str) and wanted.strip().lower() in NO_INCREMENT):
        return None, date_field
    if isinstance(wanted, IncrementalStrategy):
        return wanted, date_field
    if wanted is True:
        wanted = {"mode": "data_date"}
    elif isinstance(wanted, str):
        wanted = {"mode": wanted} if wanted in ("data_date", "ingestion_date") else {"field": wanted}
    if not isinstance(wanted, dict) or set(wanted) - _INTENT:
        raise TypeError(f"incremental takes a strategy, a text, a bool or a mapping of {', '.join(sorted(_INTENT))}")
    field = wanted.get("field") or wanted.get("date_field") or date_field
    strategy = IncrementalStrategy(wanted.get("state") or state, wanted.get("key") or name, wanted.get("mode") or "data_date", wanted.get("start") or wanted.get("initial_start"))
    return strategy, field
