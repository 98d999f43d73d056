"""Paged JSON sources as DataFrames: a serial Python data source whose pages are staged once."""

import json
import re
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import date
from itertools import islice
from typing import Any
from urllib.parse import urljoin

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from sedimenta.errors import CrossOriginPaginationError, DeduplicationError, InvalidExtractionBatchSizeError, InvalidHttpMethodError, MissingDateFieldError, PaginationLimitError, PaginationLoopError
from sedimenta.functions.paths import json_path, parse_path, read_path, resolve_select
from sedimenta.functions.values import parse_date
from sedimenta.operators import dedup, incremental, report
from sedimenta.operators.incremental import IncrementalStrategy, IncrementalWindow, NoIncrementalStrategy, incremental_intent
from sedimenta.session import drop, staged
from sedimenta.sinks.state import StateStore
from sedimenta.sources.base import Source
from sedimenta.sources.body import LongList, Spool, decode, is_list
from sedimenta.sources.http import HttpClient, resolve_auth, url_origin
from sedimenta.sources.pagination import Page, Pagination, Request, resolve_pagination

#: Names of record lists that are preferred, and how deep a list is looked for.
LIST_NAMES = {"data": 0, "results": 0, "items": 0, "records": 0, "value": 1}
OTHER_NAME = 10
MAX_DEPTH = 4
MAX_PAGES = 10_000
BATCH = 25_000
READ_ROWS = 2_000
#: Bytes of a row group of staged pages: one task writes them, many read them. Characters of records
#: that come to the driver as one row.
PAGE_GROUP = 4 * 1024 * 1024
PACK = 256 * 1024
#: Day texts a reader remembers.
MOST_DAYS = 100_000
MAX_UNIQUE_KEYS = dedup.MAX_UNIQUE_KEYS


def find_records_path(body: dict) -> str | None:
    """The dotted path of the record list in an object body: lists of objects (or empty ones) under
    at most four keys, by preferred name, then depth; None if there is none, ValueError if two rank alike."""
    ranked, level = [], [((), body)]
    for depth in range(MAX_DEPTH):
        below = []
        for path, node in level:
            for key, value in node.items():
                if type(value) is dict:
                    below.append(((*path, str(key)), value))
                elif value.objects if isinstance(value, LongList) else type(value) is list and all(type(x) is dict for x in value):
                    ranked.append((LIST_NAMES.get(str(key).lower(), OTHER_NAME), depth, ".".join((*path, str(key)))))
        level = below
    ranked.sort()
    if not ranked:
        return None
    if len(ranked) > 1 and ranked[0][:2] == ranked[1][:2]:
        raise ValueError(f"ambiguous record list; name one of {', '.join(p for *_, p in ranked[:8])}")
    return ranked[0][2]


@dataclass
class Endpoint:
    """What one source is asked, resolved once. Picklable: it travels to the reading task; secrets
    stay names until the request is made."""

    url: str
    method: str = "GET"
    params: dict[str, Any] = field(default_factory=dict)
    records: str | Callable[[Any], list] | None = None
    pagination: Pagination | str | dict | bool | None = None
    client: HttpClient = field(default_factory=HttpClient)
    start_param: str | None = None
    end_param: str | None = None
    date_format: str = "%Y-%m-%d"
    max_pages: int = MAX_PAGES
    allow_cross_origin: bool = False

    def __post_init__(self):
        self.method = self.method.upper()
        if self.method not in ("GET", "POST"):
            raise InvalidHttpMethodError(f"method {self.method!r} is neither GET nor POST")
        self.pagination = resolve_pagination(self.pagination)
        self.list_path: str | None = None
        if isinstance(self.records, str):
            parse_path(self.records)

    def pages(self, window: IncrementalWindow | None = None, max_pages: int | None = None) -> Iterator[tuple[Page, int, float]]:
        """(page, status, seconds) until the strategy ends. Each request must be new, each next URL of
        the same origin, and there are at most ``max_pages``."""
        self.pagination.reset()
        self.list_path = None
        request, seen = self.pagination.first(), set()
        limit = max_pages or self.max_pages
        for n in range(limit + 1):
            if n == limit:
                if max_pages:
                    return
                raise PaginationLimitError(f"more than {limit} pages")
            url = urljoin(self.url, request.url) if request.url else self.url
            state = (url, json.dumps(request.params, sort_keys=True, default=str))
            if state in seen:
                raise PaginationLoopError("a request came back: the pagination loops")
            seen.add(state)
            if not self.allow_cross_origin and url_origin(url) != url_origin(self.url):
                raise CrossOriginPaginationError("the next page lies on another origin")
            began = time.monotonic()
            response = self._ask(url, request, window)
            page = self._page(response)
            yield page, response.status, time.monotonic() - began
            following = self.pagination.after(page, request)
            if following is None:
                return
            request = following

    def _ask(self, url: str, request: Request, window: IncrementalWindow | None):
        # a next URL carries its own query
        params = {} if request.url else {**self.params, **request.params}
        if window and not request.url:
            if self.start_param and window.start:
                params[self.start_param] = window.start.strftime(self.date_format)
            if self.end_param:
                params[self.end_param] = window.end.strftime(self.date_format)
        if self.method == "POST":
            return self.client.request("POST", url, json_body=params)
        return self.client.request("GET", url, params)

    def _page(self, response) -> Page:
        if response.status in (204, 205) or not (isinstance(response.body, Spool) or response.body.strip()):
            return Page(None, [], response.headers)
        raw = decode(response.body)
        return Page(raw, self.items(raw), response.headers)

    def items(self, raw: Any) -> list | LongList:
        """Records of a body, each an object (others as ``{"value": ...}``)."""
        if callable(self.records):
            found = self.records(raw)
        elif self.records:
            found = read_path(raw, parse_path(self.records))
        elif is_list(raw):
            found = raw
        elif isinstance(raw, dict):
            self.list_path = self.list_path or find_records_path(raw)
            found = [raw] if self.list_path is None else read_path(raw, parse_path(self.list_path))
        else:
            found = None
        if not is_list(found):
            raise TypeError("the page holds no record list")
        if isinstance(found, LongList):
            return found.map(_record)
        return [x if isinstance(x, dict) else _record(x) for x in found]


def _record(x: Any) -> dict:
    return x if isinstance(x, dict) else {"value": x}


_DAY = re.compile(r"[0-9]{4}-[0-9]{2}-[0-9]{2}")


def _encoder() -> Callable[[Any], str]:
    """``json.dumps(x, ensure_ascii=False)``, whose encoder is made once, not for each record."""
    c = json.encoder
    if c.c_make_encoder is None:
        return json.JSONEncoder(ensure_ascii=False).encode
    chunks = c.c_make_encoder({}, json.JSONEncoder().default, c.encode_basestring, None, ": ", ", ", False, False, True)
    return lambda x: "".join(chunks(x, 0))


def _texts(records: list[dict], encode: Callable[[Any], str]) -> list[str]:
    """The text of each record. They are encoded at once and parted where one ends and the next begins;
    if other places look like that, one by one."""
    whole = encode(records)[1:-1]
    if whole.count("}, {") == len(records) - 1:
        return whole.replace("}, {", "}\n{").split("\n")  # line ends within texts are escaped
    return [encode(x) for x in records]


def _day_text(record: dict, steps: tuple[str, ...]) -> str | None:
    """What ``parse_date`` casts to a date, of the text at dotted keys."""
    value = read_path(record, steps)
    if type(value) is not str:
        return None
    found = _DAY.match(value) or _DAY.match(value.strip())
    return found.group() if found else None


def _dated(steps: tuple[str, ...], within: IncrementalWindow | None) -> Callable[[list[dict], int], tuple[list[dict], list[int], list[str | None]]]:
    """What picks, of records and the ordinal of the first: the records, their ordinals and their day
    texts, but for records whose valid date lies outside the window."""
    one = steps[0] if len(steps) == 1 else None
    known: dict[str, bool] = {}  # day texts seen so far: are they wanted

    def wanted(text: str | None) -> bool:
        try:
            day = date.fromisoformat(text) if within and text else None
        except ValueError:  # the window takes or refuses it
            return True
        return day is None or ((within.start is None or day >= within.start) and day <= within.end)

    def pick(records: list[dict], first: int):
        out, ordinals, days = [], [], []
        for n, record in enumerate(records, first):
            value = (record.get(one) if type(record) is dict else None) if one else read_path(record, steps)
            text = value[:10] if type(value) is str else None
            keep = known.get(text)
            if keep is None:
                found = _day_text(record, steps)
                keep = wanted(found)
                if found is not None and found == text and len(known) < MOST_DAYS:
                    known[found] = keep
                text = found
            if keep:
                out.append(record)
                ordinals.append(n)
                days.append(text)
        return out, ordinals, days

    return pick


def page_source(endpoint: Endpoint, window: IncrementalWindow | None, max_records: int | None, max_pages: int | None, day: tuple[str, ...] | None = None, within: IncrementalWindow | None = None) -> type[DataSource]:
    """A one-partition data source of (ordinal, raw), with ``day`` of (ordinal, raw, day): the text of
    the date at these keys; ``within``: without the records whose valid date lies outside this window.
    Limits act in the reader, so no page beyond them is asked for."""

    label = "paged_" + uuid.uuid4().hex

    class Reader(DataSourceReader):
        def partitions(self):
            return [InputPartition(0)]

        def read(self, partition):
            n, ordinals, texts, days, encode = 0, [], [], [], _encoder()
            pick = _dated(day, within) if day else None
            for page, _, _ in endpoint.pages(window, max_pages):
                records = iter(page.records if max_records is None else islice(page.records, max_records - n))
                while part := list(islice(records, READ_ROWS)):
                    first, n, at = n, n + len(part), range(n, n + len(part))
                    if pick:
                        part, at, found = pick(part, first)
                        days += found
                    ordinals += at
                    texts += _texts(part, encode)
                    if len(texts) >= READ_ROWS:
                        yield batch(ordinals, texts, days)
                        ordinals, texts, days = [], [], []
                if n == max_records:
                    break
            yield batch(ordinals, texts, days)

    def batch(ordinals: list[int], texts: list[str], days: list[str | None]) -> pa.RecordBatch:
        columns = {"ordinal": pa.array(ordinals, pa.int64()), "raw": pa.array(texts, pa.string())}
        return pa.RecordBatch.from_pydict(columns | ({"day": pa.array(days, pa.string())} if day else {}))

    class PagedSource(DataSource):
        @classmethod
        def name(cls):
            return label

        def schema(self):
            return "ordinal long, raw string" + ", day string" * bool(day)

        def reader(self, schema):
            return Reader()

    return PagedSource


@dataclass
class ProbeResult:
    records: list[dict]
    raw: Any
    headers: dict[str, str]
    records_path: str | None
    pagination: str
    status_code: int
    latency_ms: float
    response_bytes: int


class ExtractionSession:
    """One extraction of one window: read once (staged), committed once, after a full read.

    ``records``: the projected, filtered, deduplicated JSON records (ordinal, raw). Used as a
    context manager it aborts unless committed."""

    def __init__(self, connector: "RestConnector", spark: SparkSession, window: IncrementalWindow):
        self.connector, self.spark, self.window = connector, spark, window
        self.state = "open"
        self.max_data_date: date | None = None
        self.invalid_dates = 0
        self._records: DataFrame | None = None
        self.staged: list[str] = []

    def __enter__(self):
        return self

    def __exit__(self, kind, *_):
        if self.state != "committed":
            self.abort()

    @property
    def records(self) -> DataFrame:
        if self.state == "aborted":
            raise RuntimeError("the session was aborted")
        if self._records is None:
            try:
                self._records = self.connector._extract(self)
            except BaseException:
                self.abort()
                raise
            self.state = "exhausted"
        return self._records

    def batches(self, size: int = BATCH) -> Iterator[list[dict]]:
        """The records as Python objects, ``size`` at a time."""
        if isinstance(size, bool) or not isinstance(size, int) or size < 1:
            raise InvalidExtractionBatchSizeError("a batch size is a positive integer")

        def pack(batches):
            for found in batches:
                held, length = [], 0
                for text in found.column(0).to_pylist():
                    held.append(text)
                    length += len(text)
                    if length >= PACK:
                        yield pa.RecordBatch.from_pydict({"packed": ["[" + ",".join(held) + "]"]})
                        held, length = [], 0
                if held:
                    yield pa.RecordBatch.from_pydict({"packed": ["[" + ",".join(held) + "]"]})

        batch: list[dict] = []
        # a row a record would cost the driver more than its JSON
        for row in self.records.orderBy("ordinal").select("raw").mapInArrow(pack, "packed string").toLocalIterator():
            for record in json.loads(row["packed"]):
                batch.append(record)
                if len(batch) == size:
                    yield batch
                    batch = []
        if batch:
            yield batch

    def commit(self) -> None:
        if self.state == "committed":
            return
        if self.state == "aborted":
            raise RuntimeError("an aborted session cannot be committed")
        if self.state != "exhausted":
            raise RuntimeError("a session is committed only after all its records were read")
        if self.connector.date_field and self.invalid_dates:
            raise RuntimeError(f"{self.invalid_dates} records have no valid date; the checkpoint stays")
        self.connector.incremental.commit(self.window, self.max_data_date)
        self.state = "committed"

    def release(self) -> None:
        """Removes what was staged for the records, once they lie elsewhere: they cannot be read again."""
        drop(self.spark, self.staged)

    def abort(self) -> None:
        if self.state != "committed":
            self.state = "aborted"


@dataclass(frozen=True)
class DateParams:
    """The request parameters that carry the window to the source."""

    start: str
    end: str | None = None
    format: str = "%Y-%m-%d"


class RestConnector(Source):
    """A paged JSON endpoint as a source of records.

    ``select`` projects after filtering; ``primary_key`` with ``dedup=True`` keeps the first record of
    each key after the projection; ``date_field`` drives the client-side window (unless
    ``start_param`` sends it to the source) and the checkpoint."""

    def __init__(self, url: str, name: str | None = None, *, method: str = "GET", params: dict | None = None, records=None, select=None, pagination=None, auth=None, secrets=None, client: HttpClient | None = None, incremental: IncrementalStrategy | str | bool | dict | None = None, date_field: str | Callable[[dict], Any] | None = None, start_param: str | None = None, end_param: str | None = None, date_format: str = "%Y-%m-%d", primary_key=None, dedup: bool = False, record_transform: Callable[[dict], dict] | None = None, max_pages: int = MAX_PAGES, allow_cross_origin: bool = False, date_params: DateParams | dict | str | None = None, state: StateStore | None = None, max_unique_keys: int = MAX_UNIQUE_KEYS):
        if date_params is not None:
            given = DateParams(date_params) if isinstance(date_params, str) else DateParams(**date_params) if isinstance(date_params, dict) else date_params
            start_param, end_param, date_format = given.start, given.end, given.format
        client = client or HttpClient(resolve_auth(auth), secrets)
        self.endpoint = Endpoint(url, method, dict(params or {}), records, pagination, client, start_param, end_param, date_format, max_pages, allow_cross_origin)
        self.name = name or _default_name(url)
        self.select = resolve_select(select) if select else None
        strategy, self.date_field = incremental_intent(incremental, self.name, date_field, state)
        self.incremental = strategy or NoIncrementalStrategy()
        date_field = self.date_field
        self.max_unique_keys = max_unique_keys
        if self.incremental.mode == "data_date" and not isinstance(self.incremental, NoIncrementalStrategy) and not date_field:
            raise MissingDateFieldError("a data_date checkpoint needs date_field")
        self.primary_key = _keys(primary_key)
        self.dedup_enabled = bool(dedup)
        if dedup and not self.primary_key:
            raise ValueError("dedup needs primary_key")
        if dedup and self.select and not set(self.primary_key) <= {a for _, a in self.select}:
            raise ValueError("primary_key must be among the selected aliases")
        self.record_transform = record_transform
        self.current_window: IncrementalWindow | None = None

    # -- reading

    def raw_records(self, spark: SparkSession, window: IncrementalWindow | None = None, max_records: int | None = None, max_pages: int | None = None, day: tuple[str, ...] | None = None, within: IncrementalWindow | None = None, paths: list[str] | None = None) -> DataFrame:
        """(ordinal, raw) of the source, with ``day`` also the text of the date at these keys (``within`` as
        in ``page_source``), staged: later actions and retried tasks never ask it again."""
        source = page_source(self.endpoint, window, max_records, max_pages, day, within)
        spark.dataSource.register(source)
        return staged(spark.read.format(source.name()).load(), "pages", PAGE_GROUP, paths)

    def session(self, spark: SparkSession, end: date | str = "today") -> ExtractionSession:
        self.current_window = self.incremental.resolve_window(end)
        return ExtractionSession(self, spark, self.current_window)

    def _extract(self, session: ExtractionSession) -> DataFrame:
        keys = tuple(self.date_field.split(".")) if isinstance(self.date_field, str) and self.date_field else None
        cut = bool(self.date_field) and not isinstance(self.incremental, NoIncrementalStrategy) and not self.endpoint.start_param
        pages: list[str] = []
        rows = self.raw_records(session.spark, session.window, day=keys, within=session.window if cut else None, paths=pages)
        if self.date_field:
            day = F.col("day").try_cast("date") if keys else parse_date(self._date_text())
            if cut:
                rows = incremental.filter_window(rows, day, session.window)
            seen = incremental.date_progress(rows, day).first()
            session.max_data_date, session.invalid_dates = seen["max_data_date"], seen["invalid_dates"]
        if not (self.select or self.record_transform or self.dedup_enabled) and (keys or not self.date_field):
            session.staged += pages  # the pages hold the records as they are
            return rows.select("ordinal", "raw")
        records = staged(self.shape(rows.select("ordinal", "raw")), "records", paths=session.staged)
        drop(session.spark, pages)
        if self.dedup_enabled and (kept := records.count()) > self.max_unique_keys:
            raise DeduplicationError(f"{kept} distinct keys exceed the limit of {self.max_unique_keys}")
        return records

    def _date_text(self):
        """What a callable date field makes of each record."""
        pick = self.date_field

        @F.pandas_udf("string")
        def text(raw: pd.Series) -> pd.Series:
            found = (pick(json.loads(r)) for r in raw)
            return pd.Series([v.isoformat() if isinstance(v, date) else None if v is None else str(v) for v in found], dtype=object)

        return text(F.col("raw"))

    def shape(self, rows: DataFrame) -> DataFrame:
        """Transform, projection and deduplication of (ordinal, raw), in this order."""
        fields, transform = self.select, self.record_transform
        if fields or transform:

            def change(batches):
                encode = _encoder()
                for batch in batches:
                    out = []
                    for text in batch.column(1).to_pylist():
                        record = json.loads(text)
                        record = transform(record) if transform else record
                        out.append(encode({alias: read_path(record, steps) for steps, alias in fields} if fields else record))
                    yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=["ordinal", "raw"])

            rows = rows.mapInArrow(change, "ordinal long, raw string")
        if not self.dedup_enabled:
            return rows
        paths = [parse_path(k) for k in self.primary_key]

        @F.arrow_udf("boolean")
        def container(raw: pa.Array) -> pa.Array:
            found = (None if r is None else any(type(read_path(json.loads(r), p)) in (dict, list) for p in paths) for r in raw.to_pylist())
            return pa.array(list(found), pa.bool_())

        keyed = rows.withColumns({f"k{i}": json_path(F.col("raw"), p) for i, p in enumerate(paths)})
        # a container is no key; a text may look like one, so such records are looked at
        like = F.coalesce(F.greatest(*[F.col(f"k{i}").rlike(r"^\s*[\[{]") for i in range(len(paths))], F.lit(False)), F.lit(False))
        bad = F.coalesce(container(F.when(like, F.col("raw"))), F.lit(False))
        keyed = keyed.withColumn("bad", bad).withColumns({f"k{i}": F.when(~F.col("bad"), F.col(f"k{i}")) for i in range(len(paths))}).drop("bad")
        names = [f"k{i}" for i in range(len(self.primary_key))]
        return dedup.first_wins(keyed, names, ["ordinal"], strict=True, salts=8).drop(*names)

    def extract(self, spark: SparkSession, end: date | str = "today") -> Iterator[dict]:
        """The older two-step form: the records one by one; ``commit_watermark`` moves the checkpoint
        after they were all read and stored."""
        self._pending = self.session(spark, end)
        for batch in self._pending.batches():
            yield from batch

    def commit_watermark(self) -> None:
        """Commits the last ``extract``."""
        if getattr(self, "_pending", None) is None:
            raise RuntimeError("nothing was extracted")
        self._pending.commit()
        self._pending = None

    def collect(self, spark: SparkSession, end: date | str = "today") -> list[dict]:
        with self.session(spark, end) as s:
            out = [r for batch in s.batches() for r in batch]
            s.commit()
            return out

    def stream(self, spark: SparkSession, end: date | str = "today", batch_size: int = BATCH) -> Iterator[list[dict]]:
        with self.session(spark, end) as s:
            yield from s.batches(batch_size)
            s.commit()

    def probe(self, limit: int = 25) -> ProbeResult:
        """One request, no state: what the source answers and how it would be read."""
        if isinstance(limit, bool) or not isinstance(limit, int) or not 1 <= limit <= 1000:
            raise ValueError("limit is between 1 and 1000")
        page, status, seconds = next(self.endpoint.pages(max_pages=1))
        self.endpoint.pagination.after(page, self.endpoint.pagination.first())
        where = self.endpoint.records if isinstance(self.endpoint.records, str) else self.endpoint.list_path
        size = 0 if page.raw is None else _json_size(page.raw)
        return ProbeResult(page.records[:limit], page.raw, page.headers, where, self.endpoint.pagination.kind, status, seconds * 1000, size)

    preview = probe

    def profile(self, spark: SparkSession, *metrics: str, end: date | str = "today", scope: str = "full", limit: int | None = None, key=None, fields=None) -> report.ProfileReport:
        """Profile native values without moving the checkpoint; metrics are planned before any request."""
        report.resolve_metrics(metrics)
        window = self.incremental.resolve_window(end)
        most = (report.DEFAULT_SAMPLE if limit is None else limit) if scope == "sample" else None
        pages: list[str] = []
        try:
            rows = self.raw_records(spark, window, max_records=most, paths=pages)
            return report.profile_records(rows, *metrics, source=self.name, raw="raw", order="ordinal", key=key or list(self.primary_key) or None, fields=fields, scope=scope, limit=limit)
        finally:
            drop(spark, pages)

    def explain(self) -> dict[str, Any]:
        """What would be read, without reading and without secrets."""
        e = self.endpoint
        return {
            "name": self.name, "url": e.url.partition("?")[0], "method": e.method, "records": e.records if isinstance(e.records, str) or e.records is None else "callable",
            "pagination": e.pagination.kind, "select": {".".join(map(str, s)): a for s, a in self.select} if self.select else None, "primary_key": list(self.primary_key),
            "dedup": self.dedup_enabled, "incremental": self.incremental.mode, "date_field": self.date_field if not callable(self.date_field) else "callable", "auth": e.client.auth.identity,
        }

    def to(self, destination, target: str, **options):
        from sedimenta.plans.pipeline import Flow

        return Flow(self, destination, target, **options)


def _json_size(raw: Any) -> int:
    """Bytes of ``json.dumps``, a long list an element at a time."""
    if isinstance(raw, LongList):
        return 2 + sum(_json_size(x) for x in raw) + 2 * max(0, len(raw) - 1)
    if isinstance(raw, dict) and any(isinstance(v, (dict, LongList)) for v in raw.values()):
        return 2 + sum(len(json.dumps(k, ensure_ascii=False).encode()) + 2 + _json_size(v) for k, v in raw.items()) + 2 * max(0, len(raw) - 1)
    return len(json.dumps(raw, ensure_ascii=False).encode())


def _keys(value) -> tuple[str, ...]:
    return dedup.resolve_primary_key(value)


def _default_name(url: str) -> str:
    import re
    from urllib.parse import urlsplit

    parts = urlsplit(url)
    last = [x for x in parts.path.split("/") if x][-1:] or [(parts.hostname or "api").split(".")[0]]
    name = re.sub(r"[^A-Za-z0-9_]+", "_", last[0]).strip("_").lower() or "api"
    return f"api_{name}" if name[0].isdigit() else name
