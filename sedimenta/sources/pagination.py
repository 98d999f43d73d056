"""How a paged source is walked: each strategy turns the last page into the next request, or ends."""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import Any

from sedimenta.functions.paths import read_path


@dataclass
class Page:
    """One decoded response: ``raw`` body (None for an empty one), its records, its headers."""

    raw: Any
    records: list = field(default_factory=list)
    headers: dict[str, str] = field(default_factory=dict)


@dataclass(frozen=True)
class Request:
    """Parameters of the next call; ``url`` replaces the source's own where a page names one."""

    params: dict[str, Any] = field(default_factory=dict)
    url: str | None = None


def body_value(raw: Any, dotted: str) -> Any:
    """Value at dotted keys (no brackets) of a page body."""
    return read_path(raw, tuple(dotted.split(".")))


def _count(value: Any, name: str, least: int = 1) -> int:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ValueError(f"{name} is an integer of at least {least}")
    return value


class Pagination:
    """``first`` request, then ``after`` each page the next one or None."""

    def first(self) -> Request:
        return Request()

    def after(self, page: Page, last: Request) -> Request | None:
        raise NotImplementedError

    def reset(self) -> None:
        """Called before each extraction."""

    @property
    def kind(self) -> str:
        return type(self).__name__.removesuffix("Pages").lower()


class NoPages(Pagination):
    def after(self, page, last):
        return None

    kind = "none"


class _Counted(Pagination):
    """A counter parameter and a size parameter; an empty page ends, a short one if told to."""

    def __init__(self, param: str, size_param: str, size: int, start: int, step: int, stop_on_short_page: bool):
        self.param, self.size_param, self.size, self.start, self.step = param, size_param, size, start, step
        self.stop_on_short_page = stop_on_short_page

    def first(self):
        return Request({self.param: self.start, self.size_param: self.size})

    def after(self, page, last):
        got = len(page.records)
        if not got or (self.stop_on_short_page and got < self.size):
            return None
        return Request({**last.params, self.param: last.params[self.param] + self.step})


class NumberedPages(_Counted):
    kind = "page"

    def __init__(self, page_param="page", page_size_param="per_page", page_size=100, start_page=1, stop_on_short_page=True):
        super().__init__(page_param, page_size_param, _count(page_size, "page_size"), _count(start_page, "start_page", 0), 1, stop_on_short_page)


class OffsetPages(_Counted):
    kind = "offset"

    def __init__(self, offset_param="offset", limit_param="limit", limit=100, start_offset=0, stop_on_short_page=True):
        super().__init__(offset_param, limit_param, _count(limit, "limit"), _count(start_offset, "start_offset", 0), limit, stop_on_short_page)


class CursorPages(Pagination):
    kind = "cursor"

    def __init__(self, cursor_param="cursor", cursor_field="next_cursor"):
        self.cursor_param, self.cursor_field = cursor_param, cursor_field

    def after(self, page, last):
        cursor = body_value(page.raw, self.cursor_field)
        return None if cursor is None or cursor == "" else Request({self.cursor_param: cursor})


_LINK = re.compile(r"""<(?P<url>[^>]*)>(?P<rest>(?:\s*;\s*[\w*-]+(?:\s*=\s*(?:"[^"]*"|'[^']*'|[^\s;,"']+))?)*)""")
_REL = re.compile(r""";\s*rel\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s;,]+))""", re.IGNORECASE)


class LinkHeaderPages(Pagination):
    kind = "link_header"

    def __init__(self, header_name="Link"):
        self.header_name = header_name

    def after(self, page, last):
        header = next((v for k, v in page.headers.items() if k.lower() == self.header_name.lower()), "")
        for link in _LINK.finditer(header or ""):
            rels = " ".join(x for found in _REL.findall(link["rest"]) for x in found).lower().split()
            if "next" in rels and link["url"]:
                return Request(url=link["url"])
        return None


class NextUrlPages(Pagination):
    kind = "next_url"

    def __init__(self, next_url_field="next"):
        self.next_url_field = next_url_field

    def after(self, page, last):
        url = body_value(page.raw, self.next_url_field)
        return Request(url=url) if isinstance(url, str) and url else None


#: Where automatic pagination looks, in this order.
NEXT_URL_FIELDS = ("next", "next_url", "links.next", "pagination.next", "paging.next")
CURSOR_FIELDS = {
    "next_cursor": "cursor", "nextCursor": "cursor", "meta.next_cursor": "cursor", "pagination.next_cursor": "cursor", "paging.next_cursor": "cursor",
    "continuation_token": "continuation_token", "next_token": "token", "nextPageToken": "pageToken",
}


class AutoPages(Pagination):
    """Decides once an extraction, from its first page: link header, next URL, cursor, none."""

    def __init__(self):
        self.chosen: Pagination | None = None

    def reset(self):
        self.chosen = None

    @property
    def kind(self):
        return self.chosen.kind if self.chosen else "auto"

    def after(self, page, last):
        if self.chosen is None:
            options = [LinkHeaderPages(), *map(NextUrlPages, NEXT_URL_FIELDS), *[CursorPages(p, f) for f, p in CURSOR_FIELDS.items()]]
            self.chosen = next((o for o in options if o.after(page, last)), NoPages())
        return self.chosen.after(page, last)


KINDS = {"none": NoPages, "auto": AutoPages, "page": NumberedPages, "offset": OffsetPages, "cursor": CursorPages, "link_header": LinkHeaderPages, "next_url": NextUrlPages}
#: Other spellings of kinds and of their options.
KIND_ALIASES = {"": "auto", "automatic": "auto", "off": "none", "false": "none", "no": "none", "page_number": "page", "pagenumber": "page", "link": "link_header", "linkheader": "link_header", "next": "next_url", "nexturl": "next_url"}
OPTION_ALIASES = {
    "cursor": {"cursor": "cursor_field", "cursor_path": "cursor_field", "param": "cursor_param"},
    "page": {"size": "page_size", "param": "page_param", "size_param": "page_size_param", "short_page_ends": "stop_on_short_page"},
    "offset": {"size": "limit", "param": "offset_param", "size_param": "limit_param", "short_page_ends": "stop_on_short_page"},
    "next_url": {"field": "next_url_field", "path": "next_url_field"},
    "link_header": {"header": "header_name"},
}


def resolve_pagination(value: Pagination | str | dict | bool | None) -> Pagination:
    """A strategy from a name, a mapping with ``type``, True/None (auto) or False (none). Named page
    and offset strategies go on after a short page unless told otherwise."""
    if isinstance(value, Pagination):
        return value
    if value is None or value is True:
        return AutoPages()
    if value is False:
        return NoPages()
    if not isinstance(value, (str, dict)):
        raise TypeError("pagination is a name, a mapping, a boolean or a strategy")
    options = {} if isinstance(value, str) else {k: v for k, v in value.items() if k != "type"}
    name = value if isinstance(value, str) else str(value.get("type", "auto"))
    kind = re.sub(r"_?pagination$", "", "_".join(re.findall(r"[a-z0-9]+", name.lower())))
    kind = KIND_ALIASES.get(kind, kind)
    if kind not in KINDS:
        raise ValueError(f"unknown pagination {name!r}; there are {', '.join(sorted(KINDS))}")
    for alias, real in OPTION_ALIASES.get(kind, {}).items():
        if alias in options:
            options.setdefault(real, options[alias])
            del options[alias]
    if kind in ("page", "offset"):
        options.setdefault("stop_on_short_page", False)
    try:
        return KINDS[kind](**options)
    except TypeError as e:
        raise ValueError(f"bad options of {kind} pagination: {e}") from None
