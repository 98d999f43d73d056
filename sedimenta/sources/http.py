"""The HTTP client of the paged source: safe URLs, bounded retries, redirects and bodies."""

from __future__ import annotations

import ipaddress
import itertools
import json
import time
import urllib.error
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any
from urllib.parse import urlencode, urljoin, urlsplit, urlunsplit

from sedimenta.errors import HttpRequestError, InsecureTlsError, InsecureUrlError, InvalidAuthValueError, InvalidHttpMethodError, ResponseTooLargeError, UnsafeRedirectError, UnsafeUrlError
from sedimenta.sources.body import IN_MEMORY, Spool
from sedimenta.sources.secrets import SecretProvider

#: Fixed values.
MAX_BODY = 64 * 1024 * 1024
MAX_REDIRECTS = 5
TIMEOUT, RETRIES, BACKOFF = 30.0, 3, 0.5
RETRIED = frozenset({429, 500, 502, 503, 504})


@dataclass
class Response:
    """A transport may give the body in chunks; the client makes bytes of it, or a spool if it is long."""

    status: int
    headers: dict[str, str]
    body: bytes | Spool | Iterator[bytes]
    url: str = ""


def url_origin(url: str) -> tuple[str, str, int | None]:
    parts = urlsplit(url)
    return parts.scheme.lower(), (parts.hostname or "").lower(), parts.port or {"https": 443, "http": 80}.get(parts.scheme.lower())


def safe_target(url: str) -> str:
    """URL without user info and query values."""
    try:
        parts = urlsplit(url)
        host = parts.hostname or ""
        host = f"[{host}]" if ":" in host else host
        where = host + (f":{parts.port}" if parts.port is not None else "")
        return f"{parts.scheme}://{where}{parts.path}" + ("?<redacted>" if parts.query else "")
    except (TypeError, ValueError):
        return "<invalid-url>"


def check_url(url: str, allow_http: bool = False) -> None:
    """https, no user info, a host, and no literal address that is never an API (link-local and
    metadata, multicast, unspecified, reserved; private networks are allowed)."""
    parts = urlsplit(url)
    if parts.scheme not in ("https", "http") or not parts.hostname:
        raise UnsafeUrlError(f"{safe_target(url)} is no absolute http(s) URL")
    if parts.scheme == "http" and not allow_http:
        raise InsecureUrlError(f"{safe_target(url)} is not https")
    if parts.username or parts.password:
        raise UnsafeUrlError("a URL may not hold credentials")
    try:
        address = ipaddress.ip_address(parts.hostname.partition("%")[0])
    except ValueError:
        return
    address = getattr(address, "ipv4_mapped", None) or address
    if address.is_link_local or address.is_multicast or address.is_unspecified or address.is_reserved:
        raise UnsafeUrlError(f"{safe_target(url)} is a blocked address")


def _header_text(value: str) -> str:
    if not isinstance(value, str) or not value or any(ord(c) < 32 or ord(c) > 255 or ord(c) == 127 for c in value):
        raise InvalidAuthValueError("a credential holds characters no header may carry")
    return value


@dataclass(frozen=True)
class Auth:
    """``none``, ``bearer`` or ``api_key`` (in a header or the query) by secret name. Only the name
    is kept, shown and compared."""

    kind: str = "none"
    secret: str | None = None
    name: str = "X-API-Key"
    where: str = "header"

    def apply(self, secrets: SecretProvider | None, headers: dict, params: dict) -> None:
        if self.kind == "none":
            return
        if secrets is None or not self.secret:
            raise InvalidAuthValueError("this source needs a secret")
        value = _header_text(secrets.get(self.secret))
        if self.kind == "bearer":
            headers["Authorization"] = f"Bearer {value}"
        elif self.where == "query":
            params[self.name] = value
        else:
            headers[_header_text(self.name)] = value

    @property
    def identity(self) -> dict[str, str | None]:
        return {"kind": self.kind, "secret": self.secret, "name": self.name, "where": self.where}


def resolve_auth(value: Auth | str | dict | None) -> Auth:
    """None, ``bearer:NAME``, ``api_key:NAME`` or a mapping with ``type`` and ``secret_key``."""
    if isinstance(value, Auth):
        return value
    if value is None:
        return Auth()
    if isinstance(value, str):
        kind, _, secret = value.partition(":")
        value = {"type": kind, "secret_key": secret}
    kind = str(value.get("type", "none")).strip().lower()
    if kind not in ("none", "bearer", "api_key"):
        raise ValueError(f"unknown auth type {kind!r}")
    secret = value.get("secret_key")
    if kind != "none" and not secret:
        raise ValueError(f"auth {kind} needs secret_key")
    return Auth(kind, secret or None, value.get("name", "X-API-Key"), value.get("in", "header"))


Transport = Callable[[str, str, dict, bytes | None, float], Response]


class _NoRedirect(urllib.request.HTTPRedirectHandler):
    def redirect_request(self, *args):
        return None


def _chunks(r) -> Iterator[bytes]:
    with r:
        while chunk := r.read(1024 * 1024):
            yield chunk


def _urllib_transport(method: str, url: str, headers: dict, body: bytes | None, timeout: float) -> Response:
    opener = urllib.request.build_opener(_NoRedirect)
    request = urllib.request.Request(url, data=body, headers=headers, method=method)
    try:
        r = opener.open(request, timeout=timeout)
        return Response(r.status, dict(r.headers), _chunks(r), url)
    except urllib.error.HTTPError as e:
        return Response(e.code, dict(e.headers or {}), e.read(MAX_BODY + 1), url)


@dataclass
class HttpClient:
    """GET and POST with ``transport`` (tests give their own). POST is retried only if told to.
    ``max_body``: bytes a body may have, None for any size."""

    auth: Auth = field(default_factory=Auth)
    secrets: SecretProvider | None = None
    transport: Transport = _urllib_transport
    timeout: float = TIMEOUT
    retries: int = RETRIES
    backoff: float = BACKOFF
    retry_post: bool = False
    allow_http: bool = False
    verify_tls: bool = True
    max_body: int | None = MAX_BODY

    def __post_init__(self):
        if self.max_body is not None and self.max_body <= 0:
            raise ValueError("max_body is positive")
        if not self.verify_tls:
            raise InsecureTlsError("TLS verification cannot be switched off")

    def request(self, method: str, url: str, params: dict[str, Any] | None = None, json_body: Any = None, headers: dict[str, str] | None = None) -> Response:
        method = method.upper()
        if method not in ("GET", "POST"):
            raise InvalidHttpMethodError(f"method {method!r} is neither GET nor POST")
        sent, query = {"Accept": "application/json", **(headers or {})}, dict(params or {})
        self.auth.apply(self.secrets, sent, query)
        body = None
        if json_body is not None:
            body = json.dumps(json_body, ensure_ascii=False, default=str).encode()
            sent["Content-Type"] = "application/json"
        parts = urlsplit(url)
        text = "&".join(x for x in (parts.query, urlencode(query, doseq=True)) if x)
        target = urlunsplit(parts._replace(query=text, fragment=""))
        for hop in range(MAX_REDIRECTS + 1):
            check_url(target, self.allow_http)
            response = self._attempts(method, target, sent, body)
            place = next((v for k, v in response.headers.items() if k.lower() == "location"), None)
            if response.status not in (301, 302, 303, 307, 308) or not place:
                break
            following = urljoin(target, place)
            if url_origin(following) != url_origin(target):
                raise UnsafeRedirectError(f"{safe_target(target)} redirects to another origin")
            target = following
            if response.status == 303 or (method == "POST" and response.status in (301, 302)):
                # the answer lies elsewhere: ask for it, without the body
                method, body = "GET", None
                sent.pop("Content-Type", None)
        else:
            raise UnsafeRedirectError(f"{safe_target(url)} redirects more than {MAX_REDIRECTS} times")
        if response.status >= 400:
            raise HttpRequestError(f"{method} {safe_target(target)} answered {response.status}")
        return response

    def _attempts(self, method: str, target: str, headers: dict, body: bytes | None) -> Response:
        tries = self.retries if method == "GET" or self.retry_post else 0
        for n in range(tries + 1):
            try:
                response = self.transport(method, target, headers, body, self.timeout)
                response.body = self._whole(response.body, target)
            except (OSError, TimeoutError) as e:
                if n == tries:
                    raise HttpRequestError(f"{method} {safe_target(target)} failed: {type(e).__name__}") from None
            else:
                if response.status not in RETRIED or n == tries:
                    return response
            time.sleep(self.backoff * 2**n)
        raise AssertionError("unreachable")

    def _whole(self, body: bytes | Iterator[bytes], target: str) -> bytes | Spool:
        """The body, all of it: in memory while it is short."""
        chunks, size = iter([body] if isinstance(body, (bytes, bytearray)) else body), 0

        def counted() -> Iterator[bytes]:
            nonlocal size
            for chunk in chunks:
                size += len(chunk)
                if self.max_body is not None and size > self.max_body:
                    raise ResponseTooLargeError(f"{safe_target(target)} answered more than {self.max_body} bytes")
                yield chunk

        head, rest = [], counted()
        for chunk in rest:
            head.append(chunk)
            if size > IN_MEMORY:
                return Spool(itertools.chain(head, rest))
        return b"".join(head)
