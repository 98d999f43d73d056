"""Text functions over columns: redaction, URL parts, names, number formats."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Credential forms that are cut from human-facing text (text before it is kept).
CREDENTIAL_PATTERNS = (
    r"(?i)(authorization\s*[:=]\s*bearer\s+)[^\s,;]+",
    r"(?i)(bearer\s+)[A-Za-z0-9._~+/=-]{8,}",
    r"(?i)((?:api[_-]?key|access[_-]?token|refresh[_-]?token|client[_-]?secret|password|passwd|account[_-]?key|sas[_-]?token|connection[_-]?string)\s*[:=]\s*)[^\s,;]+",
    r"(?i)(https?://[^\s/?#]+/[^\s?#]*\?)[^\s#]+",
)
REDACTED = "<redacted>"
#: Fixed value: longest text that is shown.
MAX_TEXT = 256 * 1024


def redact(col: Column, known_secrets: tuple[str, ...] = (), limit: int | None = MAX_TEXT) -> Column:
    """Known secrets, then credential forms, replaced; cut at ``limit`` characters with a notice (None: whole)."""
    out = col
    for secret in known_secrets:
        if secret:
            out = F.replace(out, F.lit(secret), F.lit(REDACTED))
    for pattern in CREDENTIAL_PATTERNS:
        out = F.regexp_replace(out, pattern, "$1" + REDACTED)
    return out if limit is None else F.when(F.length(out) > limit, F.concat(F.substring(out, 1, limit), F.lit("\n<output truncated>"))).otherwise(out)


def redact_text(text: object, known_secrets: tuple[str, ...] = ()) -> str:
    """Driver-side twin of ``redact``."""
    out = str(text)
    for secret in known_secrets:
        out = out.replace(secret, REDACTED) if secret else out
    for pattern in CREDENTIAL_PATTERNS:
        out = re.sub(pattern, r"\1" + REDACTED, out)
    return out if len(out) <= MAX_TEXT else out[:MAX_TEXT] + "\n<output truncated>"


def request_target(url: Column) -> Column:
    """Scheme, host, port and path of a URL; user info dropped, a query shown as redacted."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*(:[0-9]+)", 1)
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    query = F.when(F.regexp_extract(url, r"\?([^#]+)", 1) != "", F.lit("?" + REDACTED)).otherwise(F.lit(""))
    return F.concat(scheme, F.lit("://"), host, port, path, query)


def origin(url: Column) -> Column:
    """struct(scheme, host, port) with the scheme's default port."""
    scheme = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1))
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)", 1))
    port = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?[^/?#:@]*:([0-9]+)", 1)
    default = F.when(scheme == "https", 443).when(scheme == "http", 80)
    return F.struct(scheme.alias("scheme"), host.alias("host"), F.coalesce(port.try_cast("int"), default).alias("port"))


def infer_name(url: Column) -> Column:
    """A resource name: the last path segment, else the first host label, with unsafe characters
    as ``_``; ``api_`` before a digit."""
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)", 1)
    last = F.regexp_extract(path, r"([^/]+)/*$", 1)
    label = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@.]*)", 1)
    raw = F.when(last != "", last).otherwise(label)
    name = F.lower(F.regexp_replace(F.regexp_replace(raw, r"[^A-Za-z0-9_]+", "_"), r"^_+|_+$", ""))
    name = F.when(name == "", F.lit("api")).otherwise(name)
    return F.when(name.rlike("^[0-9]"), F.concat(F.lit("api_"), name)).otherwise(name)


def thousands(col: Column) -> Column:
    return F.format_number(col, 0)


def percentage(part: Column, whole: Column) -> Column:
    """``12.5%``; ``0.0%`` of nothing."""
    share = F.when(whole == 0, F.lit(0.0)).otherwise(part * 100.0 / whole)
    return F.concat(F.format_number(share, 1), F.lit("%"))
