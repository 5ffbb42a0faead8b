"""Web addresses in one form, relative ones resolved."""

from __future__ import annotations

from functools import lru_cache
from urllib.parse import parse_qsl, quote, urlencode, urljoin, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Parameters that don't change a page, besides all that begin with utm_.
TRACKING_NAMES = ("spm", "from", "source", "ref", "fbclid", "gclid")
_PORTS = {"http": "80", "https": "443"}


@lru_cache(100_000)
def address(text: str | None, base: str | None = None) -> str:
    """``text`` as an absolute web address; '' where it is none.

    Resolved against ``base``, else given https where it has no scheme; host in lower case, without default port, fragment and
    tracking parameters; blanks and non-ASCII signs of the path percent-encoded.
    """
    value = (text or "").strip()
    if not value:
        return ""
    try:
        if base:
            value = urljoin(base, value)
        elif ":" not in value.split("/")[0].split(".")[0]:
            value = "https://" + value.lstrip("/")
        parts = urlsplit(value)
        if parts.scheme.lower() not in _PORTS or not parts.hostname:
            return ""
        host = parts.hostname.encode("idna").decode() if not parts.hostname.isascii() else parts.hostname
        port = str(parts.port) if parts.port else ""
    except (ValueError, UnicodeError):
        return ""
    if port and port != _PORTS[parts.scheme.lower()]:
        host = f"{host}:{port}"
    query = parts.query
    kept = [(k, v) for k, v in parse_qsl(query, keep_blank_values=True) if not (k.lower().startswith("utm_") or k.lower() in TRACKING_NAMES)]
    if len(kept) != len(parse_qsl(query, keep_blank_values=True)):
        query = urlencode(kept)
    return urlunsplit((parts.scheme.lower(), host, quote(parts.path or "/", safe="/%:@!$&'()*+,;=~-._"), query, ""))


@F.pandas_udf(T.StringType())
def resolved(url: pd.Series, base: pd.Series) -> pd.Series:
    """``address`` of a column against a column of bases."""
    return pd.Series([address(u, b) for u, b in zip(url, base)], dtype=object)
