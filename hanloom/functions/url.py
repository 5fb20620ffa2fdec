"""URL expressions."""

from __future__ import annotations

import re
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit, urlunsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Parameters that only track the visitor.
TRACKING = r"^(?:utm_.*|fbclid|gclid|yclid)$"
_TRACKING = re.compile(TRACKING)
_SCHEME = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]*://")


def plain_address(url: str | None) -> str | None:
    """Lower scheme and host, no fragment, tracking parameters or trailing slash; https by default; escapes in one spelling."""
    if url is None or not (url := url.strip()):
        return url
    if not _SCHEME.match(url):
        url = "https://" + url  # an address without a scheme begins with its host
    try:
        parts = urlsplit(url)
    except ValueError:
        return url
    path = quote(unquote(parts.path).rstrip("/"), safe="/:%")
    kept = [(k, v) for k, v in parse_qsl(parts.query, keep_blank_values=True) if not _TRACKING.match(k.lower())]
    return urlunsplit((parts.scheme.lower(), parts.netloc.lower(), path, urlencode(kept), ""))


def canonical(url: Column) -> Column:
    """``plain_address`` of each url; there is no built-in that decodes and encodes by these rules."""
    from pyspark.sql import SparkSession

    from ..session import ship

    if (spark := SparkSession.getActiveSession()) is not None:
        ship(spark)

    def each(urls: pd.Series) -> pd.Series:
        return urls.map(plain_address)

    return F.pandas_udf(each, StringType())(url)


def early_stop_key(url: Column) -> Column:
    """What counts as the same address while searching."""
    return F.regexp_replace(F.substring_index(F.trim(url), "#", 1), "/+$", "")


def content_kind(url: Column, content_type: Column, head: Column) -> Column:
    """pdf, text, html or unknown by type, suffix and first characters, in this order."""
    kind, address, start = F.lower(F.coalesce(content_type, F.lit(""))), F.lower(F.coalesce(url, F.lit(""))), F.lower(F.substring(F.coalesce(head, F.lit("")), 1, 500))
    return (
        F.when(kind.contains("application/pdf") | address.endswith(".pdf"), "pdf")
        .when(kind.contains("text/plain") | address.endswith(".txt"), "text")
        .when(kind.contains("text/html"), "html")
        .when(start.startswith("%pdf"), "pdf")
        .when(start.contains("<html") | start.contains("<!doctype html"), "html")
        .otherwise("unknown")
    )


def charset(content_type: Column, default: str = "utf-8") -> Column:
    """The character set a content type names."""
    found = F.regexp_extract(content_type, r"(?i)charset=[\"']?([^\s;\"']+)", 1)
    return F.when(found.isNull() | (found == ""), default).otherwise(found)
