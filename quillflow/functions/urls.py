"""URLs: hosts as browsers show them, and absolute forms of links."""

from __future__ import annotations

from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def host(url: Column) -> Column:
    """The host, lower-cased, with its port unless that is the scheme's own; '' where the URL is malformed."""
    authority = F.lower(F.try_parse_url(url, F.lit("AUTHORITY")))
    bare = F.regexp_replace(authority, "^.*@", "")
    scheme = F.lower(F.try_parse_url(url, F.lit("PROTOCOL")))
    usual = F.when(scheme == "http", F.regexp_replace(bare, ":80$", "")).when(scheme == "https", F.regexp_replace(bare, ":443$", "")).otherwise(bare)
    return F.coalesce(usual, F.lit(""))


def valid_link(href: Column, title: Column) -> Column:
    """Links that lead to another page and have a title of 1 to 60 characters."""
    return (href != "") & ~href.startswith("#") & ~F.lower(href).startswith("javascript:") & (F.length(title) > 0) & (F.length(title) <= 60)


def absolute(base: Column, href: Column) -> Column:
    """href as seen from base; null where that makes no URL. Links that are absolute already stay in the JVM's hands."""

    @F.pandas_udf("string")
    def join(bases: pd.Series, hrefs: pd.Series) -> pd.Series:
        def one(b: str | None, h: str | None) -> str | None:
            try:
                url = urljoin(b or "", h or "")
                return url if urlsplit(url).scheme and urlsplit(url).netloc else None
            except ValueError:
                return None

        return pd.Series([one(b, h) for b, h in zip(bases, hrefs)], dtype=object)

    return join(base, href)
