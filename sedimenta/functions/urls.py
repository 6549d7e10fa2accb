"""SURTs and absolute URLs, as Catalyst expressions where these can say it and in Python otherwise."""

from __future__ import annotations

import re
from urllib.parse import urljoin, urlsplit

from pyspark.sql import Column
from pyspark.sql import functions as F

_WWW = r"^www[0-9]*\."


def surt(url: Column) -> Column:
    """``http://example.org/web`` to ``org,example)/web``: lower host without www and default port, labels reversed, no protocol, no fragment."""
    bare = F.regexp_replace(url, "#.*$", "")
    host = F.lower(F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?([^/:?]*)", 1))
    port = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?[^/:?]*:([0-9]+)", 1)
    rest = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*(.*)$", 1)
    rest = F.when(rest == "", "/").when(rest.startswith("?"), F.concat(F.lit("/"), rest)).otherwise(rest)
    labels = F.array_join(F.reverse(F.split(F.regexp_replace(host, _WWW, ""), r"\.")), ",")
    at = F.when(port.isin("", "80", "443"), "").otherwise(F.concat(F.lit(":"), port))
    return F.when(host != "", F.concat(labels, at, F.lit(")"), rest))


def surt_py(url: str | None, base: str | None = None) -> str | None:
    """The same for one string; a relative URL is resolved against ``base``."""
    full = absolute_py(url, base) if url is not None and base else url
    if not full:
        return None
    try:
        parts = urlsplit(full.split("#", 1)[0])
        host, port = (parts.hostname or "").lower(), parts.port
    except ValueError:
        return None
    if not parts.scheme or not host:
        return None
    host = re.sub(_WWW, "", host)
    path = parts.path or "/"
    return ",".join(reversed(host.split("."))) + (f":{port}" if port not in (None, 80, 443) else "") + ")" + path + (f"?{parts.query}" if parts.query else "")


def absolute(link: Column, base: Column) -> Column:
    """Links resolved against a page's URL: absolute, protocol-relative, root-relative, query, fragment and plain relative ones without dots."""
    origin = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    scheme = F.regexp_extract(base, r"^([a-zA-Z][a-zA-Z0-9+.-]*:)", 1)
    page = F.regexp_replace(base, r"#.*$", "")
    bare = F.regexp_replace(page, r"\?.*$", "")
    path = F.regexp_extract(bare, r"^[a-zA-Z][a-zA-Z0-9+.-]*://[^/]*(.*)$", 1)
    folder = F.concat(origin, F.when(F.instr(path, "/") > 0, F.regexp_extract(path, r"^(.*/)", 1)).otherwise(F.lit("/")))
    return (
        F.when(link.isNull() | base.isNull(), F.lit(None).cast("string"))
        .when(link.rlike(r"^[a-zA-Z][a-zA-Z0-9+.-]*:"), link)
        .when(link.startswith("//"), F.concat(scheme, link))
        .when(link.startswith("/"), F.concat(origin, link))
        .when(link.startswith("?"), F.concat(bare, link))
        .when(link.startswith("#"), F.concat(page, link))
        .when(link == "", page)
        .otherwise(F.concat(folder, link))
    )


def absolute_py(link: str | None, base: str | None) -> str | None:
    if link is None or base is None:
        return None
    try:
        return urljoin(base, link)
    except ValueError:
        return None
