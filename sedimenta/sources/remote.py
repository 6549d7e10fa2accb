"""Remote captures: a CDX server's pages as partitions, and payloads by HTTP from its replay service.

What fetches is a function ``url -> (status line, headers, body)`` or None; it is passed in, so everything here is
testable offline.
"""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass
from urllib.parse import urlencode
from urllib.request import Request, urlopen

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.archive import Archive, Config
from sedimenta.operators.functions import HEADER_TYPE, HttpPayload
from sedimenta.sources import cdx

Fetched = tuple[str, list[tuple[str, str]], bytes]
#: What a replay service puts before the names of the archived response's own headers.
_ORIGINAL = "x-archive-orig-"


@dataclass(frozen=True)
class Service:
    """Where captures are looked up, and the address of an untouched payload with ``{timestamp}`` and ``{url}``."""

    cdx: str
    replay: str


def fetch(url: str, timeout: float = 60) -> Fetched | None:
    """A GET; None on any failure."""
    try:
        with urlopen(Request(url), timeout=timeout) as r:  # noqa: S310
            return f"HTTP/1.1 {r.status} {r.reason}", list(r.headers.items()), r.read()
    except (OSError, ValueError):
        return None


def cdx_query(server: str, url: str, match_prefix: bool = False, from_: int = 0, to: int = 0, blocks_per_page: int = 5) -> str:
    args = {"url": url, "matchType": "prefix" if match_prefix else "exact", "pageSize": blocks_per_page}
    if from_:
        args["from"] = from_
    if to:
        args["to"] = to
    return f"{server}?{urlencode(args)}"


def captures(spark: SparkSession, query: str, pages: int = 50, partitions: int = 0, get: Callable[[str], Fetched | None] = fetch, strict: bool = False) -> DataFrame:
    """The capture rows of a CDX query; one page is asked for without a number.

    A page that can't be fetched is skipped with a warning in the executor's log, or fails the job if ``strict``.
    """
    urls = [query] if pages == 1 else [f"{query}&page={k}" for k in range(pages)]
    asked = spark.createDataFrame([(u,) for u in urls], "url string").repartition(min(partitions or pages, pages))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            lines = []
            for u in b.column(0).to_pylist():
                got = get(u)
                if got is None:
                    if strict:
                        raise OSError(f"can't fetch {u}")
                    logging.getLogger(__name__).warning("skipped %s", u)
                else:
                    lines += [x for x in got[2].decode("utf-8", "replace").splitlines() if x.strip()]
            yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["value"])

    return server_rows(asked.mapInArrow(run, "value string"))


def server_rows(lines: DataFrame) -> DataFrame:
    """Rows of a CDX server's seven columns, or of eleven."""
    n = F.size(F.split(F.trim("value"), " +"))
    seven = lines.withColumn("value", F.when(n == 7, F.concat_ws(" ", F.regexp_extract("value", r"^\s*((?:\S+ +){5}\S+)", 1), F.lit("- -"), F.regexp_extract("value", r"(\S+)\s*$", 1))).otherwise(F.col("value")))
    return cdx.parse_lines(seven)


def headers(original: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The archived response's own headers: the content type, and what the replay server prefixed, in usual capitals."""
    out = []
    for k, v in original:
        low = k.lower()
        if low == "content-type":
            out.append(("Content-Type", v))
        elif low.startswith(_ORIGINAL):
            name = "-".join(p.capitalize() for p in low[len(_ORIGINAL) :].split("-"))
            if name != "Content-Type" or not any(x == "content-type" for x in (k2.lower() for k2, _ in original)):
                out.append((name, v))
    return out


def payload(replay: str, timestamp: Column, url: Column, get: Callable[[str], Fetched | None] = fetch) -> Column:
    """struct<httpStatusLine, httpHeader, payload> of a capture; null if it can't be fetched."""
    kind = f"struct<httpStatusLine:string,httpHeader:{HEADER_TYPE},payload:binary>"

    def run(stamps, urls):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        out = []
        for t, u in zip(stamps.to_pylist(), urls.to_pylist()):
            got = get(replay.format(timestamp=t, url=u)) if t and u else None
            out.append(got and {"httpStatusLine": got[0], "httpHeader": [{"k": k, "v": v} for k, v in headers(got[1])], "payload": got[2]})
        return pa.array(out, to_arrow_type(_parsed(kind)))

    return F.arrow_udf(run, kind).asNondeterministic()(timestamp, url)


def _parsed(kind: str):
    from pyspark.sql import types as T

    header = T.ArrayType(T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())]))
    return T.StructType([T.StructField("httpStatusLine", T.StringType()), T.StructField("httpHeader", header), T.StructField("payload", T.BinaryType())])


def archive_of(rows: DataFrame, replay: str, get: Callable[[str], Fetched | None] = fetch, config: Config = Config()) -> Archive:
    """Captures whose payload is fetched only where a derivation needs it."""
    from sedimenta.archive import Field

    df = rows.withColumn("v:http", payload(replay, F.col("timestamp"), F.col("originalUrl"), get))
    names = {"httpStatusLine": "string", "httpHeader": HEADER_TYPE, "payload": "binary"}
    df = df.withColumns({f"v:{n}": F.col(f"`v:http`.{n}") for n in names})
    record = [c for c in [*cdx.COLUMNS, "time"] if c in rows.columns]
    return Archive(df.drop("v:http"), record, {(n,): Field(f"v:{n}", t, hidden=True) for n, t in names.items()}, config, root_func=HttpPayload())


def from_service(spark: SparkSession, service: Service, url: str, match_prefix: bool = False, from_: int = 0, to: int = 0, blocks_per_page: int = 5, pages: int = 50, partitions: int = 0, get=fetch) -> Archive:
    """An archive of all captures of a URL (or of those below it). The capture rows are kept, so the server is asked once."""
    query = cdx_query(service.cdx, url, match_prefix, from_, to, blocks_per_page)
    return archive_of(captures(spark, query, pages, partitions, get).persist(), service.replay, get)


def from_local_cdx(spark: SparkSession, path: str, replay: str, get=fetch) -> Archive:
    """Captures from local CDX files, payloads from the replay service."""
    return archive_of(cdx.read(spark, path), replay, get)


def text_of(url: Column, get=fetch) -> Column:
    """A GET as text; null on failure."""

    def run(urls):
        import pyarrow as pa

        got = [get(u) if u else None for u in urls.to_pylist()]
        return pa.array([g and g[2].decode("utf-8", "replace") for g in got], pa.string())

    return F.arrow_udf(run, "string").asNondeterministic()(url)
