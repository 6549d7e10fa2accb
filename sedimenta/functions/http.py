"""HTTP messages, WARC records, headers and the decoding of payloads, in plain Python and as Columns."""

from __future__ import annotations

import codecs
import gzip
import re
import zlib

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bytes of a payload that become text, unless a caller says otherwise (0: all).
TEXT_LIMIT = 1 << 20
_META = re.compile(rb"<meta[^>]+charset\s*=\s*[\"']?\s*([a-zA-Z0-9_:.-]+)", re.I)


def header_lines(block: bytes) -> list[tuple[str, str]]:
    """Name and value of each line; continued lines are joined."""
    out: list[tuple[str, str]] = []
    for line in block.decode("latin-1").splitlines():
        if line[:1] in (" ", "\t") and out:
            out[-1] = (out[-1][0], f"{out[-1][1]} {line.strip()}")
        elif ":" in line:
            k, v = line.split(":", 1)
            out.append((k.strip(), v.strip()))
    return out


def _split(data: bytes) -> tuple[bytes, bytes]:
    for mark in (b"\r\n\r\n", b"\n\n"):
        head, found, rest = data.partition(mark)
        if found:
            return head, rest
    return data, b""


def _chunked(body: bytes) -> bytes:
    out, at = [], 0
    while at < len(body):
        eol = body.find(b"\n", at)
        if eol < 0:
            break
        try:
            n = int(body[at:eol].split(b";")[0].strip() or b"x", 16)
        except ValueError:
            return body
        if n == 0:
            break
        out.append(body[eol + 1 : eol + 1 + n])
        at = eol + 1 + n
        while at < len(body) and body[at] in b"\r\n":
            at += 1
    return b"".join(out)


def http_message(data: bytes) -> tuple[str, list[tuple[str, str]], bytes] | None:
    """Status line, header and decoded body; None if the bytes are no HTTP response."""
    if not data.startswith(b"HTTP/"):
        return None
    head, body = _split(data)
    status, _, rest = head.partition(b"\n")
    header = header_lines(rest)
    lower = {k.lower(): v.lower() for k, v in header}
    if "chunked" in lower.get("transfer-encoding", ""):
        body = _chunked(body)
    try:
        if "gzip" in lower.get("content-encoding", ""):
            body = gzip.decompress(body)
        elif "deflate" in lower.get("content-encoding", ""):
            body = zlib.decompress(body)
    except (OSError, EOFError, zlib.error):
        pass
    return status.decode("latin-1").strip(), header, body


#: The line before an ARC record's block: URL, IP address, 14 digits, MIME type, (more,) length.
_ARC = re.compile(rb"([a-zA-Z][a-zA-Z0-9+.-]*:\S*) (\S+) (\d{14}) (\S+)(?: \S+)*? (\d+)\r?\n")


def arc_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """An ARC record as ``warc_record`` gives a WARC record."""
    m = _ARC.match(data)
    if m is None:
        raise ValueError("not a WARC or ARC record")
    url, ip, stamp, mime_, n = (x.decode("latin-1") for x in m.groups())
    block = data[m.end() : m.end() + int(n)]
    kind = "warcinfo" if url.startswith("filedesc:") else "response" if block.startswith(b"HTTP/") else "resource"
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:]}Z"
    return [("WARC-Type", kind), ("WARC-Target-URI", url), ("WARC-Date", date), ("WARC-IP-Address", ip), ("Content-Type", mime_)], block


def warc_record(data: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """Header and block of one uncompressed WARC record, or ARC record."""
    if not data.startswith(b"WARC/"):
        return arc_record(data)
    head, rest = _split(data)
    header = header_lines(head.partition(b"\n")[2])
    n = next((int(v) for k, v in header if k.lower() == "content-length"), len(rest))
    return header, rest[:n]


def header_value(header, name: str) -> str | None:
    """The last value under exactly this name."""
    return next((v for k, v in reversed(header or []) if k == name), None)


def mime(header) -> str | None:
    v = header_value(header, "Content-Type")
    return v.split(";")[0].strip() if v else None


def charset(header) -> str | None:
    """The charset, if it is the first parameter of the content type."""
    v = header_value(header, "Content-Type")
    parts = v.split(";") if v else []
    if len(parts) < 2:
        return None
    k, _, x = parts[1].partition("=")
    return x.strip().strip("\"'") or None if k.strip() == "charset" else None


def string_content(payload: bytes | None, header=None, limit: int = TEXT_LIMIT) -> str | None:
    """The payload, up to ``limit`` bytes, as trimmed text: declared charset, then the HTML's own, then UTF-8, then Latin-1."""
    if payload is None:
        return None
    data = bytes(payload[:limit] if limit else payload)
    names = [charset(header)] if header else []
    if header and (mime(header) or "").lower() == "text/html":
        m = _META.search(data[:4096])
        names.append(m.group(1).decode("ascii") if m else None)
    for name in [n for n in (*names, "utf-8") if n]:
        try:
            # a character that the limit cuts in two is dropped
            return codecs.getincrementaldecoder(name)().decode(data).strip()
        except (LookupError, UnicodeDecodeError):
            continue
    return data.decode("latin-1").strip()


# --- the header helpers as Columns, over array<struct<k, v>> ---------------------------------------------------------


def header_col(headers: Column, name: str) -> Column:
    return F.try_element_at(F.filter(headers, lambda h: h["k"] == name), F.lit(-1))["v"]


def mime_col(headers: Column) -> Column:
    return F.trim(F.split(header_col(headers, "Content-Type"), ";")[0])


def charset_col(headers: Column) -> Column:
    first = F.get(F.split(header_col(headers, "Content-Type"), ";"), F.lit(1))
    return F.when(F.trim(F.split(first, "=")[0]) == "charset", F.regexp_replace(F.trim(F.get(F.split(first, "="), F.lit(1))), "[\"']", ""))


def ip_col(headers: Column) -> Column:
    return header_col(headers, "Remote_Addr")


def redirect_col(headers: Column) -> Column:
    return header_col(headers, "Location")
