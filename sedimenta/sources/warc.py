"""WARC files: a scan without an index, range reads with one, and a writer with side-car indexes.

Files lie on any file system that ``store`` can open. ARC files of gzip members are scanned too.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import posixpath
import uuid
import zlib
from collections.abc import Iterator
from contextlib import ExitStack
from dataclasses import dataclass
from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sedimenta.archive import Archive, Config
from sedimenta.batches import BATCH_ROWS, SLICE_BYTES, batched, cut, release
from sedimenta.functions import http, urls
from sedimenta.operators.functions import WarcPayload
from sedimenta.sources import cdx, store

#: Bytes that are read at a time (what a record leaves of them is copied), and bytes that a file system is asked for.
_CHUNK, _BUFFER = 1 << 16, 1 << 20


def members(read, limit: int = 0) -> Iterator[tuple[int, int, bytes]]:
    """(offset, stored length, bytes) of each record of a stream; ``read``: n -> bytes. Gzip members or plain records.

    ``limit``: most bytes that a record may grow to on decompression (0: any).
    """
    buf, at = read(_CHUNK), 0
    if buf[:2] != b"\x1f\x8b":
        yield from _plain(buf, read)
        return
    while buf:
        z, out, used, size = zlib.decompressobj(31), [], 0, 0
        while True:
            got = z.decompress(buf)
            size += len(got)
            if limit and size > limit:
                got, size = got[: limit - size], limit
            out.append(got)
            used += len(buf) - len(z.unused_data)
            if z.eof:
                buf = z.unused_data
                break
            buf = read(_CHUNK)
            if not buf:
                break
        yield at, used, b"".join(out)
        at += used
        if not buf:
            buf = read(_CHUNK)


def _plain(buf: bytes, read) -> Iterator[tuple[int, int, bytes]]:
    at = 0
    while True:
        while b"\r\n\r\n" not in buf:
            more = read(_CHUNK)
            if not more:
                return
            buf += more
        head = buf[: buf.index(b"\r\n\r\n")]
        size = next((int(v) for k, v in http.header_lines(head) if k.lower() == "content-length"), 0)
        need = len(head) + 4 + size
        while len(buf) < need + 4:
            more = read(max(_CHUNK, need + 4 - len(buf)))
            if not more:
                break
            buf += more
        end = need
        while buf[end : end + 1] in (b"\r", b"\n") and end < need + 4:
            end += 1
        yield at, end, buf[:need]
        at += end
        buf = buf[end:]


def capture_of(record: bytes, offset: int, length: int, filename: str, revisits: bool = True, others: bool = False) -> tuple | None:
    """The capture row of a record; None if it is none that is asked for."""
    try:
        header, block = http.warc_record(record)
    except ValueError:
        return None
    h = {k.lower(): v for k, v in header}
    kind, url = h.get("warc-type", ""), h.get("warc-target-uri", "").strip("<>")
    if not url or kind not in ("response", "revisit") and not others or kind == "revisit" and not revisits:
        return None
    stamp = "".join(c for c in h.get("warc-date", "") if c.isdigit())[:14].ljust(14, "0")
    message = http.http_message(block)
    fields = message[1] if message else None
    status = int(message[0].split()[1]) if message and len(message[0].split()) > 1 and message[0].split()[1].isdigit() else None
    digest = h.get("warc-payload-digest") or (base64.b32encode(hashlib.sha1(message[2]).digest()).decode() if message else None)
    mime = "warc/revisit" if kind == "revisit" else http.mime(fields) if fields else h.get("content-type")
    return (urls.surt_py(url), stamp, url, mime, status, digest and digest.removeprefix("sha1:"), http.header_value(fields, "Location") if fields else None, None, length, offset, filename)


_SCHEMA = "surtUrl string, timestamp string, originalUrl string, mime string, status int, digest string, redirectUrl string, meta string, compressedSize bigint, offset bigint, filename string, path string, content binary"


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class WarcSource(DataSource):
    """``spark.read.format("warc").load(folder or file)``: every record of every file, a task a file."""

    @classmethod
    def name(cls) -> str:
        return "warc"

    def schema(self) -> str:
        return _SCHEMA

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceWriter:
        return _Writer(self.options)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.revisits = options.get("includerevisits", options.get("includeRevisits", "true")).lower() == "true"
        self.others = options.get("includeothers", options.get("includeOthers", "false")).lower() == "true"
        self.limit = int(options.get("maxdecompressed", options.get("maxDecompressed", "0")))

    def partitions(self):
        return [_File(p) for p in store.files_below(self.path, (".warc", ".warc.gz", ".arc.gz", ".wat.gz"))] or [_File("")]

    def read(self, partition: _File):
        if not partition.path:
            return
        rows, size = [], 0
        with store.opened(self.path)[0].open_input_stream(partition.path, compression=None, buffer_size=_BUFFER) as f:
            for offset, length, record in members(f.read, self.limit):
                got = capture_of(record, offset, length, posixpath.basename(partition.path), self.revisits, self.others)
                if got is None:
                    continue
                rows.append((*got, partition.path, record))
                size += len(record)
                if size >= SLICE_BYTES or len(rows) >= BATCH_ROWS:
                    yield _batch(rows)
                    rows, size = [], 0
        if rows:
            yield _batch(rows)
        release()


def _batch(rows: list[tuple]):
    """Spark would gather rows by their number, whatever their size."""
    import pyarrow as pa

    kinds = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    names, types = zip(*(c.split() for c in _SCHEMA.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t]) for c, t in zip(zip(*rows), types)], names)


@dataclass
class _Done(WriterCommitMessage):
    records: int
    files: list


class _Writer(DataSourceArrowWriter):
    """One file a task, ``<prefix>-<number>.warc[.gz]``, first under a name of its own attempt, renamed on commit."""

    def __init__(self, options: dict):
        self.o = dict(options)
        self.url = options["path"]
        system, self.path = store.opened(self.url)
        system.create_dir(self.path, recursive=True)

    def write(self, iterator: Iterator) -> _Done:
        from pyspark import TaskContext

        system = store.opened(self.url)[0]
        number = TaskContext.get().partitionId()
        gz, index = self.o.get("gzip", "true") == "true", self.o.get("cdx", "true") == "true"
        name = f"{self.o.get('prefix', 'part')}-{number:05d}.warc{'.gz' if gz else ''}"
        cdx_name = name.removesuffix(".gz") + ".cdx" + (".gz" if gz else "")
        temp, temp2 = (posixpath.join(self.path, f".{n}.{uuid.uuid4().hex}") for n in (name, cdx_name))
        count = at = 0
        with ExitStack() as opened:
            out = side = None
            for row in (row for batch in iterator for part in cut(batch) for row in part.to_pylist()):
                if row.get("payload") is None:
                    continue
                if out is None:  # no empty files
                    out = opened.enter_context(system.open_output_stream(temp, compression=None))
                    first = _member(_info(self.o, name), gz)
                    out.write(first)
                    at += len(first)
                    if index:
                        side = opened.enter_context(system.open_output_stream(temp2, compression=None))
                        side = opened.enter_context(gzip.GzipFile("", "wb", fileobj=side, mtime=0)) if gz else side
                        side.write(b" CDX N b a m s k r M S V g\n")
                record = _response(row)
                stored = _member(record, gz)
                out.write(stored)
                count += 1
                got = capture_of(record, at, len(stored), name) if index else None
                if got is not None:
                    side.write((" ".join("-" if v is None else str(v).replace(" ", "%20") for v in got) + "\n").encode())
                at += len(stored)
        release()
        if out is None:
            return _Done(0, [])
        return _Done(count, [(t, posixpath.join(self.path, n)) for t, n in ((temp, name), (temp2, cdx_name))[: 1 + index]])

    def commit(self, messages) -> None:
        system = store.opened(self.url)[0]
        for m in messages:
            for temp, name in m.files if m else ():
                system.move(temp, name)
        with system.open_output_stream(posixpath.join(self.path, "_COUNT")) as f:
            f.write(str(sum(m.records for m in messages if m)).encode())

    def abort(self, messages) -> None:
        system = store.opened(self.url)[0]
        for m in messages:
            for temp, _ in m.files if m else ():
                try:
                    system.delete_file(temp)
                except FileNotFoundError:
                    pass


def _member(record: bytes, gz: bool) -> bytes:
    return gzip.compress(record + b"\r\n\r\n", mtime=0) if gz else record + b"\r\n\r\n"


def _record(kind: str, block: bytes, extra: list[tuple[str, str]]) -> bytes:
    head = [("WARC-Type", kind), *extra, ("Content-Length", str(len(block)))]
    return b"WARC/1.0\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block


def _info(o: dict, name: str) -> bytes:
    created = o.get("created") or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    block = f"software: {o.get('software', 'sedimenta')}\r\npublisher: {o.get('publisher', 'Anonymous')}\r\nformat: WARC File Format 1.0\r\n".encode()
    return _record("warcinfo", block, [("WARC-Date", created), ("WARC-Filename", name), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, name + created)}>"), ("Content-Type", "application/warc-fields")])


def _response(row: dict) -> bytes:
    header = [(h["k"], h["v"]) for h in row.get("httpHeader") or []]
    # the payload is decoded, so what described its transfer no longer holds
    header = [(k, v) for k, v in header if k.lower() not in ("transfer-encoding", "content-encoding", "content-length")] + [("Content-Length", str(len(row["payload"])))]
    status = row.get("httpStatusLine") or "HTTP/1.1 200 OK"
    block = f"{status}\r\n".encode("latin-1") + "".join(f"{k}: {v}\r\n" for k, v in header).encode("latin-1", "replace") + b"\r\n" + bytes(row["payload"])
    old = {h["k"].lower(): h["v"] for h in row.get("recordHeader") or []}
    stamp = (row.get("timestamp") or "19700101000000").ljust(14, "0")
    date = f"{stamp[:4]}-{stamp[4:6]}-{stamp[6:8]}T{stamp[8:10]}:{stamp[10:12]}:{stamp[12:14]}Z"
    ident = old.get("warc-record-id") or f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, (row.get('originalUrl') or '') + stamp)}>"
    extra = [("WARC-Target-URI", row.get("originalUrl") or ""), ("WARC-Date", date), ("WARC-Record-ID", ident), ("WARC-Payload-Digest", "sha1:" + base64.b32encode(hashlib.sha1(bytes(row["payload"])).digest()).decode())]
    if "warc-ip-address" in old:
        extra.append(("WARC-IP-Address", old["warc-ip-address"]))
    return _record("response", block, [*extra, ("Content-Type", "application/http; msgtype=response")])


# --- archives ---------------------------------------------------------------------------------------------------------


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(WarcSource)


def scan(spark: SparkSession, path: str, revisits: bool = True, others: bool = False, max_decompressed: int = 0) -> DataFrame:
    """All records of the files, with capture rows derived from them and the raw record in ``content``."""
    _register(spark)
    return spark.read.format("warc").options(includeRevisits=str(revisits).lower(), includeOthers=str(others).lower(), maxDecompressed=str(max_decompressed)).load(path)


def read_range(path: Column, offset: Column, length: Column, limit: int = 0) -> Column:
    """The bytes of a stored record, decompressed if it is a gzip member; null if it can't be read.

    About a quarter of ``SLICE_BYTES`` of stored records are read at a time, in the order of files and offsets. ``limit``: most bytes that a record may grow to (0: any). A path
    on a file system that can't be opened is an error.
    """

    import pyarrow as pa

    def run(batches: Iterator[tuple[pa.Array, ...]]) -> Iterator[pa.Array]:
        for columns in batches:
            rows, size = [], 0
            for row in zip(*(c.to_pylist() for c in columns)):
                rows.append(row)
                size += max(0, row[2] or 0)
                if size >= SLICE_BYTES // 4:
                    yield pa.array(_ranges(rows, limit), pa.binary())
                    rows, size = [], 0
            if rows:
                yield pa.array(_ranges(rows, limit), pa.binary())
        release()

    run.__annotations__ = {"batches": Iterator[tuple[pa.Array, ...]], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "binary")(path, offset, length)


def _ranges(rows: list[tuple], limit: int) -> list[bytes | None]:
    out: list[bytes | None] = [None] * len(rows)
    name, f = None, None
    try:
        for k in sorted((k for k, r in enumerate(rows) if None not in r and r[1] >= 0 and r[2] >= 0), key=lambda k: rows[k]):
            p, o, n = rows[k]
            system, at = store.opened(p)
            try:
                if p != name:
                    if f:
                        f.close()
                    f, name = None, p
                    f = system.open_input_file(at)
                if f is None:
                    continue
                f.seek(o)
                data = f.read(n)
                out[k] = zlib.decompressobj(31).decompress(data, limit) if data[:2] == b"\x1f\x8b" else data
            except (OSError, zlib.error):
                pass
    finally:
        if f:
            f.close()
    return out


def of_rows(rows: DataFrame, config: Config = Config()) -> Archive:
    """An archive of rows with capture columns and raw records in ``content``."""
    record = [c for c in [*cdx.COLUMNS, "time"] if c in rows.columns]
    return Archive(rows, record, {}, config, root_func=WarcPayload())


def from_files(spark: SparkSession, path: str, config: Config = Config(), **options) -> Archive:
    return of_rows(scan(spark, path, **{"max_decompressed": config.max_decompressed, **options}), config)


def from_index(captures: DataFrame, files: DataFrame | str, config: Config = Config()) -> Archive:
    """Captures first: a record's bytes are read only where a derivation needs them, for the captures that filters left."""
    index = cdx.file_index(captures.sparkSession, files) if isinstance(files, str) else files
    rows = cdx.located(captures, index)
    return of_rows(_with_content(rows, config), config)


def _with_content(rows: DataFrame, config: Config) -> DataFrame:
    return rows.withColumn("content", read_range(F.col("path"), F.col("offset"), F.col("compressedSize"), config.max_decompressed))


def from_files_with_cdx(spark: SparkSession, folder: str, config: Config = Config()) -> Archive:
    return from_index(cdx.read(spark, cdx.with_folder(folder)), folder, config)


def from_folders(captures: DataFrame, folder: str = "folder", config: Config = Config()) -> Archive:
    return of_rows(_with_content(cdx.located_in(captures, folder), config), config)


def save(archive: Archive, path: str, prefix: str = "part", compress: bool = True, index: bool = True, publisher: str = "Anonymous", created: str | None = None, software: str | None = None) -> int:
    """Write the records' responses as WARC files with side-car CDX; the number of records."""
    spark = archive.df.sparkSession
    _register(spark)
    a = archive.initialised(archive.root_func) if archive.root_func is not None else archive
    take = {n: a.tree.get((n,)) for n in ("recordHeader", "httpStatusLine", "httpHeader", "payload")}
    header = "array<struct<k:string,v:string>>"
    kinds = {"recordHeader": header, "httpStatusLine": "string", "httpHeader": header, "payload": "binary"}
    cols = [(F.col(f"`{f.column}`") if f else F.lit(None)).cast(kinds[n]).alias(n) for n, f in take.items()]
    base = [(F.col(c) if c in a.df.columns else F.lit(None)).cast("string").alias(c) for c in ("originalUrl", "timestamp")]
    options = {"prefix": prefix, "gzip": str(compress).lower(), "cdx": str(index).lower(), "publisher": publisher, "software": software or spark.sparkContext.appName}
    batched(a.df).select(*base, *cols).write.format("warc").mode("append").options(**options, **({"created": created} if created else {})).save(path)
    system, at = store.opened(path)
    with system.open_input_stream(posixpath.join(at, "_COUNT")) as f:
        return int(f.read())
