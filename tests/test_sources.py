import gzip
import os

import pytest
from pyspark.sql import functions as F

from sedimenta import streaming
from sedimenta.archive import Archive, Config
from sedimenta.operators import graph, revisits
from sedimenta.operators.functions import Html, HtmlText, HttpPayload, StringContent, WarcPayload
from sedimenta.operators.paths import Pointer
from sedimenta.sources import cdx, files, remote, warc

TITLE = HtmlText().of(Html.first("title"))
LINES = [
    " CDX N b a m s k r M S V g",
    "org,a)/ 20200101000000 http://a.org/ text/html 200 SHA - - 120 33 f.warc.gz",
    "short line",
    "org,b)/ 20200102000000 http://b.org/ - - - http://c.org/ - 9",
    "org,c)/ 2020 http://c.org/ text/html abc X - - 1 bad f.warc.gz",
]


def _record(kind, url, block, extra=""):
    b = block if isinstance(block, bytes) else block.encode()
    return f"WARC/1.0\r\nWARC-Type: {kind}\r\nWARC-Target-URI: {url}\r\nWARC-Date: 2020-01-02T03:04:05Z\r\nWARC-Record-ID: <urn:x:{url}>\r\n{extra}Content-Length: {len(b)}\r\n\r\n".encode() + b


def _html(title, status="200 OK"):
    return f"HTTP/1.1 {status}\r\nContent-Type: text/html; charset=utf-8\r\n\r\n<html><title>{title}</title></html>"


RECORDS = [
    _record("warcinfo", "", "software: x\r\n").replace(b"WARC-Target-URI: \r\n", b""),
    _record("response", "http://a.org/", _html("A é")),
    _record("response", "http://b.org/", _html("B", "404 Not Found")),
    _record("revisit", "http://a.org/again", "HTTP/1.1 200 OK\r\n\r\n", "WARC-Payload-Digest: sha1:AAA\r\n"),
    _record("resource", "dns:a.org", "1.2.3.4"),
]


@pytest.fixture
def folder(tmp_path):
    with open(tmp_path / "two.warc.gz", "wb") as f:
        for r in RECORDS:
            f.write(gzip.compress(r + b"\r\n\r\n"))
    (tmp_path / "plain.warc").write_bytes(b"".join(r + b"\r\n\r\n" for r in RECORDS[:2]))
    return str(tmp_path)


def test_cdx_lines(spark, tmp_path):
    (tmp_path / "a.cdx").write_text("\n".join(LINES))
    with gzip.open(tmp_path / "b.cdx.gz", "wt") as f:
        f.write(LINES[1] + "\n")
    rows = cdx.read(spark, cdx.with_folder(str(tmp_path))).orderBy("surtUrl").collect()
    assert len(rows) == 4 and rows[0].status == 200 and rows[0].offset == 33 and rows[0].redirectUrl is None and str(rows[0].time) == "2020-01-01 00:00:00"
    assert rows[2].mime is None and rows[2].redirectUrl == "http://c.org/" and rows[2].filename is None
    assert rows[3].status is None and rows[3].offset is None and rows[3].time is None
    cdx.save(cdx.read(spark, f"{tmp_path}/a.cdx"), f"{tmp_path}/out.gz")
    assert [r.value for r in spark.read.text(f"{tmp_path}/out.gz").collect()][0] == LINES[1]
    assert cdx.lines(cdx.read(spark, f"{tmp_path}/a.cdx"), additional=False).first().value == LINES[1].rsplit(" ", 2)[0]


def test_scan(spark, folder):
    rows = warc.scan(spark, f"{folder}/two.warc.gz").orderBy("offset").collect()
    assert [(r.originalUrl, r.status, r.mime) for r in rows] == [("http://a.org/", 200, "text/html"), ("http://b.org/", 404, "text/html"), ("http://a.org/again", 200, "warc/revisit")]
    assert rows[0].timestamp == "20200102030405" and rows[0].surtUrl == "org,a)/"
    assert warc.scan(spark, f"{folder}/two.warc.gz", revisits=False).count() == 2 and warc.scan(spark, f"{folder}/two.warc.gz", others=True).count() == 4
    assert warc.scan(spark, folder).count() == 4
    with open(f"{folder}/two.warc.gz", "rb") as f:
        f.seek(rows[1].offset)
        assert gzip.decompress(f.read(rows[1].compressedSize)).startswith(RECORDS[2])


def test_record_to_text(spark, folder):
    a = warc.from_files(spark, f"{folder}/two.warc.gz", revisits=False)
    assert sorted(r.t for r in a.select(t=TITLE).collect()) == ["A é", "B"]
    row = a.enrich(WarcPayload()).select(s=Pointer("httpStatusLine"), h=Pointer("recordHeader"), x=StringContent()).first()
    assert row.s == "HTTP/1.1 200 OK" and any(h.k == "WARC-Type" and h.v == "response" for h in row.h) and row.x.startswith("<html>")
    assert '"payload":"bytes(length:' in a.enrich(WarcPayload()).to_json().first()[0]


def test_write_index_and_read(spark, folder, tmp_path):
    out = str(tmp_path / "out")
    a = warc.from_files(spark, f"{folder}/two.warc.gz", revisits=False)
    assert warc.save(a, out, prefix="x", created="2024-01-01T00:00:00Z") == 2
    names = [f for f in os.listdir(out) if not f.startswith((".", "_"))]
    assert sorted(n.split(".", 1)[1] for n in names) == ["warc.cdx.gz", "warc.gz"]
    b = warc.from_files_with_cdx(spark, out)
    assert sorted((r.originalUrl, r.t) for r in b.select("originalUrl", t=TITLE).collect()) == [("http://a.org/", "A é"), ("http://b.org/", "B")]
    c = warc.from_folders(cdx.read(spark, cdx.with_folder(out)).withColumn("folder", F.lit(out)))
    assert c.select(t=TITLE).count() == 2
    ids = [h.v for r in warc.from_files(spark, out).select(h=Pointer("recordHeader")).collect() for h in r.h or [] if h.k == "WARC-Record-ID"]
    ids = [h.v for r in warc.from_files(spark, out).enrich(WarcPayload()).select(h=Pointer("recordHeader")).collect() for h in r.h if h.k == "WARC-Record-ID"]
    assert sorted(ids) == ["<urn:x:http://a.org/>", "<urn:x:http://b.org/>"]


def test_records_in_batches_of_bounded_bytes(spark, tmp_path):
    page = os.urandom(100_000).hex()
    rows = spark.range(40).repartition(1).select(F.concat(F.lit("http://a.org/"), "id").alias("originalUrl"), F.lit("20240101000000").alias("timestamp"), F.concat(F.lit("HTTP/1.1 200 OK\r\n\r\n" + page), F.col("id").cast("string")).cast("binary").alias("content"))
    assert warc.save(Archive(rows, ["originalUrl", "timestamp"], root_func=HttpPayload()), str(tmp_path / "w")) == 40
    [name] = [n for n in os.listdir(tmp_path / "w") if n.endswith(".warc.gz") and n[0] != "."]
    batches = [*warc._Reader({"path": str(tmp_path / "w")}).read(warc._File(str(tmp_path / "w" / name)))]
    assert len(batches) > 5 and max(b.nbytes for b in batches) < 1_600_000 and sum(b.num_rows for b in batches) == 40
    for a in (warc.from_files(spark, str(tmp_path / "w"), Config(text_limit=0)), warc.from_files_with_cdx(spark, str(tmp_path / "w"), Config(text_limit=0))):
        got = a.select("originalUrl", s=StringContent(limit=0)).collect()
        assert sorted(r.originalUrl for r in got) == sorted(f"http://a.org/{i}" for i in range(40)) and all(r.s == page + r.originalUrl[13:] for r in got)


def test_same_name_twice(spark, folder):
    os.makedirs(f"{folder}/sub")
    with open(f"{folder}/sub/two.warc.gz", "wb") as f:
        f.write(b"x")
    with pytest.raises(ValueError, match="two.warc.gz"):
        cdx.file_index(spark, folder)


def test_unreadable_ranges(spark, folder):
    df = spark.createDataFrame([(f"{folder}/two.warc.gz", -1, 5), (f"{folder}/none", 0, 5), (f"{folder}/plain.warc", 0, 8), (None, 0, 1)], "p string, o long, n long")
    got = [r[0] for r in df.select(warc.read_range(F.col("p"), F.col("o"), F.col("n"))).collect()]
    assert got[0] is None and got[1] is None and bytes(got[2]) == b"WARC/1.0" and got[3] is None


def test_max_decompressed(folder):
    with open(f"{folder}/two.warc.gz", "rb") as f:
        assert all(len(r) <= 40 for _, _, r in warc.members(f.read, 40))


def test_files(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text("l1\nl2")
    (tmp_path / "b.txt.gz").write_bytes(gzip.compress(b"<title>T</title>"))
    (tmp_path / "c.bin").write_bytes(b"\x00")
    assert files.files(spark, str(tmp_path)).count() == 3 and files.files(spark, str(tmp_path), [r".*\.txt", r".*\.gz"], 1).count() == 2
    assert files.text_lines(spark, f"{tmp_path}/d/*.txt").count() == 2 and files.text_files(spark, f"{tmp_path}/d/*.txt").first().value == "l1\nl2"
    a = files.of_files(files.files(spark, str(tmp_path), [r".*\.txt\.gz"]))
    assert a.select(t=TITLE).first().t == "T"


def test_lines_are_streamed(spark, tmp_path, monkeypatch):
    whole = b"a\r\nb\rc\n\n" + "é€\n".encode() * 900_000 + b"x" * 3_000_000 + b"\ntail\r"
    zipped = gzip.compress(whole)
    for name, data in {"whole.gz": zipped, "plain.txt": whole, "cut.gz": zipped[:-9], "junk.gz": b"no gzip", "bad.gz": zipped[:40] + b"\xff" * 99 + zipped[139:], "empty.gz": gzip.compress(b""), "none.txt": b""}.items():
        (tmp_path / name).write_bytes(data)
    sizes = []
    chunks = files._chunks
    monkeypatch.setattr(files, "_chunks", lambda p: (sizes.append(len(c)) or c for c in chunks(p)))
    batches = [*files._lines(files._chunks(str(tmp_path / "whole.gz")))]
    assert max(sizes) <= 1 << 20 and len(sizes) > 6 and max(sum(map(len, b)) for b in batches) <= 4_200_000
    monkeypatch.undo()
    found = files.files(spark, str(tmp_path))
    assert "content" not in files.lines(found)._jdf.queryExecution().executedPlan().toString()
    old = found.select(F.explode(files.lines_of(files.decompressed(F.col("content"), F.col("path")))).alias("value"))
    new, old = (df.groupBy("value").count().collect() for df in (files.lines(found), old))
    assert sorted(new) == sorted(old) and sum(r["count"] for r in new) == 2 * 900_005 + 1  # Spark leaves out files of no bytes


def test_hadoop(spark, tmp_path):
    (tmp_path / "x").write_text("a\nb")
    df = files.hadoop(spark, str(tmp_path / "x"), "org.apache.hadoop.mapreduce.lib.input.TextInputFormat", "org.apache.hadoop.io.LongWritable", "org.apache.hadoop.io.Text", "key long, value string")
    assert [r.value for r in df.collect()] == ["a", "b"]


def test_remote(spark, tmp_path):
    line = "org,a)/ 20200101000000 http://a.org/ text/html 200 SHA 120"
    service = remote.Service("http://index.test/cdx", "http://replay.test/{timestamp}id_/{url}")

    def get(url):
        if url.startswith("http://index.test"):
            return None if url.endswith("page=1") else ("HTTP/1.1 200 OK", [], (line + "\n").encode())
        assert url == "http://replay.test/20200101000000id_/http://a.org/"
        return "HTTP/1.1 200 OK", [("content-type", "text/html"), ("x-archive-orig-x-thing", "v"), ("Date", "no")], b"<title>W</title>"

    a = remote.from_service(spark, service, "a.org", match_prefix=True, from_=2019, to=2021, pages=3, get=get)
    rows = a.select("originalUrl", "compressedSize", t=TITLE, h=Pointer("httpHeader")).collect()
    assert len(rows) == 2 and rows[0].t == "W" and rows[0].compressedSize == 120
    assert [tuple(h) for h in rows[0].h] == [("Content-Type", "text/html"), ("X-Thing", "v")]
    assert remote.captures(spark, "http://index.test/cdx?url=a", pages=1, get=get).count() == 1
    with pytest.raises(Exception, match="can't fetch"):
        remote.captures(spark, "http://index.test/cdx?url=a", pages=1, get=lambda u: None, strict=True).count()
    assert "matchType=prefix" in remote.cdx_query("s", "a", True) and "from" not in remote.cdx_query("s", "a")
    (tmp_path / "l.cdx").write_text(line.replace("SHA 120", "SHA - - 120") + "\n")
    assert remote.from_local_cdx(spark, f"{tmp_path}/l.cdx", service.replay, get).select(t=TITLE).first().t == "W"
    assert spark.createDataFrame([("x",), (None,)], "u string").select(remote.text_of(F.col("u"), lambda u: None)).first()[0] is None


def test_http_payload_of_junk(spark):
    df = spark.createDataFrame([(1, bytearray(b"junk")), (2, None)], "id long, content binary")
    assert Archive(df, ["id"], root_func=HttpPayload()).select(p=StringContent()).collect() == [(None,), (None,)]


def test_graph(spark):
    e = spark.createDataFrame([("a", "b"), ("a", "c"), ("b", "a"), (None, "z")], "src string, dst string")
    assert {r.url: (r.in_degree, r.out_degree) for r in graph.degrees(e).collect()} == {"a": (1, 2), "b": (1, 1), "c": (1, 0)}
    assert graph.n_vertices(e).first().n == 4 and graph.with_ids(e).count() == 3
    ids = {r.url: r.id for r in graph.vertices(e).collect()}
    assert (ids["a"], ids["b"]) in {tuple(r) for r in graph.with_ids(e).collect()}


def test_revisits(spark):
    rows = [("d", "warc/revisit", "3", None, None, None), ("d", "text/html", "2", "g", 7, 70), ("d", "text/html", "1", "f", 5, 50), ("e", "warc/revisit", "1", None, None, None)]
    got = revisits.resolved(spark.createDataFrame(rows, "digest string, mime string, timestamp string, filename string, offset long, compressedSize long")).collect()
    assert sorted((r.digest, r.timestamp, r.filename or "", r.offset or 0) for r in got) == [("d", "1", "f", 5), ("d", "2", "g", 7), ("d", "3", "f", 5), ("e", "1", "", 0)]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.cdx").write_text("\n".join([LINES[1], LINES[1], LINES[3]]))
    rows = streaming.distinct(streaming.captures(spark, f"{tmp_path}/in"), "surtUrl")
    q = rows.writeStream.format("memory").queryName("seen").option("checkpointLocation", f"{tmp_path}/ck").start()
    try:
        q.processAllAvailable()
        assert sorted(r.surtUrl for r in spark.table("seen").collect()) == ["org,a)/", "org,b)/"]
    finally:
        q.stop()


def test_arc_records(spark, tmp_path):
    def member(url, mime, block):
        return gzip.compress(f"{url} 1.2.3.4 20010203040506 {mime} {len(block)}\n".encode() + block + b"\n")

    http = _html("Old").encode()
    with open(tmp_path / "a.arc.gz", "wb") as f:
        f.write(member("filedesc://a.arc", "text/plain", b"1 0 x\n") + member("http://a.org/x", "text/html", http) + member("dns:a.org", "text/dns", b"1.2.3.4"))
    rows = warc.scan(spark, f"file:{tmp_path}").collect()
    assert [(r.originalUrl, r.timestamp, r.status, r.mime) for r in rows] == [("http://a.org/x", "20010203040506", 200, "text/html")]
    assert warc.scan(spark, str(tmp_path), others=True).count() == 3
    assert [r.t for r in warc.from_files(spark, str(tmp_path)).select(t=TITLE).collect()] == ["Old"]


def test_file_systems(spark, folder):
    from pyspark.errors import PySparkException

    from sedimenta.sources import store

    assert store.opened("file:///a/b")[1] == store.opened("file:/a/b")[1] == store.opened("/a/b")[1] == "/a/b"
    with pytest.raises(ValueError, match="nowhere"):
        store.opened("nowhere://host/x")
    with pytest.raises(PySparkException, match="nowhere"):
        warc.scan(spark, "nowhere://host/x").collect()
    with pytest.raises(PySparkException):
        warc.scan(spark, f"{folder}/missing").collect()
    df = spark.createDataFrame([("nowhere://h/x", 0, 5)], "p string, o long, n long")
    with pytest.raises(PySparkException, match="nowhere"):
        df.select(warc.read_range(F.col("p"), F.col("o"), F.col("n"))).collect()


def test_ranges_in_any_order_and_limited(spark, folder):
    rows = warc.scan(spark, f"{folder}/two.warc.gz").collect()
    asked = [(r.path, r.offset, r.compressedSize) for r in reversed(rows)] + [(f"file:{rows[0].path}", rows[0].offset, rows[0].compressedSize), (f"{folder}/none", 0, 1)] + [(r.path, r.offset, r.compressedSize) for r in rows]
    df = spark.createDataFrame(asked, "p string, o long, n long").coalesce(1)
    got = [r[0] for r in df.select(warc.read_range(F.col("p"), F.col("o"), F.col("n"))).collect()]
    want = [bytes(r.content) for r in rows]
    assert [bytes(x) if x is not None else None for x in got] == [*reversed(want), want[0], None, *want]
    short = df.select(warc.read_range(F.col("p"), F.col("o"), F.col("n"), 10)).first()[0]
    assert len(short) == 10
    assert warc.from_files(spark, f"{folder}/two.warc.gz", Config(max_decompressed=230)).df.select(F.max(F.length("content"))).first()[0] == 230


def test_written_tables_are_below_the_applications_folder(spark):
    from sedimenta.plans import scratch

    path = scratch.path(spark, "x")
    spark.range(1).write.parquet(path)
    assert path.startswith(scratch.folder(spark)) and spark.conf.get("spark.app.id") in path
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    assert system.exists(at)


def test_save_rows(spark, tmp_path):
    from sedimenta.archive import save_rows

    rows = [("a\tb", 'q"x', None), ("", "l1\nl2", "é")]
    df = spark.createDataFrame(rows, "a string, b string, c string")
    for separator in "\t,":
        out = f"{tmp_path}/{ord(separator)}"
        save_rows(df, out, separator, header=True)
        back = spark.read.options(sep=separator, header="true", escape='"', multiLine="true").csv(out)
        assert sorted((r.a or "", r.b, r.c) for r in back.collect()) == sorted((a, b, c) for a, b, c in rows)


def test_registry(spark, folder):
    from sedimenta.sources import registry

    assert {"cdx", "warc", "warc-cdx", "files"} <= set(registry.names())
    assert sorted(r.t for r in registry.open_source(spark, "warc", f"{folder}/two.warc.gz", revisits=False).select(t=TITLE).collect()) == ["A é", "B"]
    assert registry.open_source(spark, "files", folder, patterns=[r"plain\.warc"]).df.count() == 1

    class Numbers(registry.Source):
        def __init__(self, n):
            self.n = n

        def load(self, spark):
            return spark.range(self.n)

    registry.register("numbers", Numbers)
    assert registry.open_source(spark, "numbers", 3).filter("id > 0").df.count() == 2
    with pytest.raises(KeyError, match="numbers"):
        registry.open_source(spark, "none")


def test_cleanup_of_a_partition(spark, tmp_path):
    from sedimenta.archive import Field
    from sedimenta.operators.functions import Func
    from sedimenta.operators.paths import parse

    log = str(tmp_path)

    def setup():
        import uuid

        name = uuid.uuid4().hex
        open(f"{log}/made-{name}", "w").close()
        return name

    def cleanup(name):
        os.rename(f"{log}/made-{name}", f"{log}/closed-{name}")

    def derive(v, name):
        if v == "5":
            raise ValueError("five")
        return {"x": v + "!"}

    df = spark.range(40).selectExpr("id", "cast(id AS string) AS text").repartition(3)
    a = Archive(df, ["id"], {parse("payload.string"): Field("text", "string", hidden=True)})
    f = Func({"x": "string"}, py=derive, setup=setup, cleanup=cleanup)
    rows = a.enrich(f).select("id", x=f).collect()
    assert {r.id: r.x for r in rows} == {k: None if k == 5 else f"{k}!" for k in range(40)}
    names = os.listdir(tmp_path)
    assert names and all(n.startswith("closed-") for n in names)


def test_navigation(spark):
    df = spark.createDataFrame([(1, "http://a.org/", "<title>T</title>")], "page_id long, url string, html string")
    a = Archive.of_pages(df).enrich(TITLE)
    assert "payload.string.html.title.text" in a.fields() and a.fields()["payload.string.html.title.text"] == "string"
    assert a.enrichments("payload.string.html") == ["title"] and a.enrichments("payload.string.html.title") == ["text"]
    assert [p.path[-1] for p in Pointer("payload.string.html").chain] == ["payload", "string", "html"]
