from sedimenta.functions import entities, http, markup, urls

BASIC = """<HTML><head><title>A &amp; B</title><style>p{}</style></head><body><h1>Top</h1><p>one <a href="/x?a=1&amp;b=2">first</a></p>
<p>two <a HREF='http://o.org/'>second</a></p><p>three <a>third</a></p><div>out<div>in</div></div><!-- <a href=no>no</a> --><script>var t="</p><a>";</script></body></HTML>"""


def test_outer():
    assert markup.outer(BASIC, "title") == ["<title>A &amp; B</title>"]
    assert [x[:2] for x in markup.outer(BASIC, "a")] == ["<a"] * 3 and len(markup.outer(BASIC, "p")) == 3
    assert markup.outer(BASIC, "div") == ["<div>out<div>in</div></div>", "<div>in</div>"]
    assert markup.outer(BASIC, "div", 1) == ["<div>out<div>in</div></div>"]
    assert markup.outer(BASIC, "h2") == [] and markup.outer(None, "p") == [] and markup.outer("", "p") == []
    assert markup.outer("<p>a<p>b", "p") == ["<p>a", "<p>b"]
    assert markup.outer("<body>x", "body") == ["<body>x"]
    assert markup.outer("<br><br/>", "br") == ["<br>", "<br/>"]


def test_text():
    assert markup.text(BASIC) == "Top one first two second three third out in"
    assert markup.text(None) is None and markup.text("") == "" and markup.text("a<b>b</b>c<br>d") == "abc d"


def test_attribute():
    assert [markup.attribute(a, "href") for a in markup.outer(BASIC, "a")] == ["/x?a=1&b=2", "http://o.org/", None]
    assert markup.attribute("no tag", "href") is None and markup.attribute("<a x=1><b href=2>", "href") is None


def test_http():
    raw = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=iso-8859-1; x=y\r\nA: 1\r\nA: 2\r\n\r\nbody"
    status, header, body = http.http_message(raw)
    assert (status, body) == ("HTTP/1.1 200 OK", b"body") and http.header_value(header, "A") == "2"
    assert http.mime(header) == "text/html" and http.charset(header) == "iso-8859-1"
    assert http.charset([("Content-Type", "text/html; x=y; charset=utf-8")]) is None and http.mime([("content-type", "a/b")]) is None
    assert http.http_message(b"junk") is None
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n4\r\nabcd\r\n2\r\nef\r\n0\r\n\r\n"
    assert http.http_message(chunked)[2] == b"abcdef"


def test_string_content():
    head = [("Content-Type", "text/html; charset=iso-8859-1")]
    assert http.string_content(" é ".encode("latin-1"), head) == "é"
    assert http.string_content(b'<meta charset="iso-8859-1">\xe9', [("Content-Type", "text/html")]).endswith("é")
    assert http.string_content("é".encode()) == "é" and http.string_content(b"\xff\xe9") == "ÿé" and http.string_content(None) is None
    assert len(http.string_content(b"a" * (2 << 20))) == 1 << 20
    assert http.string_content(b"a" * ((1 << 20) - 1) + "é".encode())[-1] == "a"


def test_urls():
    assert urls.surt_py("http://example.org/web") == "org,example)/web"
    assert urls.surt_py("https://WWW2.Example.co.uk:8080/a?b#c") == "uk,co,example:8080)/a?b"
    assert urls.surt_py("http://a.org") == "org,a)/" and urls.surt_py("/x", "http://a.org/y") == "org,a)/x" and urls.surt_py("nope") is None
    assert urls.absolute_py("../z", "http://a.org/x/y") == "http://a.org/z" and urls.absolute_py(None, "http://a.org") is None


def test_url_columns(spark):
    from pyspark.sql import functions as F

    links = ["/r", "r", "?q", "#f", "", "//b.org/x", "http://c.org/", "mailto:x@y"]
    df = spark.createDataFrame([(x, "http://www.a.org/p/q?z#y") for x in links] + [(None, "http://a.org")], "link string, base string")
    rows = df.select("link", "base", urls.absolute(F.col("link"), F.col("base")).alias("a")).collect()
    for r in rows:
        want = urls.absolute_py(r.link, r.base)
        assert r.a == (want if r.link != "" else "http://www.a.org/p/q?z"), r
    many = ["http://example.org/web", "https://WWW2.Example.co.uk:8080/a?b#c", "http://a.org", "http://a.org?x", "nope", "http://u@b.org:80/"]
    got = spark.createDataFrame([(u,) for u in many], "u string").select("u", urls.surt(F.col("u")).alias("s")).collect()
    assert all(r.s == urls.surt_py(r.u) for r in got)


def test_entities():
    tag = entities.gazetteer()
    found = entities.grouped(tag("Dr. Ada Bell met Acme Corp in Paris and Paris on 3 May 1999."), {"PERSON": "p", "LOCATION": "l", "DATE": "d", "ORGANIZATION": "o"})
    assert found == {"p": ["Ada Bell"], "l": ["Paris"], "d": ["3 May 1999"], "o": ["Acme Corp"]}
    assert entities.clean_latin("a  日 b") == "a b"


def test_truncated_tags_take_linear_time():
    import time

    began = time.time()
    for html in ("<a" * 500_000, "<" + "a" * 1_000_000, "<a " * 300_000 + ">", '<a b="' * 200_000 + ">", "<a b='>" * 100_000, "<!--" * 200_000, "</p " * 200_000 + ">", "<script>" + "</script " * 100_000):
        markup.text(html), markup.outer(html, "a"), markup.attribute(html, "href")
    assert time.time() - began < 8
    assert markup.text("<a" * 1000) == "<a" * 1000 and markup.text("x <p title=it's>y don't</p> z<!-- c") == "x y don't z"
    assert markup.outer('<a title="x>y" href=z>t</a>', "a") == ['<a title="x>y" href=z>t</a>']
