import json
import warnings

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedimenta.archive import Archive, Config, load_json, save_text, table
from sedimenta.operators import paths
from sedimenta.operators.functions import AbsoluteUrl, Entities, Html, HtmlAttribute, HtmlText, LowerCase, SURT, Values
from sedimenta.operators.paths import Pointer

TITLE = HtmlText().of(Html.first("title"))
LINKS = Html.all("a")
HREF = HtmlAttribute("href").of_each(LINKS)
TEXT = HtmlText().of_each(LINKS)
PAGES = [
    (1, "http://a.org/x/", '<html><head><title>One &amp; only</title></head><body><a href="/1">first</a><a>none</a><a href="2">second</a></body></html>'),
    (2, "http://b.org/", "<html><body><p>no links, no title</p></body></html>"),
    (3, "http://c.org/", ""),
    (4, "http://d.org/", None),
]


@pytest.fixture
def pages(spark):
    return Archive.of_pages(spark.createDataFrame(PAGES, "page_id long, url string, html string"))


name = st.text("abcxyz_", min_size=1, max_size=5)
segment = st.one_of(name, st.integers(0, 99).map(lambda i: f"[{i}]"), st.just("*"))


@given(name, st.lists(segment, max_size=6))
def test_paths_print_and_parse(first, rest):
    path = (first, *rest)
    assert paths.parse(paths.show(path)) == path


def test_path_spellings():
    assert paths.parse("a.b[3].c*") == ("a", "b", "[3]", "c", "*") and paths.parse("a.*") == ("a", "*") and paths.parse("") == ()
    assert paths.parse(["", "title"]) == ("", "title")
    p = Pointer("a.b*.c")
    assert p.parent.path == ("a", "b", "*") and p.sibling("d").path == ("a", "b", "*", "d") and p.up(2).path == ("a",)
    assert LINKS.each.path[-2:] == ("a", "*") and LINKS.single(2).path[-1] == "[2]" and LINKS.root.path == ()


def test_title(pages):
    a = pages.enrich(TITLE)
    assert [r[0] for r in a.select(t=TITLE).collect()] == ["One & only", None, None, None]
    assert json.loads(a.to_json().first()[0]) == {"record": {"page_id": 1, "originalUrl": "http://a.org/x/"}, "payload": {"string": {"html": {"title": {"text": "One & only"}}}}}
    assert json.loads(a.peek_json(1)) == {"record": {"page_id": 2, "originalUrl": "http://b.org/"}}


def test_hidden_then_shown(pages):
    a = pages.enrich(TITLE).enrich(Html.first("title"))
    assert json.loads(a.to_json().first()[0])["payload"]["string"]["html"]["title"] == {"_": "<title>One &amp; only</title>", "text": "One & only"}


def test_links(pages):
    a = pages.enrich(HREF).enrich(TEXT)
    html = json.loads(a.to_json().first()[0])["payload"]["string"]["html"]
    assert html["a"] == [{"attributes": {"href": "/1"}, "text": "first"}, {"text": "none"}, {"attributes": {"href": "2"}, "text": "second"}]
    assert [r.value for r in a.flat_map_values(HREF).collect()] == ["/1", "2"]  # the missing one is dropped
    assert a.select(x=Pointer("payload.string.html.a[2].attributes.href")).first().x == "2"
    assert a.select(x=Pointer("payload.string.html.a[7].attributes.href")).first().x is None
    assert [r.value for r in a.flat_map_values(AbsoluteUrl().of(HREF)).collect()] == ["http://a.org/1", "http://a.org/x/2"]
    assert [r.value for r in a.flat_map_values(SURT().of(HREF)).collect()] == ["org,a)/1", "org,a)/x/2"]


def test_scalar_reads_as_list(pages):
    a = pages.enrich(TITLE)
    assert a.select(x=Pointer("payload.string.html.title[0].text")).first().x == "One & only"
    assert not a.has("payload.string.html.title[1].text") and a.select(x=Pointer(["", "title", "text"])).first().x == "One & only"


def test_values(pages):
    edge = Values(Pointer("page_id"), HREF, TEXT).of_each(LINKS)
    got = [r.value for r in pages.flat_map_values(edge).collect()]
    assert got == [["1", "/1", "first"], ["1", "2", "second"]] and edge.default == "page_id_href_text"
    whole = edge.with_defaults(None, "-")
    assert [r.value for r in pages.flat_map_values(whole).collect()][1] == ["1", "-", "none"]
    pair = Values(Pointer("page_id"), TITLE, field="pair")
    assert [r.p for r in pages.select(p=pair).collect()] == [["1", "One & only"], None, None, None]


def test_maps(pages):
    low = LowerCase().of(TITLE)
    words = TITLE.map_multi("words", lambda c: F.split(c, " "))
    assert pages.select(x=low).first().x == "one & only"
    assert pages.select(x=words).first().x == ["One", "&", "only"]
    assert pages.select(x=words.each.map("n", F.length, "int")).first().x == [3, 1, 4]
    assert pages.select(x=TITLE.map_identity("same").map("up", F.upper)).first().x == "ONE & ONLY"
    assert json.loads(pages.enrich(TITLE.map_identity("same").map("up", F.upper)).to_json().first()[0])["payload"]["string"]["html"]["title"]["text"] == {"same": {"up": "ONE & ONLY"}}


def test_first_writer_wins(pages):
    a = pages.enrich(Html("a", 0))
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        b = a.enrich(Html("a", 2))
    assert b.select(x=Html("a", 2)).first().x == '<a href="/1">first</a>'


def test_filters(pages):
    ids = lambda a: [r.page_id for r in a.df.select("page_id").collect()]
    assert ids(pages.filter_exists(TITLE)) == [] and ids(pages.enrich(TITLE).filter_exists(TITLE)) == [1]
    assert ids(pages.filter_non_empty(LINKS)) == [1] and ids(pages.filter_non_empty(TITLE)) == [1]
    assert ids(pages.filter_value(TITLE, lambda c: c.isNull())) == [2, 3, 4]
    assert ids(pages.filter("page_id > 2").enrich(TITLE)) == [3, 4]
    assert [r.value for r in pages.map_values(TITLE).collect()] == ["One & only"]
    a = pages.enrich(TITLE)
    assert [r[0] for r in a.df.select(a.value_or_else(TITLE, "?")).collect()] == ["One & only", "?", "?", "?"]


def test_errors(pages):
    fails = Pointer("page_id").map_python("inverse", lambda v: 1 // (v - 2), "int")
    a = pages.enrich(fails)
    assert [r.page_id for r in a.filter_no_exception().df.collect()] == [1, 3, 4] and "ZeroDivisionError" in a.last_exception()
    assert json.loads(a.peek_json(1))["error"].startswith("ZeroDivisionError")
    assert a.enrich(TITLE).last_exception() is None  # each enrich starts anew
    strict = Archive(pages.df, pages.record, pages.tree, Config(catch_exceptions=False)).enrich(fails)
    with pytest.raises(Exception, match="ZeroDivisionError"):
        strict.df.collect()
    quiet = Archive(pages.df, pages.record, pages.tree, Config(include_errors=False)).enrich(fails)
    assert "error" not in json.loads(quiet.peek_json(1))


def test_distinct(spark):
    rows = [(1, "a", 5), (2, "a", 5), (3, "b", 1), (4, None, 9), (5, None, 2)]
    a = Archive(spark.createDataFrame(rows, "id long, k string, t int"), ["id", "k", "t"])
    assert sorted(r.id for r in a.distinct_value("k", ["t", "id"]).df.collect()) == [1, 3, 5]
    got = a.distinct_by("k", lambda x, y: x if x["t"] >= y["t"] else y).collect()
    assert {r.k: r.t for r in got} == {"a": 5, "b": 1, None: 9}
    assert [tuple(r) for r in a.count_by_value(Pointer("k")).collect()] == [("a", 2), ("b", 1)]
    assert [r.id for r in a.filter_in("k", spark.createDataFrame([("b",), ("b",)], "x string"), "x").df.collect()] == [3]


def test_filters_stay_above_distinct(spark):
    rows = [(1, "a", 5), (2, "a", 6)]
    a = Archive(spark.createDataFrame(rows, "id long, k string, t int"), ["id", "k", "t"]).enrich(Pointer("id").map("x", lambda c: c + 1, "long"))
    assert a.distinct_value("k", ["t"]).filter("t > 5").df.count() == 0 and a.filter("t > 5").distinct_value("k", ["t"]).df.count() == 1
    assert a.filter(F.col("`v:id.x`") > 2).df.count() == 1


def test_entities_either_spelling(spark):
    df = spark.createDataFrame([(1, "u", "<body>Dr. Ada Bell in Paris, 1999</body>")], "page_id long, url string, html string")
    a = Archive.of_pages(df).enrich(Entities())
    row = a.select(l=Entities().child("locations"), d=Entities().get("dates"), p=Entities()).first()
    assert (row.l, row.d, row.p) == (["Paris"], ["1999"], ["Ada Bell"])


def test_json_round_trip(spark, pages, tmp_path):
    a = pages.enrich(TITLE).enrich(HREF)
    for name in ("plain", "zipped.gz"):
        a.save_json(f"{tmp_path}/{name}")
        back = load_json(spark, f"{tmp_path}/{name}", a.schema())
        assert sorted(r[0] for r in back.select(F.to_json(F.struct("*"))).collect()) == sorted(r[0] for r in a.to_json().collect())


def test_text_and_table(spark, tmp_path):
    df = spark.range(5).select(F.col("id").cast("string").alias("value"))
    assert save_text(df, f"{tmp_path}/t") == 5 and table(df, 2).startswith("%table value\n0")


def test_udf_runs_once_a_row(spark, pages):
    seen = spark.sparkContext.accumulator(0)

    def f(v):
        seen.add(1)
        return str(v)

    a = pages.filter("page_id < 3").filter_value(Pointer("page_id").map_python("s", f), lambda c: c != "9")
    assert a.select(s=Pointer("s")).count() == 2
    a.df.collect()
    seen.value = 0
    a.df.collect()
    assert seen.value == 2


def test_plan_prunes_and_pushes(spark, pages, tmp_path):
    pages.df.write.parquet(f"{tmp_path}/p")
    a = Archive.of_pages(spark.read.parquet(f"{tmp_path}/p"), url="originalUrl").filter("page_id = 1").enrich(TITLE)
    plan = a.select("page_id", t=TITLE)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(page_id), EqualTo(page_id,1)]" in plan
    late = Archive.of_pages(spark.read.parquet(f"{tmp_path}/p"), url="originalUrl").enrich(TITLE).filter_value(TITLE, lambda c: c.isNotNull()).filter("page_id = 1")
    assert "EqualTo(page_id,1)]" in late.df._jdf.queryExecution().toString() and [r.t for r in late.select(t=TITLE).collect()] == ["One & only"]
    bare = a.df.select("originalUrl")._jdf.queryExecution().sparkPlan().toString()
    assert "html" not in bare.split("ReadSchema")[1]


@pytest.mark.parametrize("func", [HtmlText().of(Html.first("body")), HtmlText(), SURT().of(HREF)], ids=["title_text_tsv", "body_text", "surt_links"])
def test_a_batch_is_handed_back_in_slices(spark, monkeypatch, func):
    import pyarrow as pa

    runs, real = [], F.arrow_udf
    monkeypatch.setattr(F, "arrow_udf", lambda f, kind: runs.append(f) or real(f, kind))
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    spark.conf.unset(name)
    Archive.of_pages(spark.createDataFrame(PAGES, "page_id int, url string, html string")).select("page_id", x=func)
    assert int(spark.conf.get(name)) == 1000
    first = runs[0]
    page = "<body>" + "y" * 10_000 + "<a href='/z'>z</a></body>"
    parts = [*first(iter([pa.array([page] * 3000), pa.array([], pa.string())]))]
    assert len(parts) > 20 and sum(map(len, parts)) == 3000 and max(p.nbytes for p in parts) < 1_200_000
