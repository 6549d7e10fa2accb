import duckdb
import pytest
from pyspark.sql import functions as F

from sedimenta.llm import lines, mixing

ROWS = [(i, f"own {i}\nshared line\n\nshared line\nlast {i}", f"s{i % 2}") for i in range(40)]
ODD = [(100, None, "s0"), (101, "", "s1"), (102, "shared line", None), (102, "shared line", None), (None, "x y", "s0"), (103, "word " * 5000, "s1"), (104, " \n\t\n", "s2")]


def _same(df, sql, docs):
    want = duckdb.connect()
    want.register("documents", docs.toArrow())
    r = want.sql(sql)
    cols = r.columns
    assert sorted(cols) == sorted(df.columns)
    assert sorted(repr(tuple(x[c] for c in cols)) for x in df.collect()) == sorted(map(repr, r.fetchall()))


@pytest.mark.parametrize("rows", [ROWS + ODD, ROWS, ODD, [], [(1, "a\nb")]])
def test_lines_as_sql(docs, rows):
    d = docs(rows)
    got = lines.drop_lines(d, F.col("source")).select("doc_id", "text", "n_lines", "n_dropped")
    _same(got, lines.ORACLES["op1_line_dedup"], d)


def test_lines_drop_and_keep(docs):
    got = {r.doc_id: r for r in lines.drop_lines(docs(ROWS + ODD, "site bad lines _site"), F.col("source")).collect()}
    assert got[1].text == "own 1\n\nlast 1" and got[1].n_dropped == 2 and got[1].site == "clash"
    assert got[100].text is None and got[100].n_lines == 0
    assert got[102].text == "shared line"  # on two pages, which show no habit


def test_host(spark):
    urls = ["https://u@WWW.A.org:80/x", "http://b.org", "nope", None, "//c.org/x"]
    got = spark.createDataFrame([(u,) for u in urls], "url string").select(lines.host().alias("h")).collect()
    assert [r.h for r in got] == ["www.a.org", "b.org", None, None, None]
    pages = spark.createDataFrame([(k, f"http://h{k % 2}.org/{k}", f"menu {k % 2}\nown {k}") for k in range(8)], "page_id long, url string, text string")
    assert {r.text for r in lines.drop_lines(pages, lines.host()).collect()} == {f"own {k}" for k in range(8)}


@pytest.mark.parametrize("rows", [ROWS + ODD, ROWS, ODD, [], [(1, "a b c")], [(i, "a " * (i + 1), f"s{i}") for i in range(9)]])
def test_mix_as_sql(docs, rows):
    d = docs(rows, "target base size")
    got = mixing.mix(d).select("doc_id", "size", "source_size", "target", "taken")
    _same(got, mixing.ORACLES["op3_mix_sources"], d.drop("target", "base", "size"))


def test_mix_meets_targets(docs):
    rows = [(i, "w " * (1 + i % 13), "abcdefgh"[min(i % 16, 7)]) for i in range(4000)]
    d = docs(rows, "target edge repeats")
    per = mixing.mix(d).groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("goal"), F.max(F.col("taken") / F.col("size")).alias("most")).collect()
    assert all(abs(r.t - r.goal) <= 13 and r.most <= 3 for r in per)
    taken = {r.doc_id: r.repeats for r in mixing.mix(d).collect()}
    out = mixing.mixed(d)
    assert out.columns == d.columns
    assert {r.doc_id: r["count"] for r in out.groupBy("doc_id").count().collect()} == {k: v for k, v in taken.items() if v}
