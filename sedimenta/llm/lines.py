"""Line dedup by site-relative frequency.

A line is boilerplate on a site when the share of the site's pages that hold it exceeds ``ratio``. Pages are counted
once for a line however often they repeat it. All counting is partially aggregated by (site, line hash), so a site with
a third of all pages is no bottleneck, and a site can't have more than (lines a page) / ``ratio`` such lines, which
bounds what its pages are joined with. Lines are compared by the 64-bit hash of their trimmed text.

Defined results: a null text stays null; blank lines are never boilerplate; lines that are kept are kept unchanged and
in order, repeats included; a null site is a site of its own; a line held by fewer than ``min_pages`` pages is kept at
any share, as one or two pages show no habit of the site; a page of boilerplate alone becomes empty but stays a row;
repeated rows count as pages. Further columns are passed through (those named as a count are replaced by it).

Documents have no URL, so the query takes ``source`` as the site; for pages, ``host`` gives it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.llm.common import documents, written

RATIO = 0.02
MIN_PAGES = 3


def _hash(line: Column) -> Column:
    return F.xxhash64(F.trim(line))


def host(url: str = "url") -> Column:
    """The host of a URL in lower case, null if there is none."""
    found = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(found != "", found)


def boilerplate(docs: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(site, bad array<bigint>): the hashes of each site's boilerplate lines. Sites without any are absent."""
    pages = docs.select(site.alias("site"), F.split(F.col(text), "\n").alias("lines"))
    hashes = F.array_distinct(F.transform(F.filter("lines", lambda x: F.length(F.trim(x)) > 0), _hash))
    per_line = pages.select("site", F.explode(hashes).alias("line")).groupBy("site", "line").agg(F.count("*").alias("n")).filter(F.col("n") >= min_pages)
    totals = docs.groupBy(site.alias("site")).agg(F.count("*").alias("pages"))
    bad = per_line.join(totals, per_line["site"].eqNullSafe(totals["site"])).filter(F.col("n") > F.col("pages") * ratio)
    return bad.groupBy(per_line["site"].alias("site")).agg(F.collect_set("line").alias("bad"))


def drop_lines(docs: DataFrame, site: Column, text: str = "text", ratio: float = RATIO, min_pages: int = MIN_PAGES, counts: tuple[str, str] = ("n_lines", "n_dropped")) -> DataFrame:
    """``docs`` with boilerplate lines cut from ``text``, plus the numbers of lines and of dropped lines under the names ``counts``."""
    # written, so that its true size decides between a broadcast and a shuffle (in which AQE splits hot sites)
    bad = written(boilerplate(docs, site, text, ratio, min_pages), "boilerplate").toDF("_line_site", "_line_bad")
    joined = docs.withColumn("_line_key", site).join(bad, F.col("_line_key").eqNullSafe(F.col("_line_site")), "left")
    lines = F.split(F.col(text), "\n")
    kept = F.when(F.col("_line_bad").isNull(), lines).otherwise(F.filter(lines, lambda x: (F.length(F.trim(x)) == 0) | ~F.array_contains("_line_bad", _hash(x))))
    out = joined.withColumn("_line_kept", kept).withColumn("_line_all", lines)
    n_all = F.when(F.col("_line_all").isNull(), 0).otherwise(F.size("_line_all")).cast("long")
    n_kept = F.when(F.col("_line_all").isNull(), 0).otherwise(F.size("_line_kept")).cast("long")
    cols = [F.array_join("_line_kept", "\n").alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns if c not in counts]
    return out.select(*cols, n_all.alias(counts[0]), (n_all - n_kept).alias(counts[1]))


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "source", "text")
    return drop_lines(docs, F.col("source")).select("doc_id", "text", "n_lines", "n_dropped")


def lines_sql(docs: str, select: str) -> str:
    return rf"""
    ln_pages AS (SELECT source AS site, count(*) AS pages FROM {docs} GROUP BY 1),
    ln_each AS (SELECT source AS site, unnest(list_distinct(list_transform(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> ''), lambda x: trim(x, ' ')))) AS line FROM {docs}),
    ln_bad AS (SELECT e.site, list(e.line) AS bad FROM (SELECT site, line, count(*) AS n FROM ln_each GROUP BY ALL) e
        JOIN ln_pages p ON e.site IS NOT DISTINCT FROM p.site WHERE n >= {MIN_PAGES} AND n > pages * {RATIO} GROUP BY 1),
    ln_kept AS (SELECT d.*, string_split(text, chr(10)) AS all_lines,
        list_filter(string_split(text, chr(10)), lambda x: bad IS NULL OR trim(x, ' ') = '' OR NOT list_contains(bad, trim(x, ' '))) AS kept
        FROM {docs} d LEFT JOIN ln_bad b ON d.source IS NOT DISTINCT FROM b.site),
    lined AS (SELECT * EXCLUDE (text, all_lines, kept), array_to_string(kept, chr(10)) AS text, coalesce(len(all_lines), 0)::BIGINT AS n_lines,
        coalesce(len(all_lines) - len(kept), 0)::BIGINT AS n_dropped FROM ln_kept)
    {select}"""


QUERIES = {"op1_line_dedup": op1_line_dedup}
ORACLES = {"op1_line_dedup": "WITH " + lines_sql("documents", "SELECT doc_id, text, n_lines, n_dropped FROM lined").lstrip()}
