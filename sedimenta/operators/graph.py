"""Hyperlink graphs from edge lists, with DataFrame joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def vertices(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(id, url): every end of an edge; the id is a 128-bit digest of the URL, so it needs no dictionary and never changes."""
    urls = edges.select(F.col(src).alias("url")).unionAll(edges.select(F.col(dst).alias("url"))).filter("url is not null").distinct()
    return urls.select(F.md5(F.col("url").cast("binary")).alias("id"), "url")


def with_ids(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(src_id, dst_id) of each edge; no join is needed."""
    return edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.md5(F.col(src).cast("binary")).alias("src_id"), F.md5(F.col(dst).cast("binary")).alias("dst_id"))


def degrees(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(url, in_degree, out_degree)."""
    ends = edges.filter(F.col(src).isNotNull() & F.col(dst).isNotNull()).select(F.explode(F.array(F.struct(F.col(src).alias("url"), F.lit(0).alias("i"), F.lit(1).alias("o")), F.struct(F.col(dst).alias("url"), F.lit(1).alias("i"), F.lit(0).alias("o")))).alias("e"))
    return ends.groupBy(F.col("e.url").alias("url")).agg(F.sum("e.i").alias("in_degree"), F.sum("e.o").alias("out_degree"))


def n_vertices(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    return vertices(edges, src, dst).agg(F.count("*").alias("n"))
