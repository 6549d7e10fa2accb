"""Revisit records: captures without a payload of their own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(captures: DataFrame) -> DataFrame:
    """Revisits get the location (``filename``, ``offset``, ``compressedSize``) of the earliest full capture of their digest."""
    full = captures.filter("mime <> 'warc/revisit' and digest is not null")
    first = full.withColumn("n", F.row_number().over(Window.partitionBy("digest").orderBy("timestamp", "filename", "offset"))).filter("n = 1")
    first = first.select("digest", F.struct("filename", "offset", "compressedSize").alias("at"))
    revisit = F.col("mime") == "warc/revisit"
    out = captures.join(first, "digest", "left")
    for c in ("filename", "offset", "compressedSize"):
        out = out.withColumn(c, F.when(revisit & F.col("at").isNotNull(), F.col(f"at.{c}")).otherwise(F.col(c)))
    return out.select(captures.columns)
