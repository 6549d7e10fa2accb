"""Capture indexes (CDX): lines to rows and back, and rows to the files that hold the records.

Eleven columns, separated by blanks: SURT, 14-digit timestamp, URL, MIME type, status, digest, redirect, meta,
compressed size, offset, file name. ``-`` is a missing value. Lines of fewer than nine columns and the header line are
dropped.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

COLUMNS = ["surtUrl", "timestamp", "originalUrl", "mime", "status", "digest", "redirectUrl", "meta", "compressedSize", "offset", "filename"]
_NUMBERS = {"status": "int", "compressedSize": "bigint", "offset": "bigint"}
ARCHIVES = (r"(?i).*\.(arc|warc|wat)\.gz",)


def parse_lines(lines: DataFrame, column: str = "value") -> DataFrame:
    """Text lines to capture rows, plus ``time``."""
    parts = lines.filter(~F.col(column).startswith(" CDX")).select(F.split(F.trim(column), " +").alias("p")).filter(F.size("p") >= 9)
    cols = []
    for k, name in enumerate(COLUMNS):
        v = F.get("p", F.lit(k))
        v = F.when(v != "-", v)
        cols.append((F.when(v.rlike(r"^-?[0-9]+$"), v).cast(_NUMBERS[name]) if name in _NUMBERS else v).alias(name))
    rows = parts.select(*cols)
    stamp = F.when(F.col("timestamp").rlike("^[0-9]{14}$"), F.col("timestamp"))
    return rows.withColumn("time", F.try_to_timestamp(stamp, F.lit("yyyyMMddHHmmss")))


def read(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Capture rows of CDX files (globs and .gz too). Metadata only: no archive file is touched."""
    return parse_lines(spark.read.text(path))


def lines(captures: DataFrame, additional: bool = True) -> DataFrame:
    """(value): a line a capture; ``additional``: with offset and file name."""
    names = COLUMNS if additional else COLUMNS[:9]
    have = [F.coalesce(F.regexp_replace(F.col(n).cast("string"), r"\s", "%20"), F.lit("-")) if n in captures.columns else F.lit("-") for n in names]
    return captures.select(F.concat_ws(" ", *have).alias("value"))


def save(captures: DataFrame, path: str, additional: bool = True) -> None:
    out = lines(captures, additional).write
    (out.option("compression", "gzip") if path.endswith(".gz") else out).text(path)


def file_index(spark: SparkSession, path: str, patterns=ARCHIVES) -> DataFrame:
    """(filename, path) of all files below ``path`` whose base name matches a pattern; a name found twice is an error.

    Only names are read: the content column of the scan is pruned.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path").withColumn("filename", F.element_at(F.split("path", "/"), -1))
    if patterns:
        wanted = F.lit(False)
        for p in patterns:
            wanted = wanted | F.col("filename").rlike(f"^(?:{p})$")
        files = files.filter(wanted)
    twice = files.groupBy("filename").count().filter("count > 1").first()
    if twice is not None:
        raise ValueError(f"more than one file is called {twice['filename']}")
    return files


def located(captures: DataFrame, files: DataFrame) -> DataFrame:
    """Captures with the ``path`` of their file; those without one are dropped."""
    return captures.join(files.select("filename", "path"), "filename").filter("offset >= 0 and compressedSize > 0")


def located_in(captures: DataFrame, folder: Column | str = "folder") -> DataFrame:
    """Captures whose folder is known, without a lookup."""
    folder = F.col(folder) if isinstance(folder, str) else folder
    return captures.withColumn("path", F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), "filename"))


def with_folder(dir_: str) -> str:
    """The glob of the CDX files that lie in a folder of archive files."""
    return re.sub("/+$", "", dir_) + "/{*.cdx,*.cdx.gz}"
