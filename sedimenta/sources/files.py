"""Raw files: text lines, whole texts, bytes, any Hadoop input format."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedimenta.archive import Archive, Config
from sedimenta.operators.paths import parse
from sedimenta.sources import store

_CHUNK = 1 << 20


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): one row a line; globs and .gz files too."""
    return spark.read.text(path)


def text_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, value): one row a file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def files(spark: SparkSession, path: str, patterns: list[str] | None = None, partitions: int = 0) -> DataFrame:
    """(path, length, modified, content) of the files below ``path`` whose base name matches one of the regexes.

    Bytes are read only if ``content`` is used. ``partitions``: at most so many, 0 for as many as Spark sees fit.
    """
    df = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    if patterns:
        wanted = F.lit(False)
        for p in patterns:
            wanted = wanted | F.element_at(F.split("path", "/"), -1).rlike(f"^(?:{p})$")
        df = df.filter(wanted)
    if partitions:
        df = df.coalesce(partitions)
    return df.select("path", "length", F.col("modificationTime").alias("modified"), "content")


def decompressed(content: Column, path: Column) -> Column:
    """The bytes of a file, unzipped if its name ends in .gz; null if they are damaged."""

    @F.arrow_udf("binary")
    def run(data, names):
        import pyarrow as pa

        out = []
        for d, n in zip(data.to_pylist(), names.to_pylist()):
            try:
                out.append(gzip.decompress(d) if d is not None and (n or "").endswith(".gz") else d)
            except (OSError, EOFError, zlib.error):
                out.append(None)
        return pa.array(out, pa.binary())

    return run(content, path)


def lines(files: DataFrame) -> DataFrame:
    """(value): the lines of the files whose ``path`` is in ``files``, unzipped if the name ends in .gz; none of damaged files.

    The same lines as ``lines_of(decompressed(...))``, but a file is read in chunks where its task runs, so of any file
    only a chunk, or its longest line, is held. Zipped files are read twice: whether one is damaged shows at its end.
    """

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for path in batch.column(0).to_pylist():
                if path.endswith(".gz") and not _whole(path):
                    continue
                for found in _lines(_chunks(path)):
                    yield pa.record_batch([pa.array(found, pa.binary())], ["value"])

    return files.select("path").mapInArrow(run, "value binary").select(F.decode("value", "UTF-8").alias("value"))


def _chunks(path: str) -> Iterator[bytes]:
    system, at = store.opened(path)
    with system.open_input_stream(at, compression=None) as raw:
        f = gzip.GzipFile(fileobj=raw) if path.endswith(".gz") else raw
        while chunk := f.read(_CHUNK):
            yield chunk


def _whole(path: str) -> bool:
    """Whether a zipped file can be read to its end."""
    try:
        for _ in _chunks(path):
            pass
    except (gzip.BadGzipFile, EOFError, zlib.error):
        return False
    return True


def _lines(chunks: Iterator[bytes]) -> Iterator[list[bytes]]:
    """Lines, as many at a time as end in a chunk; what follows the last line break is a line too."""
    open_: list[bytes] = []
    for chunk in chunks:
        if b"\n" in chunk:
            first, *more = chunk.split(b"\n")
            found = [b"".join((*open_, first)), *more]
            open_ = [found.pop()]
            yield [x.removesuffix(b"\r") for x in found]
        else:
            open_.append(chunk)
    yield [b"".join(open_)]


def lines_of(content: Column) -> Column:
    """The lines of a file's bytes as an array; ``lines`` is for files that are large."""
    return F.split(F.decode(content, "UTF-8"), "\r?\n")


def of_files(df: DataFrame, decompress: bool = True, config: Config = Config()) -> Archive:
    """An archive of files: the path as metadata, the text at ``payload.string``."""
    content = decompressed(F.col("content"), F.col("path")) if decompress else F.col("content")
    df = df.withColumn("content", content).withColumn("v:text", F.decode("content", "UTF-8"))
    from sedimenta.archive import Field

    return Archive(df, [c for c in ("path", "length", "modified") if c in df.columns], {parse("payload"): Field("content", "binary", hidden=True), parse("payload.string"): Field("v:text", "string", hidden=True)}, config)


def hadoop(spark: SparkSession, path: str, input_format: str, key_class: str, value_class: str, schema: str = "key string, value string", **conf) -> DataFrame:
    """Any Hadoop ``InputFormat``. The one place where an RDD is needed, as Spark has no DataFrame reader for these."""
    rdd = spark.sparkContext.newAPIHadoopFile(path, input_format, key_class, value_class, conf=conf)
    return spark.createDataFrame(rdd, schema)
