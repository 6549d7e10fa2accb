"""Archives over streams: the same derivations on ``readStream``; distinct values need a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sedimenta.archive import Archive
from sedimenta.sources import cdx


def captures(spark: SparkSession, folder: str) -> DataFrame:
    """Capture rows of CDX files as they arrive in a folder."""
    return cdx.parse_lines(spark.readStream.format("text").load(folder))


def pages(spark: SparkSession, folder: str, schema) -> Archive:
    """An archive of Parquet page files as they arrive; ``enrich``, ``filter`` and ``to_json`` work unchanged."""
    return Archive.of_pages(spark.readStream.schema(schema).parquet(folder))


def distinct(rows: DataFrame, key: str, time: str = "time", late: str = "1 hour") -> DataFrame:
    """The first seen row of each key within the watermark."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark([key])
