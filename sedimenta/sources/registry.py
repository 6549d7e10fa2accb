"""Sources by name: the contract of a source, those of this library, and those that others add.

A source of one's own subclasses ``Source`` and is registered with ``register``, or by an installed package under the
entry-point group ``sedimenta.sources``.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib.metadata import entry_points

from pyspark.sql import DataFrame, SparkSession

from sedimenta.archive import Archive, Config
from sedimenta.sources import cdx, files, warc

GROUP = "sedimenta.sources"


class Source:
    """What a source has to say: how rows are loaded, and how they become an archive.

    ``load`` should return metadata and references only, so that filters on them come before any payload is read;
    ``parse`` names the metadata and attaches the function that reads a record's payload.
    """

    def load(self, spark: SparkSession) -> DataFrame:
        raise NotImplementedError

    def parse(self, rows: DataFrame, config: Config = Config()) -> Archive:
        return Archive(rows, list(rows.columns), {}, config)

    def open(self, spark: SparkSession, config: Config = Config()) -> Archive:
        return self.parse(self.load(spark), config)


class _Made(Source):
    """A source of this library, from the function that opens it."""

    def __init__(self, opener: Callable[..., Archive], *args, **options):
        self.opener, self.args, self.options = opener, args, options

    def open(self, spark: SparkSession, config: Config = Config()) -> Archive:
        return self.opener(spark, config, *self.args, **self.options)

    def load(self, spark: SparkSession) -> DataFrame:
        return self.open(spark).df


def _captures(spark, config, path):
    rows = cdx.read(spark, path)
    return Archive(rows, list(rows.columns), {}, config)


_FACTORIES: dict[str, Callable[..., Source]] = {
    "cdx": lambda *a, **o: _Made(_captures, *a, **o),
    "warc": lambda *a, **o: _Made(lambda spark, config, path, **x: warc.from_files(spark, path, config, **x), *a, **o),
    "warc-cdx": lambda *a, **o: _Made(lambda spark, config, folder: warc.from_files_with_cdx(spark, folder, config), *a, **o),
    "files": lambda *a, **o: _Made(lambda spark, config, path, **x: files.of_files(files.files(spark, path, **x), config=config), *a, **o),
}


def register(name: str, factory: Callable[..., Source]) -> None:
    """``factory``: from what ``open_source`` is given besides the name, to a ``Source``."""
    _FACTORIES[name] = factory


def names() -> list[str]:
    return sorted({*_FACTORIES, *(e.name for e in entry_points(group=GROUP))})


def open_source(spark: SparkSession, name: str, *args, config: Config = Config(), **options) -> Archive:
    """The archive of a source by its name."""
    factory = _FACTORIES.get(name)
    if factory is None:
        found = [e for e in entry_points(group=GROUP) if e.name == name]
        if not found:
            raise KeyError(f"no source {name!r}; there are {', '.join(names())}")
        factory = found[0].load()
    return factory(*args, **options).open(spark, config)
