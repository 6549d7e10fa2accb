"""File systems that executors share, by the scheme of a path: local files, and what Arrow or fsspec can open."""

from __future__ import annotations

import os
from functools import lru_cache
from urllib.parse import urlsplit

from pyarrow import fs

_ARROW = {"hdfs": "hdfs", "viewfs": "viewfs", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "gcs": "gs", "abfs": "abfs", "abfss": "abfss"}


@lru_cache(64)
def _system(scheme: str, authority: str) -> fs.FileSystem:
    if scheme in _ARROW:
        return fs.FileSystem.from_uri(f"{_ARROW[scheme]}://{authority}/")[0]
    try:
        import fsspec

        return fs.PyFileSystem(fs.FSSpecHandler(fsspec.filesystem(scheme)))
    except (ImportError, ValueError) as e:
        raise ValueError(f"no file system for {scheme}://") from e


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path, and the path in it. A scheme that nothing can open is an error."""
    parts = urlsplit(path)
    if not parts.scheme or parts.scheme == "file":
        local = path if not parts.scheme else path.removeprefix("file:")
        return fs.LocalFileSystem(), os.path.abspath("/" + local.lstrip("/") if parts.scheme else local)
    system = _system(parts.scheme, parts.netloc)
    inside = path.split("://", 1)[1]
    # buckets are part of the path, name nodes are not
    return system, inside if _ARROW.get(parts.scheme, "s3") in ("s3", "gs", "abfs", "abfss") else "/" + inside.partition("/")[2]


def files_below(path: str, endings: tuple[str, ...]) -> list[str]:
    """A file itself, or all files below a folder whose names have one of the endings, in order; paths within the file system."""
    system, at = opened(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.File:
        return [at]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = system.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.base_name.lower().endswith(endings))
