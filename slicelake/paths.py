"""Paths and URIs through Arrow's file systems, on the driver and inside tasks."""

from __future__ import annotations

from urllib.parse import unquote, urlparse


def filesystem(path: str):
    """(file system, path inside it) for a plain path or a URI."""
    from pyarrow import fs

    parsed = urlparse(path)
    if parsed.scheme == "":
        return fs.LocalFileSystem(), path
    if parsed.scheme == "file":
        return fs.LocalFileSystem(), unquote(parsed.path)
    return fs.FileSystem.from_uri(path)


def exists(path: str) -> bool:
    from pyarrow import fs

    system, inner = filesystem(path)
    return system.get_file_info(inner).type != fs.FileType.NotFound
