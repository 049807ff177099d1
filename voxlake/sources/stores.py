"""Folders that tasks open themselves, by the URIs that Spark uses for them."""

from __future__ import annotations

from pyarrow import fs

#: Spark's names of stores that Arrow knows by another.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; a path without a scheme is local.

    ``s3a`` and ``s3n`` are opened as ``s3``; ``dbfs`` by its mount. Raises ValueError for stores that only Spark can
    open.
    """
    scheme, found, rest = uri.partition(":")
    if not found or "/" in scheme:
        return fs.LocalFileSystem(), uri
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/")
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs/" + rest.lstrip("/")
    try:
        return fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{rest}")
    except (ValueError, OSError, NotImplementedError) as error:  # Arrow's errors are of these kinds
        raise ValueError(f"tasks can't open {scheme}: folders by themselves") from error


def opens(uri: str) -> bool:
    """Whether tasks can open a URI's store by themselves."""
    try:
        open_store(uri)
    except ValueError:
        return False
    return True
