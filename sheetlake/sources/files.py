"""Paths and URIs through pyarrow's file systems: the one place that opens files, on the driver and inside tasks."""

from __future__ import annotations

# Hadoop scheme names that pyarrow knows under another name.
SCHEME_ALIASES = {"s3a": "s3", "s3n": "s3"}


def plain_path(path: str) -> str:
    """``file:/x`` and ``file:///x`` -> ``/x``; other URIs unchanged."""
    if path.startswith("file://"):
        return path[len("file://"):]
    if path.startswith("file:"):
        return path[len("file:"):]
    return path


def filesystem(path: str):
    """(file system, path inside it, what to put before inner paths to get back full ones)."""
    from pyarrow import fs as pafs

    path = plain_path(path)
    if "://" not in path:
        return pafs.LocalFileSystem(), path, ""
    scheme, rest = path.split("://", 1)
    system, inner = pafs.FileSystem.from_uri(f"{SCHEME_ALIASES.get(scheme, scheme)}://{rest}")
    at = path.find(inner) if inner else -1
    return system, inner, path[:at] if at >= 0 else f"{scheme}://"


def open_input(path: str):
    """A file for random access."""
    system, inner, _ = filesystem(path)
    return system.open_input_file(inner)


def open_output(path: str):
    """A stream to write a file to; parent folders are created."""
    system, inner, _ = filesystem(path)
    parent = inner.rsplit("/", 1)[0]
    if parent:
        system.create_dir(parent, recursive=True)
    return system.open_output_stream(inner)
