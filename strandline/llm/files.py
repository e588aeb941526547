"""Files that tasks write into, and read from, the folder that all machines share, through pyarrow's file systems."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def open_fs(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a URI or plain path (local, hdfs, s3, gs), and the path in it."""
    if "://" not in uri and not uri.startswith("file:"):
        return pafs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


@contextmanager
def whole_file(uri: str, name: str, attempt: int) -> Iterator[pa.NativeFile]:
    """A file that appears under its name only when it is whole: each attempt writes its own and moves it there, so a
    task that runs again, or twice at once, leaves one whole file."""
    fs, root = open_fs(uri)
    fs.create_dir(root, recursive=True)
    temp = f"{root}/_{name}.{attempt}"
    with fs.open_output_stream(temp) as out:
        yield out
    fs.move(temp, f"{root}/{name}")


def open_file(uri: str, name: str) -> pa.NativeFile:
    """For random access; mapped into memory where the file is on a local path."""
    fs, root = open_fs(uri)
    if isinstance(fs, pafs.LocalFileSystem):
        return pa.memory_map(f"{root}/{name}")
    return fs.open_input_file(f"{root}/{name}")
