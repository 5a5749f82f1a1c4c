"""Binary files in the shared folder, written and read by Python tasks.

Spark has no sink for raw bytes. Files go through pyarrow's file systems, so the shared folder may
be local, HDFS or an object store. A task writes to a name of its own and moves the file when it is
whole: a repeated task leaves one file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder given as a URI or a local path."""
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri.replace("file:///", "file:/").replace("file:/", "file:///"))


@contextlib.contextmanager
def whole_file(folder: str, name: str) -> Iterator[object]:
    """Stream for ``folder/name``; the file appears under its name only when the block ends well."""
    store, path = open_store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        yield out
    store.move(part, f"{path}/{name}")
