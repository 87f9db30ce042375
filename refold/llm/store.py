"""Files in a shared folder, written by tasks: any store that Arrow's filesystem layer opens."""

from __future__ import annotations

import posixpath
import uuid
from contextlib import contextmanager

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The filesystem of a folder's URI, and the folder's path in it."""
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def replacing(uri: str, name: str):
    """A stream to the file `name` of the folder. The file appears whole, by renaming, when the block
    ends; a task that runs again replaces it with the same bytes."""
    system, folder = opened(uri)
    system.create_dir(folder, recursive=True)
    draft = posixpath.join(folder, f".{name}.{uuid.uuid4().hex}")
    try:
        with system.open_output_stream(draft) as out:
            yield out
        system.move(draft, posixpath.join(folder, name))
    except BaseException:
        if system.get_file_info(draft).type != fs.FileType.NotFound:
            system.delete_file(draft)
        raise


def reading(uri: str, name: str):
    """A random-access file; local ones are memory maps, so Arrow reads them without copies."""
    import pyarrow as pa

    system, folder = opened(uri)
    path = posixpath.join(folder, name)
    return pa.memory_map(path) if isinstance(system, fs.LocalFileSystem) else system.open_input_file(path)
