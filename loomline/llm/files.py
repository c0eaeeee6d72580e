"""Whole files in the shared folder, written and read by tasks."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def written_whole(uri: str) -> Iterator:
    """A stream to ``uri`` that appears there only when it is complete.

    A task that is lost and run again, or runs twice, replaces the file by the same bytes.
    """
    store, path = locate(uri)
    folder, _, name = path.rpartition("/")
    store.create_dir(folder, recursive=True)
    part = f"{folder}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as out:
        yield out
    with contextlib.suppress(OSError, FileNotFoundError):
        if not isinstance(store, fs.LocalFileSystem):
            store.delete_file(path)
    store.move(part, path)
