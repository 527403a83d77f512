"""Binary files in the shared folder, written and read inside tasks.

A task writes to a name of its own and reports it; only the names that a
committed manifest lists count, so files of lost or repeated attempts are
never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs as pafs


def open_store(path: str):
    """``(file system, path in it)`` of a URI or an absolute path."""
    return pafs.FileSystem.from_uri(path)


class NewFile:
    """A file of this attempt in ``folder``; ``name`` is what the manifest lists."""

    def __init__(self, folder: str, stem: str, suffix: str):
        store, root = open_store(folder)
        store.create_dir(root, recursive=True)
        self.name = f"{stem}-{uuid.uuid4().hex[:12]}{suffix}"
        self.out = store.open_output_stream(f"{root}/{self.name}", compression=None)
        self.size = 0

    def write(self, data: bytes) -> None:
        self.out.write(data)
        self.size += len(data)

    def close(self) -> None:
        self.out.close()


def open_file(folder: str, name: str):
    """A seekable reader of one file."""
    store, root = open_store(folder)
    return store.open_input_file(f"{root}/{name}")
