"""Files that executors write and read below the shared scratch folder, by any store that pyarrow opens."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri:
        uri = "file://" + os.path.abspath(uri.removeprefix("file:"))
    return fs.FileSystem.from_uri(uri)


def write_new(folder: str, stem: str, suffix: str, data: bytes) -> str:
    """Write under a name that no other attempt of the same task uses; what isn't in a manifest is never read."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
    store, path = _open(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    with store.open_output_stream(path, compression=None) as out:
        out.write(data)
    return uri


class RangeReader:
    """Random reads of one file."""

    def __init__(self, uri: str) -> None:
        store, path = _open(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, size: int) -> bytes:
        return self.file.read_at(size, at)

    def __enter__(self) -> RangeReader:
        return self

    def __exit__(self, *_: object) -> None:
        self.file.close()
