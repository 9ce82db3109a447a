"""Files in the shared folder, written by tasks and read by range.

Paths are full URIs, as shared_dir() gives them (a path without a scheme is this
machine's disk, for tests); any store that pyarrow opens will do. A file appears under its
name only when it is whole, so a task that runs twice leaves one file."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


class Whole:
    """A file written under another name and renamed when it is closed without error."""

    def __init__(self, uri: str) -> None:
        self.fs, self.path = opened(uri)
        self.own = f"{self.path}.{uuid.uuid4().hex}.tmp"
        self.fs.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.out = self.fs.open_output_stream(self.own)
        self.at = 0

    def write(self, data: bytes) -> int:
        """Where the data begin."""
        at, self.at = self.at, self.at + len(data)
        self.out.write(data)
        return at

    def __enter__(self) -> Whole:
        return self

    def __exit__(self, kind, *_) -> None:
        self.out.close()
        if kind is None:
            # What an earlier run of the task left goes first: not every store renames over a file.
            if self.fs.get_file_info(self.path).type != fs.FileType.NotFound:
                self.fs.delete_file(self.path)
            self.fs.move(self.own, self.path)
        else:
            self.fs.delete_file(self.own)


class Ranges:
    """Reads ranges of a file."""

    def __init__(self, uri: str) -> None:
        store, path = opened(uri)
        self.file = store.open_input_file(path)
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        data = self.file.read_at(n, at)
        if len(data) != n:
            raise ValueError(f"file ends within {at}+{n}")
        return data

    def close(self) -> None:
        self.file.close()
