"""Files that tasks write in the folder all executors share, committed by temporary names and a manifest."""

from __future__ import annotations

import hashlib
import uuid

from pyarrow import fs


class TaskFile:
    """A file that appears under its final name only when whole.

    Every attempt of a task writes to its own temporary name and renames at the end, so a lost executor leaves at most
    a temporary file that no manifest names, and a second attempt replaces equal content.
    """

    def __init__(self, folder: str, name: str):
        self.name = name
        self.fs, self.root = fs.FileSystem.from_uri(folder)
        self.fs.create_dir(self.root, recursive=True)
        self.temporary = f"{self.root}/_tmp-{name}-{uuid.uuid4().hex}"
        self.out = self.fs.open_output_stream(self.temporary)
        self.size = 0
        self._sha = hashlib.sha256()

    def write(self, data: bytes) -> int:
        """The offset at which data begins."""
        at = self.size
        self.out.write(data)
        self._sha.update(data)
        self.size += len(data)
        return at

    @property
    def sha256(self) -> str:
        return self._sha.hexdigest()

    def commit(self) -> None:
        self.out.close()
        self.fs.move(self.temporary, f"{self.root}/{self.name}")


def read_at(folder: str, name: str, at: int, size: int) -> bytes:
    where, root = fs.FileSystem.from_uri(folder)
    with where.open_input_file(f"{root}/{name}") as f:
        f.seek(at)
        return f.read(size)


def open_stream(folder: str, name: str):
    where, root = fs.FileSystem.from_uri(folder)
    return where.open_input_stream(f"{root}/{name}", compression=None)
