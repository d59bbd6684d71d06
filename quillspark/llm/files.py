"""Files that tasks write to and read from the shared folder, through any store that pyarrow knows."""

from __future__ import annotations

import uuid

from pyarrow import fs


def store(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


class Writer:
    """A file that appears under its final name only once whole; each task attempt has a name of its own."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.system, self.path = store(self.uri)
        self.system.create_dir(self.path.rpartition("/")[0], recursive=True)
        self.stream, self.at = self.system.open_output_stream(self.path + ".part"), 0

    def write(self, data: bytes) -> int:
        """The place at which `data` begins."""
        begin, self.at = self.at, self.at + len(data)
        self.stream.write(data)
        return begin

    def close(self) -> None:
        self.stream.close()
        self.system.move(self.path + ".part", self.path)


class Reader:
    """Random access to one file."""

    def __init__(self, uri: str):
        system, path = store(uri)
        self.file = system.open_input_file(path)
        self.size = self.file.size()

    def read(self, begin: int, size: int) -> bytes:
        return self.file.read_at(size, begin)

    def close(self) -> None:
        self.file.close()
