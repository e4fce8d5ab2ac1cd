"""Files in the shared folder, written and read by executors through pyarrow's file systems."""

from __future__ import annotations

import os
import uuid

from pyarrow import fs


class Rolling:
    """Writes files in `folder` one after the other; a file is under a temporary name, another one for each attempt, until
    it is complete.

    With `attempt_names` the final names hold the attempt too, so a task that runs again never meets the files of its
    first attempt. Without, a second attempt puts the same bytes under the same name. Only files that the committed index
    or manifest names count."""

    def __init__(self, folder: str, stem: str, suffix: str, limit: int, attempt_names: bool = True):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.system.create_dir(self.folder, recursive=True)
        self.attempt = uuid.uuid4().hex[:8]
        self.stem, self.suffix, self.limit = f"{stem}-{self.attempt}" if attempt_names else stem, suffix, limit
        self.number, self.size, self.out = 0, 0, None

    def _temporary(self) -> str:
        return os.path.join(self.folder, f"{self.name}.{self.attempt}.tmp")

    @property
    def name(self) -> str:
        return f"{self.stem}-{self.number:05d}{self.suffix}"

    def write(self, data: bytes) -> tuple[str, int]:
        """Appends data whole; returns the file and the offset it stands at."""
        if self.out is None:
            self.out = self.system.open_output_stream(self._temporary())
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return self.name, at

    def full(self) -> bool:
        return self.size >= self.limit

    def close(self, tail: bytes = b"") -> str | None:
        """Ends the present file under its own name; the next write begins another."""
        if self.out is None:
            return None
        self.out.write(tail)
        self.out.close()
        done = self.name
        final = os.path.join(self.folder, done)
        try:
            self.system.move(self._temporary(), final)
        except OSError:  # stores that do not replace: an earlier attempt has put the same bytes there
            if self.system.get_file_info(final).type != fs.FileType.File:
                raise
            self.system.delete_file(self._temporary())
        self.out, self.size, self.number = None, 0, self.number + 1
        return done


class Ranges:
    """Range reads from files of a folder, with the last file kept open."""

    def __init__(self, folder: str):
        self.system, self.folder = fs.FileSystem.from_uri(folder)
        self.name, self.file = None, None

    def read(self, name: str, offset: int, length: int) -> bytes:
        if name != self.name:
            self.name, self.file = name, self.system.open_input_file(os.path.join(self.folder, name))
        return self.file.read_at(length, offset)


def uri(path: str) -> str:
    """path as a URI; a bare path is a local one."""
    if "://" in path:
        return path
    return "file://" + path.removeprefix("file:") if path.startswith(("/", "file:/")) else path
