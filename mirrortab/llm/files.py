"""Binary files in the shared folder, written and read by tasks.

A task writes under a name of its own and reports what it wrote as rows; only files named in the rows of tasks that
succeeded are ever read, so a repeated or lost attempt leaves at most an unread file. Paths are URIs, opened with
the file system that Arrow has for their scheme.
"""

from __future__ import annotations

import os
import uuid

from pyarrow import fs
from pyspark.sql import DataFrame

MOST_TASKS = 10_000


def opened(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" in folder or folder.startswith("file:"):
        return fs.FileSystem.from_uri(folder.replace("file:/", "file:///", 1) if folder.startswith("file:/") and not folder.startswith("file://") else folder)
    return fs.LocalFileSystem(), folder


class Written:
    """A new file in ``folder`` that counts its bytes."""

    def __init__(self, folder: str, suffix: str):
        self.name = f"{uuid.uuid4().hex}{suffix}"
        system, base = opened(folder)
        system.create_dir(base, recursive=True)
        self.stream = system.open_output_stream(os.path.join(base, self.name), compression=None, buffer_size=1 << 20)
        self.size = 0

    def write(self, data: bytes) -> int:
        """Where the data begins."""
        begin, self.size = self.size, self.size + len(data)
        self.stream.write(data)
        return begin

    def close(self) -> None:
        self.stream.close()


def read_stream(folder: str, name: str):
    system, base = opened(folder)
    return system.open_input_stream(os.path.join(base, name), compression=None, buffer_size=1 << 20)


def read_random(folder: str, name: str):
    system, base = opened(folder)
    return system.open_input_file(os.path.join(base, name))


def one_per_task(manifest: DataFrame) -> DataFrame:
    """Rows of a written manifest dealt out evenly, a task for each up to ``MOST_TASKS``; they are too small to be left to
    adaptive merging, which would give all files to one task."""
    return manifest.repartition(max(1, min(MOST_TASKS, manifest.count())))
