"""Files in the cluster's shared folder, written and read from tasks through Arrow's file systems."""

from __future__ import annotations

import re


def open_store(uri: str):
    """File system and path of a URI; a plain absolute path is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "file:///", uri))


def attempt_name() -> str:
    """Name for what one attempt of a task writes; only files that a finished attempt reports are ever read."""
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{context.partitionId():06d}-{context.taskAttemptId()}"


def create(uri: str):
    """Output stream for a new file, with its folder."""
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    return store.open_output_stream(path, compression=None)  # else a name in .gz would be packed twice


def read_range(uri: str, start: int, length: int) -> bytes:
    store, path = open_store(uri)
    with store.open_input_file(path) as f:
        return f.read_at(length, start)
