"""Binary files in a folder that all executors share, read and written inside tasks.

A task writes under a name of its own and returns where the file is. The table of
those returns, written by Spark, is the commit record: files of attempts that
failed are in no row of it and are never read.
"""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _open(uri: str):
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(uri)


@contextmanager
def new_file(folder: str, suffix: str):
    """Yields (uri, stream) of a file that no other attempt writes."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    fs, path = _open(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path, compression=None) as stream:
        yield uri, stream


def read_file(uri: str) -> bytes:
    fs, path = _open(uri)
    with fs.open_input_stream(path, compression=None) as stream:
        return stream.read()


@contextmanager
def random_access(uri: str):
    fs, path = _open(uri)
    with fs.open_input_file(path) as stream:
        yield stream
