"""Files of bytes in shared folders, opened on executors: local and mounted paths, and stores that pyarrow reaches."""

from __future__ import annotations

import os
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def _local(uri: str) -> str | None:
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return unquote(parts.path) if parts.scheme else uri
    return None


@contextmanager
def create(uri: str):
    """A binary stream to a new file, with its folder; what an attempt that fails has left is under a name of its own."""
    path = _local(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            yield f
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        yield f


@contextmanager
def read(uri: str):
    path = _local(uri)
    if path is not None:
        with open(path, "rb") as f:
            yield f
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        yield f
