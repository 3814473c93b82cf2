"""Binary files on any store that pyarrow knows, committed by rename."""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyarrow import fs


def resolve(uri: str) -> tuple[fs.FileSystem, str]:
    if re.match(r"^(file:)?/", uri):
        return fs.LocalFileSystem(), "/" + re.sub(r"^file:", "", uri).lstrip("/")
    return fs.FileSystem.from_uri(uri)


@contextmanager
def committed(uri: str) -> Iterator:
    """A stream for a new file that appears under its name only when whole; a repeated task replaces it by the same bytes."""
    store, path = resolve(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    hidden = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with store.open_output_stream(hidden) as out:
            yield out
        store.move(hidden, path)
    except BaseException:
        if store.get_file_info(hidden).type != fs.FileType.NotFound:
            store.delete_file(hidden)
        raise


def read_range(uri: str, start: int, size: int) -> bytes:
    store, path = resolve(uri)
    with store.open_input_file(path) as f:
        return f.read_at(size, start)


def delete_tree(uri: str) -> None:
    store, path = resolve(uri)
    if store.get_file_info(path).type == fs.FileType.Directory:
        store.delete_dir(path)
