"""Files in shared folders, opened from tasks.

A file is written under a name of its own attempt and renamed when whole, so a task that runs again,
or twice at once, leaves one whole file.
"""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def resolve(uri: str) -> tuple[pafs.FileSystem, str]:
    """file:/x, as Spark writes it, and file:///x are the same place."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def whole_file(uri: str) -> Iterator:
    fs, path = resolve(uri)
    folder = path.rpartition("/")[0]
    fs.create_dir(folder, recursive=True)
    draft = f"{folder}/_draft-{uuid.uuid4().hex}"
    with fs.open_output_stream(draft, compression=None) as out:
        yield out
    fs.move(draft, path)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """Names and sizes of the files in a folder, sorted by name."""
    fs, path = resolve(uri)
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    return sorted((f.base_name, f.size) for f in found if f.base_name.endswith(suffix))
