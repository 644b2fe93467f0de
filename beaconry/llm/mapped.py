"""Raw arrays in the shared folder: written by tasks, memory-mapped by workers.

Writers put a file under a fresh name and move it into place, so a retried task leaves the same file. Readers map files of
a mounted folder directly; from another store a file is copied once per worker to a temporary one that has no name any
more, so nothing is left behind.
"""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _at(folder: str) -> tuple[fs.FileSystem, str]:
    if folder.startswith("file:"):
        folder = "/" + folder[5:].lstrip("/")
    return (fs.LocalFileSystem(), folder) if folder.startswith("/") else fs.FileSystem.from_uri(folder)


def put(folder: str, name: str, values: np.ndarray) -> None:
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    fresh = f"{path}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(fresh) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    store.move(fresh, f"{path}/{name}")


def get(folder: str, name: str, kind: str) -> np.ndarray:
    store, path = _at(folder)
    path = f"{path}/{name}"
    if store.get_file_info(path).size == 0:
        return np.zeros(0, kind)
    if isinstance(store, fs.LocalFileSystem):
        return np.memmap(path, kind, "r")
    with store.open_input_stream(path) as source, tempfile.TemporaryFile() as local:
        while some := source.read(1 << 24):
            local.write(some)
        local.flush()
        return np.memmap(local, kind, "r")
