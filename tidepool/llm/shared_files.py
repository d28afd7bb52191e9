"""Arrays as files in the shared folder, memory-mapped where they are read."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return None if "://" in uri else uri


def save(folder: str, name: str, values: np.ndarray) -> None:
    """Write an array whole or not at all; a second attempt replaces the first's equal file."""
    local = _local(folder)
    if local is not None:
        os.makedirs(local, exist_ok=True)
        part = f"{local}/.{name}.{uuid.uuid4().hex}"
        values.tofile(part)
        os.replace(part, f"{local}/{name}")
        return
    from pyarrow import fs

    store, path = fs.FileSystem.from_uri(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(values.tobytes())
    store.move(part, f"{path}/{name}")


def load(folder: str, name: str, dtype: str) -> np.ndarray:
    """The array, memory-mapped; from a store without files it is fetched to the worker's own folder first."""
    local = _local(folder)
    if local is None:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(folder)
        local = tempfile.mkdtemp()
        with store.open_input_stream(f"{path}/{name}") as src, open(f"{local}/{name}", "wb") as out:
            while block := src.read(1 << 24):
                out.write(block)
    if not os.path.getsize(f"{local}/{name}"):
        return np.zeros(0, dtype=dtype)
    return np.memmap(f"{local}/{name}", dtype=dtype, mode="r")
