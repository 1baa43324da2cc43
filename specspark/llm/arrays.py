"""Sorted arrays in the shared folder: written by tasks, memory-mapped by workers."""

from __future__ import annotations

import os
import tempfile
import uuid

import numpy as np


class ArrayStore:
    """Named numpy arrays below one folder of the shared file system.

    A file appears by one rename, so a task that runs twice leaves one whole file. On a mounted
    file system (file:) readers map the file itself; from any other, a worker copies it once
    to an unnamed local file and maps that.
    """

    def __init__(self, uri: str):
        self.uri = uri
        self._open: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return {"uri": self.uri, "_open": {}}

    @property
    def _local(self) -> str | None:
        return "/" + self.uri[5:].lstrip("/") if self.uri.startswith("file:") else None

    def save(self, name: str, values: np.ndarray) -> None:
        part = f"{name}.{uuid.uuid4().hex}.part"
        if self._local:
            os.makedirs(self._local, exist_ok=True)
            with open(f"{self._local}/{part}", "wb") as f:
                np.save(f, values)
            os.replace(f"{self._local}/{part}", f"{self._local}/{name}.npy")
            return
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(self.uri)
        store.create_dir(base, recursive=True)
        with store.open_output_stream(f"{base}/{part}") as f:
            np.save(f, values)
        store.move(f"{base}/{part}", f"{base}/{name}.npy")

    def load(self, name: str) -> np.ndarray:
        if name not in self._open:
            if self._local:
                self._open[name] = np.load(f"{self._local}/{name}.npy", mmap_mode="r")
            else:
                from pyarrow import fs

                store, base = fs.FileSystem.from_uri(self.uri)
                with tempfile.NamedTemporaryFile() as copy, store.open_input_stream(f"{base}/{name}.npy") as f:
                    while block := f.read(1 << 20):
                        copy.write(block)
                    copy.flush()
                    self._open[name] = np.load(copy.name, mmap_mode="r")
        return self._open[name]


def find(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Index of each wanted value in the sorted keys, -1 where it is missing."""
    if not len(keys):
        return np.full(len(wanted), -1)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(np.asarray(keys[at]) == wanted, at, -1)
