"""Arrays kept as files in the cluster's shared folder, written by tasks and memory-mapped by tasks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession

from sitemill.session import ensure_checkpoint_dir

_mapped: dict[str, np.ndarray] = {}


def new_folder(spark: SparkSession, name: str) -> str:
    """The address of a new folder below the checkpoint folder."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir().rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _open(address: str) -> tuple[fs.FileSystem, str]:
    if address.startswith("file:"):
        return fs.LocalFileSystem(), "/" + address[5:].lstrip("/")
    if "://" in address:
        return fs.FileSystem.from_uri(address)
    return fs.LocalFileSystem(), address


def write_array(folder: str, name: str, values: np.ndarray) -> None:
    """Writes the file whole under another name and then renames it, so that a task that runs again, or twice at
    once, leaves the same file."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(np.ascontiguousarray(values).tobytes())
    system.move(part, f"{path}/{name}")


def map_array(folder: str, name: str, kind: type) -> np.ndarray:
    """The file's array, memory-mapped: pages are read as they are used and shared by a machine's workers. Where the
    folder is not on the file system, the worker maps a copy whose file has no name, so nothing stays behind."""
    key = f"{folder}/{name}"
    if key not in _mapped:
        system, path = _open(folder)
        info = system.get_file_info(f"{path}/{name}")
        if info.type == fs.FileType.NotFound or not info.size:
            _mapped[key] = np.empty(0, kind)
        elif isinstance(system, fs.LocalFileSystem):
            _mapped[key] = np.memmap(f"{path}/{name}", kind, "r")
        else:
            with tempfile.TemporaryFile() as local, system.open_input_stream(f"{path}/{name}") as source:
                while block := source.read(8 << 20):
                    local.write(block)
                local.flush()
                _mapped[key] = np.memmap(local, kind, "r")
    return _mapped[key]


def forget(folder: str) -> None:
    """Closes what this worker has mapped from other folders than folder."""
    for key in [k for k in _mapped if os.path.dirname(k) != folder]:
        del _mapped[key]


@contextmanager
def replace_file(folder: str, name: str) -> Iterator[pa.NativeFile]:
    """A stream whose file takes its name when it is whole; see write_array."""
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        yield out
    system.move(part, f"{path}/{name}")


def open_array(folder: str, name: str) -> pa.NativeFile:
    """The file for reading at any place."""
    system, path = _open(folder)
    return system.open_input_file(f"{path}/{name}")
