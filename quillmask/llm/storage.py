"""Files of our own formats in the shared folder, through pyarrow's file systems
(file, hdfs, s3, gs), so that executors and the driver name them alike."""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri else "file://" + uri)


def write_file(folder: str, stem: str, chunks) -> tuple[str, int]:
    """Write chunks of bytes under a name that no other attempt uses; returns the URI
    and length. A retried task leaves a file that no manifest names."""
    uri = f"{folder}/{stem}-{uuid.uuid4().hex}"
    system, path = _at(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    size = 0
    with system.open_output_stream(path) as out:
        for chunk in chunks:
            out.write(chunk)
            size += len(chunk)
    return uri, size


def open_file(uri: str):
    """A random-access file with seek() and read()."""
    system, path = _at(uri)
    return system.open_input_file(path)
