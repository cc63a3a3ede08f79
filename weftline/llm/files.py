"""Files of the shared folder, written and read by Python workers through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def create(folder: str, suffix: str):
    """(uri, output stream) of a new file. Its name is of this attempt alone: what a lost or second attempt writes is never read."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    return uri, where.open_output_stream(path, compression=None)


def open_file(uri: str):
    """A seekable input file."""
    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)
