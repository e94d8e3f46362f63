"""Raw files written and read inside tasks, through Arrow's file systems.

Spark has no writer for raw bytes. A task writes its own file under a name no other attempt uses and
reports it in a row; only rows of successful attempts reach the manifest, so a lost executor or a
repeated task leaves at most a file that nobody reads.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

from slicelake.llm.common import stored
from slicelake.paths import filesystem


def new_file(folder: str, partition: int, suffix: str) -> str:
    return f"{folder}/part-{partition:06d}-{uuid.uuid4().hex}{suffix}"


def open_new(path: str):
    from pyarrow import fs

    system, inner = filesystem(path)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner, compression=None)  # else a name ending in .gz is packed twice


def open_old(path: str):
    system, inner = filesystem(path)
    return system.open_input_file(inner)


def manifest(written: DataFrame, purpose: str) -> DataFrame:
    """Run the writing tasks once; the rows of their successful attempts."""
    return stored(written, purpose)
