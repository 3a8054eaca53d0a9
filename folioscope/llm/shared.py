"""What the corpus operators share: files for driver and executors, beside the stage tables of ``sources.scratch``, and numbering."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import drop, folder, fresh, release, remove, root, small, table

__all__ = ["Files", "drop", "filesystem", "folder", "fresh", "mapped", "numbered", "put", "release", "remove", "root", "small", "table"]


def filesystem(uri: str):
    """(pyarrow file system, path) of a URI; local paths may come bare."""
    from pyarrow import fs

    if urlparse(uri).scheme in ("", "file"):
        return fs.LocalFileSystem(), urlparse(uri).path
    return fs.FileSystem.from_uri(uri.replace("s3a://", "s3://", 1))


def put(uri: str, write) -> None:
    """Calls ``write(stream)`` on a file that appears under its name only when it is whole.

    A retried or speculative task writes the same bytes and replaces the same name.
    """
    store, path = filesystem(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    part = f"{path}.{uuid.uuid4().hex}.part"
    with store.open_output_stream(part) as out:
        write(out)
    store.move(part, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """A file as a memory-mapped array. Stores that cannot be mapped are read to a file that only this process has, unlinked at once."""
    store, path = filesystem(uri)
    if store.type_name == "local":
        return np.memmap(path, dtype=dtype, mode="r") if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as local, store.open_input_stream(path) as source:
        shutil.copyfileobj(source, local, 1 << 22)
        local.flush()
        size = local.tell()
        return np.memmap(local, dtype=dtype, mode="r") if size else np.empty(0, dtype)


class Files:
    """Arrays by name, mapped when first asked for; of the ones in use the ``most`` latest stay open."""

    def __init__(self, folder: str, most: int = 256):
        self.folder, self.most, self.held = folder, most, {}

    def __call__(self, name: str, dtype) -> np.ndarray:
        out = self.held.pop(name, None)
        if out is None:
            out = mapped(f"{self.folder}/{name}", dtype)
        self.held[name] = out
        if len(self.held) > self.most:
            del self.held[next(iter(self.held))]
        return out


def numbered(rows: DataFrame, group: Column, work: str) -> DataFrame:
    """Adds ``work``, the number from 0 of each row of a group, without dealing a group to one task.

    The rows are written once, so that each has a place for good: its task and its place in that.
    """
    place = fresh(rows, f"{work}_place")
    rows = table(rows.withColumn(place, F.struct(group.alias("of"), F.monotonically_increasing_id().alias("row"))), "numbered-rows")
    task = F.shiftright(F.col(f"{place}.row"), 33)
    counts = rows.groupBy(F.col(f"{place}.of").alias("of"), task.alias("task")).agg(F.count("*").alias("n"))
    upto = Window.partitionBy("of").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(upto), F.lit(0)))
    before = fresh(rows, f"{work}_before")
    own = F.row_number().over(Window.partitionBy(F.col(f"{place}.of"), task).orderBy(F.col(f"{place}.row"))) - 1
    out = rows.withColumn(work, own).join(counts.select(F.struct("of", "task", "before").alias(before)), F.col(f"{place}.of").eqNullSafe(F.col(f"{before}.of")) & (task == F.col(f"{before}.task")))
    return out.withColumn(work, F.col(work) + F.col(f"{before}.before")).drop(place, before)
