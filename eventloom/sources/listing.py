"""A directory listing as a Spark data source.

It yields every name, hidden and bracketed ones too, with sizes and times of the file
system; folders below are listed level by level, by tasks. Contents are read later, by the
rows that are left.
"""

from __future__ import annotations

import json
import os
from datetime import datetime

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import BooleanType, StructField, StructType

from eventloom.runtime import ship, written
from eventloom.schemas import LISTING

#: Folders that a task lists.
FOLDERS_A_TASK = 64
_ARROW = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.timestamp("us"), pa.timestamp("us"), pa.bool_(), pa.int32(), pa.bool_())


class _Folders(InputPartition):
    def __init__(self, folders: list[tuple[int, str]]):
        self.folders = folders


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])

    def partitions(self):
        parts = []
        for i, root in enumerate(self.roots):
            if os.path.isdir(root):
                parts.append(_Folders([(i, root)]))
        return parts or [_Folders([])]

    def read(self, partition):
        for i, folder in partition.folders:
            for row, _ in _entries(i, folder):
                yield row


def _entries(i: int, folder: str):
    """(row of LISTING, whether it is a folder to go down into) of every entry; what is gone meanwhile is left out."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except (FileNotFoundError, NotADirectoryError):
        return
    for e in entries:
        try:
            st, is_dir = e.stat(), e.is_dir()
        except FileNotFoundError:
            continue
        times = [datetime.fromtimestamp(int(t)) for t in (st.st_mtime, st.st_ctime)]
        yield (os.path.join(folder, e.name), e.name, folder, None if is_dir else st.st_size, *times, is_dir, i), is_dir and not e.is_symlink()


def _level(batches):
    """Rows of LISTING and ``down`` for the folders (path, lib_idx) of a level."""
    for batch in batches:
        rows = [(*row, down) for path, i in zip(batch.column("path").to_pylist(), batch.column("lib_idx").to_pylist()) for row, down in _entries(i, path)]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _ARROW)], names=[*LISTING.fieldNames(), "down"])


class ListingSource(DataSource):
    """``spark.read.format("media_listing").option("roots", JSON list of folders)``"""

    @classmethod
    def name(cls):
        return "media_listing"

    def schema(self):
        return LISTING

    def reader(self, schema):
        return _Reader(self.options)


def entries_of(folders: DataFrame) -> DataFrame:
    """Rows of LISTING of what is right in the ``folders`` (path), listed by tasks; missing ones give none."""
    ship(folders.sparkSession)
    schema = StructType([*LISTING.fields, StructField("down", BooleanType())])
    rows = written(folders.select("path", F.lit(0).alias("lib_idx")).distinct(), "folders")
    return rows.repartition(max(1, -(-rows.count() // FOLDERS_A_TASK))).mapInArrow(_level, schema).drop("down")


def listing(spark: SparkSession, roots: list[str], recursive: bool = False) -> DataFrame:
    """Rows of LISTING for files and folders in ``roots`` (below them too, if recursive); missing roots give none."""
    ship(spark)
    spark.dataSource.register(ListingSource)
    if not recursive:
        return spark.read.format("media_listing").option("roots", json.dumps([os.fspath(r) for r in roots])).load()
    # level by level: the folders of one are listed by tasks, which find those of the next
    schema = StructType([*LISTING.fields, StructField("down", BooleanType())])
    level = spark.createDataFrame([(os.fspath(r), i) for i, r in enumerate(roots) if os.path.isdir(r)], "path string, lib_idx int")
    found = None
    while (n := level.count()) or found is None:
        dealt = level.repartition(max(1, -(-n // FOLDERS_A_TASK)))
        rows = written(dealt.mapInArrow(_level, schema), "listing")
        found = rows if found is None else found.unionByName(rows)
        level = rows.filter("down").select("path", "lib_idx")
    return found.drop("down")
