"""Folders that fill up, as a stream: each file comes once, over restarts too.

The offset is the latest time of arrival that was seen and the names that had it.  The time of
arrival is the one that the file system sets (``st_ctime``): media keep their own times
when they are copied in, often years old.  Files that share an instant with those of a batch, and come
after it, are told apart by the names.
"""

from __future__ import annotations

import json
import os
import time
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from eventloom.runtime import ship
from eventloom.schemas import LISTING


class _Folder(InputPartition):
    def __init__(self, number: int, folder: str, start: dict, end: dict):
        self.number, self.folder, self.start, self.end = number, folder, start, end


def _files(folder: str) -> Iterator[tuple[str, str, os.stat_result]]:
    """(path, name, stat) of the files right in a folder; what is gone meanwhile is left out."""
    try:
        with os.scandir(folder) as entries:
            for e in entries:
                try:
                    if e.is_file():
                        yield os.path.join(folder, e.name), e.name, e.stat()
                except FileNotFoundError:
                    continue
    except (FileNotFoundError, NotADirectoryError):
        return


def after(offset: dict, at: int, path: str) -> bool:
    """Whether a file isn't yet within what an offset covers."""
    return at > offset["at"] or (at == offset["at"] and path not in offset["names"])


class ArrivalsReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.settle = int(float(options.get("settle", "0")) * 1e9)
        self.last = self.initialOffset()

    def initialOffset(self) -> dict:
        return {"at": -1, "names": []}

    def latestOffset(self) -> dict:
        """The last arrival that has settled, and all names that came at its instant; only these are held."""
        at, names = self.last["at"], set(self.last["names"])
        limit = time.time_ns() - self.settle
        for root in self.roots:
            for path, _, st in _files(root):
                if st.st_ctime_ns > limit or st.st_ctime_ns < at:
                    continue
                if st.st_ctime_ns > at:
                    at, names = st.st_ctime_ns, set()
                names.add(path)
        self.last = {"at": at, "names": sorted(names)}
        return self.last

    def partitions(self, start: dict, end: dict):
        return [_Folder(i, r, start, end) for i, r in enumerate(self.roots)]

    def read(self, partition):
        names = {k: {"at": o["at"], "names": set(o["names"])} for k, o in (("start", partition.start), ("end", partition.end))}
        for path, name, st in _files(partition.folder):
            if after(names["start"], st.st_ctime_ns, path) and not after(names["end"], st.st_ctime_ns, path):
                times = [datetime.fromtimestamp(int(t)) for t in (st.st_mtime, st.st_ctime)]
                yield (path, name, partition.folder, st.st_size, *times, False, partition.number)

    def commit(self, end: dict) -> None:
        pass


class ArrivalsSource(DataSource):
    """``spark.readStream.format("media_arrivals").option("roots", JSON list of folders)``, option ``settle`` in seconds"""

    @classmethod
    def name(cls):
        return "media_arrivals"

    def schema(self):
        return LISTING

    def streamReader(self, schema):
        return ArrivalsReader(self.options)


def arrivals(spark: SparkSession, roots: list[str], settle: float = 0.0, once: bool = True) -> DataFrame:
    """A stream of LISTING rows of the files that come into ``roots`` (not below them), those that are there at first too.

    settle: seconds since a file was last written or moved before it is taken, so that copies
    under way are left alone (and clocks of file servers may differ by as much).  A later change of a
    file's attributes is an arrival to the file system; ``once`` keeps it out by a state of
    one row a file (path, size, m_date).  Files that go before they are read give no row.
    """
    ship(spark)
    spark.dataSource.register(ArrivalsSource)
    reader = spark.readStream.format("media_arrivals").option("roots", json.dumps([os.fspath(r) for r in roots]))
    rows = reader.option("settle", str(settle)).load()
    return rows.dropDuplicates(["path", "size", "m_date"]) if once else rows
