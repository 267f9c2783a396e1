"""Folder trees as a Spark data source that takes filters: what they rule out is neither walked nor made a row.

Rows are those of LISTING with ``depth`` (0: right in a root) and ``extension`` (lower case, behind
the last dot; null without one).  A bound on the depth, a folder's path or the start of a
parent's path, and the number of a root cut off whole subtrees; names, extensions and kinds are
tested before a file's size and times are asked for.
"""

from __future__ import annotations

import json
import os
import uuid
from collections.abc import Iterator
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql import datasource as ds
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from eventloom.runtime import ship
from eventloom.schemas import LISTING

TREE = StructType([*LISTING.fields, StructField("depth", IntegerType()), StructField("extension", StringType())])
#: Columns that are known before a file is looked at, and those whose filters are taken.
_CHEAP = {"path", "name", "parent", "is_dir", "lib_idx", "depth", "extension"}
_TAKEN = _CHEAP | {"size"}
#: Folders that are dealt to tasks: levels are opened on the driver until there are so many.
SUBTREES = 256
_ORDER = {
    ds.LessThan: lambda a, b: a < b, ds.LessThanOrEqual: lambda a, b: a <= b, ds.GreaterThan: lambda a, b: a > b,
    ds.GreaterThanOrEqual: lambda a, b: a >= b, ds.EqualTo: lambda a, b: a == b, ds.StringStartsWith: str.startswith,
    ds.StringEndsWith: str.endswith, ds.StringContains: lambda a, b: b in a,
}


def column_of(f: ds.Filter) -> str | None:
    """The column that a filter is on, where it is one that ``holds`` knows; else None."""
    if isinstance(f, ds.Not):
        return column_of(f.child)
    known = (*_ORDER, ds.EqualNullSafe, ds.In, ds.IsNull, ds.IsNotNull)
    return f.attribute[0] if isinstance(f, known) and len(f.attribute) == 1 else None


def holds(f: ds.Filter, row: dict) -> bool | None:
    """Whether a filter holds for a row, as in SQL: None where a null leaves it open."""
    if isinstance(f, ds.Not):
        inner = holds(f.child, row)
        return None if inner is None else not inner
    value = row[f.attribute[0]]
    if isinstance(f, (ds.IsNull, ds.IsNotNull)):
        return (value is None) == isinstance(f, ds.IsNull)
    if isinstance(f, ds.EqualNullSafe):
        return value == f.value
    if value is None:
        return None
    if isinstance(f, ds.In):
        return True if value in [v for v in f.value if v is not None] else (None if None in f.value else False)
    return None if f.value is None else _ORDER[type(f)](value, f.value)


def _leads_on(f: ds.Filter, folder: str, i: int, depth: int) -> bool:
    """Whether rows in ``folder`` (whose entries have ``depth``), or below it, may meet a filter."""
    column = column_of(f)
    if column == "lib_idx":
        return holds(f, {"lib_idx": i}) is True
    if column == "depth" and isinstance(f, (ds.EqualTo, ds.LessThanOrEqual)):
        return f.value is not None and depth <= f.value
    if column == "depth" and isinstance(f, ds.LessThan):
        return f.value is not None and depth < f.value
    if column in ("parent", "path") and isinstance(f, (ds.EqualTo, ds.StringStartsWith)):
        if f.value is None:
            return False
        inside = os.path.join(folder, "")
        # paths of entries begin with ``inside``, parents are ``folder`` or begin so
        if isinstance(f, ds.StringStartsWith):
            return inside.startswith(f.value) or f.value.startswith(inside) or (column == "parent" and folder.startswith(f.value))
        return f.value.startswith(inside) or (column == "parent" and f.value == folder)
    return True


class _Subtrees(ds.InputPartition):
    def __init__(self, folders: list[tuple[int, str, int]], deep: bool):
        self.folders, self.deep = folders, deep


class TreeReader(ds.DataSourceReader):
    def __init__(self, options: dict):
        self.roots = json.loads(options["roots"])
        self.filters: list[ds.Filter] = []

    def pushFilters(self, filters):
        for f in filters:
            if column_of(f) in _TAKEN:
                self.filters.append(f)
            else:
                yield f

    def partitions(self):
        """Levels that were opened here as rows of their folders, and the subtrees below them."""
        level = [(i, r, 0) for i, r in enumerate(self.roots) if os.path.isdir(r) and self._leads(r, i, 0)]
        opened = []
        while level and len(level) < SUBTREES:
            opened += level
            level = [(i, path, depth + 1) for i, folder, depth in level for path in self._below(folder, i, depth)]
        parts = [_Subtrees(opened[k : k + SUBTREES], False) for k in range(0, len(opened), SUBTREES)]
        return parts + [_Subtrees([x], True) for x in level] or [_Subtrees([], False)]

    def read(self, partition):
        todo = list(reversed(partition.folders))
        while todo:
            i, folder, depth = todo.pop()
            yield from self._rows(folder, i, depth)
            if partition.deep:
                todo += [(i, path, depth + 1) for path in self._below(folder, i, depth)]

    def _leads(self, folder: str, i: int, depth: int) -> bool:
        return all(_leads_on(f, folder, i, depth) for f in self.filters)

    def _below(self, folder: str, i: int, depth: int) -> list[str]:
        """Folders right in ``folder`` that are worth going down into; links aren't followed."""
        inside = os.path.join(folder, "x")
        if not self._may_go_on(inside, i, depth + 1):
            return []
        return [e.path for e in _scan(folder) if e.is_dir(follow_symlinks=False) and self._leads(e.path, i, depth + 1)]

    def _may_go_on(self, child: str, i: int, depth: int) -> bool:
        """Whether any folder below could lead on, by what doesn't depend on its name."""
        return all(_leads_on(f, child, i, depth) for f in self.filters if column_of(f) in ("depth", "lib_idx"))

    def _rows(self, folder: str, i: int, depth: int) -> Iterator[tuple]:
        early = [f for f in self.filters if column_of(f) in _CHEAP]
        late = [f for f in self.filters if column_of(f) not in _CHEAP]
        for e in _scan(folder):
            is_dir = e.is_dir()
            _, dot, end = e.name.rpartition(".")
            row = {"path": os.path.join(folder, e.name), "name": e.name, "parent": folder, "is_dir": is_dir, "lib_idx": i, "depth": depth, "extension": end.lower() if dot else None}
            if not all(holds(f, row) for f in early):
                continue
            try:
                st = e.stat()
            except FileNotFoundError:
                continue
            row["size"] = None if is_dir else st.st_size
            if all(holds(f, row) for f in late):
                row["m_date"], row["c_date"] = (datetime.fromtimestamp(int(t)) for t in (st.st_mtime, st.st_ctime))
                yield tuple(row[c] for c in TREE.fieldNames())


def _scan(folder: str) -> list[os.DirEntry]:
    try:
        return sorted(os.scandir(folder), key=lambda e: e.name)
    except (FileNotFoundError, NotADirectoryError):
        return []


class TreeSource(ds.DataSource):
    """``spark.read.format("media_tree").option("roots", JSON list of folders)``"""

    @classmethod
    def name(cls):
        return "media_tree"

    def schema(self):
        return TREE

    def reader(self, schema):
        return TreeReader(self.options)


def tree(spark: SparkSession, roots: list[str], where: Column | str | None = None) -> DataFrame:
    """Rows of TREE of everything below ``roots`` that meet ``where``, which decides what folders are opened at all.

    Missing roots give none. One subtree is walked by one task; where all of a library is wanted,
    ``listing.listing`` deals each level anew.

    A table of a Python source has one reader, which keeps the filters of the plan that was made last. So each
    call loads a table of its own, and a metric (rows that were found) keeps later filters from being pushed to it: those
    are applied to the rows, and the result can be used any number of times in one plan or in several.
    """
    ship(spark)
    spark.dataSource.register(TreeSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = spark.read.format("media_tree").option("roots", json.dumps([os.fspath(r) for r in roots])).load()
    found = found if where is None else found.filter(where)
    return found.observe(f"tree-{uuid.uuid4().hex}", F.count(F.lit(1)).alias("rows"))
