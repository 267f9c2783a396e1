"""Versioned tables, and the one of folder summaries, so that unchanged folders are never decoded again.

Each version is a Parquet snapshot in a folder of its own.  A new one is written beside the others
and becomes visible by one rename that fails if somebody else took the number: readers see whole
versions only, and of two writers one gets ``CatalogueConflict``.
"""

from __future__ import annotations

import re
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from eventloom.errors import CatalogueConflict
from eventloom.schemas import CATALOGUE, empty

_VERSION = re.compile(r"v(\d{10})")


class Versions:
    """Versions of a table under ``folder``, a path of any file system that Spark writes to."""

    def __init__(self, spark: SparkSession, folder: str, schema: StructType):
        self.spark, self.folder, self.schema = spark, folder.rstrip("/"), schema

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def versions(self) -> list[int]:
        """Numbers of the versions there are, ascending."""
        path = self._path()
        system = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not system.exists(path):
            return []
        found = (_VERSION.fullmatch(s.getPath().getName()) for s in system.listStatus(path))
        return sorted(int(m[1]) for m in found if m)

    def version(self) -> int:
        """Number of the latest version; 0 if there is none."""
        return max(self.versions(), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        """The latest version, or another one that is still kept; an empty table if there is none."""
        version = self.version() if version is None else version
        if not version:
            return empty(self.spark, self.schema)
        return self.spark.read.schema(self.schema).parquet(f"{self.folder}/v{version:010d}")

    def commit(self, table: DataFrame, after: int, keep: int = 2) -> int:
        """Make ``table`` the version that follows ``after``; the number. Versions older than the last ``keep`` go."""
        name = f"_new-{uuid.uuid4().hex}"
        table.select(*self.schema.names).write.parquet(f"{self.folder}/{name}")
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path().toUri(), conf)
        options = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        system = self._path().getFileSystem(conf)
        try:
            if self.version() != after:
                raise CatalogueConflict(self.folder, after + 1)
            context.rename(self._path(name), self._path(f"v{after + 1:010d}"), options)
        except Py4JJavaError as e:
            raise CatalogueConflict(self.folder, after + 1) from e
        finally:
            system.delete(self._path(name), True)
        for old in self.versions()[:-keep]:
            system.delete(self._path(f"v{old:010d}"), True)
        return after + 1


class Catalogue(Versions):
    """Versions of the summaries of library folders."""

    def __init__(self, spark: SparkSession, folder: str):
        super().__init__(spark, folder, CATALOGUE)


def signatures(events: DataFrame, files: DataFrame, settings: str = "") -> DataFrame:
    """``events`` (path, ...) with ``signature``: of names, sizes and times (whole seconds) of the files right in each.

    files: rows of a listing.  Sums of two hashes, so that a folder's files are never gathered or
    ordered; ``settings`` names what else the summaries depend on.
    """
    row = lambda seed: F.sum(F.xxhash64(F.lit(seed), "name", "size", "m_date").cast("decimal(38,0)"))
    sums = files.groupBy(F.col("parent").alias("path")).agg(F.concat_ws(":", F.count("*"), row(1), row(2)).alias("_sum"))
    signed = events.join(sums, "path", "left")
    return signed.withColumn("signature", F.concat_ws("|", F.lit(settings), F.coalesce("_sum", F.lit("0")))).drop("_sum")
