"""Session-level helpers that every part of the library may use."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession

_SHIPPED: set[str] = set()
_LOCAL: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Make this package importable on the Python workers of the session's executors.

    Nothing is done where PYTHONPATH already names its folder (the workers inherit it);
    elsewhere a zip of the sources goes to all executors, later ones included.
    """
    package = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(package)
    if root in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    _SHIPPED.add(context.applicationId)
    target = os.path.join(tempfile.mkdtemp(prefix="eventloom-"), "eventloom_src.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, root))
    context.addPyFile(target)


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset (local sessions only) a temporary folder of this machine is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = "file://" + tempfile.mkdtemp(prefix="eventloom-shared-")
    return _LOCAL[context.applicationId]


def _own_folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/eventloom/{spark.sparkContext.applicationId}"


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder."""
    return f"{_own_folder(spark)}/{name}-{uuid.uuid4().hex[:12]}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table in the shared folder: lineage ends there and lost executors cost nothing."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def drop_scratch(spark: SparkSession) -> bool:
    """Delete all tables that this application wrote to the shared folder; lazy results over them end with it."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
