"""Explicit schemas and column checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from eventloom.errors import MissingColumnError


_TYPES = {"STRING": T.StringType(), "TIMESTAMP_NTZ": T.TimestampNTZType(), "BIGINT": T.LongType(), "BOOLEAN": T.BooleanType(), "INT": T.IntegerType()}


def _struct(text: str) -> T.StructType:
    """Schema of ``name TYPE, ...`` without a session."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in text.split(","))])


MEDIA = _struct(
    "file_name STRING, m_date TIMESTAMP_NTZ, c_date TIMESTAMP_NTZ, exif_date TIMESTAMP_NTZ, date TIMESTAMP_NTZ, size BIGINT, "
    "hash_value STRING, is_image BOOLEAN, cluster_id BIGINT, status STRING, duplicated_to STRING, duplicated_cluster STRING"
)
CLUSTERS = _struct(
    "cluster_id BIGINT, start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ, median TIMESTAMP_NTZ, is_continuous BOOLEAN, path STRING, "
    "target_path STRING, file_count BIGINT, new_file_count BIGINT"
)
CATALOGUE = _struct(
    "root STRING, path STRING, signature STRING, start_date TIMESTAMP_NTZ, end_date TIMESTAMP_NTZ, median TIMESTAMP_NTZ, is_continuous BOOLEAN, "
    "file_count BIGINT"
)
LISTING = _struct("path STRING, name STRING, parent STRING, size BIGINT, m_date TIMESTAMP_NTZ, c_date TIMESTAMP_NTZ, is_dir BOOLEAN, lib_idx INT")
PLAN = _struct("seq BIGINT, op STRING, src STRING, dst STRING, reason STRING")


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


def require_columns(df: DataFrame, columns) -> DataFrame:
    """``df``, if it has all columns; the first one missing is named in the error."""
    for c in columns:
        if c not in df.columns:
            raise MissingColumnError(c)
    return df


def reject_others(df: DataFrame, columns) -> DataFrame:
    """``df``, if it has no column besides ``columns``."""
    known = set(columns)
    for c in df.columns:
        if c not in known:
            raise ValueError(f"unexpected column: {c}")
    return df
