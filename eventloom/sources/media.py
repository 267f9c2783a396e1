"""Media tables from folders: listing, decoded dates, hashes of the rows that need them."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from eventloom.config import Config, Status
from eventloom.functions import decode
from eventloom.functions.media import exif_timestamp, image_tag, is_image, is_supported, quicktime_timestamp, resolve_date
from eventloom.runtime import ship, written
from eventloom.schemas import MEDIA
from eventloom.sources.listing import listing


def _decoded(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        exif, moved = [], []
        for path, name in zip(part["path"], part["name"]):
            date = seconds = None
            try:
                with open(path, "rb") as f:
                    if name.lower().endswith("mov"):
                        seconds = decode.quicktime_seconds(f)
                    else:
                        date = decode.exif_date(f)
            except OSError:
                pass
            exif.append(date)
            moved.append(seconds)
        yield part.assign(exif=exif, seconds=pd.array(moved, dtype="Int64"))


def with_dates(files: DataFrame) -> DataFrame:
    """LISTING rows with exif_date, and m_date and c_date of QuickTime files from their movie header.

    A header that can't be read keeps the file's times; a time before 1990 gives none.
    """
    ship(files.sparkSession)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in files.schema.fields)
    rows = files.mapInPandas(_decoded, f"{fields}, exif string, seconds long")
    made = quicktime_timestamp(F.col("seconds"))
    return rows.withColumns({
        "exif_date": exif_timestamp(F.col("exif")),
        "m_date": F.when(F.col("seconds").isNotNull(), made).otherwise(F.col("m_date")),
        "c_date": F.when(F.col("seconds").isNotNull(), made).otherwise(F.col("c_date")),
    }).drop("exif", "seconds")


def _hashed(algorithm: str, limit: int | None, out: str):
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            digests = []
            for path in part["path"]:
                try:
                    with open(path, "rb") as f:
                        digests.append(decode.file_hash(f, algorithm, limit))
                except OSError:
                    digests.append(None)
            yield part.assign(**{out: digests})

    return run


def with_hash(files: DataFrame, algorithm: str = "sha1", limit: int | None = None, out: str = "hash_value") -> DataFrame:
    """``files`` (path, ...) with a digest of the content (or its first ``limit`` bytes), read in blocks; unreadable: null."""
    ship(files.sparkSession)
    kept = files.drop(out)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInPandas(_hashed(algorithm, limit, out), f"{fields}, {out} string")


def _thumbnailed(make: Callable[[bytes, int], bytes | None], side: int, out: str):
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for k, path in enumerate(part.column("path").to_pylist()):  # one row at a time: images are large, batches are long
                try:
                    with open(path, "rb") as f:
                        image = make(f.read(), side)
                except OSError:
                    image = None
                row = part.slice(k, 1)
                yield pa.RecordBatch.from_arrays([*row.columns, pa.array([image], pa.binary())], names=[*row.schema.names, out])

    return run


def with_thumbnails(files: DataFrame, side: int = 150, out: str = "thumbnail", make: Callable[[bytes, int], bytes | None] = decode.thumbnail) -> DataFrame:
    """``files`` (path, ...) with a JPEG of at most ``side`` squared made by tasks; what isn't an image, or can't be read, has none.

    A column named like ``out`` is replaced. ``make`` is (content, side) to JPEG or None; without an imaging library all are null.
    """
    ship(files.sparkSession)
    kept = files.drop(out)
    return kept.mapInArrow(_thumbnailed(make, side, out), StructType([*kept.schema.fields, StructField(out, BinaryType())]))


def with_image_tags(files: DataFrame, thumbnail: str = "thumbnail", out: str = "image_tag") -> DataFrame:
    """``files`` with an HTML image element of each thumbnail, as data URI; null where there is none."""
    return files.withColumn(out, image_tag(F.col(thumbnail)))


def media_table(files: DataFrame, config: Config, rule: str = "m_date", hashes: bool = False) -> DataFrame:
    """Supported files of a listing as rows of MEDIA (raw dates kept), and their path and parent."""
    rows = with_dates(files.filter(~F.col("is_dir") & is_supported(F.col("name"), config.image_extensions, config.video_extensions)))
    if hashes:
        rows = with_hash(rows)
    rows = resolve_date(rows, rule, drop=False)
    none = F.lit(None)
    values = {
        "file_name": F.col("name"),
        "is_image": is_image(F.col("name"), config.image_extensions),
        "status": F.lit(Status.UNKNOWN.name),
        "hash_value": F.col("hash_value") if hashes else none,
    }
    made = [values.get(f.name, F.col(f.name) if f.name in rows.columns else none).cast(f.dataType).alias(f.name) for f in MEDIA.fields]
    return rows.select(*made, "path", "parent")


def inbox(spark: SparkSession, config: Config, rule: str = "m_date", hashes: bool = False) -> DataFrame:
    """Media of the inbox folder itself (not below it); an empty one gives an empty table."""
    return media_table(listing(spark, [config.inbox]), config, rule, hashes)


def duplicates_of_files(found: DataFrame, library: DataFrame) -> DataFrame:
    """(file_name, duplicated_to) of inbox files (file_name, path, size) that library files (path, size, lib_idx) equal.

    Sizes first; bytes are read of what is left after each stage only.
    """
    from eventloom.functions.media import PARTIAL_BYTES

    left = found.select("file_name", "path", "size").join(library.select("size").distinct(), "size", "left_semi")
    right = library.select("path", "size", "lib_idx").join(found.select("size").distinct(), "size", "left_semi")
    left, right = (written(with_hash(x, "md5", PARTIAL_BYTES, "part"), "heads") for x in (left, right))  # both are needed twice, and read once
    near = ["size", "part"]
    left2 = with_hash(left.join(right.select(*near).distinct(), near, "left_semi"), out="full")
    right2 = with_hash(right.join(left.select(*near).distinct(), near, "left_semi"), out="full")
    first = right2.filter("full is not null").groupBy(*near, "full").agg(F.min(F.struct("lib_idx", "path")).alias("first"))
    return left2.join(first, [*near, "full"]).select("file_name", F.col("first.path").alias("duplicated_to"))
