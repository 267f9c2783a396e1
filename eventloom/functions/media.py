"""Column functions of media files: types, dates, status, hashes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.config import IMAGE_EXTENSIONS, VIDEO_EXTENSIONS
from eventloom.schemas import require_columns

#: Seconds from the QuickTime epoch (1904) to the Unix epoch, and the first year that is believed.
QUICKTIME_OFFSET, FIRST_YEAR = 2_082_844_800, 1990
#: Bytes that a partial hash covers.
PARTIAL_BYTES = 1 << 20


def has_extension(name: Column, extensions) -> Column:
    """Case-insensitive suffix match with any of ``extensions``; no extension: false."""
    low = F.lower(name)
    return reduce(lambda a, b: a | b, [F.endswith(low, F.lit(e.lower())) for e in extensions], F.lit(False))


def is_supported(name: Column, images=IMAGE_EXTENSIONS, videos=VIDEO_EXTENSIONS) -> Column:
    return has_extension(name, tuple(images) + tuple(videos))


def is_image(name: Column, images=IMAGE_EXTENSIONS) -> Column:
    return has_extension(name, images)


def resolve_date(df: DataFrame, rule: str = "m_date", drop: bool = True) -> DataFrame:
    """One ``date`` from m_date, c_date and exif_date.

    ``m_date``: the EXIF date, else the modification date; ``earliest``: the least of all three,
    nulls skipped; any other rule leaves ``date`` as it is (null if there is none).
    """
    require_columns(df, ["m_date", "c_date", "exif_date"])
    if rule == "m_date":
        df = df.withColumn("date", F.coalesce("exif_date", "m_date"))
    elif rule == "earliest":
        df = df.withColumn("date", F.least("m_date", "c_date", "exif_date"))
    elif "date" not in df.columns:
        df = df.withColumn("date", F.lit(None).cast("timestamp_ntz"))
    return df.drop("m_date", "c_date", "exif_date") if drop else df


def exif_timestamp(text: Column) -> Column:
    """An EXIF date string, with or without a fraction; null if it is anything else."""
    form = r"^\d{4}:\d{2}:\d{2} \d{2}:\d{2}:\d{2}(\.\d{1,6})?$"
    parsed = F.try_to_timestamp(F.regexp_replace(text, r"^(\d{4}):(\d{2}):", "$1-$2-")).cast("timestamp_ntz")
    return F.when(F.regexp_like(text, F.lit(form)), parsed)


def quicktime_timestamp(seconds: Column) -> Column:
    """A QuickTime creation time (unsigned seconds since 1904) as a timestamp; before 1990: null."""
    at = F.timestamp_seconds(seconds - QUICKTIME_OFFSET).cast("timestamp_ntz")
    return F.when(F.year(at) >= FIRST_YEAR, at)


def content_hash(content: Column, algorithm: str = "sha1") -> Column:
    """Lowercase hex digest of a binary column: sha1, md5 or sha256."""
    data = content.cast("binary")
    if algorithm not in ("sha1", "md5", "sha256"):
        raise ValueError(f"unknown hash: {algorithm}")
    return F.sha1(data) if algorithm == "sha1" else F.md5(data) if algorithm == "md5" else F.sha2(data, 256)


def partial_hash(content: Column, n: int = PARTIAL_BYTES) -> Column:
    """MD5 of the first ``n`` bytes."""
    return F.md5(F.substring(content.cast("binary"), 1, n))


def missing_dates(df: DataFrame) -> DataFrame:
    """One row: how many files have no date (n_missing) of how many (n_files)."""
    return df.agg(F.count_if(F.col("date").isNull()).alias("n_missing"), F.count("*").alias("n_files"))


def image_tag(jpeg: Column) -> Column:
    """An HTML image element with the bytes as a data URI; null stays null."""
    return F.concat(F.lit('<img src="data:image/jpeg;base64,'), F.translate(F.base64(jpeg), "\r\n", ""), F.lit('">'))  # without line breaks
