"""Exports for people: the event catalogue of a library, and a sample of a year's photos."""

from __future__ import annotations

import os
import shutil

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.functions.media import has_extension
from eventloom.functions.names import basename, catalogue_entry, in_year_folder
from eventloom.operators.naming import one_per_group
from eventloom.runtime import ship
from eventloom.sources.listing import listing

# Photo types of a sample, photos a year, widest photo.
SAMPLED = (".jpg", ".jpeg", ".png", ".gif", ".bmp", ".heic", ".heif")
SAMPLE_SIZE, SAMPLE_WIDTH = 10, 1024


def catalogue(folders: DataFrame, name: str = "name", year: str | None = None) -> DataFrame:
    """Lines ``date;name`` of event folders (of year folders only, if ``year`` names their column)."""
    rows = folders if year is None else folders.filter(in_year_folder(F.col(year)))
    return rows.select(catalogue_entry(F.col(name)).alias("line")).filter("line is not null")


def library_catalogue(spark: SparkSession, root: str) -> DataFrame:
    """Lines of the event folders right below the year folders of a library."""
    root = root.rstrip("/")
    rows = listing(spark, [root], recursive=True).filter("is_dir")
    inner = rows.filter(F.regexp_replace("parent", r"/[^/]*$", "") == root)
    return catalogue(inner.select("name", basename(F.col("parent")).alias("year")), year="year")


def write_catalogue(folders: DataFrame, target: str, name: str = "name") -> None:
    catalogue(folders, name).write.mode("overwrite").text(target)


def year_sample(spark: SparkSession, root: str, year: int | str, cap: int = SAMPLE_SIZE, seed: int = 0) -> DataFrame:
    """(parent, name, path): one photo of each event folder of a year, each name once, ``cap`` at most."""
    folder = f"{root.rstrip('/')}/{year}"
    rows = listing(spark, [folder], recursive=True).filter(~F.col("is_dir") & has_extension(F.col("name"), SAMPLED))
    inner = rows.filter(F.regexp_replace("parent", r"/[^/]*$", "") == folder).select("parent", "name", "path")
    return one_per_group(inner, "parent", F.col("name"), cap, seed)


def _shrunk(path: str, width: int) -> None:
    """Convert HEIC to JPEG and narrow wide photos, where an imaging library is there and reads them."""
    try:
        from PIL import Image
    except ImportError:
        return
    try:
        image = Image.open(path)
        if path.lower().endswith((".heic", ".heif")):
            image = image.convert("RGB")
            image.save(path, "JPEG")
        if image.width > width:
            image.resize((width, image.height * width // image.width)).save(path, "JPEG" if path.lower().endswith((".heic", ".heif")) else None)
    except OSError:
        return


def export_sample(sample: DataFrame, target: str, width: int = SAMPLE_WIDTH) -> None:
    """Copy a sample's photos to ``target`` on the executors, shrunk where possible; safe to run again."""
    ship(sample.sparkSession)
    os.makedirs(target, exist_ok=True)

    def copy(rows) -> None:
        for r in rows:
            out = os.path.join(target, r.name)
            shutil.copyfile(r.path, f"{out}.part")
            os.replace(f"{out}.part", out)
            _shrunk(out, width)

    sample.foreachPartition(copy)
