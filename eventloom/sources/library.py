"""Library events: folder labels, per-folder summaries, ini files, and the cluster table."""

from __future__ import annotations

import configparser
import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from eventloom.config import INI_NAME, Config, Mode
from eventloom.functions.media import is_supported
from eventloom.functions.names import folder_type, parse_flag, relative_path
from eventloom.operators.sessions import GAP, as_clusters, folder_stats
from eventloom.runtime import ship, written
from eventloom.schemas import CLUSTERS, empty
from eventloom.sources.catalogue import Catalogue, signatures
from eventloom.sources.listing import listing
from eventloom.sources.media import media_table

SECTION = "Range"
_KEYS = ("start_date", "end_date", "is_continuous", "median", "file_count")


@dataclass(frozen=True)
class Tree:
    """What one listing of all libraries found: every file and folder below them, and the event folders (path, lib_idx)."""

    rows: DataFrame
    events: DataFrame
    libraries: tuple[str, ...]

    def files(self) -> DataFrame:
        """Files whose name has a dot, of any type."""
        return self.rows.filter("not is_dir and name like '%.%'")


def scan(spark: SparkSession, libraries: list[str]) -> Tree:
    """List all libraries once; imports hand this on to whatever looks at them."""
    rows = listing(spark, libraries, recursive=True)
    events = _labelled(spark, rows, libraries).filter("folder_type = 'event'").select("path", "lib_idx")
    return Tree(rows, events, tuple(map(os.fspath, libraries)))


def _labelled(spark: SparkSession, rows: DataFrame, libraries: list[str]) -> DataFrame:
    roots = spark.createDataFrame([(i, os.fspath(r)) for i, r in enumerate(libraries)], "lib_idx int, root string")
    inner = rows.filter("is_dir").select("path", "lib_idx").join(F.broadcast(roots), "lib_idx")
    labelled = inner.withColumn("relative", relative_path(F.col("path"), F.col("root"))).drop("root")
    return labelled.withColumn("folder_type", folder_type(F.col("relative")))


def folders(spark: SparkSession, libraries: list[str]) -> DataFrame:
    """Every folder below the libraries: path, lib_idx, relative, folder_type."""
    return _labelled(spark, listing(spark, libraries, recursive=True), libraries)


def files(spark: SparkSession, libraries: list[str]) -> DataFrame:
    """Every file below the libraries whose name has a dot, of any type."""
    return scan(spark, libraries).files()


def _ini_rows(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for part in parts:
        rows = []
        for path in part["path"]:
            parser = configparser.ConfigParser()
            found = parser.read(os.path.join(path, INI_NAME))
            section = parser[SECTION] if found and SECTION in parser else {}
            rows.append([path, bool(section), *[section.get(k) for k in _KEYS]])
        yield pd.DataFrame(rows, columns=["path", "has_ini", *_KEYS])


def read_ini(events: DataFrame) -> DataFrame:
    """(path) of event folders to their ini files' values, typed; folders without one give no row.

    Dates are seconds exactly (else null), the median may have a fraction, flags are exactly
    True or False (else an error), the count is an integer.
    """
    ship(events.sparkSession)
    text = ", ".join(f"{k} string" for k in _KEYS)
    rows = events.select("path").mapInPandas(_ini_rows, f"path string, has_ini boolean, {text}").filter("has_ini")
    exact = lambda c: F.try_to_timestamp(c, F.lit("yyyy-MM-dd HH:mm:ss")).cast("timestamp_ntz")
    fraction = F.try_to_timestamp(F.col("median"), F.lit("yyyy-MM-dd HH:mm:ss.SSSSSS")).cast("timestamp_ntz")
    return rows.select(
        "path", exact(F.col("start_date")).alias("start_date"), exact(F.col("end_date")).alias("end_date"),
        F.coalesce(exact(F.col("median")), fraction).alias("median"),
        parse_flag(F.col("is_continuous")).alias("is_continuous"), F.col("file_count").cast("long").alias("file_count"),
    )


def ini_values(summary: DataFrame) -> DataFrame:
    """Summaries (path, start_date, ...) as the strings that stand in ini files."""
    text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    flag = F.when(F.col("is_continuous"), "True").otherwise("False")
    return summary.select("path", text("start_date").alias("start_date"), text("end_date").alias("end_date"), flag.alias("is_continuous"), text("median").alias("median"), F.col("file_count").cast("string").alias("file_count"))


def _write(rows) -> None:
    for r in rows:
        parser = configparser.ConfigParser()
        parser[SECTION] = {k: r[k] or "" for k in _KEYS}
        target = os.path.join(r["path"], INI_NAME)
        with open(f"{target}.part", "w") as f:
            parser.write(f)
        os.replace(f"{target}.part", target)


def write_ini(summary: DataFrame) -> None:
    """Write each folder's ini file (on executors that see the library)."""
    ship(summary.sparkSession)
    ini_values(summary).foreachPartition(_write)


def decoded(tree: Tree, events: DataFrame, config: Config, gap=GAP) -> DataFrame:
    """(path, start_date, end_date, median, is_continuous, file_count) of those of ``events`` (path) that hold media, from the files."""
    inside = tree.rows.filter("not is_dir").join(events.select(F.col("path").alias("parent")), "parent", "left_semi")
    return folder_stats(media_table(inside, config), "parent", gap=gap).select(
        F.col("parent").alias("path"), F.col("date_start").alias("start_date"), F.col("date_stop").alias("end_date"), "median",
        F.col("is_time_consistent").alias("is_continuous"), "file_count",
    )


def bare(tree: Tree) -> DataFrame:
    """(path) of event folders without any file but an ini file."""
    held = tree.rows.filter(~F.col("is_dir") & (F.col("name") != INI_NAME)).select(F.col("parent").alias("path")).distinct()
    return tree.events.join(held, "path", "left_anti").select("path")


def stale(tree: Tree, inis: DataFrame, config: Config) -> DataFrame:
    """(path) of ``inis`` (path, file_count) that don't fit their folder: a media file is younger, or their number differs."""
    media = tree.rows.filter(~F.col("is_dir") & is_supported(F.col("name"), config.image_extensions, config.video_extensions))
    own = tree.rows.filter(~F.col("is_dir") & (F.col("name") == INI_NAME)).select(F.col("parent").alias("path"), F.greatest("m_date", "c_date").alias("_made"))
    held = media.groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("_n"), F.max("m_date").alias("_last"))
    seen = inis.select("path", "file_count").join(own, "path", "left").join(held, "path", "left")
    differs = ~F.col("file_count").eqNullSafe(F.coalesce("_n", F.lit(0)))
    return seen.filter(differs | F.coalesce(F.col("_last") > F.col("_made"), F.lit(False))).select("path")


def summaries(tree: Tree, config: Config, gap=GAP) -> DataFrame:
    """(path, lib_idx, start_date, end_date, median, is_continuous, file_count) of the libraries' event folders.

    Files are opened of those folders only that nothing else tells about.  Without a catalogue, inis
    are taken as they are; with one, its rows hold as long as a folder's names, sizes and times
    are what they were, then inis that aren't stale, and what was found makes a new
    version (not in a dry run).  ``deep_scan`` decodes everything.
    """
    spark = tree.rows.sparkSession
    events = tree.events
    columns = ("path", "start_date", "end_date", "median", "is_continuous", "file_count")
    if config.catalogue is None:
        if config.deep_scan:
            return decoded(tree, events, config, gap).join(events, "path")
        known = written(read_ini(events).select(*columns), "inis")
        fresh = decoded(tree, events.join(known.select("path"), "path", "left_anti"), config, gap)
        return known.unionByName(fresh.select(*columns)).join(events, "path")
    table = Catalogue(spark, config.catalogue)
    version = table.version()
    held = table.read(version)
    settings = hashlib.md5(repr((gap, config.image_extensions, config.video_extensions)).encode()).hexdigest()
    signed = written(signatures(events, tree.rows.filter(~F.col("is_dir") & (F.col("name") != INI_NAME)), settings), "signed-folders")
    hits = held.join(signed.select("path", "signature"), ["path", "signature"], "left_semi")
    if config.deep_scan:
        hits = hits.limit(0)
    rest = signed.join(hits.select("path"), "path", "left_anti")
    if config.deep_scan:
        known = hits.select(*columns)
    else:
        inis = written(read_ini(rest).select(*columns), "inis")
        known = inis.join(stale(tree, inis, config), "path", "left_anti")
    fresh = decoded(tree, rest.join(known.select("path"), "path", "left_anti"), config, gap)
    roots = spark.createDataFrame(list(enumerate(tree.libraries)), "lib_idx int, root string")
    found = known.unionByName(fresh.select(*columns)).join(signed, "path").join(F.broadcast(roots), "lib_idx")
    # folders of other libraries stay as they are; those that are gone here don't
    others = held.join(F.broadcast(roots.select("root")), "root", "left_anti")
    now = written(others.unionByName(hits).unionByName(found.select(*held.columns)), "catalogue")
    if config.mode is not Mode.NOP and not now.exceptAll(held).unionByName(held.exceptAll(now)).isEmpty():
        table.commit(now, version)
    return now.join(events, "path").select(*columns, "lib_idx")


def clusters(spark: SparkSession, config: Config, gap=GAP, tree: Tree | None = None) -> tuple[DataFrame, DataFrame]:
    """(cluster table of all libraries, empty event folders); ids ascend from 0 by library and path.

    See ``summaries`` for where they come from; the libraries aren't written to.  Without libraries,
    or when neither duplicates nor existing events are asked for, both are empty.
    """
    none = empty(spark, CLUSTERS)
    if not config.libraries or not (config.use_existing or config.skip_duplicates):
        return none, none.select("path")
    tree = tree or scan(spark, list(config.libraries))
    # sorted in ranges; each range is numbered by itself, after what stands in those before it (one row a range)
    ranged = written(summaries(tree, config, gap).orderBy("lib_idx", "path").withColumn("_b", F.spark_partition_id()), "library-events")
    before = F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("_n")
    ahead = ranged.groupBy("_b").agg(F.count("*").alias("_n")).select("_b", before.alias("_before"))
    number = F.row_number().over(Window.partitionBy("_b").orderBy("lib_idx", "path")) - 1
    return as_clusters(ranged.withColumn("_i", number).join(ahead, "_b").withColumn("cluster_id", F.col("_i") + F.col("_before"))), bare(tree)


def refresh(spark: SparkSession, libraries: list[str], config: Config, force: bool = True) -> DataFrame:
    """Write the ini files of the libraries' event folders (those that lack one, unless ``force``); the summaries written."""
    config = replace(config, libraries=tuple(libraries), deep_scan=force, catalogue=None)
    tree = scan(spark, libraries)
    events = tree.events
    if not force:  # folders with an ini aren't opened
        events = events.join(written(read_ini(events).select("path"), "inis"), "path", "left_anti")
    fresh = written(decoded(tree, events, config), "fresh-summaries")
    write_ini(fresh)
    return fresh
