"""A whole import: duplicates, existing events, new events, names, plan."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from eventloom.config import Config, Mode, Status
from eventloom.operators import assign, duplicates, naming, sessions
from eventloom.plans import file_plan
from eventloom.runtime import written
from eventloom.schemas import CLUSTERS, MEDIA, empty
from eventloom.sources.listing import entries_of


@dataclass(frozen=True)
class Result:
    """What an import found; all lazy."""

    media: DataFrame
    library: DataFrame
    clusters: DataFrame
    plan: DataFrame
    empty_folders: DataFrame

    def summary(self) -> str:
        """Counts for people: files by status, events, and the plan's line."""
        by = {r.status: r.n for r in self.media.groupBy("status").agg(F.count("*").alias("n")).collect()}
        events = self.clusters.agg(F.count_if(F.col("path").isNull()).alias("new"), F.count_if(F.col("new_file_count") > 0).alias("used")).first()
        files = ", ".join(f"{by.get(s.name, 0)} {s.name.lower()}" for s in Status)
        return f"Files: {files}. New events: {events.new}, events with new files: {events.used}. {file_plan.summary(self.plan)}"


def organise(media: DataFrame, library: DataFrame, config: Config, found: DataFrame | None = None, taken: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(media, all clusters) with events and targets, from a media table and a library's cluster table.

    found: (file_name, duplicated_to) of files that the library has already.
    """
    if found is not None and config.skip_duplicates:
        media = duplicates.mark(media, found)
    if config.use_existing:
        media, library = assign.attach(media, library, config.gap)
        media, library = written(media, "attached"), written(library, "extended")
    first = library.agg(F.coalesce(F.max("cluster_id") + 1, F.lit(1))).first()[0]
    media = written(sessions.cluster(media, gap=config.gap, first_id=first), "clustered")
    new = media.filter(F.col("status") == Status.NEW_CLUSTER.name)
    rows = sessions.bounds(media).join(naming.named(new, method=config.representative, seed=config.seed), "cluster_id")
    every = sessions.append(library, sessions.as_clusters(rows))
    media = duplicates.with_duplicate_targets(naming.with_targets(media, every))
    return media, every


def run(spark: SparkSession, config: Config, execute: bool = True) -> Result:
    """Import the inbox as configured; a dry run (NOP) changes no file."""
    from eventloom.sources import library as lib, media as med

    files = med.inbox(spark, config)
    media = written(files, "inbox")
    tree = lib.scan(spark, list(config.libraries)) if config.libraries and (config.use_existing or config.skip_duplicates) else None
    known, bare = lib.clusters(spark, config, tree=tree)
    known = written(known, "library")
    found = None
    if config.skip_duplicates and tree is not None:
        found = med.duplicates_of_files(media, tree.files())
    done, every = organise(media.select(*MEDIA.names), known, config, found)
    done, every = written(done, "organised"), written(every, "clusters")
    taken = None if config.mode is Mode.NOP else _on_disk(config, done)
    plan = file_plan.build(done, config.inbox, config.outbox, config.mode, config.restore_names, taken)
    plan = written(plan, "plan")
    if execute and config.mode is not Mode.NOP:
        file_plan.execute(plan, config.outbox)
    return Result(done, known, every, plan, bare)


def _on_disk(config: Config, media: DataFrame) -> DataFrame:
    """(target_path, name) of what stands in the target folders of ``media`` already; no other folder is looked at."""
    root = config.outbox.rstrip("/") + "/"
    targets = media.filter("target_path is not null").select(F.concat(F.lit(root), "target_path").alias("path"))
    return written(entries_of(targets).select(F.substring(F.col("parent"), len(root) + 1, 1 << 30).alias("target_path"), "name"), "on-disk")


def nothing(spark: SparkSession) -> DataFrame:
    """An empty cluster table."""
    return empty(spark, CLUSTERS)
