"""Names, counts and targets of events; joins that carry them to files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom.config import Representative
from eventloom.functions.names import event_name, existing_target, new_target, strip_copy_suffix
from eventloom.operators import sessions
from eventloom.operators.order_stats import kth
from eventloom.runtime import written


def representative(media: DataFrame, *keys: str, method: Representative = Representative.MEDIAN, date: str = "date", seed: int = 0) -> DataFrame:
    """Rows (keys, cluster_id, representative_date).

    MEDIAN: the member at 0-based place n // 2 by date, nulls last; RANDOM: a member drawn by
    a seeded hash of its name.  Equal dates collapse to counts before they are ordered; large events'
    are not ordered at all.
    """
    group = [*keys, "cluster_id"]
    if method is Representative.RANDOM:
        return media.groupBy(*group).agg(F.max_by(date, F.struct(F.md5(F.concat_ws("|", F.lit(str(seed)), "file_name")), "file_name")).alias("representative_date"))
    counts = written(media.groupBy(*group, F.col(date).alias("_d")).agg(F.count("*").alias("_n")), "dates")
    sizes = counts.groupBy(*group).agg(F.count("*").alias("_k"), F.sum("_n").alias("_all"), F.sum(F.when(F.col("_d").isNotNull(), F.col("_n"))).alias("_dated"))
    hot = written(sizes.filter(F.col("_k") > sessions.SINGLE_WINDOW_ROWS), "large-events")
    large = None if hot.isEmpty() else _middle_of_large(sessions._same(counts, hot.select(*group), group, "left_semi"), hot, group)
    if large is not None:
        counts = sessions._same(counts, hot.select(*group), group, "left_anti")
    order = Window.partitionBy(*group).orderBy(F.col("_d").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = counts.withColumn("_upto", F.sum("_n").over(order)).withColumn("_all", F.sum("_n").over(Window.partitionBy(*group)))
    middle = F.floor(F.col("_all") / 2)
    rest = placed.filter((F.col("_upto") > middle) & (F.col("_upto") - F.col("_n") <= middle)).select(*group, F.col("_d").alias("representative_date"))
    return rest if large is None else rest.unionByName(large)


def _middle_of_large(counts: DataFrame, sizes: DataFrame, group: list[str]) -> DataFrame:
    """Representative dates of events with more dates than one window should hold, see order_stats."""
    values = counts.select(*group, F.unix_micros(F.col("_d").cast("timestamp")).alias("value"), F.col("_n").alias("n"))
    found = kth(values, group, sizes.select(*group, F.expr("_all div 2").alias("rank")))
    every = sessions._same(sizes.select(*group), found, group)  # no row: the middle has no date
    return every.select(*group, F.timestamp_micros("value").cast(counts.schema["_d"].dataType).alias("representative_date"))


def counts(media: DataFrame, *keys: str) -> DataFrame:
    """Images, videos and files of each event."""
    return media.groupBy(*keys, "cluster_id").agg(
        F.count_if("is_image").alias("n_images"), F.count_if(~F.col("is_image")).alias("n_videos"), F.count("*").alias("new_file_count")
    )


def named(media: DataFrame, *keys: str, method: Representative = Representative.MEDIAN, date: str = "date", seed: int = 0) -> DataFrame:
    """Rows (keys, cluster_id, target_path, new_file_count) of the events in ``media``."""
    group = [*keys, "cluster_id"]
    rows = counts(media, *keys).join(representative(media, *keys, method=method, date=date, seed=seed), group)
    name = event_name(F.col("representative_date"), F.col("n_images"), F.col("n_videos"), F.col("cluster_id").cast("string"))
    return rows.select(*group, new_target(name).alias("target_path"), "new_file_count")


def with_existing_targets(clusters: DataFrame) -> DataFrame:
    """Library events' targets: ``existing/<folder>``; applying it again changes nothing."""
    return clusters.withColumn("target_path", F.when(F.col("path").isNotNull(), existing_target(F.col("path"))).otherwise(F.col("target_path")))


def with_targets(media: DataFrame, clusters: DataFrame) -> DataFrame:
    """Left join of the events' targets; a file without an event has none.

    No task gathers a large event's files (or those without one): they stay where they are and its target is
    broadcast. Of the others Spark picks the physical join by the size of the event side.
    """
    media, targets = media.drop("target_path"), clusters.select("cluster_id", "target_path")
    hot = sessions._hot_keys(media, ["cluster_id"])
    if hot is None:
        return media.join(targets, "cluster_id", "left")
    hot = written(hot.join(targets, "cluster_id", "left"), "large-targets")
    large = sessions._same(media, F.broadcast(hot), ["cluster_id"], "inner")
    rest = sessions._same(media, F.broadcast(hot.select("cluster_id")), ["cluster_id"], "left_anti").join(targets, "cluster_id", "left")
    return rest.unionByName(large)


def resolved_names(media: DataFrame, restore: bool, taken: DataFrame | None = None) -> DataFrame:
    """Rows (file_name, target_path, dst_name): names in the target folders.

    Without ``restore`` every file keeps its name.  With it, a copy suffix is dropped where the
    plain name is free in the folder, case-insensitively: originals come first, then copies by
    name; names in ``taken`` (target_path, name: what is on disk) are not free.  A copy whose
    plain name is, in the end, another file's kept name keeps its own.  (What else is on disk
    under a name that is kept is for the plan to see, which then leaves that file where it is.)
    """
    rows = media.select("file_name", "target_path")
    if not restore:
        return rows.withColumn("dst_name", F.col("file_name"))
    rows = written(rows.withColumn("_want", strip_copy_suffix(F.col("file_name"))), "wanted-names")  # nested, the expression is too long to compile
    rows = rows.withColumn("_copy", F.col("_want") != F.col("file_name")).withColumn("_key", F.lower("_want"))
    first = F.row_number().over(Window.partitionBy("target_path", "_key").orderBy("_copy", "file_name")) == 1
    rows = rows.withColumn("_may", F.col("_copy") & first)
    if taken is not None:
        disk = taken.select("target_path", F.lower("name").alias("_key")).distinct().withColumn("_held", F.lit(True))
        rows = rows.join(disk, ["target_path", "_key"], "left").withColumn("_may", F.col("_may") & F.col("_held").isNull()).drop("_held")
    rows = written(rows.withColumn("_id", F.monotonically_increasing_id()), "names")
    kept = _kept(rows)
    if kept is not None:
        rows = rows.join(kept.withColumn("_keeps", F.lit(True)), "_id", "left").withColumn("_may", F.col("_may") & F.col("_keeps").isNull())
    return rows.select("file_name", "target_path", F.when(F.col("_may"), F.col("_want")).otherwise(F.col("file_name")).alias("dst_name"))


def _kept(rows: DataFrame) -> DataFrame | None:
    """(_id) of the rows that may take their plain name (_may) but for another row that keeps that name; None: there is none.

    A row's plain name can be the name of another row, which may lose it in turn: chains, at whose
    end a row takes a name that nobody has, or one keeps its own.  A row takes its plain name if
    all rows of its chain do.  Found by pointer doubling over those rows only.
    """
    names = rows.select("target_path", F.lower("file_name").alias("_key"), F.col("_id").alias("_to"), F.col("_may").alias("_moves"))
    met = rows.filter("_may").select("_id", "target_path", "_key").join(names, ["target_path", "_key"]).filter("_id <> _to")
    # of several rows of one name (but for case) one at most can move
    links = written(met.groupBy("_id").agg(F.min("_to").alias("_to"), ((F.count("*") == 1) & F.bool_and("_moves")).alias("_ok")), "name-links")
    if links.isEmpty():
        return None
    while True:
        ahead = links.select(F.col("_id").alias("_to"), F.col("_to").alias("_next"), F.col("_ok").alias("_then"))
        joined = links.filter("_ok and _to is not null").join(ahead, "_to", "left")
        moved = joined.select("_id", F.col("_next").alias("_to"), F.coalesce("_then", F.lit(True)).alias("_ok"))
        links = written(moved.unionByName(links.filter("not (_ok and _to is not null)")), "name-links")
        if links.filter("_ok and _to is not null").isEmpty():
            return links.filter("not _ok").select("_id")


def one_per_group(items: DataFrame, group: str, name: Column, cap: int = 10, seed: int = 0) -> DataFrame:
    """One item of each group, drawn by a seeded hash of its name; names once; ``cap`` groups at most."""
    key = F.md5(F.concat_ws("|", F.lit(str(seed)), name))
    ranked = items.withColumn("_k", key).withColumn("_r", F.row_number().over(Window.partitionBy(group).orderBy("_k", name)))
    drawn = ranked.filter("_r = 1").withColumn("_name", name)
    once = drawn.groupBy("_name").agg(F.min_by(F.struct(*items.columns), F.struct("_k", F.col(group))).alias("_i")).select("_i.*")
    return once.orderBy(group).limit(cap)


def total_files(clusters: DataFrame) -> DataFrame:
    """One row: files in all library events."""
    return clusters.agg(F.coalesce(F.sum("file_count"), F.lit(0)).cast("long").alias("total_files"))


