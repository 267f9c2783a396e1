"""Attaching files to existing events: an interval join whose bounds grow as files are attached."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, Window, functions as F

from eventloom.config import Status
from eventloom.functions.names import existing_target
from eventloom.operators.sessions import GAP, _us, after_the_last, micros
from eventloom.runtime import written
from eventloom.schemas import require_columns


def _open_clusters(clusters: DataFrame) -> DataFrame:
    """Continuous events with both bounds: the only ones that take files."""
    require_columns(clusters, ["cluster_id", "start_date", "end_date", "is_continuous"])
    some = F.col("is_continuous") & F.col("start_date").isNotNull() & F.col("end_date").isNotNull()
    return clusters.filter(some).select("cluster_id", _us(F.col("start_date")).alias("s"), _us(F.col("end_date")).alias("e"))


def _files(media: DataFrame, date: str) -> DataFrame:
    return media.filter((F.col("status") != Status.DUPLICATE.name) & F.col(date).isNotNull()).select("file_name", _us(F.col(date)).alias("t"))


def _lowest(times: DataFrame, events: DataFrame, g: int) -> DataFrame:
    """(t, cluster_id): the lowest event whose bounds, widened by ``g`` on both sides, hold a time; others have no row.

    Events are cut into time slots as wide as they are in the mean, so the join is on equal slots
    and there are at most three rows an event, in the mean.  times: t, distinct.
    """
    low, high = F.col("s") - g, F.col("e") + g
    events = events.select("cluster_id", low.alias("low"), high.alias("high")).filter("low <= high")
    width = max(1, int(events.agg(F.avg(F.col("high") - F.col("low"))).first()[0] or 1))
    slots = F.sequence(F.floor(F.col("low") / F.lit(width)), F.floor(F.col("high") / F.lit(width)))
    wide = events.withColumn("slot", F.explode(slots))
    met = times.select("t", F.floor(F.col("t") / F.lit(width)).alias("slot")).join(wide, "slot").filter("t >= low and t <= high")
    return met.groupBy("t").agg(F.min("cluster_id").alias("cluster_id"))


def match_static(media: DataFrame, clusters: DataFrame, gap: timedelta = GAP, date: str = "date") -> DataFrame:
    """(file_name, cluster_id): the lowest event whose bounds, widened by ``gap`` on both sides, hold the date.

    Bounds don't grow here.
    """
    files = _files(media, date)
    return files.join(_lowest(files.select("t").distinct(), _open_clusters(clusters), micros(gap)), "t").select("file_name", "cluster_id")


def match(media: DataFrame, clusters: DataFrame, gap: timedelta = GAP, date: str = "date") -> DataFrame:
    """(file_name, cluster_id): files attached in order of (date, file_name), each to the lowest event that holds it.

    An attached file widens its event for the files after it.  That needs no fold over files.  Call
    a run of files without a gap above ``gap`` a stretch.  An event that took a file holds the
    next one of the stretch too, and so all that follow there; one that took files of an earlier
    stretch reaches beyond them by its own end only.  So a file's event is the lowest
    that holds, by its bounds as they were, any file of the stretch up to this one: a
    running minimum, taken over ranges of time, with one row a range that carries the open
    stretch's minimum into the next ranges.
    """
    g = micros(gap)
    files = _files(media, date)
    times = files.select(F.col("t").alias("_ts")).distinct()
    found = _lowest(times.withColumnRenamed("_ts", "t"), _open_clusters(clusters), g)
    held = written(times.join(found, times["_ts"] == found["t"], "left").select("_ts", "cluster_id"), "held-times")
    rows, lower = after_the_last(held, [])
    inside = Window.partitionBy("_b").orderBy("_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    fresh = F.col("_p").isNull() | (F.col("_ts") - F.col("_p") > g)
    rows = rows.withColumn("_s", F.sum(fresh.cast("int")).over(inside))  # 0: the stretch began in a range before
    stretch = Window.partitionBy("_b", "_s").orderBy("_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("_m", F.min("cluster_id").over(stretch))
    if lower:
        rows = written(rows, "stretches")
        tails = rows.groupBy("_b").agg(F.max_by("_m", "_ts").alias("_tail"), F.max("_s").alias("_n"))
        by_range = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        # ranges with the same number of beginnings up to their end have one open stretch at their end
        tails = tails.withColumn("_open", F.sum("_n").over(by_range))
        out = F.min("_tail").over(Window.partitionBy("_open").orderBy("_b").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        carry = tails.withColumn("_out", out).select("_b", F.lag("_out").over(Window.orderBy("_b")).alias("_carry"))
        rows = rows.join(F.broadcast(carry), "_b").withColumn("_m", F.when(F.col("_s") == 0, F.least("_m", "_carry")).otherwise(F.col("_m")))
    of = rows.filter("_m is not null").select(F.col("_ts").alias("t"), F.col("_m").alias("cluster_id"))
    return files.join(of, "t").select("file_name", "cluster_id")


def attach(media: DataFrame, clusters: DataFrame, gap: timedelta = GAP, date: str = "date") -> tuple[DataFrame, DataFrame]:
    """(media, clusters) with attached files' cluster_id, status and target, and events' new bounds, counts and targets."""
    found = match(media, clusters, gap, date).withColumnRenamed("cluster_id", "_c")
    out = media.join(found, "file_name", "left").select(
        *[c for c in media.columns if c not in ("cluster_id", "status")],
        F.coalesce("_c", "cluster_id").alias("cluster_id"),
        F.when(F.col("_c").isNotNull(), Status.EXISTING_CLUSTER.name).otherwise(F.col("status")).alias("status"),
    )
    grown = out.filter(F.col("status") == Status.EXISTING_CLUSTER.name).groupBy("cluster_id").agg(
        F.min(date).alias("_s"), F.max(date).alias("_e"), F.count("*").alias("_n")
    )
    changed = clusters.join(grown, "cluster_id", "left").withColumns({
        "start_date": F.least("start_date", "_s"),
        "end_date": F.greatest("end_date", "_e"),
        "new_file_count": F.when(F.col("_n").isNotNull(), F.coalesce("new_file_count", F.lit(0)) + F.col("_n")).otherwise(F.col("new_file_count")),
        "target_path": F.when(F.col("_n").isNotNull(), existing_target(F.col("path"))).otherwise(F.col("target_path")),
    })
    return out, changed.select(*clusters.columns)
