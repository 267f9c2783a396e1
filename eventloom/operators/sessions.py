"""Time-gap clustering: gaps, event ids, bounds, and folder statistics."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import Column, DataFrame, Window, functions as F

from eventloom import ranges
from eventloom.config import Status
from eventloom.runtime import written
from eventloom.schemas import CLUSTERS

GAP = timedelta(minutes=60)
#: Rows of one order that are still put through a single window (by partition key, or none).
SINGLE_WINDOW_ROWS = 200_000


def micros(gap: timedelta) -> int:
    return gap // timedelta(microseconds=1)


def _us(ts: Column) -> Column:
    return F.unix_micros(ts.cast("timestamp"))


def gaps(media: DataFrame, *keys: str, date: str = "date", delta: str = "date_delta") -> DataFrame:
    """``media`` with ``delta``: time since the row before, by (date nulls last, file_name) within ``keys``.

    Only rows without a cluster take part; others have none.  Duplicates do take part: a
    duplicate between two files bridges, or takes over, their gap.

    Of the rows of one time the first by name has the gap since the time before, the others none
    at all; so times are what is ordered, in ranges, and no task holds a key or the whole table.
    """
    free = F.col("cluster_id").isNull() if "cluster_id" in media.columns else F.lit(True)
    open_rows = media.filter(free & F.col(date).isNotNull())
    times = written(open_rows.groupBy(*keys, _us(F.col(date)).alias("_ts")).agg(F.min("file_name").alias("_first"), F.min(date).alias("_date")), "times")
    rows, _ = after_the_last(times, list(keys))
    before = rows.select(*keys, "_ts", "_first", "_date", F.timestamp_micros("_p").cast(media.schema[date].dataType).alias("_before"))
    out = _same(media.withColumn("_ts", F.when(free, _us(F.col(date)))), before, [*keys, "_ts"])
    same = Window.partitionBy(*keys, "_ts", "file_name").orderBy("file_name")  # one row, but for repeated names
    leads = (F.col("file_name").eqNullSafe(F.col("_first"))) & (F.row_number().over(same) == 1)
    since = F.when(leads, F.col("_date") - F.col("_before")).otherwise(F.col("_date") - F.col("_date"))
    return out.withColumn(delta, F.when(F.col("_date").isNotNull(), since)).select(*media.columns, delta)


def after_the_last(times: DataFrame, keys: list[str]) -> tuple[DataFrame, list[int]]:
    """Distinct times (keys, _ts, ...) with _b (range of the time) and _p (the key's time before); the ranges' bounds.

    A key's last time in a range comes to its next range as one row.
    """
    lower = ranges.bounds(times, "_ts", -(-times.count() // SINGLE_WINDOW_ROWS))
    rows = times.withColumn("_b", ranges.bucket(F.col("_ts"), lower))
    spot = [*keys, "_b"] if lower else keys
    rows = rows.withColumn("_p", F.lag("_ts").over(Window.partitionBy(*spot).orderBy("_ts")))
    if lower:
        lasts = rows.groupBy(*spot).agg(F.max("_ts").alias("_last"))
        lasts = lasts.select(*spot, F.lag("_last").over(Window.partitionBy(*keys).orderBy("_b")).alias("_carry"))
        rows = _same(rows, lasts, spot).withColumn("_p", F.coalesce("_p", "_carry")).drop("_carry")
    return rows, lower


def next_id(clusters: DataFrame) -> DataFrame:
    """One row ``next_id``: the largest cluster_id plus one, or 1; holes aren't filled."""
    return clusters.agg(F.coalesce(F.max("cluster_id") + 1, F.lit(1)).cast("long").alias("next_id"))


def cluster(media: DataFrame, *keys: str, gap: timedelta = GAP, first_id: int = 1, date: str = "date") -> DataFrame:
    """``media`` with cluster_id and status of the unknown files set: a gap above ``gap`` opens an event.

    Ids ascend by date from ``first_id`` (within each of ``keys``, if given).  The gap is
    measured before duplicates are left out, so it may lie on one that is. Files without a
    date come last and join the last event.
    """
    unknown = F.col("status") == Status.UNKNOWN.name
    if "cluster_id" not in media.columns:
        media = media.withColumn("cluster_id", F.lit(None).cast("long"))
    free = F.col("cluster_id").isNull()
    if not keys:
        numbered = _numbers(media.filter(free), [], gap, first_id, date)
        out = _same(media.withColumn("_ts", _us(F.col(date))), numbered, ["_ts"])
    else:
        hot = _hot_keys(media.filter(free), keys)
        out = None
        if hot is not None:
            large = _same(media, hot, list(keys), "left_semi")
            numbered = _numbers(large.filter(free), list(keys), gap, first_id, date)
            out = _same(large.withColumn("_ts", _us(F.col(date))), numbered, [*keys, "_ts"])
            media = _same(media, hot, list(keys), "left_anti")
        order = [F.col(date).asc_nulls_last(), F.col("file_name")]
        since = _us(F.col(date)) - F.lag(_us(F.col(date))).over(Window.partitionBy(*keys, free).orderBy(*order))
        running = Window.partitionBy(*keys, unknown).orderBy(*order)
        opens = (F.row_number().over(running) == 1) | F.coalesce(F.col("_d") > micros(gap), F.lit(False))
        number = F.sum(F.col("_o").cast("int")).over(running.rowsBetween(Window.unboundedPreceding, Window.currentRow)) + first_id - 1
        rest = media.withColumn("_d", F.when(free, since)).withColumn("_o", opens).withColumn("_n", number)
        columns = [*media.columns, "_n"]
        out = rest.select(*columns) if out is None else out.select(*columns).unionByName(rest.select(*columns))
    return out.select(
        *[c for c in media.columns if c not in ("cluster_id", "status")],
        F.when(unknown, F.col("_n").cast("long")).otherwise(F.col("cluster_id")).alias("cluster_id"),
        F.when(unknown, F.lit(Status.NEW_CLUSTER.name)).otherwise(F.col("status")).alias("status"),
    )


def _same(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """Join on equal values of ``on``, nulls equal to one another; the left table's columns and the right one's others."""
    renamed = right.select(*[F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns])
    same = F.lit(True)
    for c in on:
        same = same & left[c].eqNullSafe(renamed[f"_r_{c}"])
    return left.join(renamed, same, how).drop(*[f"_r_{c}" for c in on])


def _hot_keys(free: DataFrame, keys) -> DataFrame | None:
    """Keys with more rows than one window should hold; None if there is none."""
    hot = free.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > SINGLE_WINDOW_ROWS).select(*keys)
    hot = written(hot, "hot-keys")
    return None if hot.isEmpty() else hot


def _numbers(free: DataFrame, keys: list[str], gap: timedelta, first_id: int, date: str) -> DataFrame:
    """(keys, _ts, _n): the event number at each distinct time (null time: the last event's, or the first).

    Rows of one time collapse before anything is ordered: only its first row by name can carry
    a gap, and the number changes there if that row is an unknown file.  Times are dealt to
    ranges by quantiles; each range counts its openings, and what ranges before it hold (one
    row a key and range) is added on.
    """
    unknown = F.col("status") == Status.UNKNOWN.name
    times = free.groupBy(*keys, _us(F.col(date)).alias("_ts")).agg(
        F.min_by(unknown, F.col("file_name")).alias("first_unknown"), F.bool_or(unknown).alias("any_unknown")
    )
    times = written(times, "times")
    rows, lower = after_the_last(times.filter("_ts is not null"), keys)
    spot = [*keys, "_b"] if lower else keys
    inside = Window.partitionBy(*spot).orderBy("_ts")
    upto = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    first_of = F.min(F.when(F.col("any_unknown"), F.col("_ts")))
    if lower:
        by_range = Window.partitionBy(*keys).orderBy("_b")
        heads = rows.groupBy(*spot).agg(first_of.alias("_u"))
        rows = _same(rows, heads.select(*spot, F.min("_u").over(whole).alias("_start")), spot)
    else:
        rows = rows.withColumn("_start", first_of.over(whole))
    opens = (F.col("_ts") - F.col("_p") > micros(gap)) & F.col("first_unknown")
    # the first unknown file opens an event whatever its gap: openings up to its time don't count
    rows = rows.withColumn("_o", F.when((F.col("_ts") > F.col("_start")) & opens, 1).otherwise(0))
    rows = rows.withColumn("_c", F.sum("_o").over(upto))
    if lower:
        sums = rows.groupBy(*spot).agg(F.sum("_o").alias("_s"))
        ahead = by_range.rowsBetween(Window.unboundedPreceding, -1)
        rows = _same(rows, sums.select(*spot, F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before")), spot)
        rows = rows.withColumn("_c", F.col("_c") + F.col("_before"))
    numbered = rows.select(*keys, "_ts", (F.col("_c") + first_id).cast("long").alias("_n"))
    undated = times.filter("_ts is null").select(*keys, "_ts")
    if undated.isEmpty():
        return numbered
    last = numbered.groupBy(*keys).agg(F.max("_n").alias("_n"))
    undated = _same(undated, last, keys) if keys else undated.withColumn("_n", F.lit(last.first()[0]).cast("long"))
    return numbered.unionByName(undated.select(*keys, "_ts", F.coalesce("_n", F.lit(first_id)).cast("long").alias("_n")))


def bounds(media: DataFrame, *keys: str, date: str = "date") -> DataFrame:
    """New events' rows: first and last date of members (nulls skipped), continuous, other columns null."""
    new = media.filter(F.col("status") == Status.NEW_CLUSTER.name)
    return new.groupBy(*keys, "cluster_id").agg(
        F.min(date).alias("start_date"), F.max(date).alias("end_date"), F.lit(True).alias("is_continuous")
    )


def append(clusters: DataFrame, new: DataFrame) -> DataFrame:
    """Bag union by name; columns that one side lacks are null."""
    return clusters.unionByName(new, allowMissingColumns=True)


def as_clusters(rows: DataFrame) -> DataFrame:
    """``rows`` with exactly the columns of the cluster table, missing ones null."""
    return rows.select(*[(F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in CLUSTERS.fields])


def new_cluster_ids(media: DataFrame) -> DataFrame:
    return media.filter(F.col("status") == Status.NEW_CLUSTER.name).select("cluster_id").distinct()


def expanded_cluster_ids(clusters: DataFrame) -> DataFrame:
    """Library events that got files in this run."""
    return clusters.filter(F.col("path").isNotNull() & (F.col("new_file_count") > 0)).select("cluster_id").distinct()


def folder_stats(media: DataFrame, *keys: str, gap: timedelta = GAP, date: str = "date") -> DataFrame:
    """Per folder: date_start, date_stop, median (averaged), file_count (undated ones too), is_time_consistent.

    Consistent: no gap above ``gap``, and not some dates missing while others are there.
    """
    # equal dates collapse to counts first; medians are read off running counts over ranges of dates
    counts = written(media.groupBy(*keys, F.col(date).alias("_t")).agg(F.count("*").alias("_n")).withColumn("_ts", _us(F.col("_t"))), "dates")
    rows, lower = after_the_last(counts.filter("_ts is not null"), list(keys))
    spot = [*keys, "_b"] if lower else list(keys)
    rows = rows.withColumn("_upto", F.sum("_n").over(Window.partitionBy(*spot).orderBy("_ts").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    if lower:
        ahead = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
        sums = rows.groupBy(*spot).agg(F.sum("_n").alias("_s")).select(*spot, F.coalesce(F.sum("_s").over(ahead), F.lit(0)).alias("_before"))
        rows = _same(rows, sums, spot).withColumn("_upto", F.col("_upto") + F.col("_before")).drop("_before")
    rows = rows.drop("_b").unionByName(counts.filter("_ts is null"), allowMissingColumns=True).withColumn("_u", F.col("_ts")).withColumn("_d", F.col("_ts") - F.col("_p"))
    dated = counts.groupBy(*keys).agg(F.sum(F.when(F.col("_ts").isNotNull(), F.col("_n"))).alias("_dated"))
    rows = _same(rows, dated, list(keys)) if keys else rows.withColumn("_dated", F.lit(dated.first()[0]))
    reached = lambda place: F.min(F.when(F.col("_u").isNotNull() & (F.col("_upto") > F.expr(place)), F.col("_u")))
    wide = F.coalesce(F.bool_or(F.col("_d") > micros(gap)), F.lit(False))
    mixed = (F.count_if(F.col("_u").isNull()) > 0) & (F.count("_u") > 0)
    stats = rows.groupBy(*keys).agg(
        F.min("_t").alias("date_start"), F.max("_t").alias("date_stop"), reached("(_dated - 1) div 2").alias("_low"), reached("_dated div 2").alias("_high"),
        F.sum("_n").alias("file_count"), (~(wide | mixed)).alias("is_time_consistent"),
    )
    middle = F.timestamp_micros(F.expr("_low + (_high - _low) div 2")).cast("timestamp_ntz")
    return stats.select(*keys, "date_start", "date_stop", middle.alias("median"), "file_count", "is_time_consistent")
