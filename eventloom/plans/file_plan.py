"""Plans of file operations: rows to inspect, counters, and their execution."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, functions as F

from eventloom.config import Mode
from eventloom.errors import MissingTargetError
from eventloom.operators.naming import resolved_names
from eventloom.plans.file_sink import Outcome, carry_out
from eventloom.runtime import ship, written

SKIP_REASON = "NOP mode"
TAKEN_REASON = "destination exists"


def _joined(*parts):
    return F.concat_ws("/", *[F.rtrim(p, F.lit("/")) for p in parts])


def build(media: DataFrame, inbox: str, outbox: str, mode: Mode, restore: bool = False, taken: DataFrame | None = None) -> DataFrame:
    """Rows (seq, op, src, dst, reason): mkdir of every target once, then one copy or move a file.

    A dry run has one skip a file and looks at no target.  A file without a target is an
    error.  A file whose destination is on disk (``taken``: target_path, name; whatever the case) is
    skipped with that reason: nothing that a folder holds is ever overwritten.  seq ascends in plan order and has holes: no task sees the whole plan.
    """
    none = F.lit(None).cast("string")
    source = _joined(F.lit(inbox), F.col("file_name"))
    if mode is Mode.NOP:
        rows = media.select(F.lit("skip").alias("op"), source.alias("src"), none.alias("dst"), F.lit(SKIP_REASON).alias("reason"), F.col("file_name").alias("k"))
        return rows.orderBy("k").select(F.monotonically_increasing_id().alias("seq"), "op", "src", "dst", "reason")
    # read for targets, names, folders and the bounds of the order: what leads to it is computed once
    media = written(media.select("file_name", "target_path"), "placed")
    if not media.filter("target_path is null").isEmpty():
        raise MissingTargetError()
    names = resolved_names(media, restore, taken)
    act = "copy" if mode is Mode.COPY else "move"
    held = F.lit(False)
    if taken is not None:
        disk = taken.select("target_path", F.lower("name").alias("_key")).distinct().withColumn("_held", F.lit(True))
        names = names.withColumn("_key", F.lower("dst_name")).join(disk, ["target_path", "_key"], "left")
        held = F.col("_held").isNotNull()
    made = media.select("target_path").distinct().select(none.alias("file_name"), "target_path", none.alias("dst_name"), F.lit(False).alias("held"))
    rows = made.unionByName(names.select("file_name", "target_path", "dst_name", held.alias("held")))
    # short rows are ordered, paths are put together afterwards
    folder = _joined(F.lit(outbox), F.col("target_path"))
    dst = F.concat_ws("/", folder, "dst_name")
    mkdir = F.col("file_name").isNull()
    what = F.when(mkdir, "mkdir").when(F.col("held"), "skip").otherwise(act)
    rows = rows.orderBy(F.col("file_name").asc_nulls_first(), "target_path", "dst_name")
    return rows.select(
        F.monotonically_increasing_id().alias("seq"), what.alias("op"), F.when(~mkdir, source).alias("src"), dst.alias("dst"), F.when(F.col("held"), TAKEN_REASON).alias("reason")
    )


def counters(plan: DataFrame) -> DataFrame:
    """One row: n_mkdirs, n_moves, n_copies, n_skips."""
    return plan.agg(*[F.count_if(F.col("op") == op).alias(name) for op, name in (("mkdir", "n_mkdirs"), ("move", "n_moves"), ("copy", "n_copies"), ("skip", "n_skips"))])


def summary(plan: DataFrame) -> str:
    r = counters(plan).first()
    return f"Plan: {r.n_mkdirs} dirs, {r.n_moves} moves, {r.n_copies} copies, {r.n_skips} skips"


def conflicts(plan: DataFrame, taken: DataFrame) -> DataFrame:
    """Operations whose destination is on disk already. taken: (dst)."""
    return plan.join(taken.select("dst").distinct(), "dst", "left_semi")


def _make_folders(rows) -> None:
    for r in rows:
        os.makedirs(r.dst, exist_ok=True)


def execute(plan: DataFrame, outbox: str | None = None) -> Outcome:
    """Make the folders, then copy or move on the executors, which must see both folders; skips do nothing.

    Safe to run again and beside itself, see ``file_sink``; ``outbox`` holds the journal of a run
    that is under way.
    """
    ship(plan.sparkSession)
    plan.filter("op = 'mkdir'").select("dst").foreachPartition(_make_folders)
    return carry_out(plan.filter("op in ('copy', 'move')"), outbox)
