"""Files that are already in a library: size, then a partial hash, then the whole content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from eventloom.config import Status
from eventloom.functions.media import content_hash, partial_hash
from eventloom.functions.names import duplicate_target, parent_name


def duplicates(inbox: DataFrame, library: DataFrame, content: str = "content", partial: Column | None = None) -> DataFrame:
    """(file_name, duplicated_to): inbox files whose content a library file has; the first by (lib_idx, path).

    inbox: file_name, size, content; library: path, size, content, and lib_idx if there are
    several.  Each stage keeps only what has a partner by the cheaper test, on both sides, and
    hashes just that; the last join meets one library row for each content, never pairs.
    """
    order = F.struct("lib_idx", "path") if "lib_idx" in library.columns else F.struct("path")
    part = partial_hash(F.col(content)) if partial is None else partial
    left = inbox.select("file_name", "size", content).join(library.select("size").distinct(), "size", "left_semi").withColumn("_part", part)
    right = library.join(inbox.select("size").distinct(), "size", "left_semi").withColumn("_part", part)
    near = ["size", "_part"]
    left2 = left.join(right.select(*near).distinct(), near, "left_semi").withColumn("_full", content_hash(F.col(content)))
    right2 = right.join(left.select(*near).distinct(), near, "left_semi").withColumn("_full", content_hash(F.col(content)))
    first = right2.groupBy(*near, "_full").agg(F.min(order).alias("_first"))
    return left2.join(first, [*near, "_full"]).select("file_name", F.col("_first.path").alias("duplicated_to"))


def mark(media: DataFrame, found: DataFrame) -> DataFrame:
    """``media`` with the unknown files of ``found`` (file_name, duplicated_to) marked as duplicates."""
    is_new = F.col("_to").isNotNull() & (F.col("status") == Status.UNKNOWN.name)
    joined = media.join(found.select("file_name", F.col("duplicated_to").alias("_to")), "file_name", "left")
    changed = {
        "status": F.when(is_new, Status.DUPLICATE.name).otherwise(F.col("status")),
        "duplicated_to": F.when(is_new, F.col("_to")).otherwise(F.col("duplicated_to")),
        "duplicated_cluster": F.when(is_new, parent_name(F.col("_to"))).otherwise(F.col("duplicated_cluster")),
    }
    return joined.select(*[changed.get(c, F.col(c)).alias(c) for c in media.columns])


def with_duplicate_targets(media: DataFrame) -> DataFrame:
    """Duplicates go to ``duplicated/<event folder>``."""
    target = F.when(F.col("status") == Status.DUPLICATE.name, duplicate_target(F.col("duplicated_cluster")))
    return media.withColumn("target_path", F.coalesce(target, F.col("target_path")))
