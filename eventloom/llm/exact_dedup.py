"""Exact deduplication as a stateful stream over disk-backed keyed state.

The stream carries (digest, doc_id, locator) of every text; its keyed state lives in RocksDB
instances, never expires, and keeps for each digest the smallest doc_id (the stable
identifier), the content locator of that row (file and row index) and the number of rows.
Rows of a key meet as one partial row per task, so a group of copies of any size costs one
state row and no hot task.  Stopped streams go on from their checkpoint, and folders that get
more files are taken up by the next run.

A digest that was met more than once is a hit, and hits are checked on their full bytes:
their texts are fetched by the rows' locators (no other text leaves its scan) and grouped by
(digest, whole normalised text); should one digest ever hold two different texts, each of
them becomes a group of its own.
"""

from __future__ import annotations

from contextlib import contextmanager
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from eventloom.llm.rows import fetched, join_one, located
from eventloom.runtime import scratch, written

#: Settings under which the stateful query runs.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB": "96",
    "spark.sql.streaming.stateStore.maintenanceInterval": "5s",  # stores of an ended stream are closed soon
    "spark.sql.streaming.stateStore.rocksdb.writeBufferSizeMB": "8",
    "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false",  # many small stores: no disk ahead of need
    "spark.sql.streaming.noDataMicroBatches.enabled": "false",
}


def normalised(text: Column) -> Column:
    """Every run of ``[\\x20\\x09-\\x0D]`` becomes one space; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]):
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def digests(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """Rows (doc_id, _at, sha, digest); digest: the first ``digest_bytes`` of the SHA-256 of the normalised text."""
    sha = F.unhex(F.sha2(normalised(F.col("text")).cast("binary"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_at", sha.alias("sha")).withColumn(
        "digest", F.substring("sha", 1, digest_bytes)
    )


class StreamingDeduplicator:
    """Keyed state over a folder of (doc_id, _at, digest) Parquet files that may grow between runs."""

    def __init__(self, spark: SparkSession, folder: str, state: str, files_a_batch: int | None = None):
        self.spark, self.folder, self.state, self.files_a_batch = spark, folder, state, files_a_batch

    def run(self) -> DataFrame:
        """Take up all files that are new; the state now: (digest, keep_id, keep_at, n).

        keep_id: smallest doc_id, nulls last; ties: the smallest locator.
        """
        reader = self.spark.readStream.schema("doc_id long, _at string, sha binary, digest binary")
        if self.files_a_batch:
            reader = reader.option("maxFilesPerTrigger", self.files_a_batch)
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_at"))
        changed = (
            reader.parquet(self.folder).groupBy("digest").agg(first.alias("first"), F.count("*").alias("n"))
        )
        out = f"{self.state}/changes"

        def keep(batch: DataFrame, number: int) -> None:  # a batch that is run again overwrites itself
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        with _settings(self.spark, STATE):
            query = (
                changed.writeStream.outputMode("update").foreachBatch(keep)
                .option("checkpointLocation", f"{self.state}/checkpoint").trigger(availableNow=True).start()
            )
            query.awaitTermination()
        schema = "digest binary, first struct<none: boolean, doc_id: long, _at: string>, n long, batch long"
        changes = self.spark.read.schema(schema).parquet(out)
        latest = changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("s"))
        return latest.select("digest", F.col("s.first.doc_id").alias("keep_id"), F.col("s.first._at").alias("keep_at"), F.col("s.n").alias("n"))


def deduplicate(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """One row per row of ``docs``: doc_id, _at, sha, keep_id, keep_at, group_size.

    The row whose _at is keep_at stays: the smallest doc_id of equal texts (nulls last, of
    repeated rows the first by place, one of them). Null and empty texts are equal to one another;
    texts of any length count whole; an empty table gives no row; other columns, whatever their
    names, are not looked at.
    """
    docs, at = located(docs.select("doc_id", "text"))
    return _deduplicate(docs.withColumnRenamed(at, "_at"), digest_bytes)


def _deduplicate(docs: DataFrame, digest_bytes: int = 32) -> DataFrame:
    """``deduplicate`` of rows (doc_id, text, _at)."""
    spark = docs.sparkSession
    folder = scratch(spark, "digests")
    digests(docs, digest_bytes).write.parquet(folder)
    rows = spark.read.schema("doc_id long, _at string, sha binary, digest binary").parquet(folder)
    if rows.isEmpty():
        return rows.select("doc_id", "_at", "sha", F.lit(None).cast("long").alias("keep_id"), F.lit(None).cast("string").alias("keep_at"), F.lit(None).cast("long").alias("group_size"))
    state = written(StreamingDeduplicator(spark, folder, scratch(spark, "dedup-state")).run(), "dedup-groups")
    total = rows.count()
    whole = join_one(rows, state, "digest", "n", total).select(
        "doc_id", "_at", "sha", "digest", "keep_id", "keep_at", F.col("n").alias("group_size")
    )
    whole = written(whole, "dedup-rows")
    several = written(_several(docs, whole.filter("group_size > 1").select("_at"), digest_bytes), "collisions")
    if several.isEmpty():
        return whole.drop("digest")
    # one digest, different bytes: by the bytes
    texts = _with_digest(docs, digest_bytes).join(several, "digest", "left_semi")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "_at"))
    own = texts.groupBy("digest", "norm").agg(first.alias("first"), F.count("*").alias("n"))
    split = texts.select("_at", "digest", "norm").join(own, ["digest", "norm"]).select(
        "_at", F.col("first.doc_id").alias("id2"), F.col("first._at").alias("at2"), F.col("n").alias("n2")
    )
    return whole.join(split, "_at", "left").select(
        "doc_id", "_at", "sha",
        F.when(F.col("n2").isNull(), F.col("keep_id")).otherwise(F.col("id2")).alias("keep_id"),
        F.coalesce("at2", "keep_at").alias("keep_at"),
        F.coalesce("n2", "group_size").alias("group_size"),
    )


def _with_digest(docs: DataFrame, digest_bytes: int) -> DataFrame:
    norm = normalised(F.col("text"))
    sha = F.unhex(F.sha2(norm.cast("binary"), 256))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "_at", norm.alias("norm"), F.substring(sha, 1, digest_bytes).alias("digest"))


def _several(docs: DataFrame, hits: DataFrame, digest_bytes: int) -> DataFrame:
    """(digest) of digests under which rows at ``hits`` (_at) hold different bytes; copies within a task meet before they are sent."""
    contents = fetched(docs, "_at", hits, lambda rows: _with_digest(rows, digest_bytes).groupBy("digest", "norm").agg(F.count("*").alias("n")))
    if not contents:
        return hits.limit(0).select(F.col("_at").cast("binary").alias("digest"))
    texts = reduce(DataFrame.unionByName, contents)
    if len(contents) > 1:
        texts = texts.groupBy("digest", "norm").agg(F.sum("n").alias("n"))
    return texts.groupBy("digest").agg(F.count("*").alias("k")).filter("k > 1").select("digest")


def first_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, all columns: the first of each group of equal texts (see deduplicate)."""
    docs, at = located(docs)
    rows = docs.select("doc_id", "text", F.col(at).alias("_at"))
    stay = _deduplicate(rows).filter("_at = keep_at").select(F.col("_at").alias(at))
    return docs.join(stay, at, "left_semi").drop(at)


def op9(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """Contract columns for every row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256 (see deduplicate)."""
    return deduplicate(docs).select(
        "doc_id", "keep_id", "group_size", (F.col("_at") == F.col("keep_at")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256")
    )


ORACLE = r"""
WITH t AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, text_sha256,
  row_number() OVER (PARTITION BY text_sha256 ORDER BY doc_id NULLS LAST) = 1 AS kept
FROM t WINDOW g AS (PARTITION BY text_sha256)
"""
