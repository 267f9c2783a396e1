"""Imports as a stream: each batch of new files extends the events that the batches before it left."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from eventloom.config import Config
from eventloom.plans.importing import organise
from eventloom.runtime import written
from eventloom.schemas import CLUSTERS, MEDIA
from eventloom.sources.catalogue import Versions


class IncrementalImport:
    """Events and files under ``folder``; version n + 1 of the events is what batch n left.

    A batch writes its files first and then makes its version of the events, in one step.  A
    batch that runs again finds its version and does nothing, or else overwrites its own files: it is
    never counted twice.  One folder belongs to one checkpoint.
    """

    def __init__(self, spark: SparkSession, folder: str, config: Config):
        self.spark, self.folder = spark, folder.rstrip("/")
        self.config = replace(config, use_existing=True, skip_duplicates=False, libraries=config.libraries or (config.outbox,))
        self.events = Versions(spark, f"{self.folder}/events", CLUSTERS)

    def take(self, batch: DataFrame, number: int) -> None:
        """Import a batch of media rows (columns of MEDIA; missing ones are null); for ``foreachBatch``."""
        if self.events.version() > number:
            return
        rows = batch.select(*[(F.col(f.name) if f.name in batch.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in MEDIA.fields])
        media, every = organise(written(rows, "batch"), self.events.read(number), self.config)
        media.write.mode("overwrite").parquet(f"{self.folder}/media/batch={number}")
        self.events.commit(self._settled(every), number)

    def _settled(self, every: DataFrame) -> DataFrame:
        """Events as the next batch's library: new ones have their folder, counts are added up."""
        folder = F.concat(F.lit(self.config.outbox.rstrip("/") + "/"), "target_path")
        changed = {
            "path": F.coalesce("path", folder), "target_path": F.lit(None).cast("string"), "new_file_count": F.lit(None).cast("long"),
            "file_count": F.coalesce("file_count", F.lit(0)) + F.coalesce("new_file_count", F.lit(0)),
        }
        return every.select(*[changed.get(c, F.col(c)).alias(c) for c in CLUSTERS.names])

    def start(self, files: DataFrame, **trigger) -> StreamingQuery:
        """Run over a stream of media rows; ``trigger`` as of DataStreamWriter (availableNow=True, processingTime=...)."""
        writer = files.writeStream.foreachBatch(self.take).option("checkpointLocation", f"{self.folder}/checkpoint")
        return (writer.trigger(**trigger) if trigger else writer).start()

    def clusters(self) -> DataFrame:
        """Events as the last batch left them."""
        return self.events.read()

    def media(self) -> DataFrame:
        """Rows of MEDIA with target_path and ``batch``, of the batches that are done."""
        return self.spark.read.parquet(f"{self.folder}/media").filter(F.col("batch") < self.events.version())
