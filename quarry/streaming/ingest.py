"""Files indexed as they arrive: each micro-batch goes through the catalog's own incremental index."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from quarry.sources.catalog import BINARY_FILES, Catalog, describe_files


def watch(spark: SparkSession, folder: str, catalog: Catalog, checkpoint: str, once: bool = False, corpus: Column | None = None) -> StreamingQuery:
    """A batch that is replayed after a failure finds its files indexed and skips them."""
    files = spark.readStream.format("binaryFile").schema(BINARY_FILES).load(folder)

    def index(batch: DataFrame, _: int) -> None:
        catalog.index(describe_files(batch, corpus))

    writer = files.writeStream.foreachBatch(index).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
