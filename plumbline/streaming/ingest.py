"""Samples arriving as a stream: each is stored once, with the sample it is a copy of.

Which ids came before, and what the first sample of a content was, is keyed streaming state, so a
batch reads and writes the state of the ids and contents it brings, and nothing of what is stored.
The store is append-only, with a folder for each batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from plumbline.functions.shared_storage import scratch_path
from plumbline.sources.bindings import text_samples
from plumbline.streaming.live_facts import STATE_STORE

ARRIVED = "sample_id bigint, split string, sha string, copy_of bigint"


class FirstOfContent(StatefulProcessor):
    """The first sample of a content."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.first = handle.getValueState("first", "sample_id bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:
        fresh = pd.concat(list(rows)).sort_values("sample_id")  # the batch's samples of this content, without their texts
        ids = fresh["sample_id"].tolist()
        first = self.first.get()[0] if self.first.exists() else ids[0]
        self.first.update((first,))
        copies = pd.array([None if i == first else first for i in ids], dtype="Int64")
        yield pd.DataFrame({"sample_id": ids, "split": fresh["split"].tolist(), "sha": key[0], "copy_of": copies})

    def close(self) -> None:
        pass


def marked_copies(arriving: DataFrame) -> DataFrame:
    """The streaming samples (``sample_id``, ``text``, ``split``) whose ids are new, with ``sha`` and ``copy_of``: the first stored or the smallest new sample of equal content.

    A null text counts as empty. A sample whose id came before, in whatever batch, is left out, and
    so are rows without an id.
    """
    rows = arriving.filter("sample_id is not null").select(F.col("sample_id").cast("bigint").alias("sample_id"), "split", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))
    return rows.dropDuplicates(["sample_id"]).groupBy("sha").transformWithStateInPandas(FirstOfContent(), ARRIVED, "Append", "none")


def append_batches(store: str):
    """A ``foreachBatch`` function; a batch that is run again overwrites its own folder."""

    def append(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{store}/batch={batch_id}")

    return append


def start(arriving: DataFrame, store: str, progress: str):
    """Start storing the streaming samples. The state goes to RocksDB stores, checkpointed under ``progress``."""
    spark, setting = arriving.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(setting)
    spark.conf.set(setting, STATE_STORE)
    try:
        return marked_copies(arriving).writeStream.foreachBatch(append_batches(store)).outputMode("append").option("checkpointLocation", progress).trigger(availableNow=True).start()
    finally:
        spark.conf.set(setting, before)


def run_to_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    source, store = scratch_path(spark, "arrivals"), scratch_path(spark, "samples")
    rows = text_samples(spark, sf_dir).select("sample_id", "text", "split")
    rows.repartition(4, F.col("sample_id")).write.parquet(source)
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 2).parquet(source)
    start(stream, store, scratch_path(spark, "ingest-progress")).awaitTermination()
    return spark.read.parquet(store).drop("batch")
