"""Streams of upserts: into a store, or folded to the newest version of each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tidelog.operators.mvcc import newest
from tidelog.sources.files import Folder
from tidelog.sources.store import Store


def latest_per_key(stream: DataFrame) -> DataFrame:
    """(user_key, ts, value) of the newest version of each key, deletions too; complete or update mode."""
    return stream.groupBy("user_key").agg(F.max(F.struct("ts", "value")).alias("v")).select("user_key", "v.ts", "v.value")


def ingest(stream: DataFrame, store: Store, checkpoint: str, maintain: bool = True, name: str | None = None, **trigger) -> StreamingQuery:
    """Each micro-batch of (seq, op, user_key, value) is one commit, made once.

    The batch's number stands in the manifest record that makes it count, under
    the stream's name (its checkpoint folder, if none is given), so a batch that
    was committed before a crash is known after it. Without ``maintain`` flush and
    compaction are left to ``Store.start_maintenance``.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store.write_batch(batch, name or checkpoint, number)
        if maintain:
            while store.trigger_flush():
                pass
            store.compact()

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def newest_versions(stream: DataFrame, folder: str) -> DataFrame:
    """(user_key, ts, value) of the newest version of each key once the stream's rows are read.

    Each micro-batch's changed keys are a folder of their own, written anew if
    the batch is run again; the last change of a key is the result. No state
    comes to the driver.
    """

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/changes/{number:012d}")

    query = latest_per_key(stream).writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    spark, schema = stream.sparkSession, "user_key string, ts bigint, value string"
    batches = Folder(spark, folder).names("changes")
    return newest(spark.read.schema(schema).parquet(*(f"{folder}/changes/{b}" for b in batches)) if batches else spark.createDataFrame([], schema))
