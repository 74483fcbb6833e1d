"""Running streams: sources with declared schemas, sinks, and bounded runs over what is available.

A watermark only follows events, so the last ones of a stream that ends stay in state for ever. A source that has ended is
closed with a punctuation: one row far in the future, from a control folder that the stream reads as well. It carries the
watermark past every event, windows close and timers fire, and what a stream gives is all that the batch form gives.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from arenalytics.session import shared_folder


CLOSING = "closing"
"""The kind of a punctuation, in sources whose rows have a kind; its other columns are null."""
END = 253_370_764_800_000
"""The date of a punctuation, the first of January 9999."""
TYPED_STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}
"""Settings that streams with typed state (values, lists, maps, timers) are started with."""


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Session settings for what is started inside; a stream keeps those it was started with."""
    before = {k: spark.conf.get(k, None) for k in values}
    for k, v in values.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)


def file_stream(spark: SparkSession, folder: str, schema, name_filter: str = "*.parquet", files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).option("pathGlobFilter", name_filter)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def start_append(stream: DataFrame, path: str, checkpoint: str, available_now: bool = False, every: str = "1 minute") -> StreamingQuery:
    """Append finished rows to a parquet folder, exactly once."""
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def start_batches(
    stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, every: str = "1 minute"
) -> StreamingQuery:
    """Hand each micro-batch to ``write(batch, batch_id)``, which must replace what an earlier run of the same id wrote."""
    writer = stream.writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=every)).start()


def drain(
    stream: DataFrame, purpose: str, write: Callable[[DataFrame, int, str], None] | None = None, timeout: int | None = None, folder: str | None = None
) -> str:
    """Process what the source holds now and return the folder with the result; ``timeout`` in seconds, none by default.

    With the ``folder`` of an earlier call the stream goes on where that call ended.
    """
    folder = folder or shared_folder(stream.sparkSession, purpose)
    out, checkpoint = os.path.join(folder, "out"), os.path.join(folder, "checkpoint")
    with settings(stream.sparkSession, TYPED_STATE):
        if write is None:
            query = start_append(stream, out, checkpoint, available_now=True)
        else:
            query = start_batches(stream, lambda batch, batch_id: write(batch, batch_id, out), checkpoint, available_now=True)
    if query.awaitTermination(timeout) is False:
        query.stop()
        raise TimeoutError(f"stream {purpose} did not finish in {timeout} s")
    return out


def drain_closed(source: DataFrame, build: Callable[[DataFrame], DataFrame], purpose: str, date: str = "date", timeout: int | None = None) -> str:
    """Process all of a source that has ended, close it, and return the folder with the whole result.

    ``build`` makes the result of the source's rows. It must let the punctuation reach its watermark: a filter before that has
    to keep the kind ``CLOSING``. A closed stream can't go on, as whatever comes later is late.
    """
    spark = source.sparkSession
    folder = shared_folder(spark, purpose)
    control = os.path.join(folder, "control")
    none = spark.createDataFrame([], source.schema)
    none.write.parquet(control)
    result = build(source.unionByName(file_stream(spark, control, source.schema)))
    drain(result, purpose, timeout=timeout, folder=folder)
    values = {date: F.lit(END), "kind": F.lit(CLOSING)}
    columns = [values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in source.schema]
    spark.range(1).select(*columns).write.mode("append").parquet(control)
    return drain(result, purpose, timeout=timeout, folder=folder)
