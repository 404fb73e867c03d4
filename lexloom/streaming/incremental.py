"""Incremental application of a batch step to files as they arrive."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..sources.writers import append_rows, remaining


def watch_parquet(spark: SparkSession, path: str, schema: T.StructType, files_per_batch: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def apply_incrementally(stream: DataFrame, step: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, key: str) -> StreamingQuery:
    """Runs ``step`` over each micro-batch and appends its rows.  A batch that is
    run again after a failure leaves out keys that its first run has appended,
    so each key is appended once.  Ends when all present files are done."""

    def each(batch: DataFrame, _: int) -> None:
        append_rows(step(remaining(batch, out, key)), out)

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
