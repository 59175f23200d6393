"""Manifests as a stream: every new CSV file in a folder is a batch of runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.manifests import run


def watch(spark: SparkSession, folder: str, schema: str, make: Callable[[Mapping[str, object]], str], results: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Runs make for each row of each new file; results get a folder for each batch, written anew if a batch is repeated after a failure. once: stop when all files are done."""

    def each(rows: DataFrame, number: int) -> None:
        run(rows, make).write.mode("overwrite").json(f"{results}/batch={number}")

    stream = spark.readStream.option("header", True).schema(schema).csv(folder).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (stream.trigger(availableNow=True) if once else stream).start()
