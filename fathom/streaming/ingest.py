"""Ingest of append-only libraries as a stream: an extension beside the batch update, with the same rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from fathom.functions.media import path_key
from fathom.operators.index import new_files
from fathom.sources.store import Store


def listing_stream(spark: SparkSession, folder: str, schema: str = "path string, size long, mtime double") -> DataFrame:
    """Listings that arrive as Parquet files."""
    return spark.readStream.schema(schema).parquet(folder)


def ingest(stream: DataFrame, store: Store, checkpoint: str, encode: Callable[[DataFrame], DataFrame]) -> StreamingQuery:
    """Every batch adds the files that the index does not have yet, as a part of its own: what was there is neither read whole
    nor written again, but for its paths. A batch that is run again replaces its part."""

    def one(batch: DataFrame, number: int) -> None:
        part = f"batch-{number:012d}"
        fresh = batch.dropDuplicates(["path"])
        fresh = fresh.withColumn("_k", path_key(F.col("path"))).dropDuplicates(["_k"]).drop("_k")
        try:
            fresh = new_files(fresh, store.read(without=part).select("path"))
        except FileNotFoundError:
            pass  # the first batch
        store.append(encode(fresh), part)

    return stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def arrivals(stream: DataFrame, delay: str = "10 minutes", every: str = "5 minutes") -> DataFrame:
    """Files that arrived in each window; what comes later than the delay is left out. stream: path, ts."""
    return stream.withWatermark("ts", delay).groupBy(F.window("ts", every)).agg(F.count("*").alias("n"))
