"""Structured Streaming forms of batch operators (extensions): request limits by tumbling window, incremental embedding."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def rate_windows(requests: DataFrame, key: str, at: str, limit: int, width: str = "1 minute", late: str = "5 minutes") -> DataFrame:
    """(window, key, n, refused): requests of each key and window, and how many are beyond the limit; late ones count within `late`."""
    timed = requests.withColumn("_at", F.col(at).cast("timestamp")).withWatermark("_at", late)
    counts = timed.groupBy(F.window("_at", width).alias("window"), F.col(key)).agg(F.count("*").alias("n"))
    return counts.select("window", key, "n", F.greatest(F.col("n") - limit, F.lit(0)).alias("refused"))


def embed_incrementally(texts: DataFrame, encode: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Encode each micro-batch of new texts and append the vectors; a batch that runs again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        encode(batch).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return texts.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
