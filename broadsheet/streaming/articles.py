"""Streaming extension: batches of articles or events arriving as files."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from broadsheet.functions.text import exact_key
from broadsheet.runtime import shared_dir


def _run(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over everything available into a written table of the shared folder and read it back."""
    spark = df.sparkSession
    root = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    if mode == "append":
        q = df.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    else:
        def save(batch: DataFrame, _: int) -> None:
            batch.write.mode("overwrite").parquet(f"{root}/out")

        q = df.writeStream.outputMode(mode).foreachBatch(save).option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{root}/out")


def collected(stream: DataFrame) -> DataFrame:
    """All rows an append stream gives for what is available, as a written table."""
    return _run(stream, "append")


def file_stream(spark: SparkSession, pattern: str, like: DataFrame) -> DataFrame:
    return spark.readStream.schema(like.schema).parquet(pattern)


def deduplicated_stream(articles: DataFrame, text: str = "text", time: str = "arrived_at", delay: str = "30 days") -> DataFrame:
    """Articles without repeated token sequences within the watermark."""
    d = articles.withColumn("_key", exact_key(F.col(text))).withColumn("_at", F.col(time).cast("timestamp"))
    return d.withWatermark("_at", delay).dropDuplicatesWithinWatermark(["_key"]).drop("_at")


def running_share(stream: DataFrame, by: str, success: str) -> DataFrame:
    """Complete-mode aggregate (by, n, k, share) over all that has arrived."""
    g = stream.where(F.col(success).isNotNull()).groupBy(by).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(success).cast("double")).alias("k"))
    return _run(g, "complete").withColumn("share", F.try_divide("k", "n"))


def windowed_counts(stream: DataFrame, time: str, key: str, value: str, width: str = "1 day", delay: str = "1 day") -> DataFrame:
    """(window_start, key, n, total) of event-time windows with a watermark."""
    d = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", delay)
    g = d.groupBy(F.window("_at", width).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))
    return _run(g.select(F.col("w.start").alias("window_start"), key, "n", "total"), "complete")
