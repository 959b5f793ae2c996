"""A feed of image jobs: files of pixel rows arrive, each micro-batch runs a batch pipeline; of several requests for one image the newest wins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

JOBS = "image_id long, request long, at timestamp, settings string"


def read_jobs(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    return spark.readStream.schema(JOBS).option("maxFilesPerTrigger", max_files).json(path)


def newest(jobs: DataFrame) -> DataFrame:
    """The newest request of each image in a batch."""
    return jobs.groupBy("image_id").agg(F.max_by(F.struct("request", "at", "settings"), "request").alias("j")).select("image_id", "j.*")


def requests_by_window(jobs: DataFrame, lateness: str = "10 minutes", window: str = "5 minutes") -> DataFrame:
    """window start, requests, images: tumbling windows by event time; what is later than the watermark is dropped."""
    counted = jobs.withWatermark("at", lateness).groupBy(F.window("at", window).alias("w")).agg(F.count(F.lit(1)).alias("requests"), F.approx_count_distinct("image_id").alias("images"))
    return counted.select(F.col("w.start").alias("start"), "requests", "images")


def run(jobs: DataFrame, pixels: DataFrame, pipeline: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str) -> StreamingQuery:
    """Runs pipeline over the pixels of each batch's images and writes its rows under sink, a folder a batch, so a repeated batch replaces its own."""

    def batch(df: DataFrame, number: int) -> None:
        wanted = newest(df).select("image_id", "request")
        done = pipeline(pixels.join(wanted.select("image_id"), "image_id", "left_semi"))
        done.join(wanted, "image_id").write.mode("overwrite").parquet(f"{sink}/batch={number}")

    return jobs.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
