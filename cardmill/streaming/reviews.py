"""Scores of a stream of reviews, beyond what the batch queries need.

Late reviews are dropped after the watermark; each closed window is appended once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cardmill.operators.review_logs import bucket, bucket_label, decimal_number


def review_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of review log files as they arrive."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def windowed_scores(reviews: DataFrame, window: str = "7 days", lateness: str = "30 days") -> DataFrame:
    """Per window of reviewed_at and tenth of predicted retention: n, mean predicted,
    mean actual, Brier score, over mature reviews. Works on a stream or a table."""
    timed = reviews.withColumn("at", F.col("reviewed_at").cast("timestamp"))
    timed = timed.withWatermark("at", lateness) if reviews.isStreaming else timed
    mature = timed.select("at", decimal_number(F.col("interval_days")).alias("d"), decimal_number(F.col("predicted_retention")).alias("p"), decimal_number(F.col("actual_recalled")).alias("a")).where("d > 21 and p is not null and a is not null")
    sums = mature.groupBy(F.window("at", window), bucket(F.col("p")).alias("b")).agg(F.count("*").alias("n"), F.avg("p").alias("mean_predicted"), F.avg("a").alias("mean_actual"), F.avg(F.pow(F.col("p") - F.col("a"), 2)).alias("brier"))
    return sums.select(F.col("window.start").alias("window_start"), bucket_label(F.col("b")).alias("predicted_range"), "n", "mean_predicted", "mean_actual", "brier")

