"""Incremental monthly means over a stream of observations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def window_means(stream: DataFrame, ts: str, value: str, by: str, width: str = "30 days", late: str = "1 day") -> DataFrame:
    """Counts and sums per window and key of a batch or stream; rows later than `late` are dropped."""
    if stream.isStreaming:  # watermarks need instants
        stream = stream.withColumn(ts, F.col(ts).cast("timestamp"))
    return stream.withWatermark(ts, late).groupBy(F.window(ts, width).alias("w"), by).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), by, "n", "total")
