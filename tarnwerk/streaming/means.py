"""Daily means and degree days of a stream: event time, watermark, append mode."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def daily_means(stream: DataFrame, keys: Sequence[str], ts: str, measures: Mapping[str, str], lateness: str = "1 day") -> DataFrame:
    """Means by keys and UTC day; rows later than ``lateness`` behind the newest are dropped. Works on static
    tables too."""
    at = F.col(ts).cast("timestamp")
    marked = stream.withColumn("__ts", at).withWatermark("__ts", lateness) if stream.isStreaming else stream.withColumn("__ts", at)
    out = marked.groupBy(*keys, F.window("__ts", "1 day")).agg(F.count("*").alias("n"), *(F.avg(F.col(c).cast("double")).alias(n) for n, c in measures.items()))
    return out.select(*keys, F.to_date("window.start").alias("day"), "n", *measures)


def degree_contributions(daily: DataFrame, value: str, heat_limit: float = 15.0, heat_base: float = 18.0, cool_limit: float = 24.0, cool_base: float = 21.0) -> DataFrame:
    """What each day adds to the year's degree days."""
    v = F.col(value)
    return daily.withColumn("hdd", F.when(v <= heat_limit, heat_base - v).otherwise(0.0)).withColumn("cdd", F.when(v >= cool_limit, v - cool_base).otherwise(0.0))


def write(stream: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Parquet in append mode; with ``once`` all that is there, then stop."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
